"""Dispatches that count what they see while they run: no query is run again for its counters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.demand import Amounts, demands_of, feasible
from ..operators.pack import WINDOW, best_fit, first_fit_window, strict_prefix
from ..operators.retrieve import POOL, scored, top_k
from ..sources.shared import written

COUNTERS = "method string, scanned bigint, feasible bigint, considered bigint, selected bigint, rejected bigint"


def _seen(name: str) -> Observation:
    return Observation(f"{name}-{uuid.uuid4().hex}")


def counted_dispatch(tasks: DataFrame, remaining: Amounts, capacity: Amounts, method: str, pool: int = POOL, window: int = WINDOW, rank: str = "agent_id") -> tuple[DataFrame, tuple]:
    """The batch of a method (fifo_strict, fifo_windowed, or a sparse one with its pool) and its counters.

    scanned are the tasks read, feasible those that fit alone, considered the candidates that packing looked at, selected the
    batch and rejected the rest of them. Each is observed in the job that does the work; a strict batch considers the task
    that ends it too. Counts are those of the tasks that succeeded; a lost executor's work is counted once more where it is redone.
    """
    demands = demands_of(remaining)
    scan, looked, packed = _seen("scan"), _seen("looked"), _seen("packed")
    own = tasks.observe(scan, F.count(F.lit(1)).alias("scanned"), F.count(F.when(feasible(remaining), 1)).alias("feasible"))
    if method.startswith("fifo"):
        candidates = own.orderBy(rank).limit(window)
    else:
        candidates = top_k(scored(own, method, remaining, capacity), pool)
    candidates = written(candidates.observe(looked, F.count(F.lit(1)).alias("n")), "candidates")
    if method == "fifo_strict":
        batch = strict_prefix(candidates, remaining, rank, window)
    elif method == "fifo_windowed":
        batch = first_fit_window(candidates, remaining, rank, window)
    else:
        batch = best_fit(candidates, remaining, pool)
    batch = written(batch.select("agent_id", *demands).observe(packed, F.count(F.lit(1)).alias("n")), "batch")
    selected, considered = packed.get["n"], looked.get["n"]
    if method == "fifo_strict":
        considered = min(considered, selected + 1)
    return batch, (method, scan.get["scanned"], scan.get["feasible"], considered, selected, considered - selected)
