"""Methods by name: what a dispatch of each takes from the active tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.demand import METHODS, Amounts
from ..operators.metrics import GATE_SAMPLE, gate
from ..operators.pack import WINDOW, best_fit, first_fit_window, strict_prefix
from ..operators.retrieve import POOL, scored, top_k

Dispatch = Callable[[DataFrame, Amounts, Amounts], DataFrame]


def method(name: str, rank: str = "agent_id", window: int = WINDOW, pool: int = POOL) -> Dispatch:
    """The dispatch (tasks, remaining, capacity) -> batch of a method by its name; an unknown name is an error.

    fifo_strict and fifo_windowed follow the rank of arrival, the sparse methods their pools, and adaptive whichever of
    mp and fifo_windowed the gate over the tasks at hand picks; rank must be dense for it.
    """

    def sparse(tasks: DataFrame, remaining: Amounts, capacity: Amounts, by: str = name) -> DataFrame:
        return best_fit(top_k(scored(tasks, by, remaining, capacity), pool), remaining, pool)

    def windowed(tasks: DataFrame, remaining: Amounts, capacity: Amounts) -> DataFrame:
        return first_fit_window(tasks, remaining, rank, window)

    def adaptive(tasks: DataFrame, remaining: Amounts, capacity: Amounts) -> DataFrame:
        chosen = gate(tasks, capacity, tasks.count(), GATE_SAMPLE, rank=rank).first()["policy"]
        return sparse(tasks, remaining, capacity, "mp") if chosen == "mp" else windowed(tasks, remaining, capacity)

    known = {"fifo_strict": lambda tasks, remaining, capacity: strict_prefix(tasks, remaining, rank, window), "fifo_windowed": windowed, "adaptive": adaptive} | dict.fromkeys(METHODS, sparse)
    if name not in known:
        raise ValueError(f"unknown method {name}; known are {', '.join(sorted(known))}")
    return known[name]
