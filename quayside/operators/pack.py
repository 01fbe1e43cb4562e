"""Capacity-safe packing along an order."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.demand import TOLERANCE, Amounts, by_demand, conjunction, demands_of, feasible, like_given, residual_key
from ..sources.shared import written
from .order import ranked, running_sums, sums_begin

#: Candidates that one packing looks at.
WINDOW = 65_536


def first_fit(demands: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Positions that first fit takes along the rows' order; what fits but for TOLERANCE fits.

    Whole prefixes at a time: the longest prefix whose running sums fit is taken and what no longer fits
    alone is dropped, until nothing is left. Demands are positive, so a dropped row could not fit later.
    """
    left, alive, taken = capacity.astype(np.float64).copy(), np.arange(len(demands)), []
    while len(alive := alive[(demands[alive] <= left + TOLERANCE).all(axis=1)]):
        sums = np.cumsum(demands[alive], axis=0)
        n = int(np.searchsorted(~(sums <= left + TOLERANCE).all(axis=1), True)) or 1
        taken.append(alive[:n])
        left -= sums[n - 1]
        alive = alive[n:]
    return np.concatenate(taken) if taken else alive


def _sums_fit(left: Amounts) -> Column:
    return conjunction([F.col(f"s_{d}") <= F.lit(c if isinstance(c, int) else c + TOLERANCE) for d, c in by_demand(left).items()])


def _in_reach(tasks: DataFrame, remaining: Amounts, rank: str) -> tuple[int, int]:
    """How many ranks there are, and the one from which on no running sum of demands fits: where the last chunk that begins with sums that fit ends."""
    rows = (tasks.agg(F.max(rank)).first()[0] or 0) + 1
    return rows, sums_begin(tasks, rank, demands_of(remaining), rows).where(_sums_fit(remaining)).agg(F.max("end")).first()[0] or 0


def strict_prefix(tasks: DataFrame, remaining: Amounts, rank: str, window: int | None = None) -> DataFrame:
    """Tasks in order until the first that does not fit: sums grow, so those whose sums fit are a prefix.

    rank is any order of arrival. All tasks count, however many fit; only chunks of ranks that begin with sums that fit are sorted. A query
    may set a window of so many ranks from the first of tasks on, whether all are there or not.
    """
    rows, end = _in_reach(tasks, remaining, rank) if window is None else (window, (tasks.agg(F.min(rank)).first()[0] or 0) + window)
    first = tasks.where(F.col(rank) < end)
    return running_sums(first, rank, demands_of(remaining), rows).where(_sums_fit(remaining)).select(*tasks.columns)


def strict_rest(tasks: DataFrame, remaining: Amounts, rank: str) -> DataFrame:
    """What strict_prefix without a window leaves. Neither is sent to all tasks nor joined: only chunks of ranks in reach hold both, and what they leave is written."""
    rows, end = _in_reach(tasks, remaining, rank)
    summed = running_sums(tasks.where(F.col(rank) < end), rank, demands_of(remaining), rows)
    skipped = summed.where(~F.coalesce(_sums_fit(remaining), F.lit(False))).select(*tasks.columns)
    return written(skipped, "skipped").unionByName(tasks.where(F.col(rank) >= end))


def pack_in_order(pool: DataFrame, remaining: Amounts, order: Sequence, window: int = WINDOW) -> DataFrame:
    """First fit over the first window rows of a pool in an order, all columns kept; seq is the place in the batch.

    The pool is bounded by window, which is part of the query, and Spark keeps the best window rows of each
    task before one task packs them.
    """
    demands, capacity = demands_of(remaining), np.array(list(by_demand(remaining).values()), dtype=np.float64)
    columns = [c for c in pool.columns if c in ("agent_id", "score", "fit", *demands, "duration", "arrival")]

    def pack(frames):
        parts = list(frames)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        took = rows.iloc[first_fit(rows[demands].to_numpy(dtype=np.float64), capacity)].reset_index(drop=True)
        yield took.assign(seq=np.arange(len(took), dtype=np.int64))

    chosen = pool.select(*columns).orderBy(*order).limit(window)
    schema = ", ".join(f"{c} {pool.schema[c].dataType.simpleString()}" for c in columns) + ", seq bigint"
    return chosen.coalesce(1).mapInPandas(pack, schema)


def scan_in_order(pool: DataFrame, remaining: Amounts, rank: str, skips: int) -> DataFrame:
    """First fit along a rank until it has skipped so many rows: the rows it saw, with took. One task packs the pool, which the caller bounds."""
    demands, capacity = demands_of(remaining), np.array(list(by_demand(remaining).values()), dtype=np.float64)

    def scan(frames):
        parts = list(frames)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        took = np.zeros(len(rows), dtype=bool)
        took[first_fit(rows[demands].to_numpy(dtype=np.float64), capacity)] = True
        seen = int(np.searchsorted(np.cumsum(~took), skips)) + 1
        yield rows.assign(took=took).iloc[:seen]

    schema = ", ".join(f"{c} {t}" for c, t in pool.dtypes) + ", took boolean"
    return pool.repartition(1).sortWithinPartitions(rank).mapInPandas(scan, schema)


def rank_keys(values: np.ndarray) -> np.ndarray:
    """What rank_key gives for positive values, in units of its last place; those near a half are rounded as decimals, as Spark does."""
    values = values * 1e6
    scaled = values * 1e4
    keys = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6 + 4e-15 * scaled):
        keys[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal("0.0001"), ROUND_HALF_UP).scaleb(4))
    return keys


def best_outside(level: float, remaining: Sequence[float], capacity: Sequence[float], greatest: Sequence[float]) -> float:
    """No mp score for what remains is above this among tasks whose score for the whole capacity is level at most, as rank keys.

    The shares of such a task sum up to the level at most and none is above that of the greatest demand, so the
    most that their weighted sum comes to puts all in the resources of which most remains.
    """
    left, found = (level + 1e-4) / 1e6, 0.0
    for weight, share in sorted(((r / c, g / c) for r, c, g in zip(remaining, capacity, greatest, strict=True)), reverse=True):
        found, left = found + weight * min(left, share), left - min(left, share)
    return found * 1e6 * (1 + 1e-12) + 1e-4


def pool_batches(front: DataFrame, remaining: Amounts, capacity: Amounts, pool: int, wave: int, least: Sequence[float], greatest: Sequence[float], level: float | None) -> DataFrame:
    """Best fit over the pool best tasks by mp, batch after batch and wave after wave, as long as each pool surely lies in the front.

    Outside the front are tasks whose score for the whole capacity is level at most (None: there are none), and no demand anywhere is below
    least or above greatest. One task packs the front, which the caller bounds. The rows are what the batches took, with wave, and one without
    an id: the wave that goes on, the score of the last in the front's next pool (floor, null where the front has less than a pool) and how many rows are left (n_left).
    """
    demands = demands_of(remaining)
    whole, start = (np.array([by_demand(a)[d] for d in demands], dtype=np.float64) for a in (capacity, remaining))
    least, columns = np.array(least, dtype=np.float64), ["agent_id", *demands]

    def pack(frames):
        parts = list(frames)
        rows = (pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)).sort_values("agent_id", ignore_index=True)
        d = [rows[c].to_numpy(dtype=np.float64) for c in demands]
        at, left, now, floor = np.arange(len(rows)), start.copy(), wave, None
        while len(at):
            fits = np.logical_and.reduce([x <= c + TOLERANCE for x, c in zip(d, left, strict=True)])
            n = int(fits.sum())
            if (left + TOLERANCE < least).any() or (level is None and not n):
                if (left == whole).all():
                    break
                left, now = whole.copy(), now + 1
                continue
            if n < pool and level is not None:
                break
            if n > pool or level is not None:
                keys = np.full(len(at), -1.0)
                match = sum(x[fits] / w * (r / w) for x, w, r in zip(d, whole, left, strict=True))
                keys[fits] = rank_keys(match)
                last = np.partition(keys, len(keys) - pool)[len(keys) - pool]
                if level is not None and last / 1e4 <= best_outside(level, left, whole, greatest):
                    floor = last / 1e4
                    break
                chosen = np.flatnonzero(keys > last)
                chosen = np.sort(np.concatenate([chosen, np.flatnonzero(keys == last)[: pool - len(chosen)]]))
            else:
                chosen = np.flatnonzero(fits)
            some = np.stack([x[chosen] for x in d], axis=1)
            if not (some.sum(axis=0) <= left + TOLERANCE).all():
                fit = rank_keys(sum(some[:, k] / max(r, TOLERANCE) for k, r in enumerate(left)))
                order = np.argsort(-fit, kind="stable")
                order = order[first_fit(some[order], left)]
                chosen, some = chosen[order], some[order]
            left = left - some.sum(axis=0)
            yield rows.iloc[at[chosen]][columns].assign(wave=now, floor=np.nan, n_left=-1)
            stay = np.ones(len(at), dtype=bool)
            stay[chosen] = False
            at, d = at[stay], [x[stay] for x in d]
        end = pd.DataFrame({c: pd.Series([None], dtype=object) for c in columns})
        yield end.assign(wave=now, floor=np.nan if floor is None else floor, n_left=len(at))

    schema = ", ".join(f"{c} {front.schema[c].dataType.simpleString()}" for c in columns) + ", wave bigint, floor double, n_left bigint"
    return front.select(*columns).repartition(1).mapInPandas(pack, schema)


def first_fit_window(tasks: DataFrame, remaining: Amounts, rank: str = "agent_id", window: int = WINDOW) -> DataFrame:
    """The first window active tasks by arrival, skipping those that do not fit."""
    return pack_in_order(tasks, remaining, [F.asc(rank)], window)


def best_fit(pool: DataFrame, remaining: Amounts, window: int = WINDOW) -> DataFrame:
    """Tasks with the largest demands over what remains first, then first fit."""
    keyed = pool.withColumn("fit", residual_key(remaining))
    return pack_in_order(keyed, remaining, [F.desc("fit"), F.asc("agent_id")], window)


def distributed_first_fit(tasks: DataFrame, remaining: Amounts, order: Sequence[str], rounds: int = 64) -> DataFrame:
    """First fit over a table of any size: each round takes the longest fitting prefix by running sums.

    The driver holds only the capacity vector. Tasks are ranked once. What no longer fits alone leaves the table, so it shrinks
    from round to round; rounds bounds them, and an unfinished packing raises instead of dropping rows.
    """
    demands, left, taken = demands_of(remaining), remaining, None
    alive = ranked(tasks.where(feasible(left)), order, "_place")
    for _ in range(rounds):
        alive = alive.where(feasible(left))
        rows = alive.agg(F.max("_place")).first()[0]
        if rows is None:
            return taken.select(*tasks.columns) if taken is not None else tasks.limit(0)
        got = running_sums(alive, "_place", demands, rows + 1).where(_sums_fit(left)).agg(F.max("_place").alias("last"), *(F.max(f"s_{d}").alias(d) for d in demands)).first()
        part = alive.where(F.col("_place") <= got["last"])
        taken = part if taken is None else taken.unionByName(part)
        left = like_given([c - got[d] for d, c in by_demand(left).items()], left)
        alive = alive.where(F.col("_place") > got["last"])
    raise RuntimeError(f"not packed after {rounds} rounds")
