"""Candidate retrieval: filter, score, exact or sharded top-k."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.demand import Amounts, feasible, rank_key, score

POOL = 65_536
SHARD_ROWS = 131_072
LOCAL = 16_384
#: Bins for each unit of a score's logarithm, by which floors are found; scores count from 1e-10, the last place of a rank key.
BINS, UNIT = 1024, 1e-10


def scored(tasks: DataFrame, method: str, remaining: Amounts, capacity: Amounts) -> DataFrame:
    """Feasible tasks with their score: a filter that reaches the scan and one generated expression."""
    return tasks.where(feasible(remaining)).withColumn("score", rank_key(score(method, remaining, capacity)))


def scored_by_place(tasks: DataFrame, remaining: Amounts, rank: str = "agent_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Feasible tasks with the score of the first-come policies: the place in their shard of consecutive ranks, first best."""
    return tasks.where(feasible(remaining)).withColumn("score", (-F.pmod(F.col(rank), F.lit(shard_rows))).cast("double"))


def top_k(scores: DataFrame, k: int = POOL) -> DataFrame:
    """The k best by score, then least id. Exact: each task keeps its best k and those are merged."""
    return scores.orderBy(F.desc("score"), F.asc("agent_id")).limit(max(k, 0))


def floors(tasks: DataFrame, methods: Sequence[str], remaining: Amounts, capacity: Amounts, k: int = POOL) -> dict[str, float]:
    """For each method a score, before it is rounded, that k feasible tasks or more reach; few others do. Methods with fewer tasks have none.

    One aggregate for each method counts scores by bins of about a thousandth; the floor is the least score of the bin in which the k best end.
    """
    value = F.col("value")
    at = F.floor(F.signum(value) * F.log1p(F.abs(value) / F.lit(UNIT)) * F.lit(BINS))
    fits = tasks.where(feasible(remaining))
    counted = [fits.select(F.lit(m).alias("method"), score(m, remaining, capacity).alias("value")).where(~F.isnan(value)).groupBy("method", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least")) for m in methods]
    bins = reduce(DataFrame.unionByName, counted).withColumn("above", F.sum("n").over(Window.partitionBy("method").orderBy(F.desc("bin"))))
    return {r["method"]: r["floor"] for r in bins.where(F.col("above") >= k).groupBy("method").agg(F.max("least").alias("floor")).collect()}


def pools(tasks: DataFrame, methods: Sequence[str], remaining: Amounts, capacity: Amounts, k: int = POOL) -> dict[str, DataFrame]:
    """What top_k of scored gives for each method, but only tasks that reach the method's floor have their score rounded and are sorted.

    Rounding keeps the order of scores and moves none by more than half a unit, so none of the k best is more than a unit below the floor.
    """
    found, low = {}, floors(tasks, methods, remaining, capacity, k)
    for m in methods:
        rows = scored(tasks, m, remaining, capacity)
        found[m] = top_k(rows.where(score(m, remaining, capacity) >= F.lit(low[m] - 2 * UNIT - 1e-12 * abs(low[m]))) if m in low else rows, k)
    return found


def sharded_top_k(scores: DataFrame, k: int = POOL, local: int = LOCAL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k best of the local best of each shard of consecutive ids: loses rows where a shard has more than local of them."""
    best = Window.partitionBy("shard").orderBy(F.desc("score"), F.asc("agent_id"))
    kept = scores.withColumn("shard", F.floor(F.col("agent_id") / shard_rows)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= local)
    return top_k(kept.drop("place"), k)


def active(tasks: DataFrame, dispatched: DataFrame, bounded: bool = False) -> DataFrame:
    """Tasks that no batch has taken; a batch of a bounded window or pool is sent to all tasks, and the table is not shuffled for it."""
    ids = dispatched.select("agent_id")
    return tasks.join(F.broadcast(ids) if bounded else ids, "agent_id", "left_anti")


def gather(tasks: DataFrame, pool: DataFrame) -> DataFrame:
    """The rows of a pool's tasks."""
    return tasks.join(pool.select("agent_id"), "agent_id", "left_semi")
