"""Checks of task tables and of dispatches, each as one aggregate or filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.demand import Amounts, by_demand, conjunction, demand_columns, oversize


#: Tasks of a distinctness sample.
SAMPLE = 100_000


def violations(tasks: DataFrame, demands: Sequence[str] | None = None) -> DataFrame:
    """One row: tasks in all, with a null, a non-finite and a non-positive demand or duration."""
    values = [F.col(c).cast("double") for c in (*demand_columns(tasks, demands), "duration")]
    bad = lambda conds, name: F.coalesce(F.sum(F.when(~conjunction(conds), 1)), F.lit(0)).alias(name)
    known = [F.coalesce(v, F.lit(1.0)) for v in values]
    return tasks.agg(
        F.count(F.lit(1)).alias("n_rows"),
        bad([v.isNotNull() for v in values], "n_null"),
        bad([~F.isnan(v) & (F.abs(v) < float("inf")) for v in known], "n_not_finite"),
        bad([v > 0 for v in known], "n_not_positive"),
    )


def oversize_rows(tasks: DataFrame, capacity: Amounts, limit: int = 10) -> DataFrame:
    """The first tasks, by id, that no wave can hold."""
    return tasks.where(oversize(capacity)).orderBy("agent_id").limit(limit)


def id_check(tasks: DataFrame) -> DataFrame:
    """One row: whether the ids are unique, and whether they are the numbers 0 to n-1."""
    counts = tasks.groupBy("agent_id").count().agg(F.sum("count").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"), F.min("agent_id").alias("least"), F.max("agent_id").alias("greatest"))
    unique = F.col("n_rows") == F.col("n_ids")
    return counts.select("n_rows", "n_ids", unique.alias("is_unique"), (unique & (F.col("least") == 0) & (F.col("greatest") == F.col("n_rows") - 1)).alias("is_permutation"))


def distinctness(tasks: DataFrame, rows: int, sample: int = SAMPLE, demands: Sequence[str] | None = None, rank: str = "agent_id") -> DataFrame:
    """Share of distinct demand vectors among sample tasks at even distances in a dense rank, from the first to the last; all tasks where there are no more.

    Task k of the sample has rank k * (rows - 1) div (sample - 1).
    """
    n, last = min(sample, rows) - 1, max(rows - 1, 1)
    near = F.expr(f"({rank} * {n} + {last - 1}) div {last}")
    taken = tasks.where(F.expr(f"{rank} = 0") if n < 1 else (near * F.lit(rows - 1) - F.col(rank) * F.lit(n)).between(0, n - 1))
    counts = taken.groupBy(*demand_columns(tasks, demands)).count().agg(F.sum("count").alias("n_sampled"), F.count(F.lit(1)).alias("n_distinct"))
    return counts.select("n_sampled", "n_distinct", F.round(F.col("n_distinct") / F.col("n_sampled"), 6).alias("unique_fraction"))


def dispatch_check(batch: DataFrame, remaining: Amounts, tolerance: float = 1e-8) -> DataFrame:
    """For each resource what a batch uses, what was there, and whether it holds."""
    used = batch.agg(*(F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in by_demand(remaining)))
    rows = F.explode(F.array(*(F.struct(F.lit(d).alias("resource"), F.col(d).cast("bigint").alias("used"), F.lit(int(r)).cast("bigint").alias("available")) for d, r in by_demand(remaining).items()))).alias("x")
    return used.select(rows).select("x.*").withColumn("holds", F.col("used") <= F.col("available") + F.lit(tolerance))


def duplicate_check(batch: DataFrame) -> DataFrame:
    """Ids that a batch or trace has more than once."""
    return batch.groupBy("agent_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def trace_check(trace: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: tasks without a start, with a finish before it, and without a wave."""
    joined = tasks.select("agent_id").join(trace, "agent_id", "left")
    n = lambda cond, name: F.coalesce(F.sum(F.when(cond, 1)), F.lit(0)).alias(name)
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), n(F.col("start").isNull() | F.col("finish").isNull(), "n_open"), n(F.col("finish") < F.col("start"), "n_reversed"), n(F.col("wave").isNull() | (F.col("wave") < 0), "n_without_wave"))


def duration_check(tasks: DataFrame) -> DataFrame:
    """One row: the least and greatest duration and whether all are equal, as schedules in waves demand. An empty table is equal."""
    return tasks.agg(F.min("duration").alias("least"), F.max("duration").alias("greatest"), F.coalesce(F.max("duration") - F.min("duration") <= F.lit(1e-9), F.lit(True)).alias("are_equal"))
