"""Ranks and running sums over a whole table without a single-task window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: Rows that one task of a sort or join of a whole table has, about; more rows make more tasks, so that none has to spill.
TASK_ROWS = 500_000
#: Rows of one chunk of a running sum at least; with n rows there are at most sqrt(n) chunks of more.
CHUNK_ROWS = 65_536


def task_count(rows: int) -> int:
    """Tasks among which a shuffle of so many rows is dealt."""
    return max(1, -(-rows // TASK_ROWS))


def ranked(df: DataFrame, order: Sequence[str], rank: str, columns: Sequence[str | Column] = ("*",)) -> DataFrame:
    """df, or columns of it, with the dense 0-based place of each row in a total order.

    Rows are dealt and sorted by range, numbered within their partition, and written once, with the columns that are asked for
    alone; the partitions' row counts (one row each) then give the offsets. No task sees more than its range, and there are as
    many ranges as the rows need.
    """
    spread = df.repartitionByRange(task_count(df.count()), *order).sortWithinPartitions(*order).select(*columns, F.monotonically_increasing_id().alias("_at"))
    spread = written(spread, "ranked")
    part = F.shiftright("_at", 33)
    counts = spread.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return spread.join(offsets, part == F.col("_part")).withColumn(rank, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before", "_n")


def chunk_rows(rows: int) -> int:
    """Ranks of one chunk of a running sum over so many rows."""
    return max(CHUNK_ROWS, math.isqrt(max(rows, 1)) + 1)


def running_sums(df: DataFrame, rank: str, values: Sequence[str], rows: int, prefix: str = "s_") -> DataFrame:
    """df with, for each value, its sum over all rows up to this one in the order of a dense rank.

    Sums run within chunks of the rank; the chunks' totals, at most sqrt(rows) of them, are summed up once
    and sent to all tasks. A sum is null until the first value that is not.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(rank) / F.lit(chunk_rows(rows))))
    totals = chunked.groupBy("_chunk").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(totals.select("_chunk", *(F.sum(f"_t_{v}").over(before).alias(f"_b_{v}") for v in values)))
    within = Window.partitionBy("_chunk").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    summed = chunked.select("*", *(F.sum(v).over(within).alias(f"_w_{v}") for v in values)).join(offsets, "_chunk")
    return summed.select(*df.columns, *(F.coalesce(F.col(f"_w_{v}") + F.col(f"_b_{v}"), f"_w_{v}", f"_b_{v}").alias(f"{prefix}{v}") for v in values))


def sums_begin(df: DataFrame, rank: str, values: Sequence[str], rows: int, prefix: str = "s_") -> DataFrame:
    """(end, and for each value what no running sum in it is below) for each chunk of running_sums: one aggregate, at most sqrt(rows) rows.

    That is the sum before the chunk and the chunk's negative values.
    """
    chunk = F.floor(F.col(rank) / F.lit(chunk_rows(rows))).alias("_chunk")
    totals = df.groupBy(chunk).agg(*(f(x).alias(f"{n}_{v}") for v in values for n, f, x in (("_t", F.sum, F.col(v)), ("_n", F.sum, F.least(F.col(v), F.lit(0))))))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    least = [(F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)) + F.col(f"_n_{v}")).alias(f"{prefix}{v}") for v in values]
    return totals.select(((F.col("_chunk") + 1) * chunk_rows(rows)).alias("end"), *least)


def arrival_ranks(order: DataFrame, place: str, row: str, rank: str = "arrival") -> DataFrame:
    """(row, rank): the inverse of an order of arrival, which lists the rows by any numbers as places.

    Places need not be dense. The order is checked to name each row once; a row it names twice or not at all is an error,
    as is a null one.
    """
    told = order.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(row).alias("rows"), F.countDistinct(place).alias("places")).first()
    if not told["n"] == told["rows"] == told["places"]:
        raise ValueError(f"{told['n']} entries name {told['rows']} rows at {told['places']} places")
    return ranked(order.select(place, row), [place], rank).select(row, rank)


def with_arrival(tasks: DataFrame, order: DataFrame, place: str, row: str = "agent_id", rank: str = "arrival") -> DataFrame:
    """tasks with the rank of their arrival; an order that leaves tasks out or names others is an error."""
    ranks, parts = written(arrival_ranks(order, place, row, rank), "arrival"), task_count(tasks.count())
    joined = written(tasks.repartition(parts, row).join(ranks.repartition(parts, row), row, "full_outer").withColumn("_known", F.coalesce(*(F.col(c).cast("string") for c in tasks.columns if c != row)).isNotNull()), "arrived")
    lost = joined.agg(F.count(F.when(F.col(rank).isNull(), 1)).alias("unranked"), F.count(F.when(~F.col("_known"), 1)).alias("unknown")).first()
    if lost["unranked"] or lost["unknown"]:
        raise ValueError(f"the order of arrival leaves out {lost['unranked']} tasks and names {lost['unknown']} others")
    return joined.select(*tasks.columns, rank)


def reranked(active: DataFrame, rank: str = "arrival") -> DataFrame:
    """Tasks that are left, with dense ranks in the same order."""
    return ranked(active.withColumnRenamed(rank, "_was"), ["_was"], rank).drop("_was")


def neighbours(df: DataFrame, rank: str, columns: Sequence[str]) -> DataFrame:
    """Each row beside the one before it in a dense rank, as the columns before_*: a shuffled self-join, not a window."""
    earlier = df.select((F.col(rank) + 1).alias(rank), *(F.col(c).alias(f"before_{c}") for c in columns))
    return df.select(rank, *columns).join(earlier, rank)
