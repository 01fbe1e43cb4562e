"""Usage over time of any table of starts and finishes, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.demand import demand_columns
from ..sources.shared import written
from .order import ranked, running_sums

#: Instants closer than this are one.
TOLERANCE = 1e-10


def instants(trace: DataFrame, tolerance: float = TOLERANCE, demands: Sequence[str] | None = None) -> DataFrame:
    """(instant, at, n and a change for each demand): moments at which tasks start or finish, and what changes then.

    Moments that follow one another within tolerance are one, at the first of them. A task without a start has not run and counts
    nowhere; one without a finish runs on. Starts and finishes are added up by their moment first, then moments are ranked by
    range and each compared with the one before it, so that runs of near moments join across partitions.
    """
    demands = demand_columns(trace, demands)
    moves = trace.where(F.col("start").isNotNull()).select(F.explode(F.array(*(F.struct(F.col(at).cast("double").alias("at"), F.lit(sign).alias("sign")) for at, sign in (("start", 1), ("finish", -1))))).alias("x"), *demands)
    change = moves.where(F.col("x.at").isNotNull()).groupBy("x.at").agg(F.sum("x.sign").alias("n"), *(F.sum(F.col("x.sign") * F.col(d)).alias(d) for d in demands))
    placed = written(ranked(change, ["at"], "place"), "moments")
    earlier = placed.select((F.col("place") + 1).alias("place"), F.col("at").alias("was"))
    marked = placed.join(earlier, "place", "left").withColumn("new", F.when(F.col("at") - F.col("was") <= tolerance, 0).otherwise(1))
    numbered = running_sums(marked, "place", ["new"], placed.count(), "s_").withColumn("instant", F.col("s_new") - 1)
    return numbered.groupBy("instant").agg(F.min("at").alias("at"), F.sum("n").alias("n"), *(F.sum(d).alias(d) for d in demands))


def usage_over_time(trace: DataFrame, tolerance: float = TOLERANCE, demands: Sequence[str] | None = None) -> DataFrame:
    """(at, elapsed, n_running and a level for each demand): what runs from each instant to the next; the last one lasts 0."""
    demands = demand_columns(trace, demands)
    own = written(instants(trace, tolerance, demands), "instants")
    level = running_sums(own, "instant", ["n", *demands], own.count())
    later = own.select((F.col("instant") - 1).alias("instant"), F.col("at").alias("till"))
    elapsed = F.coalesce(F.col("till") - F.col("at"), F.lit(0.0))
    return level.join(later, "instant", "left").select("at", elapsed.alias("elapsed"), F.col("s_n").alias("n_running"), *(F.col(f"s_{d}").alias(d) for d in demands))


def usage_totals(trace: DataFrame, tolerance: float = TOLERANCE, demands: Sequence[str] | None = None) -> DataFrame:
    """(resource, usage): levels times the time they last; for a complete trace the sum of demands times durations, but for the tolerance."""
    demands = demand_columns(trace, demands)
    one = usage_over_time(trace, tolerance, demands).agg(*(F.coalesce(F.sum(F.col(d) * F.col("elapsed")), F.lit(0.0)).alias(d) for d in demands))
    return one.select(F.explode(F.array(*(F.struct(F.lit(d).alias("resource"), F.col(d).cast("double").alias("usage")) for d in demands))).alias("x")).select("x.*")
