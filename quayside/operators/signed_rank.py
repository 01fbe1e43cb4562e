"""The exact signed-rank test of paired runs, with the null distribution built up rank by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pairs of a group up to which its probabilities are computed; beyond, only its deviate is.
EXACT_PAIRS = 200


def _distribution(ranks: Column) -> Column:
    """Chances of each sum of a random half of the ranks, as an array from 0 up: each rank joins the sum or not."""
    total = F.aggregate(ranks, F.lit(0).cast("bigint"), lambda s, r: s + r)
    start = F.transform(F.sequence(F.lit(0).cast("bigint"), total), lambda i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    joined = lambda chances, r: F.transform(chances, lambda x, i: (x + F.when(i >= r, F.get(chances, (i - r).cast("int"))).otherwise(F.lit(0.0))) / F.lit(2.0))
    return F.aggregate(ranks, start, joined)


def signed_rank(results: DataFrame, method: str, baseline: str, pair: Sequence[str], metric: str, keys: Sequence[str], exact_pairs: int = EXACT_PAIRS) -> DataFrame:
    """(keys, pairs, ties, rank_sum, deviate, p_less, p_two_sided): whether a method's metric is less than a baseline's.

    pairs counts differences other than zero and ties those of zero, which are left out; equal sizes share their mean rank. rank_sum
    adds the ranks where the method has more. p_less is the chance of such a sum or a smaller one if signs were random, exact for
    groups of up to exact_pairs pairs and null beyond; deviate is the sum's distance from its mean in standard deviations.
    Runs without a partner or with a null metric count nowhere. Differences of equal size are one row before anything is ranked.
    """
    one = results.where(F.col("method") == method).select(*keys, *pair, F.col(metric).alias("_own"))
    base = results.where(F.col("method") == baseline).select(*keys, *pair, F.col(metric).alias("_base"))
    apart = one.join(base, [*keys, *pair]).select(*keys, (F.col("_own") - F.col("_base")).alias("_d")).where(F.col("_d").isNotNull())
    sizes = apart.groupBy(*keys, F.abs("_d").alias("_size")).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("_d") > 0, 1)).alias("_more"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.when(F.col("_size") > 0, F.col("_n")).otherwise(0)
    # ranks are doubled, so that mean ranks are whole
    placed = sizes.withColumn("_all", F.sum(moved).over(group)).withColumn("_rank", 2 * F.coalesce(F.sum(moved).over(before), F.lit(0)) + F.col("_n") + 1)
    own = F.col("_size") > 0
    each = F.when(own & (F.col("_all") <= exact_pairs), F.array_repeat("_rank", F.col("_n").cast("int")))
    n = F.col("pairs")
    summed = placed.groupBy(*keys).agg(
        F.max("_all").alias("pairs"), F.sum(F.when(own, 0).otherwise(F.col("_n"))).alias("ties"), F.coalesce(F.sum(F.when(own, F.col("_rank") * F.col("_more"))), F.lit(0)).alias("_sum"),
        F.coalesce(F.sum(F.when(own, F.pow("_n", F.lit(3)) - F.col("_n"))), F.lit(0.0)).alias("_equal"), F.flatten(F.collect_list(each)).alias("_ranks"),
    )
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / F.lit(24.0) - F.col("_equal") / F.lit(48.0))
    chances = summed.withColumn("_chances", F.when(n <= exact_pairs, _distribution(F.col("_ranks"))))
    upto = lambda low, count: F.aggregate(F.slice("_chances", low, count), F.lit(0.0), lambda s, x: s + x)
    less, greater = upto(F.lit(1), F.col("_sum").cast("int") + 1), upto(F.col("_sum").cast("int") + 1, F.size("_chances") - F.col("_sum").cast("int"))
    return chances.select(
        *keys, "pairs", "ties", (F.col("_sum") / F.lit(2.0)).alias("rank_sum"), F.when(spread > 0, (F.col("_sum") / F.lit(2.0) - n * (n + 1) / F.lit(4.0)) / spread).alias("deviate"),
        less.alias("p_less"), F.when(n <= exact_pairs, F.least(F.lit(2.0) * F.least(less, greater), F.lit(1.0))).alias("p_two_sided"),
    )
