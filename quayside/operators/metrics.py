"""Lower bounds, utilisation and the order-correlation gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.demand import Amounts, by_demand, cosine, demand_columns, demands_of, shares, uniform
from .order import neighbours

GATE_SAMPLE = 50_000
GATE_THRESHOLD = 0.1


def column_stats(tasks: DataFrame, demands: Sequence[str] | None = None) -> DataFrame:
    """For each resource the least, mean and greatest demand."""
    demands = demand_columns(tasks, demands)
    one = tasks.agg(*(f(d).alias(f"{f.__name__}_{d}") for d in demands for f in (F.min, F.avg, F.max)))
    rows = F.explode(F.array(*(F.struct(F.lit(d).alias("resource"), F.col(f"min_{d}").alias("least"), F.round(f"avg_{d}", 6).alias("mean"), F.col(f"max_{d}").alias("greatest")) for d in demands))).alias("x")
    return one.select(rows).select("x.*")


def wave_bound(tasks: DataFrame, capacity: Amounts) -> DataFrame:
    """Waves that any schedule of unit tasks needs at least."""
    most = F.greatest(*(F.sum(d) / F.lit(float(c)) for d, c in by_demand(capacity).items()))
    return tasks.agg(F.greatest(F.lit(1), F.ceil(most - F.lit(1e-12))).cast("bigint").alias("waves"))


def event_bound(tasks: DataFrame, capacity: Amounts) -> DataFrame:
    """Time that any schedule needs at least: work over capacity, or the longest task."""
    work = [F.sum(F.col(d) * F.col("duration")) / F.lit(float(c)) for d, c in by_demand(capacity).items()]
    return tasks.agg(F.round(F.greatest(*work, F.max("duration").cast("double")), 6).alias("time"))


def usage_integral(tasks: DataFrame, demands: Sequence[str] | None = None) -> DataFrame:
    """For each resource the demand times duration of all tasks: what any complete schedule uses over time."""
    demands = demand_columns(tasks, demands)
    one = tasks.agg(*(F.sum(F.col(d) * F.col("duration")).alias(d) for d in demands))
    return one.select(F.explode(F.array(*(F.struct(F.lit(d).alias("resource"), F.col(d).alias("usage")) for d in demands))).alias("x")).select("x.*")


def utilization(tasks: DataFrame, capacity: Amounts, makespan: float) -> DataFrame:
    """Mean, least and 95th percentile over the resources of usage over capacity and time, cut to 0 to 1."""
    one = tasks.agg(*(F.sum(F.col(d) * F.col("duration")).alias(d) for d in demands_of(capacity)))
    share = lambda d, c: F.least(F.greatest(F.col(d) / F.lit(float(c) * makespan), F.lit(0.0)), F.lit(1.0 + 1e-8))
    rows = one.select(F.explode(F.array(*(share(d, c) for d, c in by_demand(capacity).items()))).alias("share"))
    return rows.agg(F.round(F.avg("share"), 6).alias("mean_utilization"), F.round(F.min("share"), 6).alias("min_utilization"), F.round(F.percentile("share", F.lit(0.95)), 6).alias("p95_utilization"))


def adjacent_cosine(tasks: DataFrame, capacity: Amounts, sample: int = GATE_SAMPLE, rank: str = "agent_id") -> DataFrame:
    """Mean cosine of tasks that arrive one after another, among the first sample by a dense rank."""
    demands = demands_of(capacity)
    first = tasks.where(F.col(rank) < sample).select(rank, *(s.alias(d) for d, s in zip(demands, shares(capacity), strict=True)))
    pairs = neighbours(first, rank, demands)
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(cosine([F.col(d) for d in demands], [F.col(f"before_{d}") for d in demands])), 6).alias("mean_cosine"))


def random_cosine(tasks: DataFrame, capacity: Amounts, rows: int, sample: int = GATE_SAMPLE, seed: int = 0, rank: str = "agent_id") -> DataFrame:
    """Mean cosine of as many random pairs out of all tasks, with replacement, drawn by a hash of the pair's number among the ranks.

    The pairs, sample of them at most, go to the tasks; the table is not shuffled for them.
    """
    demands = demands_of(capacity)
    pick = lambda salt: F.floor(uniform(seed, F.col("pair"), F.lit(salt)) * F.lit(float(rows))).cast("bigint")
    pairs = tasks.where(F.col(rank) < min(sample, rows)).select(F.col(rank).alias("pair")).select("pair", pick(1).alias("one"), pick(2).alias("other"))
    own = tasks.select(rank, *(s.alias(d) for d, s in zip(demands, shares(capacity), strict=True)))
    one = own.select(F.col(rank).alias("one"), *(F.col(d).alias(f"a_{d}") for d in demands))
    other = own.select(F.col(rank).alias("other"), *(F.col(d).alias(f"b_{d}") for d in demands))
    met = F.broadcast(F.broadcast(pairs).join(one, "one"))
    joined = met.join(other, "other")
    return joined.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(cosine([F.col(f"a_{d}") for d in demands], [F.col(f"b_{d}") for d in demands])), 6).alias("mean_cosine"))


def gate(tasks: DataFrame, capacity: Amounts, rows: int, sample: int = GATE_SAMPLE, threshold: float = GATE_THRESHOLD, seed: int = 0, rank: str = "agent_id") -> DataFrame:
    """One row: how much more alike neighbours by rank are than random pairs, and the policy that follows from it."""
    near = adjacent_cosine(tasks, capacity, sample, rank).select(F.col("mean_cosine").alias("near"))
    far = random_cosine(tasks, capacity, rows, sample, seed, rank).select(F.col("mean_cosine").alias("far"))
    both = near.withColumn("k", F.lit(0)).join(far.withColumn("k", F.lit(0)), "k")
    return both.select(F.round(F.col("near") - F.col("far"), 6).alias("gate_score"), F.when(F.col("near") - F.col("far") > threshold, "mp").otherwise("fifo_windowed").alias("policy"))


def label_runs(labelled: DataFrame, rank: str, label: str) -> DataFrame:
    """One row: places in the order where the label changes."""
    pairs = neighbours(labelled, rank, [label])
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum(F.when(F.col(label) != F.col(f"before_{label}"), 1)), F.lit(0)).alias("n_changes"))


def capacity_sweep(trace: DataFrame, capacity: Amounts) -> DataFrame:
    """For each moment of a schedule at which tasks start: tasks running and whether every resource holds.

    Starts and finishes are first added up by their moment; the running sum is over moments, not tasks.
    """
    demands = demands_of(capacity)
    moves = trace.select(F.explode(F.array(*(F.struct(F.col(at).alias("at"), F.lit(sign).alias("sign")) for at, sign in (("start", 1), ("finish", -1))))).alias("x"), *demands)
    change = moves.groupBy("x.at").agg(F.sum("x.sign").alias("n"), F.max(F.when(F.col("x.sign") > 0, 1).otherwise(0)).alias("starts"), *(F.sum(F.col("x.sign") * F.col(d)).alias(d) for d in demands))
    so_far = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    level = change.select("at", "starts", F.sum("n").over(so_far).alias("n_running"), *(F.sum(d).over(so_far).alias(d) for d in demands))
    holds = F.lit(True)
    for d, c in by_demand(capacity).items():
        holds = holds & (F.col(d) <= F.lit(c))
    return level.where("starts = 1").select("at", "n_running", holds.alias("holds"))


def method_summary(results: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """For each group: runs, valid runs, and mean and sample deviation (0 for one run) of each metric."""
    stats = [f for m in metrics for f in (F.round(F.avg(m), 6).alias(f"mean_{m}"), F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 6).alias(f"std_{m}"))]
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("valid").cast("bigint")).alias("valid_runs"), *stats)


def ordered_report(summary: DataFrame, by: Sequence[str], rank: str = "place") -> DataFrame:
    """A summary with the place of each group in order of some metrics; ties by all other columns, so that the order is one."""
    order = Window.orderBy(*(F.asc_nulls_last(c) for c in by), *(c for c in summary.columns if c not in by))
    return summary.withColumn(rank, F.row_number().over(order).cast("bigint"))


def paired_reduction(results: DataFrame, method: str, baseline: str, pair: Sequence[str], metric: str, keys: Sequence[str]) -> DataFrame:
    """For each group: pairs of runs, mean and median reduction of a metric against a baseline method, and wins."""
    one = results.where(F.col("method") == method).select(*keys, *pair, F.col(metric).alias("own"))
    base = results.where(F.col("method") == baseline).select(*keys, *pair, F.col(metric).alias("base"))
    cut = one.join(base, [*keys, *pair]).withColumn("cut", F.lit(1.0) - F.col("own") / F.col("base"))
    return cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("cut"), 6).alias("mean_reduction"), F.round(F.percentile("cut", F.lit(0.5)), 6).alias("median_reduction"), F.sum(F.when(F.col("cut") > 0, 1).otherwise(0)).alias("wins"))


def rate_pivot(results: DataFrame, row: str, column: str, values: Sequence[str], hit) -> DataFrame:
    """Share of runs that hit, one column for each value."""
    return results.groupBy(row).pivot(column, list(values)).agg(F.round(F.avg(hit.cast("double")), 6))




def result_gates(results: DataFrame, tasks: int, least_unique: float = 0.999) -> DataFrame:
    """(gate, n_failed, holds): runs that fail each check of a table of runs.

    A run is valid, has the due number of tasks, all of them explicit, is distinct enough, and takes no less than its bound.
    Null counts as failed. An empty table passes.
    """
    gates = {
        "valid": F.col("valid"), "tasks": F.col("n_agents") == tasks, "explicit": F.col("explicit_agents"),
        "distinct": F.col("unique_fraction") >= least_unique, "bound": F.col("normalized_makespan") >= 1.0 - 1e-8,
    }
    one = results.agg(*(F.coalesce(F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)), F.lit(0)).cast("bigint").alias(g) for g, ok in gates.items()))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.col(g).alias("n_failed")) for g in gates))).alias("x"))
    return rows.select("x.gate", "x.n_failed", (F.col("x.n_failed") == 0).alias("holds"))


def integrity(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each group whether all runs are valid and explicit, and the least distinctness."""
    return results.groupBy(*keys).agg(F.every("valid").alias("all_valid"), F.every("explicit_agents").alias("all_explicit"), F.round(F.min("unique_fraction"), 6).alias("min_unique_fraction"))
