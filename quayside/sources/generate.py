"""Synthetic task tables for the ids of any given table, drawn by hashes that SQL engines share."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.demand import oversize, uniform, uniform_number
from ..operators.order import ranked
from .shared import written

PATTERNS = ("bursts", "iid", "complementary")
# Numbers that keep the draws of one seed apart: of a cluster's resources, main and second level, share and place, and of a row's
# cluster, place, jitter (two for a normal number) and addition.
LEVEL, MAIN, SECOND, SHARE, TURN = 1000, 2000, 2001, 3000, 4000
LABEL, PLACE, RADIUS, ANGLE, ADDED = 17, 41, 100, 200, 300


@dataclass(frozen=True)
class Workload:
    """The laws of a workload. Fixed values where nothing else is given, so that results can be compared."""

    resources: int = 4
    clusters: int = 8
    seed: int = 100
    background: tuple[float, float] = (4.0, 16.0)
    dominant: tuple[float, float] = (90.0, 140.0)
    second: tuple[float, float] = (1.5, 3.0)
    jitter: float = 0.14
    added: tuple[float, float] = (1e-4, 1.0)
    concentration: int = 60


def _between(low: float, high: float, u: float) -> float:
    return low + (high - low) * u


def centres(shape: Workload) -> list[list[float]]:
    """For each cluster its level of each resource: one is dominant, a second one is raised, so that demands are correlated."""
    out = []
    for c in range(shape.clusters):
        main = c % shape.resources
        second = (main + 1 + c // shape.resources) % shape.resources
        own = [_between(*shape.background, uniform_number(shape.seed, c, LEVEL + k)) for k in range(shape.resources)]
        own[main] = _between(*shape.dominant, uniform_number(shape.seed, c, MAIN))
        own[second] *= _between(*shape.second, uniform_number(shape.seed, c, SECOND))
        out.append(own)
    return out


def cluster_shares(shape: Workload) -> list[float]:
    """A draw from the symmetric Dirichlet law: gamma numbers of a whole shape, each a sum of exponential ones, over their sum."""
    gammas = [sum(-math.log(max(uniform_number(shape.seed, c, SHARE + i), 1e-12)) for i in range(shape.concentration)) for c in range(shape.clusters)]
    return [g / sum(gammas) for g in gammas]


def _draw(shape: Workload, salt: int) -> Column:
    """A row's number in [0, 1); a third round of the hash, as two leave the normal numbers of neighbouring salts correlated."""
    return uniform(shape.seed, F.col("id"), F.lit(salt), F.lit(0))


def _drawn(ids: DataFrame, shape: Workload) -> DataFrame:
    """ids with a cluster drawn for each by the shares: a range join with one row for each cluster."""
    edges, low = [], 0.0
    for c, share in enumerate(cluster_shares(shape)):
        high = 2.0 if c == shape.clusters - 1 else low + share
        edges.append((c, low, high))
        low = high
    bounds = F.broadcast(ids.sparkSession.createDataFrame(edges, "cluster int, low double, high double"))
    placed = ids.withColumn("u", _draw(shape, LABEL))
    return placed.join(bounds, (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("id", "cluster")


def burst_runs(ids: DataFrame, shape: Workload) -> list[tuple[int, int, int]]:
    """(cluster, first, end) of each cluster's run: as many rows as a draw for each id gives it, in a drawn order of the clusters."""
    counts = {r["cluster"]: r["count"] for r in _drawn(ids, shape).groupBy("cluster").count().collect()}
    out, at = [], 0
    for c in sorted(range(shape.clusters), key=lambda c: (uniform_number(shape.seed, c, TURN), c)):
        out.append((c, at, at + counts.get(c, 0)))
        at = out[-1][2]
    return out


def clustered(ids: DataFrame, pattern: str, shape: Workload) -> DataFrame:
    """(id, cluster) of dense ids: in one run for each cluster (bursts), drawn for each row (iid), or in turn over shuffled rows (complementary)."""
    if pattern == "iid":
        return _drawn(ids, shape)
    if pattern == "bursts":
        runs = F.broadcast(ids.sparkSession.createDataFrame(burst_runs(ids, shape), "cluster int, first bigint, end bigint"))
        return ids.join(runs, (F.col("id") >= F.col("first")) & (F.col("id") < F.col("end"))).select("id", "cluster")
    if pattern == "complementary":
        shuffled = ranked(ids.withColumn("u", _draw(shape, PLACE)), ["u", "id"], "place")
        return shuffled.select("id", F.pmod(F.col("place"), F.lit(shape.clusters)).cast("int").alias("cluster"))
    raise ValueError(f"unknown pattern {pattern}")


def _normal(shape: Workload, k: int) -> Column:
    u, v = (_draw(shape, salt + k) for salt in (RADIUS, ANGLE))
    return F.sqrt(F.lit(-2.0) * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(F.lit(2.0 * math.pi) * v)


def generate(ids: DataFrame, pattern: str, shape: Workload | None = None, capacity=None) -> DataFrame:
    """(agent_id, cluster, r0, r1, ..., duration) for dense ids: levels of the cluster times a lognormal factor each, and but for
    complementary ones a little more. Where a capacity is given, a task that exceeds it is an error.
    """
    shape = shape or Workload()
    levels = F.broadcast(ids.sparkSession.createDataFrame([(c, *own) for c, own in enumerate(centres(shape))], "cluster int, " + ", ".join(f"l{k} double" for k in range(shape.resources))))
    rows = clustered(ids.select(F.col("id").cast("bigint").alias("id")), pattern, shape).join(levels, "cluster")
    demands = []
    for k in range(shape.resources):
        value = F.col(f"l{k}") * F.exp(F.lit(shape.jitter) * _normal(shape, k))
        if pattern != "complementary":
            low, high = shape.added
            value = value + (F.lit(low) + F.lit(high - low) * _draw(shape, ADDED + k))
        demands.append(F.round(value, 6).alias(f"r{k}"))
    made = rows.select(F.col("id").alias("agent_id"), "cluster", *demands, F.lit(1.0).alias("duration"))
    if capacity is None:
        return made
    made = written(made, "generated")
    over = made.where(oversize(capacity)).count()
    if over:
        raise ValueError(f"{over} generated tasks exceed the capacity")
    return made


def duration_column(mode: str, mean: float = 1.0, sigma: float = 0.35, seed: int = 100):
    """Durations of unit, uniform (mean, give or take sigma) or lognormal form with the given mean."""
    u = uniform(seed, F.col("agent_id"), F.lit(31))
    if mode == "unit":
        return F.lit(mean)
    if mode == "uniform":
        return F.lit(mean) * (F.lit(1.0 - sigma) + F.lit(2.0 * sigma) * u)
    if mode == "lognormal":
        v = uniform(seed, F.col("agent_id"), F.lit(37))
        normal = F.sqrt(F.lit(-2.0) * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(F.lit(2.0 * math.pi) * v)
        return F.exp(F.lit(math.log(mean) - sigma * sigma / 2) + F.lit(sigma) * normal)
    raise ValueError(f"unknown durations {mode}")
