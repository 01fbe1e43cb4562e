"""One dispatch whose order follows a solver: retrieve, solve, weigh, pack along the weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.demand import Amounts, affinity, demands_of, rank_key, shares, target
from ..operators.pack import pack_in_order
from ..operators.proximal import fista, irls
from ..operators.retrieve import POOL, scored, top_k
from ..operators.solve import pursue
from ..sources.shared import written

#: Pool rows, the best by score, among which a pursuit looks for directions.
DIRECTIONS = 2048

# Fixed values of the weights, which must be these for the same batches: shares of proxy and affinity in a pursuit, the lead
# of its chosen tasks, and the share of the proxy beside proximal coefficients.
PURSUIT_PROXY, PURSUIT_AFFINITY, LEAD, PROXY_SHARE = 0.55, 0.45, 1e-6, 1e-4


def ranked_dispatch(tasks: DataFrame, remaining: Amounts, capacity: Amounts, method: str, pool: int = POOL) -> DataFrame:
    """(agent_id, seq) of the batch that a method packs along its own order, from its pool of the best by score."""
    rows = written(top_k(scored(tasks, method, remaining, capacity), pool), "pool")
    wanted = target(remaining, capacity)
    if method in ("fista", "irls"):
        return _proximal(rows, wanted, remaining, capacity, method, pool)
    return _pursuit(rows, wanted, remaining, capacity, method, pool)


def _pursuit(rows: DataFrame, wanted: Sequence[float], remaining: Amounts, capacity: Amounts, method: str, pool: int) -> DataFrame:
    """Weights of proxy and affinity to the chosen directions; the chosen tasks come first, in the order of their ids."""
    chosen = pursue(top_k(rows, DIRECTIONS), wanted, capacity, method)
    demands = demands_of(capacity)
    vectors = {r["agent_id"]: [r[d] for d in demands] for r in rows.where(F.col("agent_id").isin([i for i, _ in chosen])).select("agent_id", *(s.alias(d) for d, s in zip(demands, shares(capacity), strict=True))).collect()}
    span = rows.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    low, wide = span["low"] or 0.0, max((span["high"] or 0.0) - (span["low"] or 0.0), 1e-12)
    weight = F.lit(PURSUIT_PROXY) * ((F.col("score") - F.lit(low)) / F.lit(wide))
    if chosen:
        weight = weight + F.lit(PURSUIT_AFFINITY) * affinity([(c, vectors[i]) for i, c in chosen], capacity)
    for k, (i, _) in enumerate(chosen):
        weight = weight + F.when(F.col("agent_id") == i, F.lit(1.0 + LEAD * (1 - k / len(chosen)))).otherwise(F.lit(0.0))
    return pack_in_order(rows.withColumn("score", rank_key(weight)), remaining, [F.desc("score"), F.asc("agent_id")], pool).select("agent_id", "seq")


def _proximal(rows: DataFrame, wanted: Sequence[float], remaining: Amounts, capacity: Amounts, method: str, pool: int) -> DataFrame:
    """Weights of the coefficients, equal ones by proxy; the solver sees the whole pool as a table."""
    found, _ = {"fista": fista, "irls": irls}[method](rows, wanted, capacity)
    weighed = rows.join(found, "agent_id")
    span = weighed.agg(F.max(F.abs("coefficient")).alias("most"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    low, high, most = span["low"] or 0.0, span["high"] or 0.0, max(span["most"] or 0.0, 1e-12)
    weight = F.col("coefficient") / F.lit(most) + F.lit(PROXY_SHARE) * (F.col("score") - F.lit(min(low, 0.0))) / F.lit(max(high - low, 1e-12))
    return pack_in_order(weighed.withColumn("score", rank_key(weight)), remaining, [F.desc("score"), F.asc("agent_id")], pool).select("agent_id", "seq")
