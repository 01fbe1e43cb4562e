"""Column expressions over any number of demands: normalisation, feasibility, scores and affinities.

Amounts of the resources (capacity, what remains) say which columns hold the demands: a mapping from column to
amount, or a sequence for the columns r0, r1 and so on. Sums are written out in the order of the resources, so that
they stay in one generated expression and give the same doubles as the same sum in SQL.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Demands of the tasks that are derived from lineitem.
DEMANDS = [f"r{k}" for k in range(4)]
TOLERANCE = 1e-10
EPSILON = 1e-12
METHODS = ("mp", "omp", "ols", "fista", "irls")

Amounts = Sequence[float] | Mapping[str, float]


def by_demand(amounts: Amounts) -> dict[str, float]:
    """Amounts by the column of the demand."""
    return dict(amounts) if isinstance(amounts, Mapping) else {f"r{k}": x for k, x in enumerate(amounts)}


def demands_of(amounts: Amounts) -> list[str]:
    return list(by_demand(amounts))


def aligned(amounts: Amounts, like: Amounts) -> list[float]:
    """Amounts in the order of the demands of others, which must be the same ones."""
    own, order = by_demand(amounts), demands_of(like)
    if set(own) != set(order):
        raise ValueError(f"demands {sorted(own)} where {sorted(order)} were expected")
    return [own[d] for d in order]


def like_given(values: Sequence[float], given: Amounts) -> Amounts:
    """Values in the order of given's demands, as a mapping where that is one."""
    return dict(zip(given, values, strict=True)) if isinstance(given, Mapping) else list(values)


def demand_columns(tasks: DataFrame, demands: Sequence[str] | None = None) -> list[str]:
    """The demands named, or else the table's columns r0, r1, ... in the order of their numbers."""
    if demands is not None:
        return list(demands)
    return sorted((c for c in tasks.columns if re.fullmatch(r"r\d+", c)), key=lambda c: int(c[1:]))


def from_vector(tasks: DataFrame, vector: str, demands: Sequence[str]) -> DataFrame:
    """tasks with the parts of an array column as demands of their own; a vector of another length has null demands."""
    part = lambda k: F.when(F.size(vector) == len(demands), F.get(vector, F.lit(k)))
    return tasks.select(*(c for c in tasks.columns if c != vector and c not in demands), *(part(k).alias(d) for k, d in enumerate(demands)))


def to_vector(tasks: DataFrame, demands: Sequence[str], vector: str = "demand") -> DataFrame:
    """tasks with their demands as one array column of doubles."""
    return tasks.select(*(c for c in tasks.columns if c not in demands and c != vector), F.array(*(F.col(d).cast("double") for d in demands)).alias(vector))


def plus(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def conjunction(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms)


def shares(capacity: Amounts) -> list[Column]:
    """Each demand as a share of the capacity."""
    return [F.col(d).cast("double") / F.lit(float(c)) for d, c in by_demand(capacity).items()]


def target(remaining: Amounts, capacity: Amounts) -> list[float]:
    """What remains of each resource as a share of the capacity."""
    return [float(r) / float(c) for r, c in zip(aligned(remaining, capacity), by_demand(capacity).values(), strict=True)]


def feasible(remaining: Amounts) -> Column:
    """Every demand fits, give or take TOLERANCE where amounts are not whole; plain comparisons of scalar columns, which reach the Parquet scan."""
    return conjunction([F.col(d) <= F.lit(c if isinstance(c, int) else c + TOLERANCE) for d, c in by_demand(remaining).items()])


def oversize(capacity: Amounts) -> Column:
    return ~feasible(capacity)


def score(method: str, remaining: Amounts, capacity: Amounts) -> Column:
    """How well a demand vector meets what remains, by the method's proxy."""
    a = shares(capacity)
    m = float(len(a))
    b = target(remaining, capacity)
    match = plus([x * F.lit(y) for x, y in zip(a, b, strict=True)])
    square = plus([x * x for x in a])
    total = plus(a)
    spread = F.sqrt(F.greatest(square / F.lit(m) - (total / F.lit(m)) * (total / F.lit(m)), F.lit(0.0)))
    if method == "mp":
        return match
    if method == "omp":
        return match / F.sqrt(square + F.lit(EPSILON))
    if method == "ols":
        positive = F.greatest(match, F.lit(0.0))
        return positive * positive / (square + F.lit(EPSILON))
    if method == "fista":
        return match - F.lit(0.02) * total - F.lit(0.02) * spread
    if method == "irls":
        return match / F.sqrt(F.sqrt(square + F.lit(EPSILON))) - F.lit(0.015) * spread
    raise ValueError(f"unknown method {method}")


def rank_key(value: Column) -> Column:
    """A score in millionths, to four places, so that rows that differ by rounding alone are ordered by id."""
    return F.round(value * F.lit(1e6), 4)


def cosine(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return plus([x * y for x, y in zip(a, b, strict=True)]) / (F.sqrt(plus([x * x for x in a])) * F.sqrt(plus([y * y for y in b])))


def affinity(directions: Sequence[tuple[float, Sequence[float]]], capacity: Amounts) -> Column:
    """Weighted mean cosine to a dozen directions at most, given as literals; all-zero weights count alike."""
    a = shares(capacity)
    weights = [max(w, 0.0) for w, _ in directions]
    total = sum(weights)
    weights = [w / total for w in weights] if total > 0 else [1.0 / len(directions)] * len(directions)
    return plus([F.lit(w) * cosine(a, [F.lit(float(x)) for x in d]) for w, (_, d) in zip(weights, directions, strict=True)])


def residual_key(remaining: Amounts) -> Column:
    """Sum of demands over what remains: the order of best fit."""
    return rank_key(plus([F.col(d).cast("double") / F.lit(max(float(r), TOLERANCE)) for d, r in by_demand(remaining).items()]))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) of keys that any SQL engine gives alike: a product and a square modulo 2**31 - 1 for each key."""
    x = F.lit(seed).cast("bigint")
    for k in keys:
        x = F.pmod((x + k.cast("bigint")) * F.lit(48271) + F.lit(11), F.lit(2147483647))
        x = F.pmod(x * x + F.lit(7), F.lit(2147483647))
    return x.cast("double") / F.lit(2147483647.0)


def uniform_number(seed: int, *keys: int) -> float:
    """What uniform gives, for plain numbers."""
    x = seed
    for k in keys:
        x = ((x + k) * 48271 + 11) % 2147483647
        x = (x * x + 7) % 2147483647
    return x / 2147483647.0


def uniform_sql(seed: int, *keys: str) -> str:
    x = f"CAST({seed} AS BIGINT)"
    for k in keys:
        x = f"(({x} + CAST({k} AS BIGINT)) * 48271 + 11) % 2147483647"
        x = f"(({x}) * ({x}) + 7) % 2147483647"
    return f"(CAST({x} AS DOUBLE) / 2147483647.0)"
