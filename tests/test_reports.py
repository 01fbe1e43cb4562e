"""The signed-rank test against all signs, and usage over time against the closed form."""

import itertools
import random

import pytest

from quayside.operators.signed_rank import signed_rank
from quayside.operators.usage import instants, usage_over_time, usage_totals


def runs(spark, groups):
    rows = [(g, m, s, float(x)) for g, pairs in groups.items() for s, (own, base) in enumerate(pairs) for m, x in (("own", own), ("base", base)) if x is not None]
    return spark.createDataFrame(rows, "g string, method string, seed int, makespan double")


def enumerated(pairs):
    """Rank sum and both chances by trying every choice of signs."""
    d = [a - b for a, b in pairs if a is not None and b is not None and a != b]
    size = sorted(map(abs, d))
    rank = {x: sum(k + 1 for k, y in enumerate(size) if y == x) / size.count(x) for x in size}
    w = sum(rank[abs(x)] for x in d if x > 0)
    sums = [sum(rank[abs(x)] for x, s in zip(d, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=len(d))]
    less, more = sum(s <= w for s in sums) / len(sums), sum(s >= w for s in sums) / len(sums)
    return len(d), w, less, min(1.0, 2 * min(less, more))


def test_exact_chances_are_those_of_all_signs(spark):
    rng = random.Random(3)
    groups = {f"n{n}": [(rng.randint(1, 9), rng.randint(1, 9)) for _ in range(n)] for n in range(1, 13)}
    groups |= {"ten": [(1 + k / 100, 2 + k / 7) for k in range(10)], "equal": [(1, 1), (2, 2)], "lone": [(1, None), (None, 2), (3, 4)]}
    got = {r["g"]: r for r in signed_rank(runs(spark, groups), "own", "base", ["seed"], "makespan", ["g"]).collect()}
    assert set(got) == set(groups)
    for g, pairs in groups.items():
        n, w, less, both = enumerated(pairs)
        assert (got[g]["pairs"], got[g]["rank_sum"]) == (n, w), g
        assert (got[g]["p_less"], got[g]["p_two_sided"]) == pytest.approx((less, both), abs=1e-12), g
    # ten wins of ten, as published
    assert got["ten"]["p_less"] == 0.0009765625
    assert got["equal"]["ties"] == 2 and got["equal"]["deviate"] is None


def test_larger_groups_have_a_deviate_alone(spark):
    groups = {"big": [(k + (5 if k % 3 else -5), k) for k in range(60)]}
    row = signed_rank(runs(spark, groups), "own", "base", ["seed"], "makespan", ["g"], exact_pairs=50).first()
    assert row["p_less"] is None and row["p_two_sided"] is None
    # 60 equal sizes share rank 30.5; 40 are positive
    assert row["rank_sum"] == 40 * 30.5
    assert row["deviate"] == pytest.approx((1220 - 915) / (30.5 * 60**0.5 / 2))


TRACE = "agent_id bigint, start double, finish double, r0 bigint, r1 bigint"


def test_a_complete_trace_uses_demand_times_duration(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        start, p = rng.randint(0, 40) / 2, rng.randint(1, 9)
        rows.append((i, start, start + p / 3, rng.randint(1, 50), rng.randint(1, 50)))
    trace = spark.createDataFrame(rows, TRACE).repartition(5)
    got = {r["resource"]: r["usage"] for r in usage_totals(trace).collect()}
    for k in (3, 4):
        assert got[f"r{k - 3}"] == pytest.approx(sum(r[k] * (r[2] - r[1]) for r in rows), rel=1e-9)
    levels = sorted(tuple(r) for r in usage_over_time(trace).collect())
    moments = sorted({round(x, 6) for r in rows for x in r[1:3]})
    assert [round(x[0], 6) for x in levels] == moments
    for at, _, n, r0, _ in levels:
        running = [r for r in rows if r[1] <= at + 1e-7 < r[2]]
        assert (n, r0) == (len(running), sum(r[3] for r in running))


def test_near_moments_join_in_chains_and_gaps_part_them(spark):
    """Idle time between tasks, finishes a hair apart, a task that never ends and one that never began."""
    rows = [(0, 0.0, 1.0, 5, 1), (1, 0.0, 1.0 + 6e-11, 7, 1), (2, 0.0, 1.0 + 12e-11, 9, 1), (3, 3.0, 4.0, 2, 1), (4, 3.5, None, 4, 1), (5, None, 9.0, 100, 1)]
    trace = spark.createDataFrame(rows, TRACE)
    got = [tuple(r)[:4] for r in usage_over_time(trace).orderBy("at").collect()]
    assert got == [(0.0, 1.0, 3, 21), (1.0, 2.0, 0, 0), (3.0, 0.5, 1, 2), (3.5, 0.5, 2, 6), (4.0, 0.0, 1, 4)]
    assert instants(trace, tolerance=0.0).count() == 7


def test_an_empty_trace(spark):
    empty = spark.createDataFrame([], TRACE)
    assert usage_over_time(empty).count() == 0
    assert [r["usage"] for r in usage_totals(empty).collect()] == [0.0, 0.0]
