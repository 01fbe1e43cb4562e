"""Every operator on two and on seven demands, by position and by name, against plain arithmetic on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.functions import demand
from quayside.operators import metrics, pack, retrieve, solve, validate
from quayside.plans import counted, dispatch, methods, waves
from quayside.sources import tables

NAMES = ["cpu", "memory", "disk", "net", "gpu", "seats", "quota"]


class Case:
    """Tasks of m demands and their amounts; named or r0, r1, ..."""

    def __init__(self, spark, m, named, rows=240, seed=5):
        rng = np.random.default_rng(seed + m)
        self.demands = NAMES[:m] if named else [f"r{k}" for k in range(m)]
        self.d = rng.integers(1, 50, (rows, m))
        self.p = rng.integers(1, 6, rows)
        self.capacity = [int(x) for x in self.d.sum(axis=0) // 6 + 50]
        self.remaining = [c * t // 10 for c, t in zip(self.capacity, (9, 6, 10, 7, 8, 5, 9), strict=False)]
        schema = "agent_id bigint, " + ", ".join(f"{x} bigint" for x in self.demands) + ", duration bigint"
        self.tasks = spark.createDataFrame([(i, *map(int, d), int(p)) for i, (d, p) in enumerate(zip(self.d, self.p, strict=True))], schema).repartition(3)
        self.cap = dict(zip(self.demands, self.capacity, strict=True)) if named else self.capacity
        self.rem = dict(zip(self.demands, self.remaining, strict=True)) if named else self.remaining
        self.a = self.d / np.array(self.capacity)
        self.b = np.array(self.remaining) / np.array(self.capacity)

    def score(self, method):
        match, square, total = self.a @ self.b, (self.a**2).sum(axis=1), self.a.sum(axis=1)
        spread = self.a.std(axis=1)
        return {
            "mp": match, "omp": match / np.sqrt(square + 1e-12), "ols": np.maximum(match, 0) ** 2 / (square + 1e-12),
            "fista": match - 0.02 * total - 0.02 * spread, "irls": match / (square + 1e-12) ** 0.25 - 0.015 * spread,
        }[method]


@pytest.fixture(params=[(2, True), (7, False)], ids=lambda x: f"{x[0]}{'named' if x[1] else ''}", scope="module")
def case(request, spark):
    return Case(spark, *request.param)


def taken(demands, limit, order, strict=False):
    left, out = list(limit), []
    for i in order:
        if all(x <= c for x, c in zip(demands[i], left, strict=True)):
            out.append(int(i))
            left = [c - x for x, c in zip(demands[i], left, strict=True)]
        elif strict:
            break
    return out


def ids(df):
    return sorted(r["agent_id"] for r in df.select("agent_id").collect())


@pytest.mark.parametrize("method", demand.METHODS)
def test_scores_and_top_k(case, method):
    got = {r["agent_id"]: r["score"] for r in retrieve.scored(case.tasks, method, case.rem, case.cap).collect()}
    fits = [i for i, d in enumerate(case.d) if (d <= case.remaining).all()]
    want = case.score(method)
    assert sorted(got) == fits
    assert np.allclose([got[i] for i in fits], want[fits] * 1e6, atol=2e-3)
    best = sorted(fits, key=lambda i: (-got[i], i))[:30]
    assert [r["agent_id"] for r in retrieve.top_k(retrieve.scored(case.tasks, method, case.rem, case.cap), 30).collect()] == best


def test_packing(case):
    everyone = range(len(case.d))
    assert ids(pack.strict_prefix(case.tasks, case.rem, "agent_id")) == taken(case.d, case.remaining, everyone, strict=True)
    assert ids(pack.first_fit_window(case.tasks, case.rem)) == taken(case.d, case.remaining, everyone)
    assert ids(pack.distributed_first_fit(case.tasks, case.rem, ["agent_id"])) == taken(case.d, case.remaining, everyone)
    key = np.round((case.d / np.array(case.remaining)).sum(axis=1) * 1e6, 4)
    order = sorted(everyone, key=lambda i: (-key[i], i))
    assert [r["agent_id"] for r in pack.best_fit(case.tasks, case.rem).orderBy("seq").collect()] == taken(case.d, case.remaining, order)


def test_checks(case):
    assert tuple(validate.violations(case.tasks, case.demands).first()) == (len(case.d), 0, 0, 0)
    assert ids(validate.oversize_rows(case.tasks, case.rem, 1000)) == [i for i, d in enumerate(case.d) if (d > case.remaining).any()]
    batch = pack.first_fit_window(case.tasks, case.rem)
    found = {r["resource"]: (r["used"], r["available"], r["holds"]) for r in validate.dispatch_check(batch, case.rem).collect()}
    own = case.d[ids(batch)].sum(axis=0)
    assert found == {x: (int(u), c, True) for x, u, c in zip(case.demands, own, case.remaining, strict=True)}
    assert validate.distinctness(case.tasks, len(case.d), 100, case.demands).first()["n_sampled"] == 100


def test_bounds_and_usage(case):
    assert metrics.wave_bound(case.tasks, case.cap).first()[0] == max(1, int(np.ceil((case.d.sum(axis=0) / np.array(case.capacity)).max() - 1e-12)))
    work = (case.d * case.p[:, None]).sum(axis=0)
    assert metrics.event_bound(case.tasks, case.cap).first()[0] == pytest.approx(max((work / np.array(case.capacity)).max(), case.p.max()), abs=1e-6)
    assert {r["resource"]: r["usage"] for r in metrics.usage_integral(case.tasks, case.demands).collect()} == {x: int(w) for x, w in zip(case.demands, work, strict=True)}
    share = np.clip(work / np.array(case.capacity) / 40.0, 0, 1 + 1e-8)
    assert tuple(metrics.utilization(case.tasks, case.cap, 40.0).first()) == pytest.approx((share.mean(), share.min(), np.quantile(share, 0.95)), abs=1e-6)
    stats = {r["resource"]: (r["least"], r["greatest"]) for r in metrics.column_stats(case.tasks, case.demands).collect()}
    assert stats == {x: (int(lo), int(hi)) for x, lo, hi in zip(case.demands, case.d.min(axis=0), case.d.max(axis=0), strict=True)}
    assert tables.capacities(case.tasks, 6, case.demands) == [int(-(-x // 6)) for x in case.d.sum(axis=0)]


def test_gate(case):
    unit = case.a / np.linalg.norm(case.a, axis=1)[:, None]
    near = metrics.adjacent_cosine(case.tasks, case.cap, 100).first()
    assert near["n_pairs"] == 99 and near["mean_cosine"] == pytest.approx((unit[1:100] * unit[:99]).sum(axis=1).mean(), abs=1e-6)
    assert -1 <= metrics.gate(case.tasks, case.cap, len(case.d), 100).first()["gate_score"] <= 1


@pytest.mark.parametrize("method", ["mp", "omp", "ols"])
def test_pursuit_reports(case, method):
    found, report = solve.pursued(case.tasks, case.b, case.cap, method)
    unit = case.a / np.linalg.norm(case.a, axis=1)[:, None]
    image = sum((c * unit[i] for i, c in found), np.zeros(len(case.b)))
    assert np.allclose(case.b - image, report.residual, atol=1e-9)
    assert report.objective == pytest.approx(0.5 * np.sum((case.b - image) ** 2))
    assert report.objective <= 0.5 * np.sum(case.b**2) and report.iterations <= solve.ATOMS and all(c > 0 for _, c in found)


@pytest.mark.parametrize("method", ["omp", "fista"])
def test_ranked_dispatch(case, method):
    batch = dispatch.ranked_dispatch(case.tasks, case.rem, case.cap, method, 100)
    own = ids(batch)
    assert len(own) == len(set(own)) > 5 and (case.d[own].sum(axis=0) <= case.remaining).all()


def test_waves(case):
    units = case.tasks.withColumn("duration", F.lit(2))
    strict = {r["agent_id"]: r["wave"] for r in waves.strict_waves(units, case.cap, len(case.d)).collect()}
    wave, left, want = 0, list(case.capacity), {}
    for i, d in enumerate(case.d):
        if (d > left).any():
            wave, left = wave + 1, list(case.capacity)
        left = [c - x for c, x in zip(left, d, strict=True)]
        want[i] = wave
    assert strict == want
    trace = waves.trace(waves.strict_waves(units, case.cap, len(case.d)), case.demands)
    assert all(r["holds"] for r in metrics.capacity_sweep(trace, case.cap).collect())
    placed = waves.policy_waves(units, case.cap, waves.fifo_policy(64))
    used = waves.wave_summary(placed, case.demands).collect()
    assert sum(r["n_tasks"] for r in used) == len(case.d)
    assert all(r[f"used_{x}"] <= c for r in used for x, c in zip(case.demands, case.capacity, strict=True))


def test_waves_of_unequal_durations_are_an_error(case):
    with pytest.raises(ValueError, match="durations from 1 to 5"):
        waves.strict_waves(case.tasks, case.cap, len(case.d))
    with pytest.raises(ValueError, match="durations"):
        waves.policy_waves(case.tasks, case.cap, waves.fifo_policy())


def test_counters(case):
    fits = sum(bool((d <= case.remaining).all()) for d in case.d)
    for method, considered in (("irls", min(fits, 50)), ("fifo_windowed", 70), ("fifo_strict", None)):
        batch, row = counted.counted_dispatch(case.tasks, case.rem, case.cap, method, pool=50, window=70)
        own = ids(batch)
        assert row == (method, len(case.d), fits, considered or len(own) + 1, len(own), (considered or len(own) + 1) - len(own))


def test_vectors_at_the_edge(spark, case, tmp_path):
    vectors = demand.to_vector(case.tasks, case.demands)
    assert vectors.columns == ["agent_id", "duration", "demand"]
    back = demand.from_vector(vectors, "demand", case.demands)
    assert ids(pack.first_fit_window(back, case.rem)) == ids(pack.first_fit_window(case.tasks, case.rem))
    short = vectors.withColumn("demand", F.when(F.col("agent_id") == 3, F.slice("demand", 1, 1)).otherwise(F.col("demand")))
    assert validate.violations(demand.from_vector(short, "demand", case.demands), case.demands).first()["n_null"] == 1
    tables.save_tasks(case.tasks, str(tmp_path / "t"), case.demands)
    manifest = tables.load_manifest(spark, str(tmp_path / "t"))
    assert manifest["resources"] == case.demands
    loaded = tables.load_tasks(spark, str(tmp_path / "t"))
    assert ids(retrieve.scored(loaded, "mp", dict(zip(manifest["resources"], case.remaining, strict=True)), dict(zip(manifest["resources"], case.capacity, strict=True)))) == ids(retrieve.scored(case.tasks, "mp", case.rem, case.cap))


def test_amounts_of_other_demands_are_an_error():
    with pytest.raises(ValueError, match="expected"):
        demand.target({"a": 1, "b": 2}, {"a": 1, "c": 2})
    assert demand.target({"b": 1, "a": 4}, {"a": 8, "b": 2}) == [0.5, 0.5]


def test_fractions_fit_but_for_rounding(spark):
    tasks = spark.createDataFrame([(i, 0.1, 0.7) for i in range(20)], "agent_id bigint, r0 double, r1 double")
    assert ids(pack.strict_prefix(tasks, [0.3, 9.0], "agent_id")) == [0, 1, 2]
    assert ids(pack.first_fit_window(tasks, [0.3, 9.0])) == [0, 1, 2]
    assert ids(pack.distributed_first_fit(tasks, [0.3, 9.0], ["agent_id"])) == [0, 1, 2]


def test_distinctness_takes_even_places(spark):
    for n in (1, 2, 5, 37, 100, 101):
        tasks = spark.createDataFrame([(i, i) for i in range(n)], "agent_id bigint, r0 bigint")
        for sample in (1, 2, 10, 100):
            want = len({int(x) for x in np.linspace(0, n - 1, min(sample, n), dtype=np.int64)})
            assert validate.distinctness(tasks, n, sample).first()["n_sampled"] == want, (n, sample)


def test_methods_by_name(case):
    for name in ("fifo_strict", "fifo_windowed", "adaptive", *demand.METHODS):
        own = ids(methods.method(name, window=60, pool=80)(case.tasks, case.rem, case.cap))
        assert own and (case.d[own].sum(axis=0) <= case.remaining).all(), name
    assert ids(methods.method("fifo_strict")(case.tasks, case.rem, case.cap)) == taken(case.d, case.remaining, range(len(case.d)), strict=True)
    with pytest.raises(ValueError, match="unknown method"):
        methods.method("lifo")


def test_pools_are_what_sorts_of_all_tasks_give(case):
    """Ties across the end of a pool, scores that rounding makes equal, and pools of more tasks than there are."""
    alike = case.tasks.unionByName(case.tasks.withColumn("agent_id", F.col("agent_id") + 1000)).unionByName(case.tasks.where("agent_id < 9").withColumn("agent_id", F.col("agent_id") - 50))
    wide = {d: 10**9 for d in case.demands}, {d: 10**12 for d in case.demands}
    for tasks, k, rem, cap in ((alike, 31, case.rem, case.cap), (alike, 31, *wide), (alike, 5000, *wide), (alike.limit(0), 1, *wide)):
        found = retrieve.pools(tasks, ["omp", "fista"], rem, cap, k)
        for m in found:
            assert found[m].collect() == retrieve.top_k(retrieve.scored(tasks, m, rem, cap), k).collect()


@pytest.mark.parametrize("method", demand.METHODS)
def test_few_tasks_reach_the_floor_of_a_pool(spark, method):
    """Of 60,000 tasks the 500 best are sorted and few others, whatever the scale of the capacity."""
    tasks = spark.range(60_000).select(F.col("id").alias("agent_id"), *((F.pmod(F.col("id") * p, F.lit(9973)) + 1).alias(f"r{k}") for k, p in enumerate((7919, 104729, 1299709))))
    for capacity in ([10**5] * 3, [10**8] * 3):
        low = retrieve.floors(tasks, [method], [10**5] * 3, capacity, 500)
        reach = tasks.where(demand.score(method, [10**5] * 3, capacity) >= F.lit(low[method])).count()
        assert 500 <= reach < 900
    assert retrieve.floors(tasks.limit(499), [method], [10**5] * 3, [10**5] * 3, 500) == {}
