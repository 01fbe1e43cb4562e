"""Packing, pursuit, ranks, sums, generators, waves and files on small inputs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.functions.demand import DEMANDS, rank_key
from quayside.operators import metrics, order, pack, retrieve, solve, validate
from quayside.operators.order import ranked, running_sums
from quayside.plans import dispatch, waves
from quayside.sources import generate, tables


def make(spark, demands, durations=None):
    rows = [(i, *map(int, d), float(durations[i]) if durations else 1.0) for i, d in enumerate(demands)]
    return spark.createDataFrame(rows, "agent_id bigint, r0 bigint, r1 bigint, r2 bigint, r3 bigint, duration double")


def wide(pairs):
    return [(a, b, 1, 1) for a, b in pairs]


def sequential(demands, capacity):
    left, out = list(capacity), []
    for i, d in enumerate(demands):
        if all(x <= c for x, c in zip(d, left)):
            out.append(i)
            left = [c - x for x, c in zip(d, left)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(1, 9)] * 4), max_size=40), st.tuples(*[st.integers(1, 40)] * 4))
def test_first_fit_is_the_sequential_scan(demands, capacity):
    got = pack.first_fit(np.array(demands, dtype=float).reshape(-1, 4), np.array(capacity, dtype=float))
    assert got.tolist() == sequential(demands, capacity)


#: Four kinds of tasks in turn, each short of another resource; the third kind alone exceeds what is left of the last one.
MIXED = [(17, 3, 29, 8), (5, 31, 11, 2), (2, 2, 4, 71), (23, 6, 1, 13)] * 5
LIMITS = [88, 97, 120, 65]


def test_strict_stops_and_window_skips(spark):
    """Strict ends at the first task of the third kind; first fit goes on to the others for as long as they fit."""
    tasks = make(spark, MIXED)
    assert [r[0] for r in pack.strict_prefix(tasks, LIMITS, "agent_id").select("agent_id").collect()] == [0, 1]
    skipping = sequential(MIXED, LIMITS)
    assert len(skipping) > 4 and not any(i % 4 == 2 for i in skipping)
    assert [r["agent_id"] for r in pack.first_fit_window(tasks, LIMITS).orderBy("seq").collect()] == skipping
    assert sorted(r[0] for r in pack.distributed_first_fit(tasks, LIMITS, ["agent_id"]).select("agent_id").collect()) == skipping


def test_best_fit_takes_the_largest_first_whatever_the_order(spark):
    tasks = make(spark, MIXED)
    size = [sum(x / c for x, c in zip(d, LIMITS)) for d in MIXED]
    order = sorted(range(len(MIXED)), key=lambda i: (-round(size[i] * 1e6, 4), i))
    want = [order[k] for k in sequential([MIXED[i] for i in order], LIMITS)]
    shuffled = tasks.orderBy(F.hash("agent_id"))
    batch = pack.best_fit(shuffled, LIMITS)
    assert [r["agent_id"] for r in batch.orderBy("seq").collect()] == want
    assert all(r["holds"] for r in validate.dispatch_check(batch, LIMITS).collect())


def test_packing_an_empty_pool(spark):
    tasks = make(spark, wide([(20, 20)])).where("r0 < 10")
    assert pack.first_fit_window(tasks, [10, 10, 10, 10]).count() == 0
    assert pack.distributed_first_fit(tasks, [10, 10, 10, 10], ["agent_id"]).count() == 0


def test_rank_and_running_sums(spark, monkeypatch):
    monkeypatch.setattr("quayside.operators.order.CHUNK_ROWS", 7)
    df = spark.range(100).select((F.lit(99) - F.col("id")).alias("k"), F.col("id").alias("v")).repartition(5)
    got = running_sums(ranked(df, ["k"], "place"), "place", ["v"], 100).orderBy("place").collect()
    assert [r["place"] for r in got] == [r["k"] for r in got] == list(range(100))
    assert [r["s_v"] for r in got] == np.cumsum(np.arange(99, -1, -1)).tolist()


def test_top_k_ties_go_to_the_least_id(spark):
    scores = spark.createDataFrame([(i, 1.0 if i % 2 else 2.0) for i in range(20)], "agent_id bigint, score double")
    assert [r["agent_id"] for r in retrieve.top_k(scores, 12).collect()] == [*range(0, 20, 2), 1, 3]
    assert retrieve.top_k(scores, 0).count() == 0
    assert [r["agent_id"] for r in retrieve.sharded_top_k(scores, 4, local=1, shard_rows=10).collect()] == [0, 10]


@pytest.mark.parametrize("method", ["mp", "omp", "ols"])
def test_pursuit_finds_the_support(spark, method):
    tasks = make(spark, [(100, 1, 1, 1), (1, 100, 1, 1), (1, 1, 100, 1), (1, 1, 1, 100), (60, 60, 60, 60)])
    found = dict(solve.pursue(tasks, [1.0, 0.01, 0.01, 0.01], [100] * 4, method))
    assert max(found, key=found.get) == 0
    assert min(found.values()) > 0


def test_nonnegative_fit_leaves_out_what_would_be_negative():
    a = np.array([[0.8, 0.6, 0.0], [0.6, -0.8, 0.0], [0.0, 0.0, 1.0]])
    target = a @ np.array([2.0, -1.5, 0.25])
    fit = solve.nonnegative_fit(a, target)
    assert (fit >= 0).all() and fit[1] == 0
    # what is left is at a right angle to the columns in use, and no other column would lower it
    rest = target - a @ fit
    assert np.allclose(a[:, fit > 0].T @ rest, 0) and (a[:, fit == 0].T @ rest <= 0).all()
    assert (solve.nonnegative_fit(-a[:, [0, 2]], np.array([1.0, 1.0, 1.0])) == 0).all()


@pytest.mark.parametrize("method", ["mp", "omp", "ols", "fista", "irls"])
def test_ranked_dispatch_is_feasible_and_starts_with_the_support(spark, method):
    rng = np.random.default_rng(3)
    tasks = make(spark, rng.integers(1, 60, (300, 4)).tolist())
    remaining, capacity = [900, 700, 500, 800], [1000] * 4
    batch = dispatch.ranked_dispatch(tasks, remaining, capacity, method, pool=120).cache()
    rows = tasks.join(batch.select("agent_id"), "agent_id")
    assert rows.count() == batch.count() > 10
    assert all(r["holds"] for r in validate.dispatch_check(rows, remaining).collect())
    if method in ("mp", "omp", "ols"):
        pool = retrieve.top_k(retrieve.scored(tasks, method, remaining, capacity), 120)
        support = {i for i, _ in solve.pursue(pool, [r / 1000 for r in remaining], capacity, method)}
        assert {r["agent_id"] for r in batch.where(f"seq < {len(support)}").collect()} == support


def test_gate_tells_runs_from_turns(spark):
    """The same 240 tasks of three kinds, first kind by kind and then in turn."""
    kinds = [(40, 2, 3, 5), (1, 55, 6, 2), (4, 3, 2, 61)]
    runs, turns = make(spark, [k for k in kinds for _ in range(80)]), make(spark, kinds * 80)
    alike = metrics.gate(runs, [900, 800, 700, 950], 240, 240).first()
    unlike = metrics.gate(turns, [900, 800, 700, 950], 240, 240).first()
    assert alike["policy"] == "mp" and alike["gate_score"] > 0.4
    assert unlike["policy"] == "fifo_windowed" and unlike["gate_score"] < 0


@pytest.mark.parametrize("policy", ["fifo", "mp"])
def test_waves_are_complete_and_feasible(spark, policy):
    tasks = generate.generate(spark.range(400), "bursts").select("agent_id", *(F.ceil(d).cast("bigint").alias(d) for d in DEMANDS), "duration")
    capacity = [2500, 2500, 2500, 2500]
    chosen = waves.fifo_policy(128) if policy == "fifo" else waves.sparse_policy("mp", 256)
    done = waves.policy_waves(tasks, capacity, chosen)
    assert done.count() == 400 and done.select("agent_id").distinct().count() == 400
    assert all(r["holds"] for r in metrics.capacity_sweep(waves.trace(done), capacity).collect())
    bound = metrics.wave_bound(tasks, capacity).first()["waves"]
    assert done.agg(F.max("wave")).first()[0] + 1 >= bound


def test_a_task_that_fits_nowhere_is_an_error(spark):
    tasks = make(spark, wide([(1, 1), (50, 1)]))
    with pytest.raises(ValueError):
        waves.strict_starts(tasks, [10, 10, 10, 10], 2)
    with pytest.raises(ValueError):
        waves.policy_waves(tasks, [10, 10, 10, 10], waves.fifo_policy())


@pytest.fixture(scope="module")
def made(spark):
    n = 20_000
    return n, {p: generate.generate(spark.range(n), p).cache() for p in generate.PATTERNS}


def counts(df):
    return {r["cluster"]: r["count"] for r in df.groupBy("cluster").count().collect()}


def test_cluster_shares_follow_the_dirichlet_law():
    """Over many seeds: the mean of a share is 1/K and its variance that of a symmetric Dirichlet law."""
    shares = np.array([generate.cluster_shares(generate.Workload(seed=s, clusters=5, concentration=12)) for s in range(400)])
    assert np.allclose(shares.sum(axis=1), 1)
    assert np.allclose(shares.mean(axis=0), 0.2, atol=0.01)
    assert np.allclose(shares.var(axis=0), 0.2 * 0.8 / (5 * 12 + 1), rtol=0.35)


def test_counts_are_drawn_by_the_shares(made):
    n, by = made
    shares = generate.cluster_shares(generate.Workload())
    got = counts(by["iid"])
    assert got == counts(by["bursts"]) and sum(got.values()) == n
    # chi-square of 7 degrees of freedom: beyond 29 once in 8,000
    assert 0 < sum((got[c] - n * p) ** 2 / (n * p) for c, p in enumerate(shares)) < 29
    assert max(counts(by["complementary"]).values()) - min(counts(by["complementary"]).values()) <= 1


def test_runs_and_transitions(made):
    """Bursts change cluster between runs alone; drawn and shuffled rows as often as independent ones."""
    n, by = made
    changes = {p: metrics.label_runs(df, "agent_id", "cluster").first()["n_changes"] for p, df in by.items()}
    assert changes["bursts"] == 7
    order = [c for c, *_ in sorted(by["bursts"].groupBy("cluster").agg(F.min("agent_id").alias("first")).collect(), key=lambda r: r["first"])]
    assert order != sorted(order)
    for p, shares in (("iid", generate.cluster_shares(generate.Workload())), ("complementary", [1 / 8] * 8)):
        change = 1 - sum(x * x for x in shares)
        assert abs(changes[p] - (n - 1) * change) < 6 * (n * change * (1 - change)) ** 0.5


def test_demands_have_the_laws_moments(made):
    """Logarithms of the factors: mean 0, deviation 0.14, no correlation of resources within a cluster."""
    n, by = made
    shape = generate.Workload()
    levels = np.array(generate.centres(shape))
    pdf = by["complementary"].toPandas()
    logs = np.log(pdf[DEMANDS].to_numpy() / levels[pdf["cluster"]])
    assert np.allclose(logs.mean(axis=0), 0, atol=0.006)
    assert np.allclose(logs.std(axis=0), shape.jitter, rtol=0.03)
    assert np.abs(np.corrcoef(logs.T) - np.eye(4)).max() < 0.04
    more = by["iid"].toPandas()
    rest = (more[DEMANDS].to_numpy() - levels[more["cluster"]] * np.exp(0.14**2 / 2)).mean()
    assert abs(rest - 0.5) < 0.15
    assert len(np.unique(pdf[DEMANDS].to_numpy(), axis=0)) == n
    for c, own in enumerate(levels):
        assert own.argmax() == c % 4 and 90 <= own.max()


def test_workloads_of_other_sizes(spark):
    shape = generate.Workload(resources=3, clusters=6, seed=4)
    df = generate.generate(spark.range(500), "bursts", shape)
    assert df.columns == ["agent_id", "cluster", "r0", "r1", "r2", "duration"] and df.count() == df.select("agent_id").distinct().count() == 500
    assert generate.generate(spark.range(500), "iid", shape, [1e6] * 3).count() == 500
    with pytest.raises(ValueError, match="exceed"):
        generate.generate(spark.range(500), "iid", shape, [100, 1e6, 1e6])
    with pytest.raises(ValueError):
        generate.generate(spark.range(1), "other")
    assert generate.generate(spark.range(0), "bursts", shape).count() == 0


def test_durations(spark):
    df = spark.range(20_000).withColumnRenamed("id", "agent_id")
    for mode, deviation in (("unit", 0.0), ("uniform", 0.35 / 3**0.5), ("lognormal", (np.exp(0.35**2) - 1) ** 0.5)):
        got = df.select(generate.duration_column(mode).alias("d")).agg(F.avg("d"), F.stddev_samp("d"), F.min("d")).first()
        assert got[0] == pytest.approx(1, abs=0.01) and got[1] == pytest.approx(deviation, rel=0.05, abs=1e-12) and got[2] > 0
    with pytest.raises(ValueError):
        generate.duration_column("other")


def test_tasks_and_results_round_trip(spark, tmp_path):
    tasks = make(spark, wide([(1, 2), (3, 4)]))
    path = str(tmp_path / "tasks")
    tables.save_tasks(tasks, path, DEMANDS, {"seed": 1})
    assert tables.load_manifest(spark, path)["metadata"] == {"seed": 1}
    assert sorted(tables.load_tasks(spark, path).collect()) == sorted(tasks.collect())
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.save_tasks(tasks, path, DEMANDS)
    results = spark.createDataFrame([("a", 1.0, True), ("a", 1.1, True), ("b", 2.0, False)], "method string, makespan double, valid boolean")
    for part in results.randomSplit([0.5, 0.5], 1):
        tables.save_results(part, str(tmp_path / "csv"))
    back = tables.load_results(spark, str(tmp_path / "csv"), results.schema.simpleString()[7:-1].replace(":", " "))
    found = {r["method"]: r for r in metrics.method_summary(back, ["method"], ["makespan"]).collect()}
    assert found["a"]["mean_makespan"] == pytest.approx(1.05) and found["a"]["valid_runs"] == 2 and found["b"]["std_makespan"] == 0


def test_validation_counts(spark):
    rows = [(0, 1, 1, 1, 1, 1.0), (0, None, 1, 1, 1, 1.0), (2, 0, 1, 1, 1, float("nan"))]
    tasks = spark.createDataFrame(rows, "agent_id bigint, r0 bigint, r1 bigint, r2 bigint, r3 bigint, duration double")
    assert tuple(validate.violations(tasks).first()) == (3, 1, 1, 1)
    assert tuple(validate.id_check(tasks).first()) == (3, 2, False, False)


def test_first_come_waves_equal_batches_and_write_the_table_once(spark, monkeypatch):
    """The waves of rounds that take the first so many tasks left, on ids with gaps; no batch writes what is left again."""
    rng = np.random.default_rng(5)
    ids, d = sorted(rng.choice(3_000, 300, replace=False).tolist()), rng.integers(1, 60, (300, 2))
    d[rng.random(300) < 0.05] *= 8
    tasks = spark.createDataFrame([(i, *map(int, x)) for i, x in zip(ids, d, strict=True)], "agent_id bigint, r0 bigint, r1 bigint").repartition(5)
    left, wave, want = list(range(300)), 0, {}
    while left:
        room = [2_300, 2_200]
        while True:
            took = []
            for i in left[:32]:
                if all(d[i] <= room):
                    room, took = [c - x for c, x in zip(room, d[i], strict=True)], [*took, i]
            want |= {ids[i]: wave for i in took}
            left = [i for i in left if i not in took]
            if not took:
                break
        wave += 1
    sizes = []
    keep = waves.written
    monkeypatch.setattr(waves, "written", lambda df, name: sizes.append((out := keep(df, name)).count()) or out)
    got = {r["agent_id"]: r["wave"] for r in waves.policy_waves(tasks, [2_300, 2_200], waves.fifo_policy(32)).collect()}
    assert got == want and wave > 4
    assert sum(n > 32 * waves.LOOKED for n in sizes) == 1


def test_ranks_of_more_rows_take_more_tasks_and_fewer_columns(spark, monkeypatch):
    """A range has about TASK_ROWS rows whatever adaptive execution would join, and only the columns asked for are written."""
    seen, keep = [], order.written
    monkeypatch.setattr(order, "TASK_ROWS", 100)
    monkeypatch.setattr(order, "written", lambda df, name: seen.append((df.columns, df.rdd.getNumPartitions())) or keep(df, name))
    df = spark.range(1_000).select((F.col("id") * 7 % 1_000).alias("k"), F.lit("x").alias("wide"))
    got = order.ranked(df, ["k"], "rank", ["k"]).collect()
    assert seen == [(["k", "_at"], 10)]
    assert len(got) == 1_000 and all(r["k"] == r["rank"] for r in got)


def test_what_is_left_is_not_written_for_each_batch(spark, monkeypatch):
    """Sparse policies write what is left once for so many ids that are gone, and place every task once."""
    names, keep = [], waves.written
    monkeypatch.setattr(waves, "written", lambda df, name: names.append(name) or keep(df, name))
    monkeypatch.setattr(waves, "KEPT_GONE", 25)
    tasks = spark.createDataFrame([(i, 1 + i % 5, 1 + i % 3) for i in range(40)], "agent_id bigint, r0 bigint, r1 bigint").repartition(2)
    got = waves.policy_waves(tasks, [70, 50], waves.sparse_policy("mp", 10)).collect()
    assert sorted(r["agent_id"] for r in got) == list(range(40))
    assert names.count("batch") >= 4 and names.count("left") == 1


def test_rank_keys_are_those_of_spark(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.random(3_000), (rng.integers(1, 10**9, 3_000) + 0.5) / 1e10, rng.integers(1, 50, 3_000) / 7_919 * (rng.integers(1, 50, 3_000) / 64)])
    got = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(rank_key(F.col("v"))).collect()]
    assert (np.round(np.array(got) * 1e4) == pack.rank_keys(values)).all()


def test_no_task_behind_a_level_scores_more():
    rng = np.random.default_rng(9)
    d, whole = rng.integers(1, 90, (500, 3)), np.array([4_000, 2_500, 3_200])
    level = (d / whole).sum(axis=1) * 1e6
    for _ in range(50):
        left, limit = whole * rng.random(3), rng.choice(level)
        assert (d / whole * (left / whole)).sum(axis=1)[level <= limit].max() * 1e6 <= pack.best_outside(limit, left, whole, d.max(axis=0))


def test_waves_by_mp_equal_batches_without_a_pass_for_each(spark, monkeypatch):
    """The waves of rounds that take best fit over the best pool of all tasks left, ties by id; several batches are packed at once."""
    rng = np.random.default_rng(8)
    n, pool, capacity = 240, 8, [1_500, 1_400]
    d = rng.integers(1, 40, (n, 2))
    d[100:180] = d[:80]
    key = lambda x: round(x * 1e6, 4)
    left, wave, batches, want = set(range(n)), 0, 0, {}
    while left:
        room = np.array(capacity)
        while fits := [i for i in left if (d[i] <= room).all()]:
            best = sorted(fits, key=lambda i: (-key(d[i, 0] / capacity[0] * (room[0] / capacity[0]) + d[i, 1] / capacity[1] * (room[1] / capacity[1])), i))[:pool]
            batches, before = batches + 1, room
            for i in sorted(best, key=lambda i: (-key(d[i, 0] / before[0] + d[i, 1] / before[1]), i)):
                if (d[i] <= room).all():
                    room, want[i] = room - d[i], wave
            left -= set(want)
        wave += 1
    names, keep = [], waves.written
    monkeypatch.setattr(waves, "written", lambda df, name: names.append(name) or keep(df, name))
    tasks = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(d)], "agent_id bigint, r0 bigint, r1 bigint").repartition(3)
    got = {r["agent_id"]: r["wave"] for r in waves.policy_waves(tasks, capacity, waves.sparse_policy("mp", pool)).collect()}
    assert got == want and wave > 3
    assert names.count("batch") < batches * 2 // 3
