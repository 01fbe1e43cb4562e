"""Orders of arrival that have nothing to do with the ids."""

import random

import pytest
from pyspark.sql import functions as F

from quayside.operators import order as orders
from quayside.operators import pack, retrieve
from quayside.operators.order import arrival_ranks, reranked, with_arrival
from quayside.plans import waves


@pytest.fixture(scope="module")
def arrived(spark):
    """(tasks with arrival, ids in their order, demands by id), on ids with gaps and places with gaps."""
    rng = random.Random(11)
    ids = rng.sample(range(10_000), 150)
    demands = {i: (rng.randint(1, 30), rng.randint(1, 30)) for i in ids}
    order = rng.sample(ids, len(ids))
    tasks = spark.createDataFrame([(i, *demands[i]) for i in ids], "agent_id bigint, r0 bigint, r1 bigint").repartition(4)
    places = spark.createDataFrame([(7 * k - 50, i) for k, i in enumerate(order)], "place bigint, agent_id bigint").repartition(3)
    return with_arrival(tasks, places, "place"), order, demands


def scan(order, demands, limit, strict):
    left, out = list(limit), []
    for i in order:
        if all(x <= c for x, c in zip(demands[i], left, strict=True)):
            out.append(i)
            left = [c - x for x, c in zip(demands[i], left, strict=True)]
        elif strict:
            break
    return out


def found(df):
    return sorted(r["agent_id"] for r in df.select("agent_id").collect())


def test_inverse_permutation(arrived):
    tasks, order, _ = arrived
    assert {r["agent_id"]: r["arrival"] for r in tasks.collect()} == {i: k for k, i in enumerate(order)}


def test_batches_follow_arrival_after_others_left(arrived):
    """Strict counts ranks from the first that is left, windowed counts tasks that are left."""
    tasks, order, demands = arrived
    first = pack.strict_prefix(tasks, [200, 200], "arrival")
    one = scan(order, demands, [200, 200], True)
    assert found(first) == sorted(one)
    gone = set(one) | set(order[len(one) + 2 : len(one) + 40 : 3])
    active = retrieve.active(tasks, tasks.where(F.col("agent_id").isin(list(gone))))
    left = [i for i in order if i not in gone]
    head = order.index(left[0])
    assert found(pack.strict_prefix(active, [150, 150], "arrival", 10)) == sorted(scan([i for i in left if order.index(i) < head + 10], demands, [150, 150], True))
    assert [r["agent_id"] for r in pack.first_fit_window(active, [150, 150], "arrival", 10).orderBy("seq").collect()] == scan(left[:10], demands, [150, 150], False)
    assert {r["agent_id"]: r["arrival"] for r in reranked(active).collect()} == {i: k for k, i in enumerate(left)}


def test_waves_by_arrival(arrived):
    tasks, order, demands = arrived
    got = {r["agent_id"]: r["wave"] for r in waves.strict_waves(tasks, [100, 120], len(order), "arrival").collect()}
    wave, left, want = 0, [100, 120], {}
    for i in order:
        if any(x > c for x, c in zip(demands[i], left, strict=True)):
            wave, left = wave + 1, [100, 120]
        left = [c - x for c, x in zip(left, demands[i], strict=True)]
        want[i] = wave
    assert got == want


@pytest.mark.parametrize("rows", [[(0, 1), (1, 1)], [(0, 1), (0, 2)], [(0, 1), (1, None)], [(None, 1), (1, 2)]])
def test_no_permutation_is_an_error(spark, rows):
    with pytest.raises(ValueError, match="entries name"):
        arrival_ranks(spark.createDataFrame(rows, "place bigint, agent_id bigint"), "place", "agent_id")


def test_an_order_of_other_tasks_is_an_error(spark):
    tasks = spark.createDataFrame([(1, 5), (2, 5)], "agent_id bigint, r0 bigint")
    for rows in ([(0, 1)], [(0, 1), (1, 2), (2, 3)]):
        with pytest.raises(ValueError, match="order of arrival"):
            with_arrival(tasks, spark.createDataFrame(rows, "place bigint, agent_id bigint"), "place")


def test_nobody_arrives(spark):
    nobody = spark.createDataFrame([], "agent_id bigint, r0 bigint, r1 bigint")
    tasks = with_arrival(nobody, spark.createDataFrame([], "place bigint, agent_id bigint"), "place")
    assert pack.strict_prefix(tasks, [1, 1], "arrival").count() == 0


def test_a_strict_batch_has_no_window(spark):
    tasks = spark.range(70_000).select(F.col("id").alias("agent_id"), F.lit(1).cast("bigint").alias("r0"), (69_999 - F.col("id")).alias("arrival")).repartition(3)
    assert tuple(pack.strict_prefix(tasks, [69_000], "arrival").agg(F.count("*"), F.min("agent_id"), F.max("arrival")).first()) == (69_000, 1_000, 68_999)
    assert pack.strict_prefix(tasks, [69_000], "arrival", pack.WINDOW).count() == pack.WINDOW


def test_a_second_strict_batch_has_no_window(spark):
    """It begins where the whole first batch ends, and has more than a window of tasks itself."""
    tasks = spark.range(150_000).select(F.col("id").alias("agent_id"), F.lit(1).cast("bigint").alias("r0"), (149_999 - F.col("id")).alias("arrival")).repartition(3)
    rest = pack.strict_rest(tasks, [70_000], "arrival")
    assert tuple(rest.agg(F.count("*"), F.min("arrival"), F.max("arrival")).first()) == (80_000, 70_000, 149_999)
    assert tuple(pack.strict_prefix(rest, [70_000], "arrival").agg(F.count("*"), F.min("arrival"), F.max("arrival")).first()) == (70_000, 70_000, 139_999)


@pytest.mark.parametrize("limit", [[0, 0], [40, 900], [900, 300], [10_000, 10_000]])
def test_a_strict_batch_takes_the_rows_whose_sums_fit(spark, monkeypatch, limit):
    """As SQL sums up, over chunks of few ranks: demands that are null count nothing, negative ones make room again."""
    rng = random.Random(4)
    demands = [[rng.choice([None, -3, 1, 7, 12]) if rng.random() < 0.4 else 5 for _ in range(2)] for _ in range(200)]
    demands[32:34] = demands[100:102] = [[None, None], [None, 4]]
    monkeypatch.setattr(orders, "CHUNK_ROWS", 8)
    want, sums = [], [None, None]
    for i, d in enumerate(demands):
        sums = [s if x is None else (s or 0) + x for s, x in zip(sums, d, strict=True)]
        if all(s is not None and s <= c for s, c in zip(sums, limit, strict=True)):
            want.append(i)
    tasks = spark.createDataFrame([(i, *d, i) for i, d in enumerate(demands)], "agent_id bigint, r0 bigint, r1 bigint, arrival bigint").repartition(4)
    assert found(pack.strict_prefix(tasks, limit, "arrival")) == want
    assert found(pack.strict_rest(tasks, limit, "arrival")) == sorted(set(range(200)) - set(want))
