"""Policies of one's own as table functions, from SQL."""

import pytest

from quayside.plans.tablefunctions import packing, retrieval

SCHEMA = "shard bigint, agent_id bigint, cpu double, disk double"
ROWS = [(s, 10 * i + s, float(1 + (i * 7 + s) % 5), float(1 + (i * 3 + s) % 4)) for s in range(3) for i in range(12)] + [(None, 500, 1.0, 1.0)]
CAPACITY = "map('cpu', 10D, 'disk', 9D)"


@pytest.fixture
def view(spark):
    def make(rows):
        spark.createDataFrame(rows, SCHEMA).repartition(4).createOrReplaceTempView("own_tasks")

    make(ROWS)
    return make


def rows(spark, sql):
    return sorted(tuple(r) for r in spark.sql(sql).collect() if r[0] is not None)


def test_first_fit_by_partition_in_any_order(spark, view):
    spark.udtf.register("own_packing", packing())
    for order, key in (("agent_id", lambda r: r[1]), ("(cpu DESC, agent_id)", lambda r: (-r[2], r[1]))):
        want = []
        for s in range(3):
            left, n = [10.0, 9.0], 0
            for r in sorted((r for r in ROWS if r[0] == s), key=key):
                if r[2] <= left[0] and r[3] <= left[1]:
                    left = [left[0] - r[2], left[1] - r[3]]
                    want.append((s, r[1], n))
                    n += 1
        assert rows(spark, f"SELECT * FROM own_packing({CAPACITY}, TABLE(own_tasks) PARTITION BY shard ORDER BY {order})") == sorted(want)
    assert spark.sql(f"SELECT * FROM own_packing({CAPACITY}, TABLE(own_tasks) PARTITION BY shard) WHERE shard IS NULL").count() == 1


def test_retrieval_keeps_the_best_of_each_partition(spark, view):
    spark.udtf.register("own_retrieval", retrieval(lambda d, limit: d[0] - d[1]))
    want = []
    for s in range(3):
        own = sorted(((r[2] - r[3], -r[1]) for r in ROWS if r[0] == s and r[2] <= 4), reverse=True)[:4]
        want += [(s, -i, x, k) for k, (x, i) in enumerate(own)]
    assert rows(spark, "SELECT * FROM own_retrieval(map('cpu', 4D, 'disk', 9D), 4, TABLE(own_tasks) PARTITION BY shard)") == sorted(want)
    assert rows(spark, f"SELECT * FROM own_retrieval({CAPACITY}, 0, TABLE(own_tasks) PARTITION BY shard)") == []


@pytest.mark.parametrize(("bad", "wants", "match"), [
    ([], lambda d, left: True, "does not fit"), ([(0, 0, 1.0, 1.0)], None, "taken twice"), ([(0, 77, None, 1.0)], None, "demand of null"),
])
def test_wrong_policies_and_tables_are_errors(spark, view, bad, wants, match):
    view(ROWS + bad)
    spark.udtf.register("own_packing", packing(wants) if wants else packing())
    with pytest.raises(Exception, match=match):
        spark.sql(f"SELECT * FROM own_packing({CAPACITY}, TABLE(own_tasks) PARTITION BY shard ORDER BY agent_id)").collect()


def test_no_tasks(spark, view):
    view([])
    spark.udtf.register("own_packing", packing())
    assert spark.sql(f"SELECT * FROM own_packing({CAPACITY}, TABLE(own_tasks) PARTITION BY shard ORDER BY agent_id)").count() == 0


def test_no_row_is_searched_by_name_for_its_demands():
    """The places of the demands are found once for a partition; a rejected row is read by place alone."""
    from pyspark.sql import Row

    searched = []

    class Counted(Row):
        def __getitem__(self, item):
            searched.append(item) if isinstance(item, str) else None
            return super().__getitem__(item)

    own = packing(lambda demand, left: False).func()
    for i in range(50):
        row = tuple.__new__(Counted, (0, i, 1.0, 2.0))
        row.__fields__ = ["shard", "agent_id", "cpu", "disk"]
        assert list(own.eval({"cpu": 10.0, "disk": 9.0}, row)) == []
    assert searched == []
