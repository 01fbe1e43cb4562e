import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import vectors

SCHEMA = "vec_id bigint, embedding array<float>"


def slow(rows, cosine=0.9):
    """(id, n_links, component, kept) by comparing all pairs; none of these tests has a cosine within rounding of the limit."""
    able = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(v)]
    unit = {k: np.float32(rows[k][1]).astype(float) for k in able}
    unit = {k: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for k, v in unit.items()}
    near = {k: [j for j in able if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= cosine] for k in able}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen), default=None) if i is not None else None
        out.append(str((i, len(near.get(k, [])), least, i is not None and least == i)))
    return sorted(out)


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def cloud(rng, groups, dims=24):
    """Groups of vectors around a centre, some chained to the next, and vectors on their own; well away from the limit."""
    rows = []
    for size in groups:
        centre = rng.standard_normal(dims)
        rows += [centre + rng.standard_normal(dims) * 0.05 for _ in range(size)]
    return rows


ODD = [None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 0.0], [1.0, 1e-9], [3.0, 0.0], [1e-38, 0.0], [1e38, 1.0], [-1.0, 0.0], [1.0], [2.0], [-2.0]]


def test_odd_vectors(spark):
    rows = [(i, v) for i, v in enumerate(ODD)] + [(None, [1.0, 0.0]), (None, None), (6, [1.0, 0.0]), (6, [0.0, 1.0]), (40, [0.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS node", "3 AS size", "'x' AS vector", "4 AS d1", "5 AS component", "6 AS n_links", "7 AS kept", "8 AS label")
    assert got(vectors.near_vectors(df)) == slow(rows)


@pytest.mark.parametrize("bucket_rows", [2048, 40])
def test_groups_against_all_pairs(spark, bucket_rows):
    """With small buckets every group is split into blocks of chunks; no link is lost or counted twice."""
    rng = np.random.default_rng(3)
    parts = cloud(rng, [300, 90, 12, 2, 2] + [1] * 150)
    copy = parts[0]
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(5000), parts + [copy] * 120, strict=False)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(vectors.near_vectors(df, recall=0.999999, bucket_rows=bucket_rows)) == slow(rows)


def test_recall_at_the_limit(spark):
    """Pairs that just reach the cosine are found at the stated rate, beside 20,000 unlike vectors; none is made up."""
    rng = np.random.default_rng(9)
    one = rng.standard_normal((1000, 32))
    one /= np.linalg.norm(one, axis=1)[:, None]
    side = rng.standard_normal((1000, 32))
    side -= (side * one).sum(axis=1)[:, None] * one
    side /= np.linalg.norm(side, axis=1)[:, None]
    other = 0.901 * one + np.sqrt(1 - 0.901**2) * side
    noise = rng.standard_normal((18000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([one, other, noise]))]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    hits = {r["id"]: (r["n_links"], r["component"]) for r in found.where("n_links > 0").collect()}
    paired = sum(hits.get(i + 1000, (0, None))[1] == i for i in range(1000))
    assert paired >= 975
    assert all(n == 1 and c in (i, i - 1000) for i, (n, c) in hits.items())


def test_more_tables_for_more_rows():
    plans = [vectors.hash_plan(n) for n in (0, 10, 10_000, 10_000_000, 10**10)]
    assert plans == sorted(plans)
    for tables, bits in plans:
        assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables >= 0.99


def test_empty_table(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_all_pairs(spark, sf_dir):
    """The query's own table, with copies and near copies of its rows beside it."""
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    moved = F.transform("embedding", lambda x, i: (x * F.lit(1.5) + F.lit(0.02) * F.pmod(i, F.lit(2))).cast("float"))
    more = own.unionByName(own.where("vec_id % 3 = 0").select((F.col("vec_id") + 10_000).alias("vec_id"), moved.alias("embedding")))
    rows = [tuple(r) for r in more.collect()]
    assert got(vectors.near_vectors(more, recall=0.999999)) == slow(rows)
    assert got(vectors.op12_embedding_near_dedup(spark, sf_dir)) == slow([tuple(r) for r in own.collect()])
