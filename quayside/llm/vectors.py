"""Near copies among embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_to_owner, table, whole_keys, written
from .graph import CHUNK_SQUARE, Forest, components, mixed

COSINE = 0.9
#: Chance that a pair just at the least cosine meets in a table; pairs above it meet more often.
RECALL = 0.99
#: Unlike vectors that a bucket holds by chance alone; the number of hyperplanes of a table follows from it.
CHANCE_ROWS = 512
#: Members of one bucket that are compared in one task; larger buckets are split into blocks.
BUCKET_ROWS = 2048
#: Rows of a bucket that are multiplied with all others at a time.
STRIP_ROWS = 256


def hash_plan(rows: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(tables, bits): bits so that a bucket holds about CHANCE_ROWS of so many unlike vectors, tables for the recall.

    A hyperplane parts two vectors with the chance angle / pi, so a table of b bits keeps them together with (1 - angle / pi) ** b.
    """
    bits = min(60, max(3, math.ceil(math.log2(max(rows, 1) / CHANCE_ROWS)))) if rows > CHANCE_ROWS else 3
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-together))), bits


def planes(tables: int, bits: int, dims: int, seed: int) -> np.ndarray:
    """The normals of the hyperplanes, (tables * bits, dims), alike in every task."""
    return np.random.default_rng([seed, dims]).standard_normal((tables * bits, dims))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by their largest part first, so that no square overflows or vanishes."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def sign_keys(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """The key of each vector in each table, (n, tables), as unsigned 64-bit numbers."""
    signs = unit_rows(vectors) @ planes(tables, bits, vectors.shape[1], seed).T > 0
    powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    return (signs.reshape(len(vectors), tables, bits) * powers).sum(axis=2, dtype=np.uint64)


def usable(vector: Column) -> Column:
    """The vector has a part other than zero, and no null or non-finite ones."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _keyed(classes: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """classes (node, size, vector), each once in each table, with its keys in all tables as sig."""

    def emit(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            column = batch.column("vector")
            lengths, flat = pc.list_value_length(column).to_numpy(), column.flatten().to_numpy()
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths):
                own = np.flatnonzero(lengths == dims)
                sigs = sign_keys(flat[starts[own][:, None] + np.arange(dims)], tables, bits, seed)
                blobs = pa.array([s.tobytes() for s in sigs], pa.binary())
                rows = batch.take(pa.array(own))
                for t in range(tables):
                    with np.errstate(over="ignore"):
                        key = mixed(sigs[:, t] + np.uint64((t * 1_000_003 + int(dims)) * 0x9E3779B97F4A7C15 % 2**64))
                    numbers = pa.array(np.full(len(own), t, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), numbers, rows.column("node"), rows.column("size"), blobs, rows.column("vector")], names=["key", "table", "node", "size", "sig", "vector"])

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("node", "size", "vector").mapInArrow(emit, f"key long, table int, node long, size long, sig binary, vector {kind}")


def compared(vectors: np.ndarray, chunks: np.ndarray, sigs: np.ndarray, table: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i before j, of pairs of at least the cosine, strip by strip.

    A pair counts in the first table that both share a key of, so later tables leave it out. Where the group is a
    block of two chunks, only pairs from one to the other count; each chunk also has a block of its own.
    """
    unit, crossing, n = unit_rows(vectors), len(np.unique(chunks)) > 1, len(vectors)
    for a in range(0, n, STRIP_ROWS):
        b = min(a + STRIP_ROWS, n)
        i, j = np.nonzero(unit[a:b] @ unit[a:].T >= cosine)
        ahead = j > i
        i, j = i[ahead] + a, j[ahead] + a
        if crossing:
            apart = chunks[i] != chunks[j]
            i, j = i[apart], j[apart]
        if table:
            new = ~(sigs[i, :table] == sigs[j, :table]).any(axis=1)
            i, j = i[new], j[new]
        if len(i):
            yield i, j


def links(classes: DataFrame, cosine: float = COSINE, recall: float = RECALL, seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b, n) between distinct vectors, classes (node, size, vector): rows with b connect what links connect, rows without
    b say that a was linked to n more vectors, counting each node by its size.

    Pairs themselves never leave a task. Buckets over bucket_rows are counted first and split into blocks of chunks.
    """
    tables, bits = hash_plan(classes.count(), cosine, recall)
    rows = written(_keyed(classes, tables, bits, seed), "sign_keys")
    hot = rows.groupBy("key").count().where(F.col("count") > bucket_rows)
    placed = joined_to_owner(rows, written(hot, "hot_buckets"), ["key"], "count")
    n = F.ceil(F.sqrt(F.col("count") / F.lit(CHUNK_SQUARE))).cast("int")
    spread = placed.withColumn("chunk", F.when(F.col("count").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), n)).cast("int"))
    others = F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1))
    spread = spread.withColumn("other", F.explode(others)).withColumn("group", F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")))
    # a block of two chunks that holds one of them alone has no pairs of its own
    spread = spread.withColumn("crosses", F.col("chunk") != F.col("other"))

    def compare(batches):
        for t in whole_keys(batches, "group"):
            groups = t.column("group").to_numpy()
            node, size, chunk, number, crosses = (t.column(c).to_numpy() for c in ("node", "size", "chunk", "table", "crosses"))
            cuts = np.flatnonzero(np.diff(groups)) + 1
            a_out, b_out, n_out = [], [], []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(groups)], strict=True):
                if hi - lo < 2 or crosses[lo] and len(np.unique(chunk[lo:hi])) < 2:
                    continue
                own = t.slice(lo, hi - lo)
                flat = own.column("vector").combine_chunks().flatten().to_numpy()
                vectors = flat.reshape(hi - lo, -1)
                sigs = np.frombuffer(b"".join(own.column("sig").to_pylist()), dtype="<u8").reshape(hi - lo, -1)
                forest, counts = Forest(hi - lo), np.zeros(hi - lo, dtype=np.int64)
                for i, j in compared(vectors, chunk[lo:hi], sigs, int(number[lo]), cosine):
                    np.add.at(counts, i, size[lo:hi][j])
                    np.add.at(counts, j, size[lo:hi][i])
                    for k in np.unique(i):
                        with_k = np.unique(forest.roots()[j[i == k]])
                        forest.join(np.full(len(with_k), k), with_k)
                root, linked = forest.roots(), np.flatnonzero(counts)
                moved = np.flatnonzero(root != np.arange(hi - lo))
                a_out += [node[lo:hi][linked], node[lo:hi][moved]]
                b_out += [pa.nulls(len(linked), pa.int64()), pa.array(node[lo:hi][root[moved]])]
                n_out += [pa.array(counts[linked]), pa.nulls(len(moved), pa.int64())]
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.concat_arrays(b_out), pa.concat_arrays(n_out)], names=["a", "b", "n"])

    grouped = spread.select("group", "table", "node", "size", "chunk", "crosses", "sig", "vector")
    return grouped.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "a long, b long, n long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, n_links, component, kept) for every row: how many other vectors have at least the cosine, and the least id reachable by links.

    Equal vectors are one class, linked among themselves whatever the hashing; the cosines of the others are those of double
    precision, of pairs that share a key in some table. Vectors that are null, empty, zero or hold null or non-finite parts,
    and rows without an id, link with nothing; the latter have no component and are not kept. Vectors of different lengths do
    not link. Rows that repeat an id count as vectors of their own with that id. Other columns are not looked at. An empty table
    gives one.
    """
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    able = F.col("id").isNotNull() & usable(F.col("vector"))
    digests = [F.when(able, F.xxhash64(F.lit(k), "vector")).alias(f"d{k}") for k in (1, 2)]
    rows = written(own.select("id", "vector", *digests), "vectors")
    classes = rows.where(F.col("d1").isNotNull()).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least"), F.first("vector").alias("vector"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector_classes")
    found = written(links(classes, cosine, recall, seed, bucket_rows), "vector_links")
    counted = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = written(components(found.where(F.col("b").isNotNull()).select("a", "b")), "vector_roots")
    named = classes.select("d1", "d2", "node", "size", "least").join(counted, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named, "vector_named")
    sizes = named.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.min("least").alias("component"))
    whole = joined_to_owner(named, written(sizes, "vector_components"), ["root"], "members")
    owners = written(whole.select("d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component", "size"), "vector_owners")
    placed = joined_to_owner(rows.select("id", "d1", "d2"), owners, ["d1", "d2"], "size")
    component = F.coalesce("component", "id")
    return placed.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def op12_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
