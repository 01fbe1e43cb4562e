"""Connected components and the exact join of near fingerprints, both without pairs of whole groups."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_keys, written

#: Edges of a graph that are contracted at a time; a graph of more takes rounds of shuffles.
TASK_EDGES = 65_536
#: Members of one bucket that are compared in one task; larger buckets are split into blocks.
BUCKET_ROWS = 2048
#: One node in so many is looked at to tell large buckets.
COUNTED = 16
#: Members of a bucket from which on its pairs are compared as a square, and pairs that are compared at a time.
SQUARE_RUN, SQUARE_PAIRS = 32, 1 << 14
#: Rows of a group of one chunk; a group of 100 times as many has 10 chunks of 10 times as many rows.
CHUNK_SQUARE = 32
#: Members of a bucket by chance alone that the number of key bits is chosen for.
CHANCE_ROWS = 400


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node that can be reached.

    Edges are contracted where they are, a chunk of TASK_EDGES at a time. What then still has more edges than one chunk goes
    through alternating large-star and small-star rounds, until it is a star forest or fits a chunk. The minima are
    written before they are joined back, so that both sides of each join are plain shuffles and Spark can split the rows of a hub.
    """
    stars = written(_contracted(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    while (rows := stars.count()) > TASK_EDGES and not _is_star_forest(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        stars = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    if rows <= TASK_EDGES:
        stars = written(_contracted(stars.coalesce(1)), "small")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what those of each chunk of a task's edges connect: every node beside the least it reaches there."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TASK_EDGES):
                part = batch.slice(at, TASK_EDGES)
                if rows + part.num_rows > TASK_EDGES:
                    yield from stars_of(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        yield from stars_of(held)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema)
    return edges.mapInArrow(run, kinds)


def stars_of(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The star forest of the edges (u, v) of some batches; roots are the least nodes."""
    if not (n := sum(b.num_rows for b in batches)):
        return
    ends = pa.chunked_array([b.column(c) for c in ("u", "v") for b in batches]).combine_chunks()
    nodes = ends.unique().sort()
    at = pc.index_in(ends, nodes).to_numpy()
    forest = Forest(len(nodes))
    forest.join(at[:n], at[n:])
    root = forest.roots()
    own = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([nodes.take(pa.array(own)), nodes.take(pa.array(root[own]))], names=["u", "v"])


def _is_star_forest(stars: DataFrame) -> bool:
    """Each u hangs on one v, and no v hangs on another node."""
    if not stars.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return stars.select(F.col("v").alias("u")).distinct().join(stars.select("u"), "u", "left_semi").isEmpty()


def block_plan(radius: int, rows: int) -> list[np.ndarray]:
    """Bit masks of which fingerprints within radius share at least one whole.

    With b blocks, two fingerprints within radius agree on at least b - radius of them. The fewest blocks
    are taken that leave about CHANCE_ROWS of so many random fingerprints in a bucket; any b is exact.
    """
    blocks = radius + 1
    while rows / 2 ** (64 * (blocks - radius) / blocks) > CHANCE_ROWS and blocks < radius + 4:
        blocks += 1
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    own = [((1 << b) - (1 << a)) for a, b in itertools.pairwise(edges)]
    return [np.array(sorted(x), dtype=np.int64) for x in itertools.combinations(range(blocks), blocks - radius)], [np.uint64(m) for m in own]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with well spread bits."""
    out = x >> np.uint64(30)
    out ^= x
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def masked_keys(radius: int, rows: int) -> Callable[[np.ndarray], np.ndarray]:
    """Keys (n, k) of fingerprints: one for each set of blocks that a pair within radius may agree on."""
    combos, own = block_plan(radius, rows)

    def keys(fps: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.stack([mixed((fps & np.bitwise_or.reduce([own[b] for b in c])) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) for k, c in enumerate(combos)], axis=1)

    return keys


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


class Forest:
    """Union-find over positions; roots are the least members."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, pairs_a: np.ndarray, pairs_b: np.ndarray) -> None:
        for i, j in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
            a, b = self.find(i), self.find(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if np.array_equal(higher, self.up):
                return self.up
            self.up = higher


def same_key_pairs(keys: np.ndarray, test: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs with equal keys that meet a test, from sorted keys.

    test takes two arrays of positions that broadcast. Runs of SQUARE_RUN or more equal keys are compared as squares, some rows of
    at most SQUARE_PAIRS pairs at a time; shorter runs by the distance of their members, all runs at once.
    """
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(first, len(keys)))
    for a, n in zip(first[sizes >= SQUARE_RUN].tolist(), sizes[sizes >= SQUARE_RUN].tolist(), strict=True):
        at = a
        while at < a + n - 1:
            rows = min(max(1, SQUARE_PAIRS // (a + n - at)), a + n - at)
            i, j = np.nonzero(test(np.arange(at, at + rows)[:, None], np.arange(at, a + n)[None, :]))
            below = i < j
            if below.any():
                yield i[below] + at, j[below] + at
            at += rows
    short = (sizes > 1) & (sizes < SQUARE_RUN)
    left = np.repeat(first[short] + sizes[short], sizes[short])
    at = left - _countdown(sizes[short])
    d = 1
    while len(at):
        on = at + d < left
        at, left = at[on], left[on]
        hit = at[test(at, at + d)]
        if len(hit):
            yield hit, hit + d
        d += 1


def _countdown(sizes: np.ndarray) -> np.ndarray:
    """n, n - 1, ..., 1 for each n."""
    return np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())


def near_forest(points: DataFrame, keys: Callable[[np.ndarray], np.ndarray], linked: Callable[[np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """Edges (a, b) that connect just what the links between fingerprints connect.

    points has one row for each distinct fingerprint, fp. keys gives the bucket keys of fingerprints; linked
    takes an array of fingerprints and returns a test of pairs of its positions (arrays that broadcast).
    """
    own = points.select(F.col("fp").alias("node"), "fp")
    return bucket_forest(own, lambda some: keyed(some, keys), lambda columns: linked(columns["fp"].view(np.uint64)))


def keyed(points: DataFrame, keys: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """points with key, one row for each bucket key of its fingerprint fp."""
    names = points.columns

    def emit(batches):
        for batch in batches:
            k = keys(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), k.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64)), *(batch.column(c).take(rows) for c in names)], names=["key", *names])

    return points.mapInArrow(emit, "key long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema))


def bucket_forest(points: DataFrame, rows_of: Callable[[DataFrame], DataFrame], linked: Callable[[dict[str, np.ndarray]], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """Edges (a, b) between nodes that connect just what the links within buckets connect.

    rows_of gives the rows of points, which have node: key, node and whatever linked looks at, all numbers; linked takes
    these columns and returns a test of pairs of positions. Each bucket gives a spanning forest, so at most one edge for each member.
    Buckets of about BUCKET_ROWS or more, told by the rows of one node in COUNTED before anything is moved, are split into
    blocks: pairs of chunks, each its own group; how a bucket is split does not change what is found. linked sees the group as a column too; its lowest bit is that of the key.
    """
    rows = rows_of(points)
    others = [c for c in rows.columns if c != "key"]

    def compare(batches):
        for t in whole_keys(batches, "group"):
            columns = {c: t.column(c).to_numpy() for c in ["group", *others]}
            key, nodes = columns["group"], columns["node"]
            forest = Forest(len(nodes))
            for i, j in same_key_pairs(key, linked(columns)):
                while (apart := forest.up[i] != forest.up[j]).any():
                    i, j = i[apart], j[apart]
                    some = np.unique(j, return_index=True)[1]
                    forest.join(i[some], j[some])
                    forest.roots()
            root = forest.roots()
            if len(own := np.flatnonzero(nodes[root] != nodes)):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["a", "b"])

    few = rows_of(points.where(F.pmod(F.xxhash64("node"), F.lit(COUNTED)) == 0))
    hot = written(few.groupBy("key").agg((F.count(F.lit(1)) * COUNTED).alias("count")).where(F.col("count") > BUCKET_ROWS), "hot")
    if hot.isEmpty():
        grouped = rows.select(F.col("key").alias("group"), *others)
    else:
        grouped = rows.join(hot, "key", "left").select("key", *others, F.explode(blocks(F.col("node"), F.col("count"))).alias("block"))
        own = F.xxhash64("key", "block").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("key").bitwiseAND(F.lit(1)))
        grouped = grouped.select(F.when(F.col("block") < 0, F.col("key")).otherwise(own).alias("group"), *others)
    return grouped.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "a long, b long")


def in_groups(members: DataFrame, member: str, most: int) -> DataFrame:
    """members, which have root, with group in its place: the root, or for a root of more than most members a block of it.

    The roots over most are counted first; their members are repeated by blocks, so that no task holds a whole group.
    """
    sizes = written(members.groupBy("root").count().where(F.col("count") > most), "sizes")
    others = [c for c in members.columns if c != "root"]
    if sizes.isEmpty():
        return members.select(F.col("root").alias("group"), *others)
    placed = members.join(sizes, "root", "left").select("root", *others, F.explode(blocks(F.col(member), F.col("count"))).alias("block"))
    return placed.select(F.when(F.col("block") < 0, F.col("root")).otherwise(F.xxhash64("root", "block")).alias("group"), *others)


def blocks(member: Column, rows: Column) -> Column:
    """The blocks of a member of a group of so many rows, as numbers of pairs of chunks; -1 alone where rows is null.

    A group of n rows has about sqrt(n / CHUNK_SQUARE) chunks, so that neither the chunks' size nor the
    number of copies of a row grows with more than the root of n. Every two members share a block.
    """
    n = F.ceil(F.sqrt(rows / F.lit(CHUNK_SQUARE))).cast("int")
    own = F.pmod(F.xxhash64(member), n)
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(own, j) * n + F.greatest(own, j))
    return F.when(rows.isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(pairs.cast("array<bigint>"))
