"""SimHash near-duplicates, linked exactly within a Hamming radius by pivot distance tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import majority, may_hold, small_batches, table, texts_of, vote_counts, whole_keys, written
from .graph import Forest, block_plan, bucket_forest, components, in_groups, keyed, mixed, near, near_forest

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: The stage of the pipeline: shingles and the least share of them that two near copies have in common.
STAGE_SHINGLE_WORDS, LEAST_SIMILARITY = 5, 0.8
#: Words of the least part of a text that has a fingerprint of its own, and bits that equal parts may differ in. Larger parts
#: have twice, four times, ... as many words; a text has four parts at least, or none.
PART_WORDS, PART_RADIUS = 6, 3
#: Bits that the fingerprints of whole texts may differ in where a part is near. Texts that share 0.8 of their shingles
#: differ in about 5 of 100 pairs of words, which is 6 or 7 bits on average; unlike texts differ in 32.
WHOLE_RADIUS = 16
#: Texts of so many words at most meet by their shingles, too: parts of so few words rarely survive an edit.
SHORT_WORDS = 44
#: Texts of a group that one task compares; larger groups are split into blocks.
GROUP_ROWS = 256
#: Reference fingerprints that are spread over all bits, beside those of the blocks.
WIDE_PIVOTS = 16


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles of a text, A-Z in lower case; zero for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hashes = shingle_hashes(words, shingle_words)
    return int(majority(vote_counts(hashes, np.zeros(1, dtype=np.int64)), np.array([len(hashes)]))[0])


def shingle_hashes(words: list[bytes], shingle_words: int) -> np.ndarray:
    """XXH64 of the shingles of one word or more, in their order; of fewer words than a shingle, of all."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    k = min(shingle_words, len(words))
    starts = np.append(0, ends[:-1] + 1)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]), dtype=">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): the fingerprint of every row, as a signed long. Null texts count as empty."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in texts_of(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


class Pivots:
    """Reference fingerprints and the tables of distances to them.

    Reference 0 is zero. Each block of bits has one reference for each of its prefixes, zero elsewhere; the
    distances to these, less the distance to zero, depend on the block alone and settle its bits. Two
    fingerprints within the radius agree on all of them in some set of blocks, which is the bucket key.
    The other references are spread over all bits. No pair within the radius differs by more than
    the radius in any distance (triangle inequality), so the largest difference discards pairs.
    """

    def __init__(self, radius: int, rows: int):
        self.radius = radius
        self.combos, masks = block_plan(radius, rows)
        refs, self.of_block, begin = [0], [], 0
        for mask in masks:
            bits = [b for b in range(64) if int(mask) >> b & 1]
            refs += [sum(1 << b for b in bits[: k + 1]) for k in range(len(bits))]
            self.of_block.append(np.arange(begin + 1, len(refs)))
            begin = len(refs) - 1
        with np.errstate(over="ignore"):
            wide = mixed(np.arange(1, WIDE_PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            self.odd = mixed(np.arange(101, 101 + len(refs), dtype=np.uint64)) | np.uint64(1)
        self.refs = np.append(np.array(refs, dtype=np.uint64), wide)

    def distances(self, fps: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fps[:, None] ^ self.refs[None, :]).astype(np.int8)

    def keys(self, fps: np.ndarray) -> np.ndarray:
        d = self.distances(fps)
        with np.errstate(over="ignore"):
            part = [((d[:, cols] - d[:, :1]).astype(np.int64).view(np.uint64) * self.odd[cols]).sum(axis=1, dtype=np.uint64) for cols in self.of_block]
            return np.stack([mixed(np.add.reduce([part[b] for b in c]) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) for k, c in enumerate(self.combos)], axis=1)

    def linked(self, fps: np.ndarray):
        """A test of pairs: largest coordinate difference, the wide references first, then the exact distance."""
        d = np.ascontiguousarray(self.distances(fps)[:, ::-1])

        def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.abs(d[i, :4] - d[j, :4]).max(axis=-1) <= self.radius
            a, b = (x[out] for x in np.broadcast_arrays(i, j))
            for cols in (slice(4, WIDE_PIVOTS), slice(WIDE_PIVOTS, None)):
                left = np.abs(d[a, cols] - d[b, cols]).max(axis=1) <= self.radius
                a, b, out[out] = a[left], b[left], left
            out[out] = near(fps[a], fps[b], self.radius)
            return out

        return test


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp, component): documents whose fingerprints are joined by links of at most radius bits.

    component is the least id that can be reached. Null and empty texts have fingerprint zero and link like
    any other. Rows with equal ids or texts each keep their row. Null ids are kept and never name a
    component unless all ids of it are null. Other columns of docs are not looked at.
    Equal fingerprints count once before any comparison, so copies cost nothing but their row.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle_words), "fps")
    firsts = written(fps.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    pivots = Pivots(radius, firsts.count())
    joined = components(near_forest(firsts, pivots.keys, pivots.linked))
    roots = written(firsts.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    least = written(roots.groupBy("root").agg(F.min("first").alias("component")), "components")
    of_fp = written(roots.join(least, "root").select("fp", "component"), "of_fp")
    return fps.join(of_fp, "fp").select("id", "fp", "component")


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


class WordHashes(dict):
    """Hashes of words, some of them kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def part_prints(text: str, hashes: WordHashes) -> list[int]:
    """SimHash of the pairs of neighbouring words of a text, A-Z in lower case, each pair once, then of its parts.

    Parts are runs of equal length, counted from the beginning in the first half of a text and from the end in the second, so
    that words put in or left out at one place move no part before or after it. Texts just above a step of the
    length of parts have those of the step below as well, as a near copy may fall there.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return []
    own = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    with np.errstate(over="ignore"):
        own = mixed(own * np.uint64(0x9E3779B97F4A7C15) + np.append(own[1:], np.uint64(0)))
    step = PART_WORDS
    while 8 * step <= n:
        step *= 2
    least = step // 2 if PART_WORDS < step and n < 5 * step else step
    p = n // 2 // least if n >= 4 * PART_WORDS else 0
    cuts = [least * k for k in range(p)] + [least * p] * (2 * least * p < n) + [n - least * k for k in range(p, 0, -1)]
    counts = vote_counts(own, np.array(cuts))
    every = np.unique(own)
    fps = [majority(vote_counts(every, np.zeros(1, dtype=np.int64)), np.array([len(every)]))]
    if p:
        q = p // 2
        levels = [(least, counts[:p], counts[-p:])]
        if least < step:
            levels.append((step, counts[: 2 * q].reshape(q, 2, 64).sum(axis=1), counts[len(counts) - 2 * q :].reshape(q, 2, 64).sum(axis=1)))
        fps += [majority(x, np.full(len(x), size)) for size, *sides in levels for x in sides]
    return np.concatenate(fps).tolist()


def short_keys(text: str, shingle_words: int, least: float) -> tuple[list[int], int, int]:
    """(keys, sketch, size) of a text of SHORT_WORDS words at most, ([], 0, 0) of a longer or empty one.

    keys are the least of the hashes of its distinct shingles, so many that two such texts whose sets have a Jaccard
    similarity of least or more share one (prefix filter). sketch has the bit of each shingle, size is their number.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split(None, SHORT_WORDS)
    if not words or len(words) > SHORT_WORDS:
        return [], 0, 0
    own = np.unique(shingle_hashes(words, shingle_words))
    bits = np.bitwise_or.reduce(np.uint64(1) << (own & np.uint64(63)))
    return own[: len(own) - math.ceil(least * len(own) - 1e-9) + 1].tolist(), int(bits), len(own)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = STAGE_SHINGLE_WORDS, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(text_key, root): texts that are joined by links, for every text with a word that has a link; root is one of their keys.

    A link: the sets of word shingles have a Jaccard similarity of least or more, and either both texts have SHORT_WORDS words
    at most, or a part (or the whole) of one has a fingerprint within PART_RADIUS bits of that of a part of the other
    and the whole texts are within WHOLE_RADIUS. Candidates come by pivot distance tables over the parts' fingerprints,
    as most edits leave a part of a text alone, and for short texts by the keys of short_keys, where sketches that differ in
    more bits than such sets differ in shingles discard pairs. Only texts with a candidate are moved to be compared.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    #: Shingles that one of two linked sets has alone, as a share of the sum of their sizes.
    apart = (1 - least) / (1 + least) + 1e-9

    def lists(found):
        cuts = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.array([x for f in found for x in f], dtype=np.uint64).view(np.int64)))

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            texts = texts_of(batch.column("text"))
            short = [short_keys(t, shingle_words, least) for t in texts]
            sketches = np.array([s for _, s, _ in short], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), lists([part_prints(t, hashes) for t in texts]), lists([k for k, _, _ in short]), pa.array(sketches), pa.array([n for _, _, n in short], pa.int64())],
                names=["node", "fps", "keys", "sketch", "size"],
            )

    named = docs.select(F.xxhash64(text).alias("node"), text.alias("text"))
    prints = written(named.mapInArrow(run, "node long, fps array<long>, keys array<long>, sketch long, size long").where(F.size("fps") > 0).dropDuplicates(["node"]), "prints")
    pivots = Pivots(PART_RADIUS, 6 * prints.count())
    # the lowest bit of a key tells keys of shingles, whose rows have the sketch and the size, from those of parts
    even = F.col("key").bitwiseAND(F.lit(-2))

    def rows_of(some):
        points = some.select("node", F.explode(F.array_distinct("fps")).alias("fp"), F.get("fps", F.lit(0)).alias("whole"))
        by_part = keyed(points, pivots.keys).withColumn("key", even)
        by_shingle = some.select(F.explode("keys").alias("key"), "node", F.col("sketch").alias("fp"), F.col("size").alias("whole")).withColumn("key", even.bitwiseOR(F.lit(1)))
        return by_part.unionByName(by_shingle)

    def linked(columns):
        fps, wholes, short = columns["fp"].view(np.uint64), columns["whole"], (columns["group"] & 1).astype(bool)
        test = pivots.linked(fps)

        def pairs(i, j):
            few = np.bitwise_count(fps[i] ^ fps[j]) <= apart * (wholes[i] + wholes[j])
            return np.where(short[i], few, (np.bitwise_count(wholes[i].view(np.uint64) ^ wholes[j].view(np.uint64)) <= WHOLE_RADIUS) & test(i, j))

        return pairs

    roots = written(components(bucket_forest(prints, rows_of, linked)), "candidates")
    members = prints.join(roots, "node").select("node", "fps", "sketch", "size", "root")
    texts = named.where(may_hold(roots, "node")(F.col("node")))
    said = written(texts.join(members, "node").dropDuplicates(["node"]), "said")

    def compare(batches):
        for t in whole_keys(batches, "group"):
            group, nodes = t.column("group").to_numpy(), t.column("node").to_numpy()
            fps = [np.array(x, dtype=np.int64).view(np.uint64) for x in t.column("fps").to_pylist()]
            wholes, own = np.array([f[0] for f in fps], dtype=np.uint64), [None] * len(nodes)
            sketches, sizes = t.column("sketch").to_numpy().view(np.uint64), t.column("size").to_numpy()
            last, forest = np.searchsorted(group, group, side="right"), Forest(len(nodes))

            def shingles(i):
                if own[i] is None:
                    own[i] = np.unique(shingle_hashes(t.column("text")[i].as_py().encode("utf-8", "surrogatepass").lower().split(), shingle_words))
                return own[i]

            for i in range(len(nodes)):
                rest = slice(i + 1, last[i])
                short = (sizes[i] > 0) & (sizes[rest] > 0) & (np.bitwise_count(sketches[rest] ^ sketches[i]) <= apart * (sizes[rest] + sizes[i]))
                for j in (np.flatnonzero(short | near(wholes[rest], wholes[i], WHOLE_RADIUS)) + i + 1).tolist():
                    if forest.find(i) != forest.find(j) and (short[j - i - 1] or near(fps[i][:, None], fps[j][None, :], PART_RADIUS).any()):
                        a, b = shingles(i), shingles(j)
                        if min(len(a), len(b)) >= least * max(len(a), len(b)):
                            both = len(np.intersect1d(a, b, assume_unique=True))
                            if both >= least * (len(a) + len(b) - both):
                                forest.join(np.array([i]), np.array([j]))
                own[i] = None
            root = forest.roots()
            if len(moved := np.flatnonzero(root != np.arange(len(nodes)))):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])

    placed = in_groups(said, "node", GROUP_ROWS)
    edges = placed.repartition("group").sortWithinPartitions("group", "node").mapInArrow(compare, "a long, b long")
    return components(edges).select(F.col("node").alias("text_key"), "root")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of equal texts and near copies: that of the least id, null ids last.

    Near copies are those of near_copies: five-word shingles, similarity 0.8 or more, candidates by pivot distance tables. Rows
    that repeat id and text are one; of those with other columns that differ, any one stays. Equal ids
    with different texts are different documents. Texts without a word are equal to one another. An empty table stays empty.
    """
    small_batches(spark)
    word = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    none = F.lit(0).cast("bigint")
    # two hashes of 64 bits with different seeds name a text
    named = docs.withColumn("_q_key", F.when(word, F.xxhash64(F.col("text"))).otherwise(none)).withColumn("_q_more", F.when(word, F.xxhash64(F.lit(7), F.col("text"))).otherwise(none))
    roots = written(near_copies(docs), "near").withColumnRenamed("text_key", "_q_key")
    placed = written(named.select("doc_id", "_q_key", "_q_more").join(roots, "_q_key", "left"), "placed")
    own = [F.coalesce("root", "_q_key").alias("group"), F.when(F.col("root").isNull(), F.col("_q_more")).otherwise(none).alias("more")]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("_q_key").alias("key"))).alias("first")
    groups = written(placed.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), first).where("n > 1"), "copied")
    touched = written(placed.select(*own, "_q_key").join(groups, ["group", "more"]).select("_q_key", "first").distinct(), "touched")
    test = may_hold(touched, "_q_key")
    aside, some = named.where(~test(F.col("_q_key"))), named.where(test(F.col("_q_key")))
    met = some.join(touched.withColumnRenamed("_q_key", "_q_own"), F.col("_q_key") == F.col("_q_own"), "left")
    stays = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("_q_key") == F.col("first.key")))
    kept = met.where(stays)
    alone, repeated = kept.where("first IS NULL"), kept.where("first IS NOT NULL").dropDuplicates(["doc_id", "_q_key"])
    return aside.select(*docs.columns).unionByName(alone.select(*docs.columns)).unionByName(repeated.select(*docs.columns))
