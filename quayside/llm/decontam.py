"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted shingles of passages."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bitmap_of, in_bitmap, may_hold, small_batches, table, texts_of, written
from .graph import mixed

SHINGLE_WORDS = 5
LEAST_SIMILARITY = 0.8
#: Bits that a window's fingerprint may differ in from that of its item. A fifth of other words is 13 bits on average.
RADIUS = 19
#: Blocks of the fingerprints; within the radius one block differs in at most RADIUS // BLOCKS bits.
BLOCKS = 4
#: Words beside the aligned passage in which shingles are looked for.
SLACK = 2
#: Items of one index. Of larger benchmarks each slice is searched for in the texts that may hold anything of the benchmark.
SLICE_ITEMS = 2_000
BLOCK_WORDS = 16_384
#: Places of a shingle in the filter of texts, and its bits: 8 MB at most.
FILTER_PLACES, FILTER_BITS = 3, 1 << 26
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words in lower case, without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


class WordHashes(dict):
    """64-bit hashes of words, some of them kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 11)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """(words + 1, 64): how many of the words before a place have each bit set."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def window_prints(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of the words of each window, from the sums of bit_sums."""
    counts = sums[ends] - sums[begins]
    return np.packbits(2 * counts > (ends - begins)[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def rolled_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words."""
    n = max(len(hashes) - k + 1, 0)
    rolled = np.full(n, k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k if n else 0):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
            rolled ^= rolled >> np.uint64(31)
    return rolled


def shingles(hashes: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of each shingle; a shingle weighs the bytes of its words. Fewer words: one shingle of all."""
    k = min(SHINGLE_WORDS, len(words))
    n = len(words) - k + 1 if words else 0
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    weight = np.zeros(n, dtype=np.int64)
    for i in range(k if n else 0):
        weight += lengths[i : i + n]
    return rolled_hashes(hashes, k)[:n], weight


@dataclass
class Item:
    item_id: object
    words: int
    shingles: np.ndarray  # sorted, without repeats
    weights: np.ndarray  # of each, times its count
    counts: np.ndarray

    def held(self, passage: np.ndarray) -> float:
        """The share of the item's shingle weight that a passage holds, repeats counted as often as they are there."""
        at = np.searchsorted(self.shingles, passage)
        at[at == len(self.shingles)] = 0
        hit = at[self.shingles[at] == passage]
        if not len(hit):
            return 0.0
        found = np.minimum(np.bincount(hit, minlength=len(self.shingles)), self.counts)
        return float((self.weights * found / self.counts).sum() / self.weights.sum())


class Index:
    """The items' fingerprints by their number of words, each under the values of its blocks, and their shingles."""

    def __init__(self, items: list[tuple[object, str]], radius: int = RADIUS):
        self.radius, self.items, of_size, own = radius, [], {}, WordHashes()
        for item_id, text in items:
            words = words_of(text or "")
            if not words:
                continue
            h = own.of(words)
            rolled, weight = shingles(h, words)
            unique, first, counts = np.unique(rolled, return_index=True, return_counts=True)
            of_size.setdefault(len(words), []).append((int(window_prints(bit_sums(h), np.array([0]), np.array([len(h)]))[0]), len(self.items)))
            self.items.append(Item(item_id, len(words), unique, weight[first] * counts, counts))
        self.sizes = sorted(of_size)
        self.reach = max(self.sizes, default=0) + SLACK
        self.anchors = {s: tuple(np.array([x[k] for x in a], dtype=np.uint64 if k == 0 else np.int64) for k in range(2)) for s, a in of_size.items()}
        self.tables = {s: [self._by_value(a[0], b) for b in range(BLOCKS)] for s, a in self.anchors.items()}
        self.shingle_sizes = sorted({min(SHINGLE_WORDS, s) for s in self.sizes})
        self.shingles = np.unique(np.concatenate([i.shingles for i in self.items] or [np.zeros(0, dtype=np.uint64)]))

    def places(self, rolled: np.ndarray) -> np.ndarray:
        """Where a shingle is one of the items'."""
        at = np.searchsorted(self.shingles, rolled)
        at[at == len(self.shingles)] = 0
        return np.flatnonzero(self.shingles[at] == rolled)

    def _by_value(self, prints: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The values of a block that are near enough to that of an anchor, sorted, and their anchors."""
        bits, most = 64 // BLOCKS, self.radius // BLOCKS
        every = np.arange(1 << bits, dtype=np.uint64)
        flips = every[np.bitwise_count(every) <= most]
        value = prints >> np.uint64(bits * block) & np.uint64((1 << bits) - 1)
        near = (value[:, None] ^ flips[None, :]).astype(np.uint16).reshape(-1)
        order = np.argsort(near, kind="stable")
        return near[order], (order // len(flips)).astype(np.int32)

    def near(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, anchor) of every pair within the radius, each once."""
        anchors, found = self.anchors[size][0], []
        values = np.ascontiguousarray(prints).view("<u2").reshape(-1, BLOCKS)
        for block, (value, own) in enumerate(self.tables[size]):
            first = np.searchsorted(value, values[:, block], side="left")
            n = np.searchsorted(value, values[:, block], side="right") - first
            window = np.repeat(np.arange(len(prints)), n)
            anchor = own[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            close = np.bitwise_count(prints[window] ^ anchors[anchor]) <= self.radius
            found.append(window[close] * len(anchors) + anchor[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(anchors), pairs % len(anchors)


def pieces_of(texts: list[str], reach: int):
    """(words, text of each piece, its first word, words of the text before it) of whole texts or overlapping pieces of long ones, many at a time."""
    words: list[bytes] = []
    at: list[int] = []
    starts: list[int] = []
    skipped: list[int] = []
    for t, text in enumerate(texts):
        own = words_of(text)
        for begin in range(0, max(len(own) - 2 * reach, 1), BLOCK_WORDS):
            piece = own[begin : begin + BLOCK_WORDS + 2 * reach] if len(own) > BLOCK_WORDS else own
            at.append(t)
            starts.append(len(words))
            skipped.append(begin)
            words += piece
            if len(words) >= BLOCK_WORDS:
                yield words, np.array(at), np.array(starts), np.array(skipped)
                words, at, starts, skipped = [], [], [], []
            if piece is own:
                break
    if words:
        yield words, np.array(at), np.array(starts), np.array(skipped)


def search(texts: list[str], index: Index, hashes: WordHashes, least: float = LEAST_SIMILARITY) -> list[tuple[int, object, float, int]]:
    """(text, item_id, similarity, first word) of the best passage of each item in each text that holds it.

    Windows have the items' numbers of words, begin at every word and end with the text; only those that touch a shingle of
    an item are looked at, as others hold nothing. Their fingerprints lead to the items within the radius,
    and the weighted shingles decide. Of equally similar passages the one is best that needs the slack least, then the earliest.
    """
    best: dict[tuple[int, int], tuple[float, float, int]] = {}
    if not index.items:
        return []
    for words, text_of, starts, skipped in pieces_of(texts, index.reach):
        h, ends, sums = hashes.of(words), np.append(starts[1:], len(words)), None
        for k in index.shingle_sizes:
            rolled = rolled_hashes(h, k)
            place = index.places(rolled)
            piece = np.searchsorted(ends, place, side="right")
            whole = place + k <= ends[piece]
            place, piece = place[whole], piece[whole]
            if not len(place):
                continue
            sums = bit_sums(h) if sums is None else sums
            slack = SLACK if k == SHINGLE_WORDS else 0
            for size in index.sizes:
                if min(size, SHINGLE_WORDS) != k:
                    continue
                # every start from which a window, with its slack, has a shingle; a window may lie half beyond either end of its text
                low = np.maximum(place - size - slack + k, starts[piece] - size // 2)
                high = np.minimum(place + slack, np.maximum(ends[piece] - size + size // 2, starts[piece]))
                own, begin = _union(piece, low, high)
                if not len(begin):
                    continue
                first, last = np.maximum(begin, starts[own]), np.minimum(begin + size, ends[own])
                window, anchor = index.near(size, window_prints(sums, first, np.maximum(last, first + 1)))
                item = index.anchors[size][1][anchor]
                order = np.lexsort((window, item, own[window]))
                cuts = np.flatnonzero(np.diff(own[window[order]] * len(index.items) + item[order], prepend=-1)).tolist()
                for x, y in itertools.pairwise([*cuts, len(order)]):
                    p, i = int(own[window[order[x]]]), int(item[order[x]])
                    found = _best_window(index.items[i], rolled, k, slack, begin[window[order[x:y]]], int(starts[p]), int(ends[p]), least)
                    if found:
                        rank, key = (-found[0], -found[1], found[2] - int(starts[p]) + int(skipped[p])), (int(text_of[p]), i)
                        best[key] = min(rank, best.get(key, rank))
    return [(t, index.items[i].item_id, -s, w) for (t, i), (s, _, w) in sorted(best.items())]


def _union(piece: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, number) of every number in the intervals from low to high, which do not fall within a piece, each once."""
    some = high >= low
    piece, low, high = piece[some], low[some], high[some]
    if not len(low):
        return piece, low
    before = np.concatenate([[False], piece[1:] == piece[:-1]])
    low = np.where(before, np.maximum(low, np.concatenate([[0], high[:-1]]) + 1), low)
    n = np.maximum(high - low + 1, 0)
    return np.repeat(piece, n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _best_window(item: Item, rolled: np.ndarray, k: int, slack: int, begins: np.ndarray, start: int, end: int, least: float) -> tuple[float, float, int] | None:
    """(similarity, that without slack, first word) of the best of the windows of an item in a text, or None if none is similar.

    The weights of all of the item's shingles in a window bound what it holds, as repeats beyond the item's
    count less; windows are taken by falling bounds until no other can be the best.
    """
    own = rolled[start : max(end - k + 1, start)]
    at = np.searchsorted(item.shingles, own)
    at[at == len(item.shingles)] = 0
    weight = np.where(item.shingles[at] == own, item.weights[at] / item.counts[at], 0.0)
    sums = np.concatenate([[0.0], np.cumsum(weight)])
    a, b = np.clip(begins - slack - start, 0, len(own)), np.clip(begins + item.words + slack - k + 1 - start, 0, len(own))
    bound = (sums[np.maximum(a, b)] - sums[a]) / item.weights.sum()
    best = None
    for w in np.argsort(-bound, kind="stable").tolist():
        if bound[w] < (least if best is None else -best[0]) - 1e-9:
            break
        held = item.held(own[a[w] : max(b[w], a[w])])
        if held >= least:
            begin = int(begins[w])
            exact = item.held(rolled[max(start, begin) : max(min(end, begin + item.words) - k + 1, 0)])
            rank = (-held, -exact, max(start, begin))
            best = rank if best is None else min(best, rank)
    return None if best is None else (-best[0], -best[1], best[2])


def _places(rolled: np.ndarray) -> list[np.ndarray]:
    """Keys of a shingle in the filter."""
    with np.errstate(over="ignore"):
        return [mixed(rolled + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(1, FILTER_PLACES + 1)]


def suspects(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows whose text has a shingle of any item, and a few more; one scan of docs, for a benchmark of any size.

    The items' shingles are a bitmap of at most FILTER_BITS that never misses one; in a fuller bitmap more other texts pass.
    """
    items = benchmark.select(F.col(text_col).alias("text")).where("text IS NOT NULL")

    def keys(batches):
        hashes = WordHashes()
        for batch in batches:
            for text in texts_of(batch.column("text")):
                words = words_of(text)
                if words:
                    own = np.unique(shingles(hashes.of(words), words)[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(own)).view(np.int64)), pa.array(np.full(FILTER_PLACES * len(own), min(len(words), SHINGLE_WORDS), dtype=np.int32))], names=["key", "size"])

    filled = written(items.mapInArrow(keys, "key long, size int"), "shingles")
    sizes, bits = sorted(r[0] for r in filled.select("size").distinct().collect()), 1 << 16
    n = filled.count()
    while bits < min(64 * n, FILTER_BITS):
        bits *= 2
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(filled, "key", bits))

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            texts, keep = texts_of(batch.column("text")), np.zeros(batch.num_rows, dtype=bool)
            for words, text_of, starts, _ in pieces_of(texts, SHINGLE_WORDS):
                h = hashes.of(words)
                for k in sizes:
                    own = rolled_hashes(h, k)
                    place = np.arange(len(own))
                    for c in range(FILTER_PLACES):
                        place = place[in_bitmap(shared.value, _places(own[place])[c])]
                    keep[text_of[np.searchsorted(starts, place, side="right") - 1]] = True
            yield batch.filter(pa.array(keep))

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return written(named.mapInArrow(run, named.schema), "suspects")


def indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", slice_items: int = SLICE_ITEMS):
    """Broadcast indexes of slices of the benchmark, each of slice_items at most; the driver holds one at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = items.count()
    if total <= slice_items:
        slices = [items] if total else []
    else:
        numbered = written(items.repartition(-(-total // slice_items)).withColumn("place", F.monotonically_increasing_id()), "items")
        parts = numbered.groupBy(F.shiftright("place", 33).alias("part")).count().collect()
        slices = [
            numbered.where((F.col("place") >= (r["part"] << 33) + at) & (F.col("place") < (r["part"] << 33) + at + slice_items)).select("item", "text")
            for r in parts for at in range(0, r["count"], slice_items)
        ]
    for own in slices:
        yield spark.sparkContext.broadcast(Index(sorted(((r["item"], r["text"]) for r in own.collect()), key=lambda x: (x[0] is not None, x[0]))))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item_id, similarity, first_word) of each benchmark item that a document holds a passage of.

    A passage, of the item's length and SLACK words at each end, holds if it has LEAST_SIMILARITY or more of the
    item's weighted shingles and a window of its place has a fingerprint within RADIUS bits of the item's. Null and
    empty texts and items hold nothing, and an empty table of either kind gives no rows; repeated rows of either
    table each count. Texts of any length are searched whole, in pieces that overlap. Other columns are not looked at.
    """
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    schema = f"id {kinds[0]}, item_id {kinds[1].simpleString()}, similarity double, first_word long"
    item_type = to_arrow_type(kinds[1])
    named, out = suspects(docs, benchmark, id_col, text_col), None
    for shared in indexes(benchmark, item_col):

        def run(batches, shared=shared):
            hashes = WordHashes()
            for batch in batches:
                found = search(texts_of(batch.column("text")), shared.value, hashes)
                if found:
                    at, item, similarity, word = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(item, item_type), pa.array(similarity, pa.float64()), pa.array(word, pa.int64())], names=["id", "item_id", "similarity", "first_word"])

        part = named.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a passage of the benchmark, as contaminated finds them.

    Null and empty texts hold none and stay, repeated rows share their fate, and with an empty benchmark all stay. What is
    found is known by two 64-bit hashes of its text; only texts that may be among them meet the table of those.
    """
    small_batches(spark)
    keyed = docs.withColumn("_q_key", F.xxhash64("text")).withColumn("_q_more", F.xxhash64(F.lit(7), F.col("text")))
    named = keyed.select(F.concat_ws(":", F.col("_q_key").cast("string"), F.col("_q_more").cast("string")).alias("own"), "text")
    found = F.split("id", ":")
    dirty = written(contaminated(named, table(spark, sf_dir, "benchmark"), "own").select(found[0].cast("bigint").alias("_d_key"), found[1].cast("bigint").alias("_d_more")).distinct(), "dirty")
    test = may_hold(dirty, "_d_key")
    aside, some = keyed.where(~test(F.col("_q_key"))), keyed.where(test(F.col("_q_key")))
    clean = some.join(dirty, (F.col("_q_key") == F.col("_d_key")) & (F.col("_q_more") == F.col("_d_more")), "left_anti")
    return aside.unionByName(clean).select(*docs.columns)
