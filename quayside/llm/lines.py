"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line of each group."""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import majority, may_hold, small_batches, table, texts_of, vote_counts, whole_keys, written
from .graph import bucket_forest, components, in_groups, keyed, masked_keys, mixed, near

#: Shorter lines have no near copies; equal ones are repeats all the same.
LEAST_WORDS = 5
#: Words at either end of a line that make a key: the most of these that are half of the line at most.
END_WORDS = (6, 12, 24, 48, 96, 192, 384)
#: Words of fewer bytes have no vote in a line's fingerprint, unless the line has no others.
VOTING_BYTES = 4
RADIUS = 4
#: Bits that lines with the same words at one end may differ in to be compared.
WIDE_RADIUS = 10
LEAST_SIMILARITY = 0.8
#: Lines of one group that are compared in one task; larger groups are split into blocks.
GROUP_ROWS = 256
#: Characters of texts that are hashed together, and bytes of a longer text that are hashed at a time.
BLOCK_CHARS, BLOCK_BYTES = 200_000, 1_000_000
_NORMAL = bytes(c if c == 10 or c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Spaces and punctuation beyond ASCII that part words, and characters of scripts without spaces, each a word.
_PARTS = re.compile("[\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20]")
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
#: Multiplier of the words' rolling hash, and random numbers for the values of a byte.
_STEP = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(7).integers(1, 2**64, 256, dtype=np.uint64)


def normal(text: str, apart: bool = True) -> bytes:
    """A text in lower case, with ASCII punctuation as spaces; lines stay. With apart, each character of a script
    without spaces is a word of its own."""
    text = text.lower()
    if not text.isascii():
        try:
            text.encode("latin-1")  # has one character of _PARTS, and none of _UNSPACED
            text = text.replace("\u00a0", " ")
        except UnicodeEncodeError:
            text = _PARTS.sub(" ", text)
            if apart:
                text = _UNSPACED.sub(r" \1 ", text)
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL)


#: Powers of _STEP and of its inverse, as many as were asked for so far.
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers_of_step(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of _STEP and of its inverse modulo 2**64; those of BLOCK_BYTES at most are kept."""
    if n < len(_POWERS[0]):
        return _POWERS[0][: n + 1], _POWERS[1][: n + 1]
    size = max(n, min(2 * n, BLOCK_BYTES))
    with np.errstate(over="ignore"):
        found = [np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, x, dtype=np.uint64)])) for x in (_STEP, pow(_STEP, -1, 2**64))]
    if size <= BLOCK_BYTES:
        _POWERS[:] = found
    return found[0][: n + 1], found[1][: n + 1]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, hash) of each word of a normalised text. The lowest bit of a hash tells whether the word votes.

    A word's hash is the sum of its bytes' numbers times powers of an odd number by their places, modulo
    2**64: one running sum over the text, less its value before the word, divided by the power there.
    """
    inside = np.concatenate([[False], (raw != 32) & (raw != 10), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    n = len(raw)
    powers, inverse = powers_of_step(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[raw] * powers[:n], out=sums[1:])
        h = mixed((sums[end] - sums[begin]) * inverse[begin])
    return begin, np.where(end - begin >= VOTING_BYTES, h | np.uint64(1), h & ~np.uint64(1))


def line_hashes(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each line from its words' hashes and their places."""
    starts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        place = (np.arange(len(words)) - np.repeat(starts, sizes) + 1).astype(np.uint64)
        return mixed(np.add.reduceat(mixed(words + place * np.uint64(_STEP)), starts))


def line_prints(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of lines, each of one word or more; a word that a line repeats has one vote."""
    line = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    bits = np.uint64(max(len(sizes).bit_length(), 1))
    order = np.argsort(line << (np.uint64(64) - bits) | words >> bits)
    line, words = line[order], words[order]
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (words[1:] != words[:-1])])
    line, words = line[new].astype(np.int64), words[new]
    sizes = np.bincount(line, minlength=len(sizes))
    votes = (words & np.uint64(1)).astype(bool)
    own = np.add.reduceat(votes, np.cumsum(sizes) - sizes, dtype=np.int64)
    votes |= np.repeat(own == 0, sizes)
    own = np.where(own == 0, sizes, own)
    return majority(vote_counts(mixed(words[votes]), np.cumsum(own) - own), own)


def end_keys(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(lines, 4): hashes of the words at the beginning and at the end of each line, 0 where a line is too short.

    The number of words is a step of END_WORDS; lines just above a step also have the keys of the step below, as a line with a
    word less may fall there. An edit of a line leaves one end whole.
    """
    out = np.zeros((len(sizes), 4), dtype=np.uint64)
    if not len(sizes):
        return out
    steps = np.array([0, *END_WORDS])
    own = np.searchsorted(steps, sizes // 2, side="right") - 1
    below = np.where(4 * sizes < 10 * steps[own], own - 1, 0)
    powers, inverse = powers_of_step(len(words))
    with np.errstate(over="ignore"):
        # sums of the words' hashes times powers by place, as of the bytes of a word
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(words) * powers[: len(words)], dtype=np.uint64)])
        for c, step in ((0, own), (2, below)):
            k, on = steps[step], step > 0
            for side, begin in ((0, starts), (1, starts + sizes - k)):
                h = mixed((sums[begin + k] - sums[begin]) * inverse[begin] + (2 * k + side).astype(np.uint64))
                out[:, c + side] = np.where(on, h | np.uint64(1), np.uint64(0))
    return out


def lines_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(text, line, hash, fingerprint, ends, words) of every line with a word, for all texts at once.

    hash has two words of 64 bits; ends are the end_keys, of lines of LEAST_WORDS or more.
    """
    own = [normal(t) for t in texts]
    counts = np.array([r.count(b"\n") + 1 for r in own])
    raw = b"\n".join(own)
    cuts = [0]
    while len(raw) - cuts[-1] > BLOCK_BYTES:  # only between words
        cut = raw.rfind(b"\n", cuts[-1] + 1, cuts[-1] + BLOCK_BYTES)
        cut = cut if cut > 0 else raw.find(b" ", cuts[-1] + BLOCK_BYTES)
        if cut < 0:
            break
        cuts.append(cut)
    buffer = np.frombuffer(raw, dtype=np.uint8)
    parts = [(a, *word_hashes(buffer[a:b])) for a, b in itertools.pairwise([*cuts, len(raw)])]
    begin, words = np.concatenate([a + x for a, x, _ in parts]), np.concatenate([h for _, _, h in parts])
    ends = np.searchsorted(begin, np.append(np.flatnonzero(buffer == 10), len(raw)))  # words before the end of each line
    sizes = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(own)), counts)
    line = np.arange(len(sizes)) - np.repeat(np.cumsum(counts) - counts, counts)
    keep = sizes > 0
    sizes = sizes[keep]
    if not len(sizes):
        return tuple(np.zeros((0, k) if k else 0, dtype=np.int64) for k in (0, 0, 2, 0, 4, 0))
    starts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        hashes = np.stack([line_hashes(words, sizes), line_hashes(mixed(words ^ np.uint64(_STEP)), sizes)], axis=1)
    ends = np.where((sizes >= LEAST_WORDS)[:, None], end_keys(words, starts, sizes), np.uint64(0))
    return text[keep], line[keep], hashes.view(np.int64), line_prints(words, sizes).view(np.int64), ends.view(np.int64), sizes


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, line, hash, fp, ends) of every line with a word. text_key and id together name a text.

    hash is one of 128 bits of the normalised line. fp and ends are null for lines of under LEAST_WORDS words.
    """

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            first, size = 0, 0
            for row, text in enumerate(texts):
                size += len(text) + 1
                if size >= BLOCK_CHARS or row + 1 == len(texts):
                    at, line, own, fps, ends, sizes = lines_of(texts[first : row + 1])
                    rows = pa.array(at + first)
                    short = sizes < LEAST_WORDS
                    held = ends != 0
                    cuts = np.concatenate([[0], np.cumsum(held.sum(axis=1))])
                    some = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ends[held]))
                    both = pa.Array.from_buffers(pa.binary(16), len(line), [None, pa.py_buffer(np.ascontiguousarray(own).tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(rows), batch.column("text_key").take(rows), pa.array(line, pa.int32()), both, pa.array(fps, pa.int64(), mask=short), some],
                        names=["id", "text_key", "line", "hash", "fp", "ends"],
                    )
                    first, size = row + 1, 0

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, f"id {kind}, text_key long, line int, hash binary, fp long, ends array<long>")


def edit_distance(a: str, b: str, most: float = math.inf) -> int:
    """Levenshtein distance: common ends are cut off, the rest is bit-parallel in whole numbers of any length.

    Ends early, with some number over most, once what is left of b can no longer bring the distance down to most.
    """
    if len(a) > len(b):
        a, b = b, a
    begin, n = 0, len(a)
    while begin < n and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < n - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = mask, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        equal = where.get(c, 0)
        vertical = equal | down
        level = ((equal & up) + up ^ up) | equal
        higher, lower = down | mask & ~(level | up), up & level
        distance += bool(higher & top) - bool(lower & top)
        if distance - left > most:
            return distance - left
        higher = (higher << 1 | 1) & mask
        up, down = (lower << 1) & mask | mask & ~(vertical | higher), higher & vertical
    return distance


def words_apart(a: str, b: str, most: float = math.inf) -> int:
    """Edits of whole words that turn a into b, in characters: never less than their edit distance, and a number over most if that many do not do.

    Words that differ are replaced, or left out or put in where the next word then agrees.
    """
    x, y = a.split(" "), b.split(" ")
    i = j = edits = 0
    while i < len(x) and j < len(y) and edits <= most:
        if x[i] != y[j]:
            after_x, after_y = x[i + 1 : i + 2], y[j + 1 : j + 2]
            if after_x != after_y and after_x == [y[j]]:
                edits, j = edits + len(x[i]) + 1, j - 1
            elif after_x != after_y and after_y == [x[i]]:
                edits, i = edits + len(y[j]) + 1, i - 1
            else:
                edits += max(len(x[i]), len(y[j]))
        i, j = i + 1, j + 1
    return edits + sum(len(w) + 1 for w in x[i:]) + sum(len(w) + 1 for w in y[j:])


def similar(a: str, b: str, least: float = LEAST_SIMILARITY) -> bool:
    longest = max(len(a), len(b))
    most = (1 - least) * longest + 1e-9
    return abs(len(a) - len(b)) <= most and (words_apart(a, b, most) <= most or edit_distance(a, b, most) <= most)


def numbers(line: str) -> int:
    """A number for the runs of digits of a line, in order; lines with other numbers say other things."""
    return hash(tuple(re.findall(r"\d+", line)))


def _fetched(texts: DataFrame) -> DataFrame:
    """The wanted lines of each text, which is split once: wanted, an array of structs, as rows with said."""
    inner = texts.schema["wanted"].dataType.elementType
    names = [f.name for f in inner if f.name != "line"]

    def fetch(batches):
        for batch in batches:
            rows = [(w, lines[w["line"]]) for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True) for lines in [text.split("\n")] for w in wanted]
            kinds = batch.schema.field("wanted").type.value_type
            columns = [pa.array([w[c] for w, _ in rows], kinds.field(c).type) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s for _, s in rows], pa.string())], names=[*names, "said"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner if f.name != "line")
    return texts.select("text", "wanted").mapInArrow(fetch, f"{schema}, said string")


@F.pandas_udf(StringType())
def _without(text, drops):
    """Texts less the lines with these numbers, each text split once; texts without numbers stay as they are."""
    import pandas as pd

    out = []
    for t, gone in zip(text, drops, strict=True):
        if gone is not None:
            numbers = set(gone.tolist())
            t = "\n".join([x for i, x in enumerate(t.split("\n")) if i not in numbers])
        out.append(t)
    return pd.Series(out, dtype=object)


def line_links(firsts: DataFrame, docs: DataFrame, id_col: str, text_col: str, radius: int = RADIUS, wide: int = WIDE_RADIUS) -> DataFrame:
    """Edges (a, b) between hashes of different lines that connect just what links connect.

    A link: the same numbers, edit similarity of LEAST_SIMILARITY or more, and fingerprints within radius, or within wide
    with the same words at one end. Lines are first grouped by fingerprints and ends; only lines of groups of two or
    more fetch their text, from the one document of their first occurrence, and are compared within the group, large ones by blocks.
    """
    points = written(firsts.where("fp IS NOT NULL").select(F.xxhash64("hash").alias("node"), "fp", "ends", "hash", "first"), "points")
    keys = masked_keys(radius, points.count())

    def rows_of(some):
        by_print = keyed(some.select("node", "fp"), keys).select((F.col("key").bitwiseAND(F.lit(-2))).alias("key"), "node", "fp")
        return by_print.unionByName(some.select(F.explode("ends").alias("key"), "node", "fp"))

    def linked(columns):
        fps, most = columns["fp"].view(np.uint64), np.where(columns["group"] & 1, wide, radius).astype(np.uint8)
        return lambda i, j: np.bitwise_count(fps[i] ^ fps[j]) <= most[i]

    joined = written(components(bucket_forest(points, rows_of, linked)), "candidates")
    members = written(points.join(joined, "node").select("hash", "fp", "ends", "root", "first.*"), "members")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    texts = texts.where(may_hold(members, "text_key")(F.col("text_key"))).alias("t")
    wanted = members.groupBy("id", "text_key").agg(F.collect_list(F.struct("line", "hash", "fp", "ends", "root")).alias("wanted"))
    members = wanted.alias("m")
    same = F.col("t.id").eqNullSafe(F.col("m.id")) & (F.col("t.text_key") == F.col("m.text_key"))
    said = _fetched(texts.join(members, same)).dropDuplicates(["hash"])
    placed = in_groups(written(said, "said"), "hash", GROUP_ROWS)

    def compare(batches):
        for t in whole_keys(batches, "group"):
            group, fps, hashes = t.column("group").to_numpy(), t.column("fp").to_numpy().view(np.uint64), t.column("hash").combine_chunks()
            ends = [frozenset(x) for x in t.column("ends").to_pylist()]
            lines = [b" ".join(normal(s, apart=False).split()).decode("utf-8", "surrogatepass") for s in texts_of(t.column("said"))]
            counted, long = np.fromiter(map(numbers, lines), dtype=np.int64, count=len(lines)), np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
            last, root = np.searchsorted(group, group, side="right").tolist(), np.arange(len(fps))
            for i in range(len(fps)):
                if last[i] > i + 1:
                    rest = slice(i + 1, last[i])
                    apart = np.bitwise_count(fps[rest] ^ fps[i])
                    fits = (apart <= wide) & (root[rest] != root[i]) & (counted[rest] == counted[i]) & (np.abs(long[rest] - long[i]) <= (1 - LEAST_SIMILARITY) * np.maximum(long[rest], long[i]))
                    for j in (np.flatnonzero(fits) + i + 1).tolist():
                        if root[i] != root[j] and (apart[j - i - 1] <= radius or ends[i] & ends[j]) and similar(lines[i], lines[j]):
                            low, high = sorted((root[i], root[j]))
                            own = root[low : last[i]]
                            own[own == high] = low
            own = np.flatnonzero(root != np.arange(len(fps)))
            if len(own):
                yield pa.RecordBatch.from_arrays([hashes.take(pa.array(own)), hashes.take(pa.array(root[own]))], names=["a", "b"])

    return placed.select("group", "fp", "ends", "hash", "said").repartition("group").sortWithinPartitions("group", "hash").mapInArrow(compare, "a binary, b binary")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, text_key, line, kept_id, kept_line) of every line to drop, with the place of the line that stays.

    Of each group of lines that links connect (equal normalised lines always, however short) the first stays, by id (null
    first), key of the text and number. Lines of under LEAST_WORDS words have no near copies; lines without a word
    take no part. Null and empty texts have no lines. Rows that repeat id and text are one text, and keep the same lines.
    A text of any length is read whole, in blocks of BLOCK_BYTES. An empty table has no repeats.
    """
    lines = written(line_table(docs, id_col, text_col), "lines")
    firsts = written(lines.groupBy("hash").agg(F.min("fp").alias("fp"), F.first("ends").alias("ends"), F.min(F.struct("id", "text_key", "line")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    joined = written(components(line_links(firsts, docs, id_col, text_col, radius)), "joined")
    classes = written(firsts.join(joined.withColumnRenamed("node", "hash"), "hash", "left").where("n > 1 OR root IS NOT NULL").select("hash", "first", F.coalesce("root", "hash").alias("root")), "classes")
    kept = written(classes.groupBy("root").agg(F.min("first").alias("kept")), "kept")
    of_hash = written(classes.join(kept, "root").select("hash", "kept"), "of_hash")
    here = F.struct("id", "text_key", "line")
    return lines.select("id", "text_key", "line", "hash").join(of_hash, "hash").where(~here.eqNullSafe(F.col("kept"))).select("id", "text_key", "line", F.col("kept.id").alias("kept_id"), F.col("kept.line").alias("kept_line"))


def _drops(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_q_id, _q_text, _q_lines): the sorted numbers of the lines to drop of each text that has any."""
    found = repeated_lines(docs, id_col, text_col)
    return found.groupBy(F.col("id").alias("_q_id"), F.col("text_key").alias("_q_text")).agg(F.array_sort(F.collect_set("line")).alias("_q_lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with their texts less the repeated lines; a text left without a word by that goes.

    Only texts that may have lines to drop are moved to meet them; the others pass by.
    """
    drops = written(_drops(docs, id_col, text_col), "drops")
    test = may_hold(drops, "_q_text")
    named = docs.withColumn("_q_key", F.xxhash64(F.col(text_col)))
    aside, some = named.where(~test(F.col("_q_key"))), named.where(test(F.col("_q_key")))
    same = some[id_col].eqNullSafe(drops["_q_id"]) & (some["_q_key"] == drops["_q_text"])
    left = _without(some[text_col], drops["_q_lines"])
    out = {c: some[c] for c in docs.columns} | {text_col: F.col("_q_left")}
    if length_col in docs.columns:
        out[length_col] = F.when(F.col("_q_lines").isNull(), some[length_col]).otherwise(F.length("_q_left").cast(docs.schema[length_col].dataType))
    joined = some.join(drops, same, "left").withColumn("_q_left", left).where(F.col("_q_lines").isNull() | F.col("_q_left").rlike(r"[^\x20\x09-\x0D]"))
    return aside.select(*docs.columns).unionByName(joined.select(*(v.alias(c) for c, v in out.items())))


def op9_fuzzy_line_dedup(spark, sf_dir: str) -> DataFrame:
    """For each row of documents its lines, how many of them repeat a line that stays, and the numbers of those."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drops = written(_drops(docs, "doc_id", "text"), "drops")
    given = F.coalesce("text", F.lit(""))
    sizes = docs.select("doc_id", F.xxhash64("text").alias("text_key"), (F.octet_length(given) - F.octet_length(F.replace(given, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    same = sizes["doc_id"].eqNullSafe(drops["_q_id"]) & (sizes["text_key"] == drops["_q_text"])
    n = F.coalesce(F.size("_q_lines"), F.lit(0)).cast("long")
    return sizes.join(drops, same, "left").select("doc_id", "n_lines", F.when(F.col("_q_lines").isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_dropped"), F.coalesce(F.array_join("_q_lines", ","), F.lit("")).alias("dropped_lines"))


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less their repeated lines, as dedup_lines; documents of repeats alone go, null and empty texts stay."""
    small_batches(spark)
    return dedup_lines(docs)
