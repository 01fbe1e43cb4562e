"""Alignment of two tokenizers over the same texts by interval coalescing, with corpus-wide counts of aligned id pairs."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, texts_of, written

#: Characters whose tokens are aligned at a time; longer texts take several turns.
RUN_CHARS = 400_000
#: Words whose ids a Python worker keeps between texts, and their greatest length.
MEMO_ENTRIES, MEMO_CHARS = 250_000, 64
#: The most frequent id pairs, which are sent to all tasks with their counts: 12 bytes each. The others meet theirs in a join.
HOT_PAIRS = 1 << 18
#: Distinct id pairs that a task counts before it hands them on.
COUNTED_PAIRS = 2_000_000

#: A single space between other characters: no token of either kind reaches over its start.
_CUT = re.compile(r"(?<=\S) (?=\S)").split


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


class TokenPair:
    """Both tokenizers, the bytes of their tokens, and the ids of words seen before; bad words are those whose bytes do not come back."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte = byte_of_character()
        entries = json.loads(a_json)
        vocabulary = dict(entries["model"]["vocab"]) | {t["content"]: t["id"] for t in entries.get("added_tokens", ())}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        #: Words can be encoded one by one, as no piece goes on after a space within.
        self.by_words = not any("▁" in p.lstrip("▁") for p in pieces)
        n = len(self.a_bytes)
        #: The decimal of each id with what may follow it: A ids by comma or bar, then B ids by comma or semicolon.
        self.written = [f"{k}{c}".encode() for k in range(n) for c in ",|"] + [f"{k}{c}".encode() for k in range(len(pieces)) for c in ",;"]
        self.memo: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}
        self.long: list[str] = []

    def words(self, text: str) -> list[str]:
        return _CUT(text) if self.by_words else [text]

    def ids_of(self, words: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """A mapping with, for each of these words, its A ids, with a space before it, and its B ids, as native 32-bit integers; None for bad ones.

        The mapping is the memo itself, good until the next call, which first drops long words and sets a full memo aside.
        """
        for w in self.long:
            del self.memo[w]
        if len(self.memo) > MEMO_ENTRIES:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        new = []
        for w in words:
            if w not in memo:
                if w in older:
                    memo[w] = older[w]
                else:
                    new.append(w)
        self.long = [w for w in new if len(w) > MEMO_CHARS]
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            for w, a, b in zip(some, self.a.encode_batch([" " + w for w in some], add_special_tokens=False), self.b.encode(some, num_threads=1), strict=True):
                whole, ids = b" " + w.encode(), a.ids
                good = b"".join(map(a_bytes, ids)) == whole and b"".join(map(b_bytes, b)) == whole
                memo[w] = (array("I", ids).tobytes(), array("I", b).tobytes()) if good else None
        return memo

    def align(self, a: list[bytes], b: list[bytes]) -> Iterator[tuple]:
        """For each stretch of bytes that both a and b are ids of: tokens of A and B, groups, links, id pairs, how often, and the groups as text.

        All tokens are ordered by their start; a group ends where a start reaches the furthest end so far. A group can be
        long, so its links are found by bisection: the B tokens that end after an A token starts and start before it ends.
        """
        n_a, n_b = (np.array([len(x) // 4 for x in own], dtype=np.int64) for own in (a, b))
        ids_a, ids_b = (np.frombuffer(b"".join(own), dtype="<u4").astype(np.int64) for own in (a, b))
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        starts_a, starts_b = ends_a - self.a_sizes[ids_a], ends_b - self.b_sizes[ids_b]
        starts, ends = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
        order = np.lexsort((np.arange(len(starts)) >= len(ids_a), starts))
        reach = np.maximum.accumulate(ends[order])
        breaks = np.ones(len(order), dtype=np.int64)
        breaks[1:] = starts[order[1:]] >= reach[:-1]
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(breaks) - 1
        group_a, group_b = group[: len(ids_a)], group[len(ids_a) :]
        last_a, last_b = np.append(np.diff(group_a), 1) > 0, np.append(np.diff(group_b), 1) > 0
        # tokens in the order of the text of groups: those of A before those of B in each
        text = np.empty(len(order), dtype=np.int64)
        text[np.arange(len(ids_a)) + np.append(0, np.flatnonzero(last_b) + 1)[group_a]] = 2 * ids_a + last_a
        text[np.arange(len(ids_b)) + np.append(np.flatnonzero(last_a) + 1, 0)[group_b]] = 2 * (len(self.a_bytes) + ids_b) + last_b
        low, high = np.searchsorted(ends_b, starts_a, side="right"), np.searchsorted(starts_b, ends_a, side="left")
        n = high - low
        of_a = np.repeat(np.arange(len(ids_a)), n)
        of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(n) - n - low, n)
        stretch = np.repeat(np.arange(len(a)), n_a)
        whole = len(self.a_bytes) * len(self.b_bytes)
        pairs, times = np.unique(stretch[of_a] * whole + ids_a[of_a] * len(self.b_bytes) + ids_b[of_b], return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(len(a) + 1) * whole)
        till_a = np.cumsum(n_a)
        links = np.bincount(stretch, weights=n, minlength=len(a)).astype(np.int64)
        groups = group_a[till_a - 1] - group_a[till_a - n_a] + 1
        codes = text.tolist()
        at = np.cumsum(n_a + n_b)
        for k in range(len(a)):
            own = slice(cuts[k], cuts[k + 1])
            yield int(n_a[k]), int(n_b[k]), int(groups[k]), int(links[k]), pairs[own] - k * whole, times[own], b"".join(map(self.written.__getitem__, codes[at[k] - n_a[k] - n_b[k] : at[k]]))[:-1]


class Document:
    """What is known of a document of which some stretches are aligned."""

    def __init__(self) -> None:
        self.counts, self.sha, self.text, self.pairs, self.times, self.bad = [0, 0, 0, 0], hashlib.sha256(), [], [], [], False

    def add(self, n_a: int, n_b: int, groups: int, links: int, pairs: np.ndarray, times: np.ndarray, text: bytes, keep: bool) -> None:
        self.sha.update((b";" if self.counts[0] else b"") + text)
        self.counts = [x + y for x, y in zip(self.counts, (n_a, n_b, groups, links), strict=True)]
        self.pairs.append(pairs)
        self.times.append(times)
        if keep:
            self.text.append(text)

    def row(self, keep: bool) -> tuple:
        if self.bad or not self.pairs:
            return (0, 0, 0, 0, "", b"", b"") + ("",) * keep
        if len(self.pairs) == 1:
            pairs, times = self.pairs[0], self.times[0]
        else:
            pairs, place = np.unique(np.concatenate(self.pairs), return_inverse=True)
            times = np.bincount(place, weights=np.concatenate(self.times)).astype(np.int64)
        return (*self.counts, self.sha.hexdigest(), pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes()) + (b";".join(self.text).decode(),) * keep


_PAIRS: dict[bytes, TokenPair] = {}


def _pair_of(a_json: bytes, b_model: bytes) -> TokenPair:
    """The tokenizers, built once in each Python worker."""
    key = hashlib.sha256(len(a_json).to_bytes(8, "big") + a_json + b_model).digest()
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = TokenPair(a_json, b_model)
    return _PAIRS[key]


def _documents(pair: TokenPair, texts: list[str], keep: bool) -> list[tuple]:
    """The rows of texts, RUN_CHARS at a time."""
    docs = [Document() for _ in texts]
    run: list[tuple[int, list[str]]] = []
    held = 0

    def flush() -> None:
        ids = pair.ids_of(set().union(*(own for _, own in run))).__getitem__
        good, a, b = [], [], []
        for k, own in run:
            found = list(map(ids, own))
            if docs[k].bad or None in found:
                docs[k].bad = True
                continue
            good.append(k)
            a.append(b"".join([x[0] for x in found]))
            b.append(b"".join([x[1] for x in found]))
        if good:
            for k, found in zip(good, pair.align(a, b), strict=True):
                docs[k].add(*found, keep)
        run.clear()

    for k, text in enumerate(texts):
        words, at = pair.words(text) if text else [], 0
        while at < len(words):
            start = at
            while at < len(words) and (held < RUN_CHARS or at == start):
                held += len(words[at]) + 1
                at += 1
            run.append((k, words[start:at]))
            if held >= RUN_CHARS:
                flush()
                held = 0
    if run:
        flush()
    return [d.row(keep) for d in docs]


def aligned_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) and, if asked for, groups: how the tokens of each text meet.

    a_path is a byte-level tokenizer of the tokenizers library, fed a space and the text; b_path a sentencepiece model, which adds
    the space itself. Special tokens in texts are plain text. groups is like `a1,a2|b1;a3|b2,b3`: between bytes where both
    have a token's end. pairs holds the distinct linked (overlapping) ids, a * (size of B) + b, ascending, and times how often
    each is linked, both as little-endian 32-bit numbers. Null and empty texts, and those that the tokens' bytes do not give
    back, have zeros, an empty digest and no pairs. Every row gives a row, repeated ones too; other columns are not looked
    at. Texts of any length are aligned in stretches that end before a single space, or whole where there is none.
    """
    spark = docs.sparkSession
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        shared = spark.sparkContext.broadcast((a.read(), b.read()))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"] + ["groups"] * with_groups
    kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()] + [pa.string()] * with_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair_of(*shared.value)
        for batch in batches:
            rows = zip(*_documents(pair, texts_of(batch.column("text")), with_groups), strict=True)
            columns = [pa.array(list(x), t) for x, t in zip(rows, kinds, strict=True)] if batch.num_rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *names])

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary" + ", groups string" * with_groups
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of a column of binaries one after another, and how many each row has."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), dtype="<u4").astype(np.int64), np.array([len(x) // 4 for x in blobs], dtype=np.int64)


def pair_counts(aligned: DataFrame, most: int = COUNTED_PAIRS) -> DataFrame:
    """(pair, n): in how many documents each id pair is linked. Each task counts what it reads first, at most so many pairs at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            own, n = np.unique(_flat(batch.column("pairs"))[0], return_counts=True)
            joined, place = np.unique(np.concatenate([pairs, own]), return_inverse=True)
            pairs, counts = joined, np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(joined)).astype(np.int64)
            if len(pairs) > most:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])
                pairs, counts = pairs[:0], counts[:0]
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): aligned_tokens, with each link's pair looked up in the corpus.

    A pair's count is the number of documents that link it; n_best counts links whose pair has the highest count of its A id,
    count_sum adds the counts of all links. The hot_pairs most frequent pairs and the highest count of each A id (as many as
    the vocabulary) are broadcast; the other pairs of each document meet their counts in a join, where none is frequent. An
    empty table gives one.
    """
    spark = docs.sparkSession
    aligned = aligned_tokens(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    aligned = written(aligned, "aligned")
    counts = written(pair_counts(aligned), "pair_counts")
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        pair = _pair_of(a.read(), b.read())
    size_a, size_b = len(pair.a_bytes), len(pair.b_bytes)
    if size_a * size_b > 1 << 32:
        raise ValueError("the id pairs of these vocabularies need over 32 bits")
    top = counts.groupBy(F.floor(F.col("pair") / size_b).alias("a")).agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(size_a, dtype=np.int64)
    best[top.column("a").to_numpy()] = top.column("n").to_numpy()
    hot = counts.orderBy(F.desc("n"), "pair").limit(hot_pairs).toArrow()
    order = np.argsort(hot.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast((hot.column("pair").to_numpy()[order].astype("<u4"), hot.column("n").to_numpy()[order], best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, frequency, highest = shared.value
        for batch in batches:
            pairs, each = _flat(batch.column("pairs"))
            times, _ = _flat(batch.column("times"))
            doc = np.repeat(np.arange(batch.num_rows), each)
            at = np.minimum(np.searchsorted(codes, pairs.astype("<u4")), max(len(codes) - 1, 0))
            known = codes[at] == pairs if len(codes) else np.zeros(len(pairs), dtype=bool)
            n = np.where(known, frequency[at], 0) if len(codes) else np.zeros(len(pairs), dtype=np.int64)
            is_best = known & (n == highest[pairs // size_b])
            # sums stay whole: bincount's weights are doubles, exact up to 2 ** 53
            sums = [pa.array(np.bincount(doc, weights=w, minlength=batch.num_rows).astype(np.int64)) for w in (times * is_best, times * n)]
            others = np.flatnonzero(~known)
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(doc[others], minlength=batch.num_rows))).astype(np.int32))
            left = [pa.ListArray.from_arrays(offsets, pa.array(x[others])) for x in (pairs, times)]
            names = ["id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *sums, *left], names=[*names, "n_best", "count_sum", "left_pairs", "left_times"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, left_pairs array<long>, left_times array<long>"
    found = aligned.mapInArrow(run, schema)
    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if hot.num_rows < hot_pairs:
        return found.select(*columns)
    found = written(found, "alignment")
    rest = found.select("row", F.explode(F.arrays_zip("left_pairs", "left_times")).alias("x")).select("row", F.col("x.left_pairs").alias("pair"), F.col("x.left_times").alias("times"))
    best_of = F.broadcast(spark.createDataFrame(pa.table({"a": top.column("a"), "best": top.column("n")})))
    known = counts.withColumn("a", F.floor(F.col("pair") / size_b)).join(best_of, "a")
    joined = rest.join(known, "pair")
    more = joined.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    whole = found.join(more, "row", "left")
    return whole.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).select(*columns)


def op13_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")
