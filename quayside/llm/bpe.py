"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the rest by a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, texts_of

#: Pre-tokens whose ids a Python worker keeps between texts, at most twice as many. About 0.2 KB each.
MEMO_ENTRIES = 200_000
#: The same in the pipeline, whose workers hold what earlier stages left them, too.
STAGE_MEMO_ENTRIES = 40_000
#: Keys of one bucket of the perfect hash, on average.
BUCKET_KEYS = 2
#: Characters on which the classes of Python's re and of \p{L}, \p{N} and \s surely agree, as ranges.
_PLAIN = [(0x00, 0x1B), (0x20, 0xB1), (0xB4, 0xB8), (0xBA, 0xBB), (0xBF, 0x24F)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a tiktoken vocabulary file in the order of their ranks, which must be 0 to n-1."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError(f"the ranks of {path} have gaps or empty tokens")
    return tokens


class PerfectHash:
    """A minimal perfect hash of the vocabulary, by hash and displace.

    Keys fall into buckets by their 64-bit hash; each bucket, the largest first, gets the first
    displacement that sends its keys to free slots, and a bucket of one key gets a free slot itself,
    stored as a negative number. slot_id holds the rank at each of the n slots.
    """

    def __init__(self, tokens: list[bytes]):
        self.n, self.tokens = len(tokens), tokens
        self.digest = hashlib.sha256(b"".join(len(t).to_bytes(4, "little") + t for t in tokens)).digest()
        self.buckets = max(1, self.n // BUCKET_KEYS)
        own: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for rank, token in enumerate(tokens):
            h = xxhash.xxh64_intdigest(token)
            own[h % self.buckets].append((h, rank))
        self.shift, self.slot_id, taken = [0] * self.buckets, [0] * self.n, bytearray(self.n)
        order = sorted(range(self.buckets), key=lambda b: -len(own[b]))
        for b in order:
            shift = 0
            while len(own[b]) > 1:
                slots = [self._slot(h, shift) for h, _ in own[b]]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    for s, (_, rank) in zip(slots, own[b], strict=True):
                        taken[s], self.slot_id[s] = 1, rank
                    break
                shift += 1
            self.shift[b] = shift
        free = (s for s in range(self.n) if not taken[s])
        for b in order:
            if len(own[b]) == 1:
                s = next(free)
                self.shift[b], self.slot_id[s] = -1 - s, own[b][0][1]

    def _slot(self, h: int, shift: int) -> int:
        return ((h ^ shift * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 >> 40 & 0xFFFFFFFFFF) % self.n

    def find(self, token: bytes) -> int:
        """The rank of token, or -1 where the vocabulary has no such token."""
        h = xxhash.xxh64_intdigest(token)
        shift = self.shift[h % self.buckets]
        rank = self.slot_id[self._slot(h, shift) if shift >= 0 else -1 - shift]
        return rank if self.tokens[rank] == token else -1


class Codec(dict):
    """Encodes and decodes by one vocabulary. As a dict it maps pre-tokens to their ids' bytes, up to entries (MEMO_ENTRIES where not given); a full
    one is kept aside until the next is full, so that frequent pre-tokens are not looked up anew.
    """

    def __init__(self, perfect: PerfectHash, pattern: str, entries: int | None = None):
        super().__init__()
        self.entries = entries
        self.tokens, self.perfect, self.older = perfect.tokens, perfect, {}
        rank_of = {t: i for i, t in enumerate(self.tokens)}
        self.of_byte = [rank_of[bytes([b])] for b in range(256)]
        halves = ((t[:k], t[k:], i) for t, i in rank_of.items() for k in range(1, len(t)))
        self.bits = len(self.tokens).bit_length()
        self.joined = {rank_of[a] << self.bits | rank_of[b]: i for a, b, i in halves if a in rank_of and b in rank_of}.get
        self.of_pair = [rank_of.get(bytes([a, b])) for a in range(256) for b in range(256)]
        self.split = regex.compile(pattern).findall
        # the same pattern in Python's quicker re, for texts of plain characters alone
        chars = [chr(c) for a, b in _PLAIN for c in range(a, b + 1)]
        some = lambda f: "[" + "".join(re.escape(c) for c in chars if f(c)) + "]"
        letter, number, other = some(str.isalpha), some(str.isdecimal), some(lambda c: not c.isalnum() and not c.isspace())
        self.odd = re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _PLAIN) + "]").search
        quick = pattern.replace(r"[^\s\p{L}\p{N}]", other).replace(r"\p{L}", letter).replace(r"\p{N}", number)
        self.quick = re.compile(quick).findall if r"\p" not in quick else None

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= (self.entries or MEMO_ENTRIES):
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            rank = self.perfect.find(raw)
            ids = array("I", [rank] if rank >= 0 else self.merge(raw)).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a piece: the pair of neighbours of least rank is joined first, the leftmost of equals.

        Parts are linked by the position of their first byte; the heap holds rank and position in one
        number, and an entry is void when its part has another rank by now.
        """
        joined, bits, of_pair, push, pop = self.joined, self.bits, self.of_pair, heapq.heappush, heapq.heappop
        n = len(raw)
        ids = [self.of_byte[b] for b in raw]
        rank = [of_pair[a << 8 | b] for a, b in zip(raw, raw[1:], strict=False)]
        rank.append(None)
        places = n.bit_length()
        mask = (1 << places) - 1
        heap = [r << places | i for i, r in enumerate(rank) if r is not None]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            top = pop(heap)
            i, own = top & mask, top >> places
            if rank[i] != own:
                continue
            j = after[i]
            after[i] = end = after[j]
            before[end] = i
            ids[i], ids[j], rank[j] = own, -1, None
            if end < n:
                rank[i] = r = joined(own << bits | ids[end])
                if r is not None:
                    push(heap, r << places | i)
            else:
                rank[i] = None
            if i:
                k = before[i]
                rank[k] = r = joined(ids[k] << bits | own)
                if r is not None:
                    push(heap, r << places | k)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text, each as a little-endian unsigned 32-bit integer."""
        pieces = self.split(text) if self.quick is None or self.odd(text) else self.quick(text)
        return b"".join([self[x] for x in pieces])

    def decode(self, ids: bytes) -> bytes:
        found = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(itemgetter(*found)(self.tokens)) if len(found) > 1 else b"".join(self.tokens[x] for x in found)


_CODECS: dict[tuple[bytes, str, int | None], Codec] = {}


def codec_of(perfect: PerfectHash, pattern: str, entries: int | None = None) -> Codec:
    """The codec of a vocabulary, built once in each Python worker; vocabularies are told apart by a digest of their tokens."""
    key = (perfect.digest, pattern, entries)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(perfect, pattern, entries)
    return _CODECS[key]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, entries: int | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), and with_ids also ids as an array of ints. entries bounds the memo of a worker.

    vocabulary is the path of a tiktoken file on the driver, pattern the pre-tokeniser. Null and empty
    texts have no tokens; both digests are then those of no bytes. Every row gives a row, repeated ones
    too; other columns are not looked at. The file (under 1 MB at 50,000 tokens) is the only broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(PerfectHash(read_ranks(vocabulary)))

    def run(batches):
        codec = codec_of(shared.value, pattern, entries)
        for batch in batches:
            n, a, b, kept = [], [], [], []
            for text in texts_of(batch.column("text")):
                ids = codec.encode(text)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cuts = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(b"".join(kept), dtype="<u4").astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), *_public()).withColumnRenamed("id", "doc_id")


def bpe_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: for each document its token ids, their number and the digests of the ids and of their bytes.

    Null and empty texts have no ids; every row gives a row, and an empty table none.
    """
    small_batches(spark)
    return encode_decode(docs, *_public(), with_ids=True, entries=STAGE_MEMO_ENTRIES).withColumnRenamed("id", "doc_id")
