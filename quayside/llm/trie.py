"""Prefix trie of conversations by truncation peeling: from the deepest turn up, nodes are found and added up in one pass."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import shared_dir
from .common import joined_to_owner, table, whole_keys, written

#: Bytes of a node's key: 16 of the hash of its turns and 8 of the words of its last text.
KEY = 24
#: Turns that one band of levels holds at least and at most before it is cut; between, a share of all turns.
LEAST_ROWS, MOST_ROWS, BANDS = 4_096, 500_000, 64
#: Conversation ids, by their higher bits, whose decimals are joined before they are hashed in turn: 256 at most.
ENDS_SHIFT = 8
#: In the query, conversations that share a beginning, and the turns it may have.
FAMILY, BORROWED = 20, 4

_NODE = "key binary, parent binary, depth int, conv long, n_convs long, n_children long, n_leaves long, saved_tokens long, path binary"


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, digest, words) of all turns: the place from 1 in the conversation, a digest of role and text, words of the text.

    Turns are ordered by number, null first, and equal numbers by the digest; null role or text is empty. Rows without a
    conversation belong to none and are left out.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    own = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), words.alias("words"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest"))
    return own.select("conv", place.cast("long").alias("place"), "digest", "words")


def families(turns: DataFrame, size: int = FAMILY, most: int = BORROWED) -> DataFrame:
    """Ordered turns, each conversation with the beginning of its family's first in place of its own, and a row of place 0 for each.

    Conversation c takes the first h turns of conversation c - c % size and keeps its own after the first h; h is the CRC-32 of
    its decimal id modulo most. Remainders have the sign of c, as in SQL.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most))
    convs = turns.where("place = 1").select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % size).alias("base"))
    heads = turns.where((F.col("conv") % size == 0) & (F.col("place") < most)).withColumnRenamed("conv", "base")
    borrowed = convs.join(heads, "base").where("place <= h").select("conv", "place", "digest", "words")
    own = turns.where(F.col("place") > h)
    marks = convs.select("conv", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(borrowed).unionByName(marks)


def paths(turns: DataFrame) -> DataFrame:
    """(conv, depth, key, path) of each conversation: the keys of its prefixes, shortest first, one after another in path.

    A key hashes the key before it and the turn's digest, so that equal keys mean equal prefixes. Turns stream through a task in
    order; a conversation of any length takes KEY bytes for each of its turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, key, path, out = None, b"", bytearray(), ([], [], [], [])

        def done() -> None:
            for column, value in zip(out, (conv, len(path) // KEY, key, bytes(path)), strict=True):
                column.append(value)

        for batch in batches:
            for c, digest, words in zip(*(batch.column(x).to_pylist() for x in ("conv", "digest", "words")), strict=True):
                if c != conv:
                    if conv is not None:
                        done()
                    conv, key, path = c, b"", bytearray()
                if digest is not None:
                    key = hashlib.blake2b(key + digest, digest_size=16).digest() + words.to_bytes(8, "big")
                    path += key
            yield _batch(out)
            for column in out:
                column.clear()
        if conv is not None:
            done()
            yield _batch(out)

    def _batch(out) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["conv", "depth", "key", "path"])

    return turns.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(run, "conv long, depth int, key binary, path binary")


def bands(ended: Mapping[int, int], least: int = LEAST_ROWS, most: int = MOST_ROWS) -> list[tuple[int, int]]:
    """(low, high) ranges of depths, low excluded, deepest first, from the number of conversations that end at each depth.

    A band of several levels holds a 64th of all turns at most, and no more than most; a level of more is its own band. So the
    number of rounds does not grow with the depth of a few long conversations.
    """
    limit = min(max(least, sum(d * n for d, n in ended.items()) // BANDS), most)
    out, alive, rows, high = [], 0, 0, max(ended, default=0)
    for d in range(high, 0, -1):
        alive += ended.get(d, 0)
        if rows and rows + alive > limit:
            out.append((d, high))
            high, rows = d, 0
        rows += alive
    return [*out, (0, high)] if high else out


def _part(path: str, depth: int) -> Column:
    return F.expr(f"substring({path}, {KEY * (depth - 1) + 1}, {KEY})")


def _level(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of one level from what ends there and what survives from below: one aggregate, partial before its shuffle."""
    own = rows.groupBy(_part("path", depth).alias("key")).agg(F.first("path").alias("path"), F.min("conv").alias("conv"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    words = F.conv(F.hex(F.expr("substring(key, 17, 8)")), 16, 10).cast("long")
    leaves, saved = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")), F.col("saved_tokens") + (F.col("n_convs") - 1) * words
    parent = _part("path", depth - 1) if depth > 1 else F.lit(b"")
    return own.select("key", parent.alias("parent"), F.lit(depth).cast("int").alias("depth"), "conv", "n_convs", "n_children", leaves.cast("long").alias("n_leaves"), saved.alias("saved_tokens"), "path")


def _several(rows: DataFrame, low: int, high: int) -> DataFrame:
    """The nodes of a band of levels, peeled within the groups that share the key at the band's upper end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, "anchor"):
            out = peeled(zip(*(t.column(c).to_pylist() for c in ("path", "conv", "n_convs", "n_children", "n_leaves", "saved_tokens")), strict=True), low)
            kinds = (pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _NODE.split(", ")])

    keyed = rows.select(_part("path", low + 1).alias("anchor"), "path", "conv", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return keyed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _NODE)


def peeled(rows: Iterator[tuple], low: int) -> list[tuple]:
    """Rows (path, conv, n_convs, n_children, n_leaves, saved_tokens) that end or survive at some depth over low, as nodes of all depths over low.

    From the deepest level up: equal paths are merged, the last turn is stripped, and what remains joins the level above.
    """
    levels: dict[int, dict[bytes, list]] = {}

    def add(path: bytes, conv: int, *sums: int) -> None:
        level = levels.setdefault(len(path) // KEY, {})
        found = level.get(path[-KEY:])
        if found is None:
            level[path[-KEY:]] = [path, conv, *sums]
        else:
            found[1] = min(found[1], conv)
            for k, x in enumerate(sums):
                found[k + 2] += x

    for row in rows:
        add(*row)
    out = []
    for depth in range(max(levels, default=low), low, -1):
        for key, (path, conv, n_convs, children, leaves, saved) in levels.pop(depth, {}).items():
            leaves, saved = leaves if children else 1, saved + (n_convs - 1) * int.from_bytes(key[16:], "big")
            out.append((key, path[-2 * KEY : -KEY], depth, conv, n_convs, children, leaves, saved, path if depth == low + 1 else None))
            if depth > low + 1:
                add(path[:-KEY], conv, n_convs, 1, leaves, saved)
    return out


def _ends(ways: DataFrame) -> DataFrame:
    """(key, n_ends, ends_sha256): the conversations that end at a node, in order, as the hash of their joined decimals.

    Up to 256 neighbouring ids are joined at a time; a task then hashes these pieces in order and keeps only the hash's state.
    """
    decimals = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = ways.groupBy("key", F.shiftright("conv", ENDS_SHIFT).alias("piece")).agg(F.count(F.lit(1)).alias("n"), decimals.alias("decimals"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, sha = None, 0, None
        for batch in batches:
            out = []
            for k, count, text in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "decimals")), strict=True):
                if k != key:
                    if sha is not None:
                        out.append((key, n, sha.hexdigest()))
                    key, n, sha = k, 0, hashlib.sha256()
                sha.update(("," if n else "").encode() + text.encode())
                n += count
            yield from _rows(out)
        if sha is not None:
            yield from _rows([(key, n, sha.hexdigest())])

    def _rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["key", "n_ends", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(run, "key binary, n_ends long, ends_sha256 string")


def prefix_trie(turns: DataFrame, least: int = LEAST_ROWS, most: int = MOST_ROWS) -> DataFrame:
    """(key, parent, depth, conv, parent_conv, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256): a row for each
    distinct prefix of the conversations of ordered turns, the empty one (depth 0) included.

    conv is the least conversation with the prefix and n_convs their number; subtrees include their top; saved_tokens are the
    words that need not be read again, (n_convs - 1) times those of a node's last text, over its subtree. Conversations without
    a turn need a row of place 0. An empty table has no prefix and no row.

    Equal conversations are merged first. Bands of levels are then peeled from the deepest up, each written for the next: a level
    of many conversations is one aggregate, levels of few are peeled together in tasks that hold MOST_ROWS turns at most. The
    driver gets only the number of conversations for each length.
    """
    spark = turns.sparkSession
    ways = written(paths(turns), "trie_paths")
    copies = ways.groupBy("key", "depth").agg(F.first("path").alias("path"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"))
    none = F.lit(0).cast("long")
    columns = ["path", "conv", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ended = written(copies.select("depth", "path", "conv", "n_convs", none.alias("n_children"), none.alias("n_leaves"), none.alias("saved_tokens")), "trie_ended")
    lengths = {r["depth"]: r["n"] for r in ended.groupBy("depth").agg(F.sum("n_convs").alias("n")).collect()}
    base, parts, above = f"{shared_dir(spark)}/quayside/trie-{uuid.uuid4().hex}", [], None

    def keep(nodes: DataFrame) -> DataFrame:
        parts.append(f"{base}/{len(parts)}")
        nodes.write.parquet(parts[-1])
        return spark.read.schema(_NODE).parquet(parts[-1])

    for low, high in bands(lengths, least, most):
        rows = ended.where((F.col("depth") > low) & (F.col("depth") <= high)).select(*columns)
        if above is not None:
            rows = rows.unionByName(_stripped(above, high))
        nodes = keep(_level(rows, high) if high == low + 1 else _several(rows, low, high))
        above = nodes.where(F.col("depth") == low + 1)
    rows = ended.where("depth = 0").select(*columns)
    rows = rows if above is None else rows.unionByName(_stripped(above, 0))
    root = rows.agg(F.min("conv").alias("conv"), *(F.sum(c).alias(c) for c in columns[2:])).where("n_convs > 0")
    leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")).cast("long")
    keep(root.select(F.lit(b"").alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("int").alias("depth"), "conv", "n_convs", "n_children", leaves.alias("n_leaves"), "saved_tokens", F.lit(None).cast("binary").alias("path")))
    nodes = spark.read.schema(_NODE).parquet(*parts).drop("path")
    owners = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"), F.col("n_children").alias("_size"))
    nodes = joined_to_owner(nodes, owners, ["parent"], "_size").drop("_size").join(_ends(ways), "key", "left")
    return nodes.withColumns({"n_ends": F.coalesce("n_ends", F.lit(0).cast("long")), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))})


def _stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes as what survives of them at a depth above: their turns up to it, one child each."""
    return nodes.select(F.expr(f"substring(path, 1, {KEY * depth})").alias("path"), "conv", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    turns = written(ordered_turns(table(spark, sf_dir, "conversations")), "turns")
    found = prefix_trie(families(turns))
    return found.select(F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: CRC-32 bit by bit: -1 shifts, other numbers are bytes. The list of a list keeps equal steps apart.
_CRC = "xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END) END, CAST(4294967295 AS BIGINT)), 4294967295)"

ORACLE_SQL = f"""
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {BORROWED} AS h FROM (SELECT DISTINCT conv_id FROM placed)),
rebuilt AS (
  SELECT c.conv_id, p.place, p.role, p.said FROM convs c JOIN placed p ON p.conv_id = c.base AND p.place <= c.h
  UNION ALL SELECT c.conv_id, p.place, p.role, p.said FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place > c.h),
prefixes AS (
  SELECT conv_id, said, row_number() OVER w AS depth, list(CAST(length(role) AS VARCHAR) || ':' || role || said) OVER w AS key FROM rebuilt
  WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
chain AS (
  SELECT conv_id, depth, sha256(to_json(key)) AS key, len(regexp_extract_all(said, '[^\\x20\\x09-\\x0D]+')) AS words FROM prefixes
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS n FROM chain GROUP BY conv_id),
nodes AS (
  SELECT key, depth, min(c.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(CAST(c.conv_id AS VARCHAR), ',' ORDER BY c.conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM chain c JOIN lengths USING (conv_id) GROUP BY key, depth),
born AS (SELECT n.*, p.key AS parent_key, q.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN chain p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes q ON q.key = p.key),
bearing AS (SELECT parent_key AS key, count(*) AS n_children FROM born WHERE parent_key IS NOT NULL GROUP BY parent_key),
whole AS (SELECT b.*, coalesce(n_children, 0) AS n_children FROM born b LEFT JOIN bearing USING (key)),
sums AS (
  SELECT a.key, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, sum(w.saved) AS saved_tokens
  FROM whole w JOIN chain a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY a.key)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM whole JOIN sums USING (key)
"""
