"""Sharding by fixed virtual slots and a versioned map of slots to shards."""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.shared import shared_dir
from .common import table

SLOTS = 8192
SHARDS = 40
ROW_BYTES = 16
MAP_SCHEMA = T.StructType([T.StructField(n, t, False) for n, t in (("version", T.IntegerType()), ("virtual_slot", T.IntegerType()), ("shard", T.IntegerType()), ("bytes", T.LongType()), ("rows", T.LongType()), ("first", T.LongType()))])


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot): no text, only what placing a record takes.

    The slot is a hash of the id with the size and checksum of the text, so rows without an id spread too.
    A null text has no bytes and the checksum of no bytes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")).withColumn(
        "virtual_slot", F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(slots)).cast("int")
    )


def slot_sizes(placed: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of every slot; as many as there are slots, however many records."""
    sizes = [(0, 0)] * slots
    for r in placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect():
        sizes[r["virtual_slot"]] = (r["bytes"], r["rows"])
    return sizes


def _entries(version: int, sizes: list[tuple[int, int]], shard_of: list[int]) -> list[tuple]:
    """Map entries; first is the place of a slot's first record in its shard."""
    filled: dict[int, int] = {}
    out = []
    for slot, ((size, rows), shard) in enumerate(zip(sizes, shard_of, strict=True)):
        out.append((version, slot, shard, size, rows, filled.get(shard, 0)))
        filled[shard] = filled.get(shard, 0) + rows
    return out


def first_map(sizes: list[tuple[int, int]], shards: int = SHARDS) -> list[tuple]:
    """Version 0: the slots by falling bytes, each to the shard with the fewest bytes so far."""
    loads, shard_of = [(0, s) for s in range(shards)], [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s][0], s)):
        load, shard = heapq.heappop(loads)
        shard_of[slot] = shard
        heapq.heappush(loads, (load + sizes[slot][0], shard))
    return _entries(0, sizes, shard_of)


def grown_map(entries: list[tuple]) -> list[tuple]:
    """The next version with one more shard: slots move only into it, from the fullest shard of the moment."""
    version, sizes, shard_of = entries[0][0], [(e[3], e[4]) for e in entries], [e[2] for e in entries]
    new = max(shard_of) + 1
    own: dict[int, list[int]] = {s: [] for s in range(new)}
    for slot in sorted(range(len(sizes)), key=lambda s: (sizes[s][0], s)):
        own[shard_of[slot]].append(slot)
    loads = {s: sum(sizes[x][0] for x in own[s]) for s in own}
    goal, got = sum(loads.values()) // (new + 1), 0
    fullest = [(-load, s) for s, load in loads.items()]
    heapq.heapify(fullest)
    while fullest and got < goal:
        load, s = heapq.heappop(fullest)
        fits = [x for x in own[s] if 0 < sizes[x][0] <= goal - got]
        if not fits or -load <= goal:
            continue
        slot = fits[-1]
        own[s].remove(slot)
        shard_of[slot] = new
        got += sizes[slot][0]
        heapq.heappush(fullest, (load + sizes[slot][0], s))
    return _entries(version + 1, sizes, shard_of)


def save_map(spark, entries: list[tuple], path: str) -> None:
    """Adds one version to the stored map; earlier versions stay readable."""
    spark.createDataFrame(entries, MAP_SCHEMA).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> list[tuple]:
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return [tuple(r) for r in stored.where(F.col("version") == version).orderBy("virtual_slot").select(*MAP_SCHEMA.names).collect()]


def assign(placed: DataFrame, entries: list[tuple]) -> DataFrame:
    """placed with shard, and slot: the place of the record in its shard, without gaps from 0.

    The map has one row for each virtual slot, so its broadcast has a fixed size. Records are numbered
    within their virtual slot, never within a whole shard.
    """
    spark = placed.sparkSession
    slots = F.broadcast(spark.createDataFrame(entries, MAP_SCHEMA).select("virtual_slot", "shard", "first"))
    order = Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size")
    numbered = placed.withColumn("in_slot", F.row_number().over(order) - 1)
    return numbered.join(slots, "virtual_slot").withColumn("slot", F.col("first") + F.col("in_slot")).drop("first", "in_slot")


def op4_virtual_slot_shards(spark, sf_dir: str) -> DataFrame:
    """The records by version 0 of a stored map; grown_slot_shard is the shard of version 1, with one shard more.

    Version 0 is stored and read again, then edited for a forty-first shard and stored as version 1.
    """
    placed = records(table(spark, sf_dir, "documents"))
    path = f"{shared_dir(spark)}/quayside/slot-map-{uuid.uuid4().hex}"
    save_map(spark, first_map(slot_sizes(placed)), path)
    save_map(spark, grown_map(load_map(spark, path)), path)
    found = assign(placed, load_map(spark, path, 0))
    grown = F.broadcast(spark.createDataFrame(load_map(spark, path), MAP_SCHEMA).select("virtual_slot", F.col("shard").alias("grown_slot_shard"), F.col("version").alias("grown_version")))
    return found.join(grown, "virtual_slot").select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(0).alias("map_version"), "grown_slot_shard", "grown_version",
    )
