"""Pieces the training-data operators share: texts, bit votes, runs of keys, and from the core tables and cuts of lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from ..sources.tables import table

__all__ = ["bitmap_of", "in_bitmap", "joined_to_owner", "majority", "may_hold", "small_batches", "table", "texts_of", "vote_counts", "whole_keys", "written"]

#: Bits of the largest bitmap of keys that is sent to all tasks: 8 MB.
BITMAP_BITS = 1 << 26
#: Bytes of an Arrow batch that goes to a Python worker, unless the session says otherwise.
BATCH_BYTES = 4 << 20
#: Hashes whose bits are unpacked at a time, 64 bytes for each.
VOTE_ROWS = 1 << 17


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes where the session leaves that open; 10,000 whole texts of any length are too many for a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def vote_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of 64-bit hashes that begins at starts: how many of them set each bit, as (runs, 64).

    The unpacked bits are added eight byte lanes at a time; a lane holds 255, so longer runs are added
    in pieces first. Every run must have at least one hash.
    """
    ends = np.append(starts[1:], len(hashes))
    sizes = ends - starts
    if len(hashes) > VOTE_ROWS:
        return _votes_by_blocks(hashes, starts, ends)
    lanes = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    if len(sizes) and sizes.max() <= 255:
        return np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    partial = np.add.reduceat(lanes, at, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    return np.add.reduceat(partial, first, axis=0)


def _votes_by_blocks(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """vote_counts of many hashes, VOTE_ROWS at a time, so that a very long text needs no more memory than a block."""
    out = np.zeros((len(starts), 64), dtype=np.int64)
    for a in range(0, len(hashes), VOTE_ROWS):
        b = min(a + VOTE_ROWS, len(hashes))
        first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
        out[first:last] += vote_counts(hashes[a:b], np.maximum(starts[first:last] - a, 0))
    return out


def majority(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints: a bit is 1 if set in over half of the hashes."""
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def whole_keys(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables cut where key changes, from batches sorted by key, so that no key is split between two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut == 0 and held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        elif cut == 0:
            held.append(batch)
        else:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def bitmap_of(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bitmap, as 64-bit words, with the bit of each key modulo bits (a power of two); the driver gets bits / 8 bytes at most."""
    place = F.pmod(F.col(key), F.lit(bits))
    held = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod({key}, 64) AS INT))")).alias("held")).toArrow()
    bitmap = np.zeros(bits // 64, dtype=np.uint64)
    bitmap[held.column("word").to_numpy()] = held.column("held").to_numpy().view(np.uint64)
    return bitmap


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.int64) & (64 * len(bitmap) - 1)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def may_hold(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test of columns of 64-bit keys: false only for keys that are not among those of a table.

    The test looks into a bitmap with eight bits a key at least while that fits BITMAP_BITS; beyond, more other keys pass.
    It spares a join the rows that surely have no partner, and never decides alone.
    """
    bits, n = 1 << 16, keys.count()
    while bits < min(8 * n, BITMAP_BITS):
        bits *= 2
    shared = keys.sparkSession.sparkContext.broadcast(bitmap_of(keys, key, bits))

    @F.pandas_udf("boolean")
    def test(column):
        import pandas as pd

        return pd.Series(in_bitmap(shared.value, column.to_numpy(dtype=np.int64)))

    return lambda name: test(name)


def joined_to_owner(rows: DataFrame, owners: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows left-joined to owners, which has one row for each key, where a key may own any share of the rows.

    size names owners' column with the number of rows a key owns. Keys that own over a thousandth of all rows, a thousand at
    most, are broadcast; no other key brings more than that to one task of the shuffled join. Null keys stay without owner.
    """
    total = owners.agg(F.sum(size)).first()[0] or 0
    hot = owners.where(F.col(size) > max(1_000, total / 1_000))
    names = [c for c in owners.columns if c not in keys]
    early = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    found = early.where("_hot").select(*rows.columns, *names)
    rest = early.where(F.col("_hot").isNull()).select(*rows.columns)
    return found.unionByName(rest.join(owners, keys, "left").select(*rows.columns, *names))
