"""The order-correlation gate over a stream: one decision for each key and window, once the watermark has closed it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..functions.demand import cosine, plus, uniform, uniform_number
from ..operators.metrics import GATE_THRESHOLD
from ..sources.shared import shared_dir

LATENESS = "2 hours"
WINDOW_SECONDS = 86_400
DECISIONS = "key string, window_start bigint, n_rows bigint, gate_score double, policy string"
#: Stands for a policy in rows that count what came too late.
LATE = "late"
_STATE = "ts array<bigint>, id array<bigint>, parts array<double>"


def _known(vectors: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Rows with a time and a vector other than zero; parts without a value are 0."""
    filled = vectors.withColumns({p: F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for p in parts})
    return filled.where(F.col("ts").isNotNull() & (plus([F.col(p) * F.col(p) for p in parts]) > 0))


def _start(seconds: int):
    return F.floor(F.unix_timestamp("ts") / F.lit(seconds)) * F.lit(seconds)


def gate_by_window(vectors: DataFrame, parts: Sequence[str], seconds: int = WINDOW_SECONDS, threshold: float = GATE_THRESHOLD, seed: int = 0) -> DataFrame:
    """The decisions of a whole table (key, ts, id and parts): how much more alike neighbours in time are than as many random pairs.

    Rows are ordered by time, then id, within a window; windows of one row have no neighbours and no decision.
    """
    own = _known(vectors, parts).withColumn("window_start", _start(seconds))
    order = Window.partitionBy("key", "window_start").orderBy("ts", "id")
    n = F.count(F.lit(1)).over(Window.partitionBy("key", "window_start"))
    placed = own.select("key", "window_start", *parts, (F.row_number().over(order) - 1).cast("bigint").alias("i"), n.alias("n"), *(F.lag(p).over(order).alias(f"was_{p}") for p in parts))
    near = placed.groupBy("key", "window_start").agg(F.max("n").alias("n_rows"), F.avg(cosine([F.col(p) for p in parts], [F.col(f"was_{p}") for p in parts])).alias("near")).where("n_rows > 1")
    pick = lambda salt: F.floor(uniform(seed, F.col("i"), F.lit(salt)) * F.col("n")).cast("bigint")
    pairs = placed.select(F.col("key").alias("k"), F.col("window_start").alias("w"), pick(1).alias("one"), pick(2).alias("other"))
    side = lambda name: placed.select(F.col("key").alias(f"k_{name}"), F.col("window_start").alias(f"w_{name}"), F.col("i").alias(f"i_{name}"), *(F.col(p).alias(f"{name}_{p}") for p in parts))
    met = lambda name: F.col("k").eqNullSafe(F.col(f"k_{name}")) & (F.col("w") == F.col(f"w_{name}")) & (F.col(name) == F.col(f"i_{name}"))
    joined = pairs.join(side("one"), met("one")).join(side("other"), met("other"))
    far = joined.groupBy("k", "w").agg(F.avg(cosine([F.col(f"one_{p}") for p in parts], [F.col(f"other_{p}") for p in parts])).alias("far"))
    both = near.join(far, F.col("key").eqNullSafe(F.col("k")) & (F.col("window_start") == F.col("w")))
    score = F.col("near") - F.col("far")
    return both.select("key", "window_start", "n_rows", F.round(score, 6).alias("gate_score"), F.when(score > threshold, "mp").otherwise("fifo_windowed").alias("policy"))


def decision(ts: Sequence[int], ids: Sequence[int], parts: np.ndarray, seed: int) -> float:
    """The gate's score of the rows of one window."""
    order = np.lexsort((ids, ts))
    unit = parts[order] / np.sqrt((parts[order] ** 2).sum(axis=1))[:, None]
    n = len(unit)
    one, other = ([int(uniform_number(seed, i, salt) * n) for i in range(n)] for salt in (1, 2))
    return float((unit[1:] * unit[:-1]).sum(axis=1).mean() - (unit[one] * unit[other]).sum(axis=1).mean())


def rolling_gate(vectors: DataFrame, parts: Sequence[str], seconds: int = WINDOW_SECONDS, lateness: str = LATENESS, threshold: float = GATE_THRESHOLD, seed: int = 0) -> DataFrame:
    """gate_by_window of a stream, in append mode: a window's rows are kept as state until the watermark passes its end.

    Rows that come for a window that is closed are dropped; each batch with such rows gives one row with policy LATE, no score (NaN)
    and their number. State holds the vectors of open windows alone.
    """
    m = len(parts)

    def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, start = key
        if state.hasTimedOut:
            ts, ids, flat = state.get
            state.remove()
            if len(ts) > 1:
                score = decision(ts, ids, np.array(flat, dtype=np.float64).reshape(-1, m), seed)
                yield pd.DataFrame([(name, start, len(ts), round(score, 6), "mp" if score > threshold else "fifo_windowed")], columns=["key", "window_start", "n_rows", "gate_score", "policy"])
            return
        if (int(start) + seconds) * 1000 <= state.getCurrentWatermarkMs():
            yield pd.DataFrame([(name, start, sum(map(len, frames)), float("nan"), LATE)], columns=["key", "window_start", "n_rows", "gate_score", "policy"])
            return
        ts, ids, flat = map(list, state.get) if state.exists else ([], [], [])
        for frame in frames:
            ts += frame["micros"].tolist()
            ids += frame["id"].tolist()
            flat += frame[list(parts)].to_numpy(dtype=np.float64).reshape(-1).tolist()
        state.update((ts, ids, flat))
        state.setTimeoutTimestamp((int(start) + seconds) * 1000)

    own = _known(vectors, parts).withWatermark("ts", lateness).withColumn("window_start", _start(seconds)).withColumn("micros", F.unix_micros("ts"))
    return own.groupBy("key", "window_start").applyInPandasWithState(gather, DECISIONS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drained(spark: SparkSession, stream: DataFrame) -> tuple[DataFrame, int]:
    """All decisions that a rolling gate appends until its source is read to its end, and how many rows came too late for it."""
    base = f"{shared_dir(spark)}/quayside/gate-{uuid.uuid4().hex}"
    epochs: list[int] = []

    def keep(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/{epoch}")
        epochs.append(epoch)

    query = stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not epochs:
        return spark.createDataFrame([], stream.schema), 0
    found = spark.read.schema(stream.schema).parquet(*(f"{base}/out/{e}" for e in sorted(set(epochs))))
    late = found.where(F.col("policy") == LATE).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    return found.where(F.col("policy") != LATE), late


def event_vectors(events: DataFrame) -> DataFrame:
    """Events as vectors: the value, the user and the number in the properties, each on a scale of its own, by type of event."""
    number = F.regexp_extract("props", r"([0-9]+)", 1).cast("double")
    return events.select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), (F.col("value") / 50.0).alias("p0"), (F.col("user_id") / 150.0).alias("p1"), (number / 100.0).alias("p2"))


def drain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions on all events, read as a stream: those of the windows that the last watermark has closed."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque[t]")
    return drained(spark, rolling_gate(event_vectors(events), ["p0", "p1", "p2"]))[0]
