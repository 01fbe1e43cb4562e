"""Structured Streaming over the events: demand per window with a watermark for late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

WINDOW = "1 hour"
LATENESS = "2 hours"


def windowed(events: DataFrame, window: str = WINDOW, lateness: str | None = LATENESS) -> DataFrame:
    """(window_start, event_type, n, value_milli) of a stream or table of events; values are summed as whole thousandths."""
    own = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 1000).cast("bigint").alias("milli"))
    own = own.withWatermark("ts", lateness) if own.isStreaming else own
    return own.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("milli").alias("value_milli")).select(F.unix_timestamp("w.start").alias("window_start"), "event_type", "n", "value_milli")


def drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of all events, read as a stream to its end.

    In update mode a batch writes the windows that it changed, and windows that the watermark has closed leave the state; of each
    window the row of its last batch stands. Rows that come after their window was closed count nowhere.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return merged(spark, windowed(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(sf_dir))))


def merged(spark: SparkSession, totals: DataFrame) -> DataFrame:
    """The last state of each window of a stream of totals."""
    base = f"{shared_dir(spark)}/quayside/stream-{uuid.uuid4().hex}"
    epochs: list[int] = []

    def keep(rows: DataFrame, epoch: int) -> None:
        rows.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{base}/out/{epoch}")
        epochs.append(epoch)

    query = totals.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not epochs:
        return spark.createDataFrame([], totals.schema)
    rows = spark.read.parquet(*(f"{base}/out/{e}" for e in sorted(set(epochs))))
    last = F.max(F.struct("epoch", "n", "value_milli")).alias("last")
    return rows.groupBy("window_start", "event_type").agg(last).select("window_start", "event_type", "last.n", "last.value_milli")


def _folder(sf_dir: str) -> str:
    return f"{sf_dir}/events.parque[t]"
