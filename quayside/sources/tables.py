"""The given tables, and the tasks that are derived from lineitem."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.demand import demand_columns
from ..operators.order import ranked
from .shared import written

#: A total order of lineitem.
ARRIVAL = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
#: The whole table fills about so many waves.
WAVES = 15

_TASKS: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_tasks(lineitem: DataFrame, **more: Column) -> DataFrame:
    """(agent_id, r0..r3, duration) and more: one task for each row, numbered in the order of arrival; demands are whole and positive."""
    own = [
        F.round(F.col("l_quantity") * 100).cast("bigint").alias("r0"),
        F.round("l_extendedprice").cast("bigint").alias("r1"),
        (F.round(F.col("l_discount") * 1000).cast("bigint") + 1).alias("r2"),
        (F.round(F.col("l_tax") * 1000).cast("bigint") + 1).alias("r3"),
        F.col("l_linenumber").cast("bigint").alias("duration"),
        *(c.alias(n) for n, c in more.items()),
    ]
    return ranked(lineitem, ARRIVAL, "agent_id", own).select("agent_id", "r0", "r1", "r2", "r3", "duration", *more)


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of a set of tables, written once for each session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TASKS:
        _TASKS[key] = written(lineitem_tasks(table(spark, sf_dir, "lineitem")), "tasks")
    return _TASKS[key]


def capacities(df: DataFrame, waves: int = WAVES, demands: Sequence[str] | None = None) -> list[int]:
    """For each resource the least whole capacity that so many waves of the whole table fill."""
    demands = demand_columns(df, demands)
    row = df.agg(*(F.ceil(F.sum(d) / F.lit(float(waves))).cast("bigint").alias(d) for d in demands)).first()
    return [int(row[d] or 1) for d in demands]


def save_tasks(df: DataFrame, path: str, resources: Sequence[str], metadata: dict | None = None, overwrite: bool = False) -> None:
    """Tasks as Parquet with a manifest of their resources and metadata beside them; refuses to replace unless told to."""
    mode = "overwrite" if overwrite else "errorifexists"
    df.write.mode(mode).parquet(f"{path}/rows")
    manifest = json.dumps({"resources": list(resources), "schema": df.schema.jsonValue(), "metadata": metadata or {}}, sort_keys=True)
    df.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/manifest")


def load_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql.types import StructType

    return spark.read.schema(StructType.fromJson(load_manifest(spark, path)["schema"])).parquet(f"{path}/rows")


def save_results(df: DataFrame, path: str) -> None:
    """Result rows as CSV with a header, added to what is there."""
    df.write.mode("append").option("header", True).csv(path)


def load_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
