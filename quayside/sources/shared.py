"""Cuts of lineage as Parquet tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset on one machine (tests), one of our own.

    On a cluster a folder of our own would be a different one on each machine, so an unset one is an error there.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="quayside-")
    return _OWN_DIRS[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: a cut of lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/quayside/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
