"""Shared helpers: durable cut points, table readers and vectorised hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). A local one is set only where it is unset and all tasks run on this machine,
    as in tests; on a cluster an unset folder is an error, as executors would each write to their own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(?:\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master or 'the cluster'} share")
        at = "file://" + tempfile.mkdtemp(prefix="tarvos-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_written: dict[str, str] = {}  # path of every table written -> application that wrote it


def materialize(df: DataFrame, label: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    _written[path] = spark.sparkContext.applicationId
    out = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    out.table_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; without arguments all that this application has written."""
    mine = [p for p, app in _written.items() if app == spark.sparkContext.applicationId]
    for path in [t.table_path for t in tables] if tables else mine:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _written.pop(path, None)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, vectorised."""
    with np.errstate(over="ignore"):
        x = x + M1
        x = (x ^ (x >> np.uint64(30))) * M2
        x = (x ^ (x >> np.uint64(27))) * M3
        return x ^ (x >> np.uint64(31))
