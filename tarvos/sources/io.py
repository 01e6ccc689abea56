"""Sources and sinks: JSON lines, chunk files, HTML and Markdown files, upserts, deletes, payload patches, reports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CRAWL_SCHEMA = "url string, category string, doc_type string, http_status int, content_type string, last_modified string, etag string, content_length bigint, crawl_timestamp timestamp, link_date_label string, html_body_path string, _corrupt_record string"
CHUNK_SCHEMA = "chunk_id string, text string, source_url string, document_title string, section_heading string, breadcrumb string, document_type string, date_published string, date_scraped date, chunk_index int, token_count int, source_format string, block_type string, page_number int, batch_year int"


def read_crawl_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an explicit schema; what does not parse keeps its text in _corrupt_record, blank lines are skipped by the reader."""
    return spark.read.schema(CRAWL_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A .json array or .jsonl lines, by the suffix; a file that is missing or without a chunk is an error."""
    c = spark.read.schema(CHUNK_SCHEMA).option("multiLine", path.endswith(".json")).json(path)
    if c.isEmpty():
        raise ValueError(f"no chunks in {path}")
    return c


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, content`` of whole text files (HTML, Markdown)."""
    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_chunks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("document_type").parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). A local one is set only where it is unset and all tasks run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(?:\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tarvos-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """``df`` written as a table of the shared folder and read back, for a plan that is used several times; it outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str, tie: str | None = None) -> DataFrame:
    """Latest version of each key; at equal versions the larger ``tie`` or, without one, the change wins. Applying it twice changes nothing."""
    both = table.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.desc_nulls_last(version), *([F.desc_nulls_last(tie)] if tie else []), F.desc("_side")]).drop("_side")


def table_info(spark: SparkSession, path: str) -> tuple[bool, int]:
    """Whether a table is there, and its number of rows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return False, 0
    return True, spark.read.parquet(path).count()


def recreate(df: DataFrame, path: str) -> None:
    """The table anew, whatever was there."""
    df.write.mode("overwrite").parquet(path)


def chunk_source(rows: DataFrame, files: DataFrame, notes: str = "chunk_notes", stem: str = "stem") -> DataFrame:
    """Rows with ``chunk_path``: the path in the notes, else '{stem}_ir_chunks.jsonl', else '{stem}_chunks.jsonl', whichever is there first."""
    have = files.select(F.col("path").alias("_p")).distinct()
    wanted = [F.col(notes), F.concat(F.col(stem), F.lit("_ir_chunks.jsonl")), F.concat(F.col(stem), F.lit("_chunks.jsonl"))]
    x = rows.withColumn("_id", F.xxhash64(F.struct("*")))
    tried = x.select("_id", F.posexplode(F.array(*wanted)).alias("_k", "_p")).join(have, "_p").groupBy("_id").agg(F.min_by("_p", "_k").alias("chunk_path"))
    return x.join(tried, "_id", "left").drop("_id")


def delete_by_id(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def patch(table: DataFrame, **columns: Column) -> DataFrame:
    return table.withColumns(columns)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines, in as many files as its plan has parts."""
    df.write.mode("overwrite").json(path)
