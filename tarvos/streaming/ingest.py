"""Structured Streaming: crawl log ingest, address de-duplication, the stage log folded to state, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.io import CRAWL_SCHEMA


def crawl_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(CRAWL_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("maxFilesPerTrigger", per_trigger).json(path)


def first_seen(stream: DataFrame, time: str = "crawl_timestamp", delay: str = "1 day") -> DataFrame:
    """First record of an address within the watermark; state older than ``delay`` is dropped."""
    return stream.where("_corrupt_record is null and url is not null").withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])


def stage_state(events: DataFrame) -> DataFrame:
    """Newest status per address and stage, kept by the engine's aggregate state (complete or update mode)."""
    return events.groupBy("url", "stage").agg(F.max_by("status", F.struct("seq", "ts", "status")).alias("status"), F.max("seq").alias("last_seq"))


def event_windows(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def without_known_content(stream: DataFrame, known: DataFrame, content: str = "content_hash") -> DataFrame:
    """Stream rows whose content no row of the table ``known`` has; rows without a hash pass."""
    k = known.select(F.col(content).alias("_k")).where("_k is not null").distinct()
    return stream.join(k, F.col(content) == F.col("_k"), "left").where("_k is null").drop("_k")


def upsert_stream(stream: DataFrame, target: str, keys: list[str], version: str, checkpoint: str, after: Callable[[SparkSession, int], None] | None = None) -> StreamingQuery:
    """Idempotent upsert: each micro-batch writes the latest of its rows in a folder named by its id, so a batch run twice writes the same
    folder again and no batch writes the table anew. ``folded`` reads the table, ``compact`` shortens the log; ``after`` runs when a batch
    is written, as the retirement of superseded rows does."""
    from ..sources.io import latest

    def write(batch: DataFrame, epoch: int) -> None:
        latest(batch, keys, [F.desc_nulls_last(version)]).write.mode("overwrite").parquet(f"{target}/v{epoch}")
        if after is not None:
            after(batch.sparkSession, epoch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, target: str) -> list[int]:
    """Ids of the batches that are wholly written, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    done = lambda s: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName()[:1] == "v" and done(s))


def folded(spark: SparkSession, target: str, keys: list[str], version: str) -> DataFrame:
    """The upserted table: the latest version of each key over all batches; at equal versions the later batch wins."""
    from functools import reduce

    from ..sources.io import latest

    parts = [spark.read.parquet(f"{target}/v{v}").withColumn("_batch", F.lit(v)) for v in versions(spark, target)]
    if not parts:
        raise ValueError(f"no batch in {target}")
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return latest(every, keys, [F.desc_nulls_last(version), F.desc("_batch")]).drop("_batch")


def compact(spark: SparkSession, target: str, keys: list[str], version: str) -> None:
    """All batches but the last become one: the fold is written beside them, then put in the place of the newest of them. A reader sees the
    same table before and after; run twice it changes nothing."""
    old = versions(spark, target)[:-1]
    if len(old) < 2:
        return
    from functools import reduce

    from ..sources.io import latest

    path = lambda v: spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{v}")
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(f"{target}/v{v}").withColumn("_batch", F.lit(v)) for v in old])
    latest(every, keys, [F.desc_nulls_last(version), F.desc("_batch")]).drop("_batch").write.mode("overwrite").parquet(f"{target}/compacted")
    fs = path("compacted").getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(f"v{old[-1]}"), True)
    fs.rename(path("compacted"), path(f"v{old[-1]}"))
    for v in old[:-1]:
        fs.delete(path(f"v{v}"), True)
