"""The stage manifest: an append-only event log folded to state, and relational operators on the state table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import join_unique

STAGES = ["scrape", "download", "parse", "clean", "chunk", "embed", "index"]
STATUSES = ["pending", "running", "done", "failed", "skipped"]


def fold_events(events: DataFrame) -> DataFrame:
    """Newest status per address and stage (by sequence, then time); notes are the last given ones. Aggregation is partial before the
    shuffle, so an address with a large share of the log is no hot spot."""
    order = F.struct("seq", "ts", "status")
    note = F.when(F.coalesce(F.col("notes"), F.lit("")) != "", F.struct("seq", "ts", "notes"))
    return events.groupBy("url", "stage").agg(F.max_by("status", order).alias("status"), F.max(note)["notes"].alias("notes"), F.count("*").alias("n_events"), F.max("seq").alias("last_seq"))


def state_table(events: DataFrame) -> DataFrame:
    """One row per address, a status column per stage ('pending' where the log is silent)."""
    f = fold_events(events)
    cols = [F.coalesce(F.max(F.when(F.col("stage") == s, F.col("status"))), F.lit("pending")).alias(f"{s}_status") for s in STAGES]
    return f.groupBy("url").agg(*cols)


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: str = "url", order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` whose key is new, the first writer of each key; null keys are skipped."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*(order or [F.lit(1)])))
    fresh = new.where(F.col(key).isNotNull()).join(existing.select(key), key, "left_anti")
    return fresh.withColumn("_rn", first).where("_rn = 1").drop("_rn")


def unpivot_stages(manifest: DataFrame, *keep: str) -> DataFrame:
    pairs = ", ".join(f"'{s}', {s}_status" for s in STAGES)
    return manifest.select(*keep, F.expr(f"stack({len(STAGES)}, {pairs}) as (stage, status)"))


def stage_counts(manifest: DataFrame) -> DataFrame:
    return unpivot_stages(manifest).groupBy("stage", "status").agg(F.count("*").alias("n"))


def dashboard(manifest: DataFrame) -> DataFrame:
    """Counts per stage and status, per category, in total and of duplicates, in one long table."""
    s = stage_counts(manifest).select(F.concat_ws(":", F.lit("stage"), "stage", "status").alias("metric"), "n")
    c = manifest.groupBy("category").agg(F.count("*").alias("n")).select(F.concat_ws(":", F.lit("category"), F.coalesce("category", F.lit("null"))).alias("metric"), "n")
    t = manifest.agg(F.count("*").alias("total"), F.count_if(F.col("is_duplicate")).alias("duplicates")).select(F.expr("stack(2, 'total', total, 'duplicates', duplicates) as (metric, n)"))
    return s.unionByName(c).unionByName(t)


def queue(manifest: DataFrame, stage: str, status: str = "pending") -> DataFrame:
    return manifest.where(F.col(f"{stage}_status") == status).orderBy("id")


def recover(manifest: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """What a crash left running is pending again; the rest is untouched."""
    return manifest.withColumns({f"{s}_status": F.when(F.col(f"{s}_status") == "running", F.lit("pending")).otherwise(F.col(f"{s}_status")) for s in stages})


def ready_to_embed(manifest: DataFrame) -> DataFrame:
    return manifest.where("chunk_status = 'done' and embed_status = 'pending'")


def recent(manifest: DataFrame, days: int = 7, now: Column | None = None) -> DataFrame:
    """Rows scraped within ``days`` before ``now`` (given as a column, or the newest time in the table)."""
    if now is None:
        last = manifest.agg(F.max("date_scraped").alias("_now"))
        m = manifest.join(F.broadcast(last))  # one row
    else:
        m = manifest.withColumn("_now", now)
    return m.where(F.col("date_scraped") >= F.col("_now") - F.expr(f"interval {days} days")).drop("_now").orderBy(F.desc("date_scraped"))


def first_of_hash(manifest: DataFrame, key: str = "file_hash", *order: str) -> DataFrame:
    """``key, _first`` (a struct of ``order``): the smallest row of each value that more than one row has. A partial aggregate takes it, so no
    value is a hot spot, and values of a single row, and nulls, are out."""
    g = manifest.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*(order or ("id", "url")))).alias("_first"), F.count("*").alias("_n"))
    return g.where("_n > 1").drop("_n")


def mark_hash_duplicates(manifest: DataFrame) -> DataFrame:
    """The first row (by id) of each content hash stays; later ones are duplicates of it: open stages are skipped, the flag is set (and
    never taken back), the note names the original unless there is one. Null hashes are nobody's duplicate. Stages left running by a
    crash are open as well."""
    m = join_unique(manifest, first_of_hash(manifest), ["file_hash"], "id").withColumn("duplicate_of", F.when(F.col("_first.id") != F.col("id"), F.col("_first.url"))).drop("_first")
    dup = F.col("duplicate_of").isNotNull()
    out = {f"{s}_status": F.when(dup & F.col(f"{s}_status").isin("pending", "running"), F.lit("skipped")).otherwise(F.col(f"{s}_status")) for s in STAGES[1:]}
    out["is_duplicate"] = dup | F.coalesce("is_duplicate", F.lit(False)) if "is_duplicate" in manifest.columns else dup
    out["scrape_notes"] = F.when(dup, F.coalesce("scrape_notes", F.concat(F.lit("duplicate_of:"), "duplicate_of"))).otherwise(F.col("scrape_notes"))
    return m.withColumns(out)


def known_by_hash(manifest: DataFrame, new: DataFrame, statuses: tuple[str, ...] = ("done",)) -> DataFrame:
    """Rows ``(url, file_hash)`` with ``known_url``: the first other address (by id) with the hash whose download has one of the statuses.
    Two candidates of each hash suffice, as at most one of them is the row itself."""
    two = manifest.where(F.col("file_hash").isNotNull() & F.col("download_status").isin(*statuses)).groupBy("file_hash").agg(F.min_by("url", "id").alias("_a"), F.min("id").alias("_i"))
    rest = manifest.where(F.col("download_status").isin(*statuses)).join(two, "file_hash").where(F.col("id") > F.col("_i")).groupBy("file_hash").agg(F.min_by("url", "id").alias("_b"))
    x = new.join(two.drop("_i").join(rest, "file_hash", "left"), "file_hash", "left")
    return x.withColumn("known_url", F.when(F.col("_a") != F.col("url"), F.col("_a")).otherwise(F.col("_b"))).drop("_a", "_b")


def stage_event(stage: str, status: str, url: Column, seq: Column, ts: Column, notes: Column | None = None) -> list[Column]:
    """Columns of one event of the log; unknown stages and statuses are refused as they are written."""
    if stage not in STAGES:
        raise ValueError(f"no such stage: {stage}")
    if status not in STATUSES:
        raise ValueError(f"no such status: {status}")
    return [url.alias("url"), seq.alias("seq"), ts.alias("ts"), F.lit(stage).alias("stage"), F.lit(status).alias("status"), (notes if notes is not None else F.lit(None)).cast("string").alias("notes")]


def valid_events(events: DataFrame) -> DataFrame:
    """Events with an address and a known stage and status."""
    return events.where(F.col("url").isNotNull() & F.col("stage").isin(*STAGES) & F.col("status").isin(*STATUSES))


def apply_updates(manifest: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows with the last update (by seq) of each address: ``updates`` are ``url, seq`` and any of the manifest's columns, where null
    leaves a value as it is. One row per address is written at once, so file data and status cannot part."""
    cols = [c for c in updates.columns if c not in ("url", "seq")]
    last = updates.where("url is not null").groupBy("url").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in cols])
    x = manifest.join(last, "url", "left")
    return x.withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).select(*manifest.columns)


def finalized(downloads: DataFrame, stage: str = "download") -> DataFrame:
    """Updates of finished downloads ``(url, seq, file_path, file_size, file_hash)``: file data with the stage done and its path as note."""
    return downloads.select("url", "seq", "file_path", "file_size", "file_hash", F.lit("done").alias(f"{stage}_status"), F.col("file_path").alias(f"{stage}_notes"))


def by_document_type(manifest: DataFrame, kind: str) -> DataFrame:
    return manifest.where(F.col("document_type") == kind).orderBy("id")


def pdf_work(manifest: DataFrame, superseded: DataFrame | None = None) -> DataFrame:
    """Downloaded PDFs with a file that are not indexed yet (null counts as not) and not superseded, by id."""
    m = manifest.where((F.col("download_status") == "done") & F.col("category").like(r"%\_pdf%") & F.col("file_path").isNotNull() & ~F.col("index_status").eqNullSafe("done"))
    return (m if superseded is None else m.join(superseded.select("url").distinct(), "url", "left_anti")).orderBy("id")


def html_work(manifest: DataFrame, categories: list[str], force: bool = False) -> DataFrame:
    """Scraped pages of the categories with a file, unless their index note says they are done, by id."""
    m = manifest.where((F.col("scrape_status") == "done") & F.col("category").isin(*categories) & F.col("file_path").isNotNull())
    return (m if force else m.where(~F.col("index_notes").eqNullSafe("html_done"))).orderBy("id")


def import_crawl(records: DataFrame, doctypes: dict[str, str]) -> DataFrame:
    """Crawl records to manifest rows: malformed and address-less ones are out, the first crawl of an address counts, the document
    type comes from the category."""
    good = records.where("_corrupt_record is null and url is not null and trim(url) <> ''")
    kind = F.create_map(*[F.lit(x) for kv in doctypes.items() for x in kv])
    return insert_or_ignore(
        good.sparkSession.createDataFrame([], "url string"), good, "url", [F.col("crawl_timestamp").asc_nulls_last(), F.coalesce("http_status", F.lit(0)), F.coalesce("category", F.lit(""))]
    ).select(
        "url", F.coalesce("category", F.lit("unknown")).alias("category"),
        F.coalesce(F.try_element_at(kind, F.coalesce("category", F.lit(""))), F.lit("unknown")).alias("document_type"),
        F.coalesce(F.nullif("link_date_label", F.lit("")), "last_modified").alias("date_published"),
        F.when(F.col("http_status") == 200, "done").otherwise("failed").alias("scrape_status"),
        F.to_json(F.struct("http_status", "content_type", "etag", "content_length")).alias("scrape_notes"),
    )


def import_quality(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("malformed"),
        F.count_if(F.col("_corrupt_record").isNull() & (F.coalesce(F.trim("url"), F.lit("")) == "")).alias("without_url"),
        F.countDistinct(F.when(F.col("_corrupt_record").isNull(), F.nullif(F.trim("url"), F.lit("")))).alias("addresses"),
    )
