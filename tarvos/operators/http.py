"""Outcome semantics of fetches: retry classes, content gates, back-off, dates, content duplicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import join_unique

# Statuses worth another try and content types taken.
RETRY = [429, 500, 502, 503, 504]
TYPES = ["application/pdf", "text/html", "application/xhtml+xml", "text/plain"]


def mime(c: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(c, F.lit("")), F.lit(";"), F.lit(1))))


def outcome(status: Column, content_type: Column, length: Column, least: int = 512) -> Column:
    """retry, fatal, wrong_type, too_small, ok; a missing status is fatal, a missing length is not judged."""
    return (
        F.when(status.isNull(), "fatal").when(status.isin(RETRY), "retry").when(status >= 400, "fatal").when(status >= 300, "redirect")
        .when(~mime(content_type).isin(TYPES), "wrong_type").when(length < least, "too_small").otherwise("ok")
    )


def backoff(attempt: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def http_date(c: Column) -> Column:
    """ISO time of an HTTP date, with or without its weekday; what does not parse stays as it is."""
    t = F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), c)


def note(prefix: str, message: Column, longest: int = 1000) -> Column:
    return F.left(F.concat_ws(": ", F.lit(prefix), message), F.lit(longest))


def content_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, content_hash, first_id``: the smallest id with the same content. The minimum is taken by a partial aggregate and only contents
    that repeat are joined back with their rows spread, so that no content is a hot spot; null content has no hash and is its own first."""
    d = df.select(F.col(id_col).alias("id"), F.sha2(F.col(text_col), 256).alias("content_hash"))
    first = d.where("content_hash is not null").groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    x = join_unique(d, first, ["content_hash"], "id")
    return x.select("id", "content_hash", F.coalesce("first_id", "id").alias("first_id"))


def content_length(c: Column) -> Column:
    """A Content-Length header as a number, null if it is none."""
    return F.trim(c).try_cast("bigint")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


@dataclass(frozen=True)
class FetchConfig:
    """Settings of fetches, refused as they are made if they make no sense."""

    concurrency: int = 4
    max_retries: int = 3
    base_delay: float = 1.0
    max_delay: float = 60.0
    timeout: float = 30.0
    min_bytes: int = 512

    def __post_init__(self):
        for name, least in (("concurrency", 1), ("max_retries", 0), ("base_delay", 0), ("timeout", 0.001), ("min_bytes", 0)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")
        if self.max_delay < self.base_delay:
            raise ValueError("max_delay must not be below base_delay")


def log_line(level: Column, message: Column, **fields: Column) -> Column:
    """A log entry as one JSON object; fields without a value are left out."""
    return F.to_json(F.struct(level.alias("level"), message.alias("message"), *[c.alias(n) for n, c in fields.items()]))


def log_level(result: Column) -> Column:
    return F.when(result == "ok", "info").when(result.isin("retry", "redirect"), "warning").otherwise("error")
