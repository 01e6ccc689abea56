"""Joins with tables of unique keys that keep hot keys apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000  # rows of a few dozen bytes that may go to every executor


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    return df.limit(limit + 1).count() <= limit


def join_unique(df: DataFrame, unique: DataFrame, keys: list[str], spread: str, how: str = "left", salts: int = 32) -> DataFrame:
    """Join of ``df`` with a table that has each key once: broadcast where its rows are few, else every key's rows of ``df`` are spread over
    ``salts`` tasks by the column ``spread``, and the table is repeated that often."""
    if small(unique):
        return df.join(F.broadcast(unique), keys, how)
    many = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(many, [*keys, "_salt"], how).drop("_salt")
