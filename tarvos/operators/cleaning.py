"""The cleaning pass over parsed blocks: normalise, drop what is trivial, drop repeats within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from .lines import boilerplate

ITEM, CELL = "\u0001", "\u0002"  # stand between the strings of an array while they are normalised as one


def _each(c: Column) -> Column:
    """Normalised strings of an array, through one string, as the normal form needs a Python worker."""
    return F.transform(F.split(normalize(F.array_join(F.transform(c, lambda s: F.coalesce(s, F.lit(""))), ITEM)), ITEM), lambda s: F.trim(s))


def normalize_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks ``(.., kind, text, items, rows, headers, caption)`` in normal form; texts, lists and tables that become empty are out, and so
    are empty items and rows without text."""
    cells = F.transform("rows", lambda r: F.array_join(F.transform(r, lambda s: F.coalesce(s, F.lit(""))), CELL))
    b = blocks.withColumn("text", normalize(F.col("text"))).withColumn("items", F.when(F.col("items").isNotNull(), F.filter(_each(F.col("items")), lambda s: s != "")))
    b = b.withColumn("rows", F.when(F.col("rows").isNotNull(), F.transform(_each(cells), lambda r: F.transform(F.split(r, CELL), lambda s: F.trim(s)))))
    b = b.withColumn("rows", F.filter("rows", lambda r: F.exists(r, lambda s: s != "")))
    b = b.withColumn("headers", F.when(F.size("headers") > 0, _each(F.col("headers"))).otherwise(F.col("headers")))
    b = b.withColumn("caption", F.nullif(normalize(F.col("caption")), F.lit("")))
    return b.where(F.when(F.col("kind") == "list", F.size("items") > 0).when(F.col("kind") == "table", F.size("rows") > 0).otherwise(F.col("text") != ""))


def trivial(least: int = 20, heading: int = 2) -> Column:
    """Paragraphs under ``least`` characters or of boilerplate, headings under ``heading``, lists without an item of ``least``; no table."""
    short = (F.length("text") < least) | boilerplate(F.col("text"))
    return F.when(F.col("kind") == "paragraph", short).when(F.col("kind") == "heading", F.length("text") < heading).when(F.col("kind") == "list", ~F.exists("items", lambda s: F.length(s) >= least)).otherwise(F.lit(False))


def fingerprint() -> Column:
    """What makes two blocks of a document repeats, whatever their case; null for tables."""
    items = F.array_join(F.transform("items", lambda s: F.lower(s)), " | ")
    return F.when(F.col("kind") == "heading", F.concat(F.lit("h:"), F.lower("text"))).when(F.col("kind") == "paragraph", F.concat(F.lit("p:"), F.lower("text"))).when(F.col("kind") == "list", F.concat(F.lit("l:"), items))


def clean_blocks(blocks: DataFrame, id_col: str = "doc_id", least: int = 20, heading: int = 2) -> DataFrame:
    """The whole pass; positions keep their gaps. Of repeats the first stays, tables all do."""
    b = normalize_blocks(blocks).where(~trivial(least, heading)).withColumn("_fp", F.sha2(fingerprint(), 256))
    rn = F.row_number().over(Window.partitionBy(id_col, "_fp").orderBy("pos"))
    return b.withColumn("_rn", F.when(F.col("_fp").isNull(), 1).otherwise(rn)).where("_rn = 1").drop("_fp", "_rn")


def before_and_after(blocks: DataFrame, cleaned: DataFrame) -> DataFrame:
    """``kind, before, after``: numbers of blocks."""
    n = lambda d, name: d.groupBy("kind").agg(F.count("*").alias(name))
    return n(blocks, "before").join(n(cleaned, "after"), "kind", "left").select("kind", "before", F.coalesce("after", F.lit(0)).alias("after"))
