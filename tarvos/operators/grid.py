"""Cells of raw tables, as rows ``(table, row, col, cell)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cell = lambda: F.nullif(F.trim(F.coalesce(F.col("cell"), F.lit(""))), F.lit(""))


def forward_fill(g: DataFrame) -> DataFrame:
    """Empty cells take the value above in their column."""
    w = Window.partitionBy("tab", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("filled", F.coalesce(F.last(cell(), ignorenulls=True).over(w), F.lit("")))


def data_start(g: DataFrame) -> DataFrame:
    """First row after the first with more than half its cells filled, else the number of rows."""
    r = g.groupBy("tab", "row").agg(F.count(cell()).alias("full"), F.count("*").alias("every"))
    return r.groupBy("tab").agg(F.coalesce(F.min(F.when((F.col("row") >= 1) & (F.col("full") * 2 > F.col("every")), F.col("row"))), F.max("row") + 1).cast("bigint").alias("data_start"))


def combine_headers(g: DataFrame) -> DataFrame:
    """Header of each column: its first non-empty cell above the data, else 'Col n'."""
    h = g.join(data_start(g), "tab").where(F.col("row") < F.col("data_start"))
    first = F.min_by(cell(), F.when(cell().isNotNull(), F.col("row")))
    return h.groupBy("tab", "col").agg(F.coalesce(first, F.concat(F.lit("Col "), (F.col("col") + 1).cast("string"))).alias("header"))


def header_repeats(g: DataFrame) -> DataFrame:
    """Rows below the first that repeat two or more header cells, case ignored."""
    h = g.where("row = 0").select("tab", "col", F.lower(cell()).alias("h"))
    return g.where("row > 0").join(h, ["tab", "col"]).groupBy("tab", "row").agg(F.count_if(F.lower(cell()) == F.col("h")).alias("same")).where("same >= 2").select("tab", "row", "same")


def meaningful_rows(g: DataFrame) -> DataFrame:
    return g.groupBy("tab", "row").agg(F.max(F.rlike(F.coalesce("cell", F.lit("")), F.lit("[A-Za-z]{3,}"))).alias("meaningful"))


def linearize(headers: Column, cells: Column, caption: Column | None = None) -> Column:
    """'caption: h: c, h: c' without cells that have no letter or digit; the shorter of headers and cells counts."""
    n = F.least(F.size(headers), F.size(cells))
    pair = F.zip_with(F.slice(headers, 1, n), F.slice(cells, 1, n), lambda h, c: F.when(F.rlike(F.coalesce(c, F.lit("")), F.lit("[A-Za-z0-9]")), F.when(F.rlike(F.coalesce(h, F.lit("")), F.lit("[A-Za-z0-9]")), F.concat(h, F.lit(": "), c)).otherwise(c)))
    body = F.array_join(F.filter(pair, lambda x: x.isNotNull()), ", ")
    return F.when(body == "", F.lit("")).otherwise(F.concat(F.coalesce(F.concat(caption, F.lit(": ")), F.lit("")), body) if caption is not None else body)


def linearize_rows(rows: Column, headers: Column, caption: Column) -> Column:
    """Lines of an array of rows, each as by ``linearize``, without the caption where there is none; rows without a word are out. Without
    headers a row is its cells."""
    word = lambda c: F.rlike(F.coalesce(c, F.lit("")), F.lit("[A-Za-z0-9]"))
    bare = lambda r: F.array_join(F.transform(F.filter(r, word), lambda c: F.trim(c)), ", ")

    def named(r):
        n = F.least(F.size(headers), F.size(r))
        pair = F.zip_with(F.slice(headers, 1, n), F.slice(r, 1, n), lambda h, c: F.when(word(c), F.when(word(h), F.concat(F.trim(h), F.lit(": "), F.trim(c))).otherwise(F.trim(c))))
        return F.array_join(F.filter(pair, lambda x: x.isNotNull()), ", ")

    lead = F.when(F.coalesce(caption, F.lit("")) != "", F.concat(caption, F.lit(": "))).otherwise(F.lit(""))
    return F.transform(F.filter(F.transform(rows, lambda r: F.when(F.size(headers) > 0, named(r)).otherwise(bare(r))), lambda s: s != ""), lambda s: F.concat(lead, s))


def to_block(g: DataFrame) -> DataFrame:
    """``tab, headers, rows`` of raw grids: header rows combined, merged cells filled, and of the data rows those that are not empty, do not
    repeat the header and hold a word of three letters; grids without such a row are out. Rows are padded or cut to the header's width."""
    heads = combine_headers(g).groupBy("tab").agg(F.sort_array(F.collect_list(F.struct("col", "header"))).alias("_h"))
    heads = heads.select("tab", F.transform("_h", lambda x: x["header"]).alias("headers"))
    full = forward_fill(g).join(data_start(g), "tab").where(F.col("row") >= F.col("data_start"))
    rows = full.groupBy("tab", "row").agg(F.sort_array(F.collect_list(F.struct("col", "filled"))).alias("_c"))
    rows = rows.join(heads, "tab").withColumn("cells", F.transform("headers", lambda h, i: F.coalesce(F.try_element_at(F.transform(F.filter("_c", lambda x: x["col"] == i), lambda x: F.trim(x["filled"])), F.lit(1)), F.lit(""))))
    same = F.size(F.filter(F.zip_with("headers", "cells", lambda h, c: (h != "") & (F.lower(F.trim(h)) == F.lower(c))), lambda x: x))
    rows = rows.where(F.exists("cells", lambda c: F.rlike(c, F.lit("[A-Za-z]{3,}"))) & (same < 2))
    g2 = rows.groupBy("tab").agg(F.max("headers").alias("headers"), F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("_r"))
    return g2.select("tab", "headers", F.transform("_r", lambda x: x["cells"]).alias("rows"))
