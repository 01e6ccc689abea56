"""Audits of chunk tables and the retirement of superseded chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentence_end_density
from ..sources.io import cut, latest
from .skew import join_unique

REQUIRED = ["chunk_id", "text", "source_url", "document_title", "section_heading", "document_type", "chunk_index", "token_count"]
# Words of navigation, and what a record of a staff directory has once.
NAV_WORDS = r"(?i)\b(?:Home|About Us|Contact Us|Sitemap|Login|Click here|Read More|Quick Links|Important Links)\b"
DESIGNATION = r"(?i)Designation\s*:"
# Fixed values of the retirement rules: headings and texts of regulations, and what is kept of them.
REGULATION_HEADING = r"(?i)R\.?\s*1?\s*\(B\)\.?\s*\d+|^REGULATIONS\b"
REGULATION_TEXT = r"R\.\s*1\s*\(B\)\.\s*\d+\s+[A-Z]"
KEPT_HEADING = r"(?i)unfair\s*means"


def body_of(text: Column) -> Column:
    """What follows the first empty line, the whole text where there is none."""
    t = F.coalesce(text, F.lit(""))
    at = F.instr(t, "\n\n")
    return F.when(at > 0, F.substr(t, at + 2)).otherwise(t)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def audit(chunks: DataFrame) -> DataFrame:
    """``chunk_id, issue`` in long form: empty_meta, tiny, huge, multi_faculty, interleaved_or_runon, nav_junk, dup_text (a chunk whose body
    another id had first). Rows of a repeated body find its first owner through a partial aggregate, so no body is a hot spot."""
    t = F.coalesce("token_count", F.lit(0))
    c = chunks.withColumn("_body", body_of(F.col("text"))).withColumn("_h", F.sha2("_body", 256))
    owner = c.groupBy("_h").agg(F.min("chunk_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    c = join_unique(c, owner, ["_h"], "chunk_id")
    body = F.col("_body")
    flags = {
        "empty_meta": (F.coalesce("source_url", F.lit("")) == "") | (F.coalesce("document_title", F.lit("")) == ""),
        "tiny": (t > 0) & (t < 20), "huge": t > 700,
        "multi_faculty": (F.col("document_type") == "dept_faculty") & (F.regexp_count(body, F.lit(DESIGNATION)) > 1),
        "interleaved_or_runon": (F.col("block_type") == "prose") & (sentence_end_density(body) < 1.2) & (word_count(body) > 120),
        "nav_junk": F.regexp_count(body, F.lit(NAV_WORDS)) >= 4,
        "dup_text": F.col("chunk_id") > F.col("_first"),
    }
    return c.select("chunk_id", F.explode(F.filter(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(n)) for n, x in flags.items()]), lambda s: s.isNotNull())).alias("issue"))


def validate(chunks: DataFrame, tolerance: int = 5, low: int = 50, high: int = 700, prefix: str = "Section: ") -> DataFrame:
    """``check, n``: rows that miss a required value, whose count is off the estimate, out of bounds, with a bad heading, without the prefix,
    a repeated id or text, or an index that is not their place in their document; and numbers missing from ids of the form auto_n.
    Repeats are counted by aggregates; only the order needs a document's indexes together."""
    est = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)
    miss = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in REQUIRED])
    idx = F.row_number().over(Window.partitionBy("source_url").orderBy("chunk_index", "chunk_id")) - 1
    h = F.trim(F.coalesce("section_heading", F.lit("")))
    checks = {
        "required": miss, "token_count": F.abs(F.coalesce("token_count", F.lit(0)) - est) > tolerance, "bounds": ~F.coalesce("token_count", F.lit(0)).between(low, high),
        "heading": (h == "") | F.rlike(h, F.lit(r"^[0-9]+$")) | (F.length(h) < 4), "prefix": ~F.startswith(F.coalesce("text", F.lit("")), F.lit(prefix)),
    }
    one = lambda name, df, value: df.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("n")).select(F.lit(name).alias("check"), "n")
    flat = chunks.agg(*[F.count_if(c).alias(n) for n, c in checks.items()]).select(F.expr("stack({}, {}) as (check, n)".format(len(checks), ", ".join(f"'{n}', {n}" for n in checks))))
    number = F.regexp_extract(F.coalesce("chunk_id", F.lit("")), r"^auto_(\d+)$", 1).try_cast("bigint")
    repeats = lambda key: chunks.groupBy(key.alias("k")).agg(F.count("*").alias("c")).where("c > 1")
    return reduce(DataFrame.unionByName, [
        flat, one("dup_id", repeats(F.col("chunk_id")), F.sum("c")), one("dup_text", repeats(F.sha2(F.coalesce("text", F.lit("")), 256)), F.sum("c")),
        one("order", chunks.select((F.coalesce("chunk_index", F.lit(-1)) != idx).alias("x")), F.count_if(F.col("x"))),
        one("sequence", chunks.select(number.alias("k")).where("k is not null").distinct(), F.max("k") + 1 - F.count("*")),
    ])


def year_of(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"20\d{2}", 0), F.lit("")).cast("int"), F.lit(0))


def newest_year_only(chunks: DataFrame, heading: str = "section_heading", year: Column | str = "batch_year") -> DataFrame:
    """Ids of chunks whose heading (case and blanks ignored, four characters or more) another chunk has for a newer year."""
    h = F.lower(F.regexp_replace(F.trim(F.coalesce(heading, F.lit(""))), r"\s+", " "))
    x = chunks.select("chunk_id", h.alias("_h"), (F.col(year) if isinstance(year, str) else year).alias("_y")).where(F.length("_h") >= 4)
    top = x.groupBy("_h").agg(F.max("_y").alias("_top"), F.min("_y").alias("_low")).where("_low < _top").drop("_low")
    return join_unique(x, top, ["_h"], "chunk_id", "inner").where("_y < _top").select("chunk_id")


def floods(chunks: DataFrame, heading: str = "section_heading", most: int = 15, keep: int = 3) -> DataFrame:
    """Ids beyond the first ``keep`` of (source, heading) groups of more than ``most`` chunks, headings of four characters or more. The first
    of a group are taken task by task before they meet, so a group of any size does."""
    x = chunks.select("chunk_id", "source_url", F.lower(F.trim(heading)).alias("_h"), F.coalesce("chunk_index", F.lit(0)).alias("_i")).where(F.length("_h") >= 4)
    big = x.groupBy("source_url", "_h").agg(F.count("*").alias("_n")).where(F.col("_n") > most).drop("_n")
    x = join_unique(x.where("source_url is not null"), big, ["source_url", "_h"], "chunk_id", "inner")
    first = x.withColumn("_rn", F.row_number().over(Window.partitionBy("source_url", "_h").orderBy("_i", "chunk_id"))).where(F.col("_rn") <= keep)
    return x.join(first.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id")


def retired(chunks: DataFrame, scope: str = "ordinance", exempt: str = "curated_stats") -> DataFrame:
    """``chunk_id, rule_no`` of the chunks of addresses within ``scope`` that go, each by the first rule it falls under: 1 a regulation by its
    heading or the first 400 characters of its text; 2 an older year's prose under a heading that a newer year has; 3 beyond the first three of
    more than 15 chunks under one heading of a document; 4 the prose that is left. Headings on unfair means stay from rules 1 and 4."""
    c = chunks.where(F.contains(F.lower(F.coalesce("source_url", F.lit(""))), F.lit(scope)) & ~F.col("document_type").eqNullSafe(exempt))
    c = cut(c.select("chunk_id", "source_url", "section_heading", "block_type", "chunk_index", F.rlike(F.left(F.coalesce("text", F.lit("")), F.lit(400)), F.lit(REGULATION_TEXT)).alias("_rule")), "scope")
    kept = F.rlike(F.coalesce("section_heading", F.lit("")), F.lit(KEPT_HEADING))
    prose = ~F.col("block_type").eqNullSafe("table")
    rule = F.rlike(F.coalesce("section_heading", F.lit("")), F.lit(REGULATION_HEADING)) | F.col("_rule")
    one = c.where(~kept & rule).select("chunk_id")
    rest = c.join(one, "chunk_id", "left_anti")  # each rule reads the cut table anew, of which only short columns are left
    two = newest_year_only(rest.where(prose), "section_heading", year_of(F.col("source_url")))
    rest = rest.join(two, "chunk_id", "left_anti")
    three = floods(rest)
    four = rest.join(three, "chunk_id", "left_anti").where(prose & ~kept).select("chunk_id")
    return reduce(DataFrame.unionByName, [x.select("chunk_id", F.lit(n).alias("rule_no")) for n, x in enumerate((one, two, three, four), 1)])


def retire(chunks: DataFrame, *id_sets: DataFrame, dry_run: bool = False) -> DataFrame:
    """Chunks without the ids of any set; a dry run changes nothing."""
    if dry_run:
        return chunks
    ids = reduce(DataFrame.unionByName, [x.select("chunk_id") for x in id_sets])
    return chunks.join(ids.distinct(), "chunk_id", "left_anti")


def current(chunks: DataFrame) -> DataFrame:
    return latest(chunks, ["chunk_id"], [F.desc_nulls_last("date_scraped"), F.desc("text")])
