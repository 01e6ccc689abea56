"""Address predicates, ordered rules and names made of addresses."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rules are data: (category, pattern), the first that matches wins; refusals are tested before. These fit the tables' own hosts.
DENY = [r"(?i)/(?:login|register|admin|result|marksheet)[/.]", r"(?i)^(?:mailto|javascript):", r"(?i)[?&]session="]
ALLOW = [
    ("ordinance_pdf", r"(?i)/ordinance/.*\.pdf"), ("ordinance_html", r"(?i)/ordinance/"), ("notice_pdf", r"(?i)/notice/.*\.pdf"), ("notice_html", r"(?i)/notice/"),
    ("scholarship_pdf", r"(?i)/scholarship/"), ("syllabus_pdf", r"(?i)/syllabus/"), ("exam_pdf", r"(?i)/exam/"), ("anti_ragging_pdf", r"(?i)/anti_ragging/"),
    ("dept_pdf", r"(?i)/dept/"), ("hostel_html", r"(?i)/hostel/"), ("tnp_html", r"(?i)/(?:tnp|placement)/"), ("admissions_html", r"(?i)/admissions?/"), ("library_html", r"(?i)/library/"),
    ("page_html", r"(?i)\.php(?:[?#].*)?$"),
]


def is_pdf(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(r"(?i)\.pdf(\?.*)?$")), F.lit(False))


def denied(c: Column, deny: list[str] = DENY) -> Column:
    x = F.lit(False)
    for p in deny:
        x = x | F.rlike(c, F.lit(p))
    return F.coalesce(x, F.lit(False))


def classify(c: Column, allow: list[tuple[str, str]] = ALLOW, deny: list[str] = DENY) -> Column:
    """'denied', the first matching category, or 'unknown'; null addresses are unknown. One expression, no join."""
    x = F.when(c.isNull(), F.lit("unknown")).when(denied(c, deny), F.lit("denied"))
    for name, pattern in allow:
        x = x.when(F.rlike(c, F.lit(pattern)), F.lit(name))
    return x.otherwise(F.lit("unknown"))


def allowed(c: Column, allow: list[tuple[str, str]] = ALLOW, deny: list[str] = DENY) -> Column:
    return ~classify(c, allow, deny).isin("denied", "unknown")


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z]+://([^/?#]+)", 1))


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)


def stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path(c), r"([^/]*)$", 1), r"\.[A-Za-z0-9]+$", "")


def title_of(c: Column) -> Column:
    return F.translate(stem(c), "_-", "  ")


def safe_name(c: Column, longest: int = 120) -> Column:
    return F.substring(F.trim(F.regexp_replace(path(c), r"[^A-Za-z0-9_.\-]", "_"), F.lit("_")), 1, longest)


def collision_suffix(df: DataFrame, name: str, order: str, hot: int = 100_000) -> DataFrame:
    """``unique_name``: the first holder keeps the name, the k-th gets _k. Names that already look suffixed stay distinct because they are
    numbered within their own name. Names of more than ``hot`` rows are numbered in ranges of their order: each range by itself, plus the
    rows of the ranges before it; null names stay null."""
    n = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi")).where(F.col("_n") > hot)
    # ranges of equal width of the order; a count of rows per range is bounded by rows / hot
    x = df.join(F.broadcast(n) if n.limit(100_001).count() <= 100_000 else n, name, "left")
    width = (F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_n") / F.lit(hot))
    x = x.withColumn("_r", F.coalesce(F.floor((F.col(order) - F.col("_lo")) / width), F.lit(0)))
    per = x.where("_n is not null").groupBy(name, "_r").agg(F.count("*").alias("_c"))
    before = per.select(name, "_r", (F.sum("_c").over(Window.partitionBy(name).orderBy("_r")) - F.col("_c")).alias("_before"))
    x = x.join(before, [name, "_r"], "left")
    rn = F.row_number().over(Window.partitionBy(name, "_r", F.when(F.col(name).isNull(), F.xxhash64(order))).orderBy(order)) + F.coalesce("_before", F.lit(0))
    x = x.withColumn("_rn", rn)
    return x.withColumn("unique_name", F.when(F.col("_rn") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), F.col("_rn").cast("string")))).drop("_n", "_lo", "_hi", "_r", "_before", "_rn")


def rule_join(df: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """The same first match as a join with a rule table ``(rule_no, category, pattern)`` of checked size, once per distinct address;
    repeated rows stay."""
    n = rules.limit(10_001).count()
    if n > 10_000:
        raise ValueError("rule tables hold at most 10,000 rules")
    each = df.select(F.col(url).alias("_u")).where("_u is not null").distinct()
    hit = each.join(F.broadcast(rules), F.rlike("_u", F.col("pattern"))).groupBy("_u").agg(F.min_by("category", "rule_no").alias("_c"))
    return df.join(hit, F.col(url) == F.col("_u"), "left").withColumn("category_found", F.coalesce("_c", F.lit("unknown"))).drop("_u", "_c")


def department(c: Column) -> Column:
    """The department in the path of a faculty page, null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?i)Departments/([^/]+)/faculty", 1), F.lit(""))


def url_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def follow(links: DataFrame, url: str = "url", pdf_only: bool = False, categories: list[str] | None = None, drop: str | None = None, allow=ALLOW, deny=DENY) -> DataFrame:
    """Links worth following, once per page and address: allowed ones, of them PDFs only, or those of some categories (any PDF
    besides), without addresses that match ``drop``."""
    kind = classify(F.col(url), allow, deny)
    x = links.withColumn("category", kind).where(~F.col("category").isin("denied", "unknown"))
    if pdf_only:
        x = x.where(is_pdf(F.col(url)))
    if categories is not None:
        x = x.where(F.col("category").isin(*categories) | is_pdf(F.col(url)))
    return x if drop is None else x.where(~F.rlike(F.col(url), F.lit(drop)))


def resolve(base: str, href: str) -> str | None:
    try:
        return urljoin(base or "", re.sub(r"\s+", "", href or ""))
    except ValueError:
        return None


# What reads the pages of a category; any other page is read for its links alone.
ROUTES = {"ordinance_html": "pdf_index", "scholarship_pdf": "pdf_index", "notice_html": "notice_index", "dept_pdf": "department", "hostel_html": "hostel", "tnp_html": "placement", "admissions_html": "admissions", "exam_pdf": "exam_portal"}


def route(category: Column, is_file: Column, routes: dict[str, str] = ROUTES, default: str = "generic") -> Column:
    """The reader of an address: files are only registered, pages go by their category."""
    table = F.create_map(*[F.lit(x) for kv in routes.items() for x in kv])
    return F.when(is_file, F.lit("register")).otherwise(F.coalesce(F.try_element_at(table, F.coalesce(category, F.lit(""))), F.lit(default)))


def crawl_record(pages: DataFrame, doctypes: dict[str, str]) -> DataFrame:
    """Crawl records of fetched addresses: the class of the address, its document type, the body's key for pages."""
    kind = F.create_map(*[F.lit(x) for kv in doctypes.items() for x in kv])
    found = classify(F.col("url"))
    return pages.select("url", found.alias("category"), F.coalesce(F.try_element_at(kind, found), F.lit("unknown")).alias("doc_type"), "http_status", F.when(~is_pdf(F.col("url")), F.concat(url_hash(F.col("url")), F.lit(".html"))).alias("html_body_path"), route(found, is_pdf(F.col("url"))).alias("reader"))
