"""Ordered rule classification of pages by k-of-n signals, and the vote of a document's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A rule is (label, signals needed, signals); a signal is a list of (pattern, least number of matches) that must all be met. The first rule that
# holds wins. The labels, patterns and numbers, in the order of the cascade.
RULES = [
    ("syllabus", 3, [
        [(r"\bL\s*/?\s*T\s*/?\s*P\b", 1)], [(r"\d+\.\s+[A-Z]{2,4}-?\d{3}", 1)], [(r"Credit Hours|Contact Hours", 1)], [(r"Reading List|Reference Books|Text Books", 1)],
        [(r"Name of Books|Authors/Publisher", 1)], [(r"(?m)^\d+\.\s+[A-Z]", 3)],
    ]),
    ("policy", 1, [[(r"(?i)transcript", 1), (r"(?i)fee|verification|duplicate", 1)]]),
    ("policy", 1, [[(r"National Cadet Corps|National Service Scheme|\bNCC\b|\bNSS\b", 1)]]),
    ("form", 2, [[(r"FORM OF APPLICATION", 1)], [(r"Proposed Project Title", 1)], [(r"Signature of", 1)], [(r"Roll Number\s*:", 1)], [(r"\bDate\s*:", 2)]]),
    ("contact", 3, [[(r"PROFESSOR", 3)], [(r"ASSISTANT PROFESSOR", 2)], [(r"Ph\.D", 3)], [(r"\bDesignation\b", 1)]]),
    ("notice", 2, [
        [(r"Circular No|F\.\s*No|Ref:-", 1)], [(r"All Students|all students", 1)], [(r"last date|Last Date|due date", 1)], [(r"Dean Academic|Associate Dean", 1)],
        [(r"(?i)academic calendar", 1)], [(r"\d{2}\.\d{2}\.\d{4}", 4)],
    ]),
    ("placement", 2, [
        [(r"(?i)placement highlight|placement stat|placement record", 1)], [(r"(?i)No\.?\s*of Offers|number of offers", 1)], [(r"(?i)Average CTC|Median CTC|Highest CTC|Maximum CTC|LPA|lakh per annum", 1)],
        [(r"(?i)Students Registered for Placement|eligible students", 1)], [(r"(?i)placement coordinator|Training.*Placement|T&P|TPC|TNP", 1)], [(r"(?i)campus recruit|on.campus|off.campus", 1)],
        [(r"(?i)placement brochure|placement policy|placement procedure", 1)], [(r"(?i)top recruiter|hiring partner|dream offer|super dream", 1)], [(r"(?i)final.?placement.?report|placement.?season|placement.?overview", 1)],
        [(r"\bCTC\b", 1), (r"(?i)placement|MBA|package|salary", 1)], [(r"(?i)recruiters?|recruiting companies|companies? visit", 1), (r"(?i)campus|placement", 1)],
        [(r"(?i)\bplaced\b", 1), (r"(?i)placement|T&P|students", 1)],
    ]),
    ("admissions", 2, [
        [(r"(?i)joint admission|JAC Delhi|admission counsell", 1)], [(r"(?i)seat matrix|choice filling|allotment", 1)], [(r"(?i)JEE Main|JEE rank|All India Rank|opening rank|closing rank", 1)],
        [(r"(?i)online registration", 1), (r"(?i)admission|rank|seat|counsel", 1)], [(r"(?i)B\.?\s*Tech", 1), (r"(?i)admission|counsel|seat|programme|eligib", 1)], [(r"(?i)eligibility criteria|document verification|reporting", 1)],
    ]),
    ("policy", 2, [[(r"(?i)hostel", 1)], [(r"(?i)warden|allottee|allotment", 1)], [(r"(?i)resident|inmate|hosteller", 1)], [(r"(?i)mess", 1)], [(r"(?i)ragging", 1)]]),
    ("policy", 1, [[(r"(?i)ragging", 1)]]),
    ("policy", 1, [[(r"(?i)rules\s+for\s+\w+", 1), (r"(?m)^\d+\.\s+[A-Z]", 2)]]),
    ("policy", 2, [
        [(r"Regulation|Ordinance|R\.\s*1\s*\(B\)", 1)], [(r"\bshall be\b", 3)], [(r"Dean \(UG\)|Dean \(PG\)|COE\b|HOD\b", 1)], [(r"(?is)\battendance\b.*(?:percentage|75%)|(?:percentage|75%).*\battendance\b", 1)],
        [(r"CGPA|grade point|SGPA", 1)], [(r"CGPA|grade point|SGPA", 1), (r"(?i)percentage", 1)], [(r"(?i)letter\s*grade|numerical\s*grade", 1), (r"(?i)outstanding|excellent|formula|grade.?point|SGPA|CGPA", 1)],
        [(r"(?i)minimum\s*credits|maximum\s*credits|programme\s*credits", 1)], [(r"(?i)annexure", 1), (r"(?i)guidelines|procedure|regulation|student", 1)], [(r"(?i)financial support|merit scholarship|scholarship to", 1)],
        [(r"(?i)penalty|penalties", 1), (r"(?i)student", 1)], [(r"(?i)industrial training|field training", 1), (r"(?i)evaluation|procedure", 1)], [(r"(?i)unfair means", 1)],
        [(r"(?i)semester away|summer semester", 1), (r"(?i)register|credits", 1)],
    ]),
]


def signal(text: Column, parts: list[tuple[str, int]]) -> Column:
    """Whether all patterns of a signal are found often enough."""
    x = F.lit(True)
    for pattern, least in parts:
        x = x & (F.rlike(text, F.lit(pattern)) if least == 1 else F.regexp_count(text, F.lit(pattern)) >= least)
    return x


def count_signals(c: Column, signals: list[list[tuple[str, int]]]) -> Column:
    """How many signals a text has; null text has none."""
    text, out = F.coalesce(c, F.lit("")), F.lit(0)
    for parts in signals:
        out = out + signal(text, parts).cast("int")
    return out


def classify_page(c: Column, rules=RULES, default: str = "skip") -> Column:
    """First label whose rule holds; branches are evaluated in order and only as far as needed."""
    x = None
    for label, need, signals in rules:
        hold = count_signals(c, signals) >= need
        x = F.when(hold, F.lit(label)) if x is None else x.when(hold, F.lit(label))
    return x.otherwise(F.lit(default))


def document_vote(pages: DataFrame, doc: str, page: str, label: str, preferred: list[tuple[str, float]] = (("policy", 0.4), ("syllabus", 0.3)), skip: str = "skip") -> DataFrame:
    """``doc, document_class``: a preferred label with more than its share of the pages that are not skipped, else the most frequent (ties: the
    one seen on the earliest page), else ``skip``. Two aggregations with partial counts; no window over a document's pages."""
    per = pages.groupBy(doc, label).agg(F.count("*").alias("n"), F.min(page).alias("first"))
    kept = F.sum(F.when(F.col(label) != skip, F.col("n")))
    best = F.max_by(F.when(F.col(label) != skip, F.col(label)), F.when(F.col(label) != skip, F.struct("n", (-F.col("first")).alias("f"))))
    agg = per.groupBy(doc).agg(kept.alias("kept"), best.alias("best"), *[F.sum(F.when(F.col(label) == name, F.col("n"))).alias(f"n_{name}") for name, _ in preferred])
    x = None
    for name, share in preferred:
        hold = F.col(f"n_{name}") > share * F.col("kept")
        x = F.when(hold, F.lit(name)) if x is None else x.when(hold, F.lit(name))
    return agg.select(doc, x.otherwise(F.coalesce("best", F.lit(skip))).alias("document_class"))


def line_fonts(chars: DataFrame, keys: list[str], top: str = "top", size: str = "size", text: str = "char", x: str = "x") -> DataFrame:
    """Glyphs to lines: positions rounded half-even to two points make a line; its mean size and its text in reading order."""
    line = (F.bround(F.col(top) / 2) * 2).alias("line_top")
    glyphs = F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(text).alias("t"))))
    return chars.groupBy(*keys, line).agg(F.avg(size).alias("font"), F.array_join(F.transform(glyphs, lambda g: g["t"]), "").alias("line"))


def visible_glyphs(chars: DataFrame, x: str = "x", top: str = "top", width: str = "page_width", height: str = "page_height", upright: str = "upright") -> DataFrame:
    """Glyphs inside their page's box that stand upright; where the flag is missing they count as upright."""
    inside = F.col(x).between(0, F.col(width)) & F.col(top).between(0, F.col(height))
    return chars.where(inside & F.coalesce(F.col(upright), F.lit(True)))


def syllabus_tables(pages: DataFrame, tables: DataFrame, doc: str = "doc_id", widest: int = 15, least: int = 80) -> DataFrame:
    """``doc, page, tab, heading`` of the teaching schemes: tables of up to ``widest`` columns in their first row on syllabus pages that name
    lectures, tutorials and practicals, a repeated page once, with the page's first line as heading."""
    scheme = r"\bL\s*/?\s*T\s*/?\s*P\b"
    g = page_gates(pages, doc, least=least, unwanted=())
    g = g.where(F.col("kept") & (F.col("page_class") == "syllabus") & F.rlike("text", F.lit(scheme)))
    first = F.element_at(F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != ""), 1)
    narrow = tables.where("row = 0").groupBy(doc, "page", "tab").agg(F.count("*").alias("_n")).where(F.col("_n") <= widest).drop("_n")
    return narrow.join(g.select(doc, "page", first.alias("heading")), [doc, "page"])


def claim_tables(sections: DataFrame, tables: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(claimed, left over): the first section of a page takes the page's tables."""
    first = sections.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_rn = 1").drop("_rn")
    return tables.join(first, keys), tables.join(first, keys, "left_anti")


def page_gates(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text", least: int = 100, unwanted: tuple[str, ...] = ("syllabus", "contact", "form", "skip")) -> DataFrame:
    """Pages with ``page_class`` and ``kept``: a page goes that repeats an earlier one's text, has fewer than ``least`` characters or is of an
    unwanted class."""
    p = pages.withColumn("_t", F.trim(F.coalesce(text, F.lit(""))))
    p = p.withColumn("_h", F.when(F.col("_t") != "", F.sha2("_t", 256)))
    first = p.where("_h is not null").groupBy(doc, "_h").agg(F.min(page).alias("_first"))
    p = p.join(first, [doc, "_h"], "left").withColumn("page_class", classify_page(F.col(text)))
    kept = (F.col("_h").isNull() | (F.col(page) == F.col("_first"))) & (F.length("_t") >= least) & ~F.col("page_class").isin(*unwanted)
    return p.withColumn("kept", kept).drop("_t", "_h", "_first")


def class_counts(gated: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages of each class per document, and how many of them are kept."""
    return gated.groupBy(doc, "page_class").agg(F.count("*").alias("n_pages"), F.count_if(F.col("kept")).alias("n_kept"))
