"""Line tables: headings, sections, table blocks, list and contents tests, cleaning of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the heading rules.
NUMBERED = r"^\d+(?:\.\d+)*\.?\s+[A-Z]"
MODAL = r"(?i)\b(?:shall|must|will|may|is|are|was|were)\b"
REGULATION = r"(?i)^R\.\s*\d+\s*(?:\([A-Za-z]\))?\s*\.\s*\d+"
JUNK = r"[=∑σ≥≤±×÷→←∫∝∂]|[.…]{3,}|[-–—]{4,}"
CUT_SHORT = r"(?i)\b(?:and|or|the|a|an|of|in|for|with|to|from|by|as|at|on|into|about|that|which|who|whose|when|where|if|but|nor|yet|so)\s*$"
DEFINITION = r"(?i)^(?:[ivxlcdm]+\.|[a-z]\.)\s+.+\bshall mean\b"
# What no heading is: a number alone, a lower-case or bracketed start, notes and captions, list marks, an open or finished end.
NO_HEADING = [r"^\d+\.?\d*\s*$", r"^[\p{Ll}(]", r"(?i)^(?:note|provided|table|figure)", r"(?i)^(?:[a-d]\)|(?:i{1,3}|iv|vi{0,3}|ix|x{1,3})\))", r"[.,:;)]$", CUT_SHORT, DEFINITION, JUNK]
NUMBERED_START = r"(?i)^(?:\d|[IVXLCDM]+\.?\s)"
OCR_WORDS = r"(?i)\b(?:the|and|of|in|for|to|a|an|is|are|has|was)\b"


def explode_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, pos, line``; null text has no line, empty text one empty line."""
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))


def heading_by_text(line: Column, next_line: Column) -> Column:
    """Heading by its wording: 5 to 119 characters with a letter, nothing on the list of what no heading is, no sentence's verb unless it is
    numbered, and the next line that is not empty is longer."""
    s = F.trim(line)
    ok = F.length(s).between(5, 119) & F.rlike(s, F.lit("[A-Za-z]")) & (F.length(next_line) > F.length(s))
    for p in NO_HEADING:
        ok = ok & ~F.rlike(s, F.lit(p))
    return ok & (~F.rlike(s, F.lit(MODAL)) | F.rlike(s, F.lit(NUMBERED_START)) | F.rlike(s, F.lit(REGULATION)))


def headings(lines: DataFrame, id_col: str = "doc_id", least_body: int = 3, page: str | None = None, font: str | None = None, page_font: str | None = None) -> DataFrame:
    """``is_heading`` of each line: a regulation number, a line set in a font 2.5 points above its page's mean (where fonts are given), or a
    heading by its wording; and then only if ``least_body`` lines that are not empty follow before the next such line of the page, or
    it is a regulation number. Without ``page`` a document is one page."""
    keys = [id_col, *([page] if page else [])]
    w = Window.partitionBy(*keys).orderBy("pos")
    text, s = F.nullif(F.trim("line"), F.lit("")), F.trim("line")
    rule = F.rlike(s, F.lit(REGULATION))
    big = F.coalesce((F.col(page_font) > 0) & (F.col(font) > F.col(page_font) + 2.5), F.lit(False)) if font else F.lit(False)
    x = lines.withColumn("_next", F.coalesce(*[F.lead(text, k).over(w) for k in range(1, 6)]))
    cand = text.isNotNull() & (((rule | big) & ~F.rlike(s, F.lit(JUNK))) | F.coalesce(heading_by_text(F.col("line"), F.col("_next")), F.lit(False)))
    x = x.withColumn("_cand", cand).withColumn("_body", (text.isNotNull() & ~F.col("_cand")).cast("int"))
    x = x.withColumn("_seg", F.sum(F.col("_cand").cast("int")).over(w))
    x = x.withColumn("_n", F.sum("_body").over(Window.partitionBy(*keys, "_seg")))
    return x.withColumn("is_heading", F.col("_cand") & ((F.col("_n") >= least_body) | rule)).drop("_next", "_cand", "_body", "_seg", "_n")


def sections(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, section_no, heading, body``: lines grouped under the last heading, 'Preamble' before the first; empty bodies are out."""
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = marked.withColumn("section_no", F.sum(F.col("is_heading").cast("int")).over(w))
    body = F.filter(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "line")))), lambda r: F.trim(r["line"])), lambda s: s != "")
    g = x.groupBy(id_col, "section_no").agg(F.max(F.when(F.col("is_heading"), F.trim("line"))).alias("heading"), F.array_join(body, "\n").alias("body"))
    return g.where("body <> ''").select(id_col, F.col("section_no").cast("bigint").alias("section_no"), F.coalesce("heading", F.lit("Preamble")).alias("heading"), "body")


def breadcrumbs(heads: DataFrame, id_col: str = "doc_id", levels: int = 6, title: str | None = None) -> DataFrame:
    """Headings ``(id, pos, level, text)`` to ``breadcrumb``: a level is in the chain if its last heading stands after the last heading of
    every shallower level; the title comes first, repeats in a row collapse."""
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = heads
    for k in range(1, levels + 1):
        x = x.withColumn(f"_m{k}", F.max(F.when(F.col("level") == k, F.struct("pos", "text"))).over(w))
    chain = []
    for k in range(1, levels + 1):
        at = F.coalesce(F.col(f"_m{k}.pos"), F.lit(-1))
        above = F.greatest(F.lit(-1), *[F.coalesce(F.col(f"_m{j}.pos"), F.lit(-1)) for j in range(1, k)]) if k > 1 else F.lit(-1)
        chain.append(F.when(at > above, F.col(f"_m{k}.text")))
    full = F.filter(F.array(*([F.col(title)] if title else []), *chain), lambda t: t.isNotNull())
    keep = F.filter(full, lambda t, i: (i == 0) | (t != F.element_at(full, F.greatest(i, F.lit(1)))))
    return x.withColumn("breadcrumb", F.array_join(keep, " > ")).drop(*[f"_m{k}" for k in range(1, levels + 1)])


def contents_share(body: Column) -> Column:
    """Whether a section is a table of contents: four lines or more of which three in five end in a number of up to three digits."""
    lines = F.filter(F.split(body, "\n"), lambda s: F.trim(s) != "")
    hit = F.filter(lines, lambda s: F.rlike(s, F.lit(r"\D\d{1,3}\s*$")))
    return (F.size(lines) >= 4) & (F.size(hit) >= 0.6 * F.size(lines))


def runs(lines: DataFrame, flag: Column, id_col: str = "doc_id", least: int = 3) -> DataFrame:
    """Gaps and islands: ``id_col, first_pos, n_lines`` of runs of at least ``least`` flagged lines."""
    w = Window.partitionBy(id_col).orderBy("pos")
    x = lines.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_g", F.col("pos") - F.sum(F.col("_f").cast("int")).over(w))
    return x.where("_f").groupBy(id_col, "_g").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_lines")).where(F.col("n_lines") >= least).drop("_g")


def text_tables(lines: DataFrame, id_col: str = "doc_id", least: int = 3) -> DataFrame:
    """``id_col, kind, first_pos, n_lines`` of tables in plain text: runs of lines with two bars or more (kind pipe), and runs of ``least`` other
    lines with columns set apart by three blanks (kind aligned)."""
    kind = F.when(F.regexp_count("line", F.lit(r"\|")) >= 2, "pipe").when(F.rlike("line", F.lit(r"\S+\s{3,}\S+")), "aligned")
    x = lines.withColumn("kind", kind).where("kind is not null")
    x = x.withColumn("_g", F.col("pos") - F.row_number().over(Window.partitionBy(id_col, "kind").orderBy("pos")))
    g = x.groupBy(id_col, "kind", "_g").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_lines"))
    return g.where((F.col("kind") == "pipe") | (F.col("n_lines") >= least)).drop("_g")


def merge_paragraphs(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adjacent non-blank lines to one paragraph each: ``id_col, par_no, text``."""
    w = Window.partitionBy(id_col).orderBy("pos")
    s = F.trim("line")
    x = lines.withColumn("_b", (s == "").cast("int")).withColumn("_g", F.sum("_b").over(w)).where(s != "")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.trim("line").alias("t")))), lambda r: r["t"]), " ")
    g = x.groupBy(id_col, "_g").agg(F.min("pos").alias("first_pos"), joined.alias("text"))
    return g.withColumn("par_no", F.row_number().over(Window.partitionBy(id_col).orderBy("first_pos")).cast("bigint") - 1).select(id_col, "par_no", "text")


def boilerplate(line: Column) -> Column:
    """Empty, a bare address, nothing but digits and marks, or a trail of three or more crumbs under 250 characters."""
    s = F.trim(F.coalesce(line, F.lit("")))
    crumb = r"[\p{L}\p{N}_\s.&'\-()]+"
    trail = F.rlike(s, F.lit(rf"^{crumb}(?:[>|/»·]{crumb}){{2,}}$")) & (F.length(s) < 250)
    return (s == "") | F.rlike(s, F.lit(r"^https?://\S+$")) | F.rlike(s, F.lit(r"^[\d\s.,;:\-–—|/\\()\[\]{}]+$")) | trail


def dedup_in_document(pars: DataFrame, id_col: str = "doc_id", pos: str = "par_no", text: str = "text") -> DataFrame:
    """First of each text within a document, case ignored."""
    rn = F.row_number().over(Window.partitionBy(id_col, F.lower(text)).orderBy(pos))
    return pars.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def ocr_headings(lines: DataFrame, id_col: str = "doc_id", page: str | None = None) -> DataFrame:
    """Scanned text's heading rule on lines that are not empty: up to 90 characters, no end mark, and numbered, or all capitals (five or
    more), or a title of up to 60 characters without a sentence's small words before a longer line of its page."""
    w = Window.partitionBy(id_col, *([page] if page else [])).orderBy("pos")
    x = lines.where("trim(line) <> ''").withColumn("s", F.trim("line")).withColumn("_next", F.lead("s").over(w))
    s = F.col("s")
    short = (F.length(s) <= 60) & F.rlike(s, F.lit(r"^\p{Lu}")) & (F.length("_next") > F.length(s)) & ~F.rlike(s, F.lit(OCR_WORDS))
    kind = F.rlike(s, F.lit(r"^[0-9]+[.)]\s+\S")) | F.rlike(s, F.lit(r"^[A-Z][A-Z\s\-/]{4,}$")) | short
    keep = [id_col, *([page] if page else []), "pos", "s"]
    return x.select(*keep, F.coalesce((F.length(s) <= 90) & ~F.rlike(s, F.lit(r"[.,;]$")) & kind, F.lit(False)).alias("is_heading"))


def ocr_blocks(lines: DataFrame, id_col: str = "doc_id", page: str = "page") -> DataFrame:
    """``id_col, page, pos, kind, text, level`` of scanned pages: a heading line is a block, the lines between two of them one paragraph, which
    never crosses a page. ``pos`` is the block's first line."""
    x = ocr_headings(lines, id_col, page)
    w = Window.partitionBy(id_col, page).orderBy("pos")
    h = F.col("is_heading").cast("int")
    x = x.withColumn("_p", F.coalesce(F.lag(h).over(w), F.lit(0))).withColumn("_g", F.sum(h + F.col("_p")).over(w))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda r: r["s"]), " ")
    g = x.groupBy(id_col, page, "_g").agg(F.min("pos").alias("pos"), F.max("is_heading").alias("h"), text.alias("text"))
    return g.select(id_col, page, "pos", F.when(F.col("h"), "heading").otherwise("paragraph").alias("kind"), "text", F.when(F.col("h"), 1).alias("level"))


def drop_repeated_pages(pages: DataFrame, id_col: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Pages without later copies of a page's text within a document; pages without text are all kept. The first of each text is taken by a
    partial aggregate, so the texts of a document do not meet."""
    p = pages.withColumn("_h", F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.sha2(F.trim(text), 256)))
    first = p.where("_h is not null").groupBy(id_col, "_h").agg(F.min(page).alias("_first"))
    return p.join(first, [id_col, "_h"], "left").where(F.col("_h").isNull() | (F.col(page) == F.col("_first"))).drop("_h", "_first")


def scanned_documents(pages: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 80) -> DataFrame:
    """``id_col, n_pages, scanned``: fewer than half of a document's pages have ``least`` characters of text."""
    full = (F.length(F.trim(F.coalesce(text, F.lit("")))) >= least).cast("int")
    return pages.groupBy(id_col).agg(F.count("*").alias("n_pages"), (F.sum(full) < 0.5 * F.count("*")).alias("scanned"))
