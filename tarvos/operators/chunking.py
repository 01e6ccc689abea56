"""Token-budget packing and chunk records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_year, sentences, squash, token_estimate


def estimate(s: Column) -> Column:
    """The default token count, one per four characters; every function below takes another in its place."""
    return F.floor(F.length(s) / 4).cast("int")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pack(units: Column, budget: Column | int, joiner: str = " ", count=estimate, base: Column | int = 0, first: int = 0) -> Column:
    """Greedy groups of an array of units: a new group opens when the units so far and the next (each a token more than its count)
    pass the budget; the first unit of a later group is charged its count and ``first``, all groups ``base`` besides. One fold inside the
    row, no shuffle."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    start = F.lit(base) if isinstance(base, int) else base.cast("int")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), start.alias("n"), F.lit(0).alias("k"))

    def step(a, s):
        over = (a["k"] > 0) & (a["n"] + count(s) + 1 > b)
        return F.struct(
            F.when(over, F.array_append(a["done"], a["cur"])).otherwise(a["done"]).alias("done"),
            F.when(over | (a["k"] == 0), s).otherwise(F.concat(a["cur"], F.lit(joiner), s)).alias("cur"),
            F.when(over, start + count(s) + first).otherwise(a["n"] + count(s) + 1).alias("n"),
            F.when(over, F.lit(1)).otherwise(a["k"] + 1).alias("k"),
        )

    return F.aggregate(units, zero, step, lambda a: F.when(a["k"] > 0, F.array_append(a["done"], a["cur"])).otherwise(a["done"]))


def merge_tail(groups: Column, least: int = 100, joiner: str = "\n", count=estimate) -> Column:
    """Groups under ``least`` tokens are appended to the one before."""
    zero = F.array().cast("array<string>")

    def step(a, s):
        n = F.size(a)
        small = (n > 0) & (count(s) < least)
        return F.when(small, F.array_append(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), F.concat(F.element_at(a, F.greatest(n, F.lit(1))), F.lit(joiner), s))).otherwise(F.array_append(a, s))

    return F.aggregate(groups, zero, lambda a, s: F.when(F.size(a) == 0, F.array(s)).otherwise(step(a, s)))


def overlap_of(s: Column, target: int = 100, most: int = 120, count=estimate) -> Column:
    """What a group hands to the next: all of it up to ``target`` tokens, else its last ``most`` tokens (4 characters each) from their first
    sentence start on, a capital or an opening bracket after a full stop."""
    def long(tail):
        return let(F.regexp_extract(tail, r"(?s)\.\s([A-Z(].*)$", 1), lambda start: F.when(start != "", start).otherwise(tail))

    return let(s, lambda x: F.trim(F.when(count(x) <= target, x).otherwise(let(F.right(x, F.lit(4 * most)), long))))


def with_overlap(groups: Column, target: int = 100, most: int = 120, joiner: str = " ", count=estimate) -> Column:
    """Each later group starts with the overlap of the one before."""

    def led(all_, g, i):
        before = overlap_of(F.element_at(all_, F.greatest(i, F.lit(1))), target, most, count)
        return F.when(i == 0, g).otherwise(let(before, lambda b: F.when(b == "", g).otherwise(F.concat(b, F.lit(joiner), g))))

    return let(groups, lambda all_: F.transform(all_, lambda g, i: led(all_, g, i)))


def pack_prose(text: Column, budget: Column | int, least: int = 100, count=estimate) -> Column:
    """A text within the budget as it is, else its sentences packed, led by overlaps, small pieces joined to the one before."""
    b = F.lit(budget) if isinstance(budget, int) else budget

    def split(t):
        packed = merge_tail(with_overlap(pack(sentences(t), b, count=count), count=count), least, " ", count)
        return F.when(count(t) <= b, F.array(t)).otherwise(let(packed, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(t))))

    return let(text, split)


def chunk_id(url: Column, index: Column) -> Column:
    return F.concat(F.lit("c_"), F.substring(F.sha2(F.concat(url, F.lit("::"), index.cast("string")), 256), 1, 14))


def batch_year(*sources: Column) -> Column:
    """First year found in the sources in order, 0 if none."""
    return F.coalesce(*[first_year(c) for c in sources], F.lit(0))


def first_in_row(pieces: Column) -> Column:
    """(index, text) of an array's texts without later repeats; the indexes keep their gaps."""
    return let(pieces, lambda p: F.filter(F.transform(p, lambda s, i: F.struct(i.alias("i"), s.alias("text"))), lambda x: F.array_position(p, x["text"]) == x["i"] + 1))


def chunk_documents(docs: DataFrame, budget: int = 512, least: int = 15, id_col: str = "doc_id", url_col: str = "url", title_col: str = "title", text_col: str = "text", date_col: str = "date_published") -> DataFrame:
    """Prose chunks of plain documents: sentences packed with overlaps, small tails merged, pieces under ``least`` tokens dropped,
    numbered, then repeats of a text within a document dropped (numbers keep their gaps). Null text gives nothing. No shuffle."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(url_col).alias("url"), F.coalesce(F.col(title_col), F.col(url_col)).alias("title"), F.col(date_col).alias("date_published"), F.col(text_col).alias("text")).where("text is not null")
    d = d.withColumn("_keep", F.filter(pack_prose(squash(F.col("text")), budget), lambda s: estimate(s) >= least))
    c = d.select("doc_id", "url", "title", "date_published", F.explode(first_in_row(F.col("_keep"))).alias("c")).select("doc_id", "url", "title", "date_published", F.col("c.i").alias("chunk_index"), F.col("c.text").alias("text"))
    c = c.withColumn("token_count", token_estimate(F.col("text"))).withColumn("chunk_id", chunk_id(F.col("url"), F.col("chunk_index"))).withColumn("batch_year", batch_year(F.col("date_published"), F.col("title"), F.col("url")))
    return c.select("chunk_id", "doc_id", "url", "title", "chunk_index", "token_count", "batch_year", F.sha2("text", 256).alias("text_hash"), "text")


RECORD = ["chunk_id", "text", "source_url", "document_title", "section_heading", "breadcrumb", "document_type", "date_published", "date_scraped", "chunk_index", "token_count", "source_format", "block_type", "page_number", "batch_year"]


def section_blocks(blocks: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Blocks ``(id, pos, kind, text, level, items, ordered, rows, headers, caption, page)`` that are no headings, each with its section's
    number, heading (the last one before it, else the document's title, else 'Preamble'), breadcrumb (title and the chain of headings,
    repeats in a row collapsed), page (the heading's, else that of the section's first block) and ``_type``, the document's."""
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("document_type") if "document_type" in docs.columns else F.lit(None).cast("string")
    b = blocks.join(docs.select(id_col, F.nullif("title", F.lit("")).alias("_title"), kind.alias("_type")), id_col)
    head = F.when(F.col("kind") == "heading", F.struct("pos", F.col("text").alias("text"), F.col("page").alias("page")))
    b = b.withColumn("_h", F.max(head).over(w)).withColumn("section", F.sum((F.col("kind") == "heading").cast("int")).over(w))
    chain = []
    for k in range(1, 7):
        b = b.withColumn(f"_l{k}", F.max(F.when((F.col("kind") == "heading") & (F.col("level") == k), F.struct("pos", "text"))).over(w))
    for k in range(1, 7):
        at = F.coalesce(F.col(f"_l{k}.pos"), F.lit(-1))
        above = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"_l{j}.pos"), F.lit(-1)) for j in range(1, k)])
        chain.append(F.when(at > above, F.col(f"_l{k}.text")))
    heading = F.coalesce("_h.text", "_title", F.lit("Preamble"))
    full = F.filter(F.array("_title", *chain, F.when(F.col("_h").isNull(), heading)), lambda t: t.isNotNull())
    crumbs = F.filter(full, lambda t, i: (i == 0) | (t != F.element_at(full, F.greatest(i, F.lit(1)))))
    b = b.where("kind <> 'heading'").withColumn("section_heading", heading).withColumn("breadcrumb", F.array_join(crumbs, " > "))
    first = F.first("page", ignorenulls=True).over(Window.partitionBy(id_col, "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return b.withColumn("page", F.when(F.col("_h").isNotNull(), F.col("_h.page")).otherwise(first)).drop("_h", "_title", *[f"_l{k}" for k in range(1, 7)])


def list_text(items: Column, ordered: Column) -> Column:
    return F.array_join(F.transform(items, lambda s, i: F.concat(F.when(ordered, F.concat((i + 1).cast("string"), F.lit(". "))).otherwise(F.lit("- ")), s)), "\n")


def chunk_blocks(blocks: DataFrame, docs: DataFrame, budget: int = 512, least: int = 15, id_col: str = "doc_id", one_per_paragraph: tuple[str, ...] = ("dept_faculty",), count=estimate) -> DataFrame:
    """Chunk records of parsed documents. A table is a segment of its own and its rows, each a line of 'header: cell', are packed to the
    budget less the breadcrumb; paragraphs and lists between tables are one segment of prose (in documents of the types
    ``one_per_paragraph`` a paragraph ends it), freed of a leading repeat of the heading, packed with overlaps, pieces under ``least`` tokens
    dropped. Indexes run over the document, then repeats of a text are dropped. Documents ``(id, url, title, document_type,
    date_published, date_scraped, source_format)``. All windows and groups are of one document: one shuffle."""
    from .grid import linearize_rows

    b = section_blocks(blocks, docs, id_col)
    w = Window.partitionBy(id_col, "section").orderBy("pos")
    table = F.col("kind") == "table"
    ends = table | (F.col("_type").isin(*one_per_paragraph) & (F.col("kind") == "paragraph"))
    cut = (table | F.coalesce(F.lag(ends).over(w), F.lit(False))).cast("int")
    b = b.withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    prose = F.when(F.col("kind") == "list", list_text(F.col("items"), F.coalesce("ordered", F.lit(False)))).when(~table, F.coalesce("text", F.lit("")))
    lines_ = F.sort_array(F.collect_list(F.struct("pos", prose.alias("t"))))
    g = b.groupBy(id_col, "section", "segment").agg(
        F.max(table).alias("is_table"), F.max("section_heading").alias("section_heading"), F.max("breadcrumb").alias("breadcrumb"), F.max("page").alias("page_number"),
        F.array_join(F.transform(lines_, lambda x: x["t"]), "\n").alias("blob"), F.max(F.when(table, F.struct("rows", "headers", "caption"))).alias("tab"),
    )
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    blob, h = strip(F.col("blob")), F.trim("section_heading")
    blob = F.when((h != "") & F.startswith(blob, h), F.regexp_replace(F.substr(blob, F.length(h) + 1), r"^[ :\-\n]+", "")).otherwise(blob)
    over = count(F.col("breadcrumb")) + 2
    g = g.withColumn("_blob", blob).withColumn("_room", F.lit(budget) - over)
    rows = pack(linearize_rows(F.col("tab.rows"), F.coalesce("tab.headers", F.array().cast("array<string>")), F.col("tab.caption")), budget, "\n", count, over, 1)
    pieces = F.when(F.col("is_table"), rows).when(F.col("_blob") != "", F.filter(pack_prose(F.col("_blob"), F.col("_room"), count=count), lambda s: count(s) >= least))
    c = g.select(id_col, "section", "segment", "section_heading", "breadcrumb", "page_number", "is_table", F.posexplode(pieces).alias("piece", "content"))
    c = c.withColumn("chunk_index", F.row_number().over(Window.partitionBy(id_col).orderBy("section", "segment", "piece")) - 1)
    c = c.withColumn("text", F.concat("breadcrumb", F.lit("\n\n"), "content"))
    rn = F.row_number().over(Window.partitionBy(id_col, "text").orderBy("chunk_index"))
    c = c.withColumn("_rn", rn).where("_rn = 1").join(docs.select(id_col, F.col("url").alias("source_url"), F.coalesce("title", F.lit("")).alias("document_title"), "document_type", F.coalesce("date_published", F.lit("")).alias("date_published"), "date_scraped", "source_format"), id_col)
    c = c.withColumn("block_type", F.when(F.col("is_table"), "table").otherwise("prose")).withColumn("token_count", count(F.col("text")).cast("bigint"))
    c = c.withColumn("batch_year", batch_year(F.col("date_published"), F.col("document_title"), F.col("source_url"))).withColumn("chunk_id", chunk_id(F.col("source_url"), F.col("chunk_index")))
    return c.select(id_col, *RECORD)


def renumber(chunks: DataFrame, doc: str, heading: str, order: str) -> DataFrame:
    """``seq`` over a document and ``in_section`` over (document, heading), both without gaps."""
    return chunks.withColumn("seq", F.row_number().over(Window.partitionBy(doc).orderBy(order))).withColumn("in_section", F.row_number().over(Window.partitionBy(doc, heading).orderBy(order)) - 1)


def split_curated(md: Column) -> Column:
    """Array of (heading, body) of '## ' sections, the body with its heading line; what stands before the first goes to the end of every body."""
    parts = F.split(md, r"(?m)^## ")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    pre = strip(F.element_at(parts, 1))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    body = lambda s: F.concat(F.lit("## "), strip(s), F.when(pre != "", F.concat(F.lit("\n\n"), pre)).otherwise(F.lit("")))
    return F.transform(rest, lambda s: F.struct(strip(F.substring_index(s, "\n", 1)).alias("heading"), body(s).alias("body")))


def curated_records(files: DataFrame, name: str = "name", md: str = "md", default_url: str = "") -> DataFrame:
    """Chunk records of curated Markdown: 'title > heading' above each section, the address after 'Source:' and the year after 'Batch-year:'
    at a line's start (none: ``default_url``, 0), ids of the file's name and the section's number."""
    title = F.trim(F.regexp_replace(F.substring_index(F.col(md), "\n", 1), r"^[# ]+", ""))
    x = files.select(F.col(name).alias("name"), title.alias("document_title"), F.posexplode(split_curated(F.col(md))).alias("chunk_index", "s"))
    body, text = F.col("s.body"), F.concat("document_title", F.lit(" > "), "s.heading", F.lit("\n\n"), "s.body")
    url, year = F.regexp_extract(body, r"(?m)^Source:\s*(\S+)", 1), F.regexp_extract(body, r"(?m)^Batch-year:\s*(\d{4})", 1)
    return x.select(
        F.sha2(F.concat(F.lit("curated::"), "name", F.lit("::"), F.col("chunk_index").cast("string")), 256).alias("chunk_id"), text.alias("text"), F.coalesce(F.nullif(url, F.lit("")), F.lit(default_url)).alias("source_url"),
        "document_title", F.col("s.heading").alias("section_heading"), F.lit("curated_stats").alias("document_type"), "chunk_index", token_estimate(text).alias("token_count"),
        F.lit("table").alias("block_type"), F.lit(0).alias("page_number"), F.coalesce(F.nullif(year, F.lit("")), F.lit("0")).cast("int").alias("batch_year"),
    )


def chunk_sections(sections: DataFrame, docs: DataFrame, budget: int = 600, least: int = 100, table_budget: int = 400, rows_per_chunk: int = 6, id_col: str = "doc_id", count=estimate) -> DataFrame:
    """The older chunker of text sections ``(doc_id, section_no, heading, page, body)``: a section within the budget is one chunk; of a larger
    one the tables in its lines are set apart, whole up to ``table_budget`` and else in groups of ``rows_per_chunk`` rows under their first line,
    and the text between them is one chunk or sentences packed with overlaps. Every text begins with 'Section: heading'. Repeats within a
    document are dropped, then ids ``auto_n`` run over the document and indexes over its section and page."""
    from .lines import text_tables

    s = sections.withColumn("_k", F.struct(id_col, "section_no"))
    big = s.where(count(F.col("body")) > budget)
    l = big.select("_k", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    t = text_tables(l, "_k").select("_k", F.explode(F.sequence("first_pos", F.col("first_pos") + F.col("n_lines").cast("int") - 1)).alias("pos"), F.col("first_pos").alias("_tab"))
    l = l.join(t, ["_k", "pos"], "left").withColumn("_t", F.coalesce("_tab", F.lit(-1)))
    w = Window.partitionBy("_k").orderBy("pos")
    l = l.withColumn("_cut", F.coalesce((F.lag("_t").over(w) != F.col("_t")).cast("int"), F.lit(0))).withColumn("part", F.sum("_cut").over(w))
    lines_ = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    g = l.groupBy("_k", "part").agg(F.max("_tab").isNotNull().alias("is_table"), lines_.alias("ls"))
    blob, head = F.array_join("ls", "\n"), F.element_at("ls", 1)
    data = F.when(F.size("ls") > 1, F.slice("ls", 2, F.greatest(F.size("ls") - 1, F.lit(1)))).otherwise(F.col("ls"))
    groups = let(data, lambda d: F.transform(F.sequence(F.lit(0), F.floor((F.size(d) - 1) / rows_per_chunk).cast("int")), lambda i: F.concat(F.lit("[Headers: "), head, F.lit("]\n"), F.array_join(F.slice(d, i * rows_per_chunk + 1, rows_per_chunk), "\n"))))
    pieces = F.when(F.col("is_table") & (count(blob) <= table_budget), F.array(blob)).when(F.col("is_table"), groups).otherwise(pack_prose(blob, budget, least, count))
    split = g.select("_k", "part", F.posexplode(pieces).alias("piece", "content"))
    whole = s.where(count(F.col("body")) <= budget).select("_k", F.lit(0).cast("bigint").alias("part"), F.lit(0).alias("piece"), F.col("body").alias("content"))
    c = whole.unionByName(split).join(s.select("_k", "heading", "page"), "_k").select(f"_k.{id_col}", "_k.section_no", "part", "piece", "heading", "page", F.concat(F.lit("Section: "), "heading", F.lit("\n\n"), "content").alias("text"))
    order = ("section_no", "part", "piece")
    c = c.withColumn("_rn", F.row_number().over(Window.partitionBy(id_col, "text").orderBy(*order))).where("_rn = 1").drop("_rn")
    c = c.withColumn("chunk_id", F.format_string("auto_%03d", F.row_number().over(Window.partitionBy(id_col).orderBy(*order)) - 1))
    c = c.withColumn("chunk_index", F.row_number().over(Window.partitionBy(id_col, "heading", "page").orderBy(*order)) - 1)
    return c.join(docs, id_col).select(id_col, "chunk_id", "chunk_index", F.col("heading").alias("section_heading"), F.col("page").alias("page_number"), count(F.col("text")).cast("bigint").alias("token_count"), "text")


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Chunks, mean, least and most tokens, and how many are above 600 or below 100."""
    t = F.col("token_count")
    return chunks.agg(F.count("*").alias("n"), F.floor(F.sum(t) / F.count(t)).cast("bigint").alias("mean_tokens"), F.min(t).alias("least_tokens"), F.max(t).alias("most_tokens"), F.count_if(t > 600).alias("over"), F.count_if(t < 100).alias("under"))
