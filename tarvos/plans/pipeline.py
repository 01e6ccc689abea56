"""End-to-end plans: corpus to chunks to ranking to evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, quality, retrieval
from ..sources import io


def evaluate_lexical(docs: DataFrame, items: DataFrame, k: int = 5, with_keywords: bool = True) -> DataFrame:
    """Chunks ranked for each answerable item by BM25, judged by keywords and source fragment: one row of Hit@k and MRR. With
    ``with_keywords`` the expected keywords join the query, which flatters the figures; both settings are reported by the queries."""
    chunks = io.cut(chunking.chunk_documents(docs).select("chunk_id", "url", "title", "text"), "chunks")  # read by the statistics, the postings and the judge
    q = items.where("answerable").select(F.col("id").alias("query_id"), F.concat_ws(" ", "question", *(["expect_keywords_any"] if with_keywords else [])).alias("query"))
    top = retrieval.bm25_rank(q, chunks, k, id_col="chunk_id")
    j = top.join(chunks.select(F.col("chunk_id").alias("doc_id"), "text", "url"), "doc_id").join(items.select(F.col("id").alias("query_id"), "expect_keywords_any", "expect_source_contains"), "query_id")
    judged = j.select("query_id", "rank", retrieval.is_relevant(F.col("text"), F.col("url"), F.col("expect_keywords_any"), F.col("expect_source_contains")).alias("correct"))
    return retrieval.hit_and_mrr(judged, q)


def run_pipeline(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Documents to one context per query: chunk, rank, assemble."""
    chunks = io.cut(chunking.chunk_documents(docs).select("chunk_id", "url", "title", "text"), "chunks")
    top = retrieval.bm25_rank(queries, chunks, k, id_col="chunk_id")
    full = top.join(chunks.select(F.col("chunk_id").alias("doc_id"), F.col("title").alias("section"), "url", "text"), "doc_id")
    return retrieval.assemble_context(full)


def build_corpus(parts: list[DataFrame]) -> DataFrame:
    """One corpus of several parsers' chunks ``(category, chunk_id, text, token_count)`` with ``first``: whether a row is the first, by part and
    id, that has its text. Null texts are out. The first of each repeated text is taken by a partial aggregate."""
    from ..operators.skew import join_unique

    every = None
    for n, p in enumerate(parts):
        x = p.where("text is not null").withColumn("_o", F.struct(F.lit(n).alias("part"), "chunk_id")).withColumn("_h", F.sha2("text", 256))
        every = x if every is None else every.unionByName(x)
    owner = every.groupBy("_h").agg(F.min("_o").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return join_unique(every, owner, ["_h"], "chunk_id").withColumn("first", F.col("_first").isNull() | (F.col("_o") == F.col("_first"))).drop("_h", "_o", "_first")


def corpus_statistics(corpus: DataFrame) -> DataFrame:
    """Per category: chunks, mean (rounded down) and largest number of tokens of first texts, and repeats left out."""
    tok = F.when(F.col("first"), F.col("token_count"))
    return corpus.groupBy("category").agg(F.count_if(F.col("first")).alias("n"), F.floor(F.sum(tok) / F.count(tok)).cast("bigint").alias("mean_tokens"), F.max(tok).alias("most_tokens"), F.count_if(~F.col("first")).alias("repeats"))


def index(records: DataFrame, table: DataFrame | None, key: str = "chunk_id", version: str = "date_scraped", scope: str = "ordinance") -> DataFrame:
    """The index with new records: upserted by key, then without what the retirement rules take, which follows every run so that a run
    cannot bring it back. Applying it twice changes nothing."""
    full = io.cut(records if table is None else io.upsert(table, records, [key], version), "index")
    return quality.retire(full, quality.retired(full, scope))


def backfill_year(table: DataFrame) -> DataFrame:
    """Index records with the year of their title, else their address, else their date, else 0."""
    return io.patch(table, batch_year=chunking.batch_year(F.col("document_title"), F.col("source_url"), F.col("date_published")))


def index_html(pages: DataFrame, docs: DataFrame, table: DataFrame | None = None, id_col: str = "doc_id", html_col: str = "html", suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Saved pages ``(doc_id, url, html)`` to index records: blocks (staff directories by their own parser), the cleaning pass, chunks, upsert and
    retirement. ``docs`` are the documents' metadata ``(doc_id, url, title, document_type, date_published, date_scraped, source_format)``."""
    from ..operators import cleaning, html, urls

    p = pages.join(docs.select(id_col, "document_type"), id_col).withColumn("_dept", urls.department(F.col("url")))
    staff = F.col("document_type") == "dept_faculty"
    plain = html.html_blocks(p.where(~F.coalesce(staff, F.lit(False))), id_col, html_col, "url", suffixes)
    blocks = plain.unionByName(html.faculty_blocks(p.where(staff), id_col, html_col, "_dept")).withColumn("page", F.lit(None).cast("int"))
    return index(chunking.chunk_blocks(cleaning.clean_blocks(blocks, id_col), docs, id_col=id_col).drop(id_col), table)


def parse_scans(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Blocks of scanned pages ``(doc_id, page, text)``: pages of 80 characters or more that are of no unwanted class, line by line."""
    from ..operators import classify, lines

    kept = classify.page_gates(pages.where(F.length(F.trim("text")) >= 80), id_col, least=80).where("kept")
    l = kept.select(id_col, "page", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    b = lines.ocr_blocks(l, id_col)
    return b.withColumn("pos", F.col("page").cast("bigint") * 1_000_000 + F.col("pos"))


def parse_pages(pages: DataFrame, tables: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Blocks of text pages ``(doc_id, page, text)`` and grids ``(doc_id, page, tab, row, col, cell)``: gated pages to lines, headings, sections (thin
    ones and tables of contents out), each a heading and a paragraph; a page's tables go to the first section that begins on it, tables of pages
    that no section takes come last. Form and contact pages, and pages under 50 characters, have no tables."""
    from ..functions.text import token_estimate
    from ..operators import classify, grid, lines

    gated = classify.page_gates(pages, id_col)
    l = gated.where("kept").select(id_col, "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    l = l.withColumn("pos", F.col("page").cast("bigint") * 1_000_000 + F.col("line_no"))
    marked = lines.headings(l, id_col, page="page")
    from pyspark.sql import Window

    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = marked.withColumn("section_no", F.sum(F.col("is_heading").cast("int")).over(w)).groupBy(id_col, "section_no").agg(F.min("page").alias("page"), F.min("pos").alias("pos"))
    s = lines.sections(marked, id_col).join(at, [id_col, "section_no"])
    keyword = r"(?i)\b(?:attendance|grade|grading|examination|hostel|fee|scholarship|promotion|withdrawal|registration|credit|cgpa)\b"
    s = s.where(~lines.contents_share(F.col("body")) & ((token_estimate(F.col("body")) >= 150) | F.rlike("heading", F.lit(keyword))))
    names = ["kind string", "text string", "level int", "rows array<array<string>>", "headers array<string>"]
    block = lambda **kw: F.struct(*[kw.get(n.split()[0], F.lit(None)).cast(n.split(" ", 1)[1]).alias(n.split()[0]) for n in names])
    flow = s.select(id_col, "page", "pos", F.posexplode(F.filter(F.array(F.when(F.col("heading") != "Preamble", block(kind=F.lit("heading"), text=F.col("heading"), level=F.lit(1))), block(kind=F.lit("paragraph"), text=F.replace(F.col("body"), F.lit("\n"), F.lit(" ")))), lambda x: x.isNotNull())).alias("k", "b"))
    flow = flow.select(id_col, "page", (F.col("pos") * 10 + F.col("k")).alias("pos"), "b.*")
    skip = gated.where((F.length(F.trim(F.coalesce("text", F.lit("")))) < 50) | F.col("page_class").isin("form", "contact")).select(id_col, "page").distinct()
    t = tables.join(skip, [id_col, "page"], "left_anti")
    ir = grid.to_block(t.withColumn("tab", F.struct(id_col, "page", "tab"))).select(F.col(f"tab.{id_col}").alias(id_col), "tab.page", F.col("tab.tab").alias("tab"), "headers", "rows")
    claimed, left = classify.claim_tables(s.select(id_col, "page", F.col("pos").alias("at")), ir, [id_col, "page"], "at")
    both = claimed.withColumn("pos", F.col("at") * 10 + 5).drop("at").unionByName(left.withColumn("pos", F.lit(10**15) + F.col("page")))
    both = both.select(id_col, "page", "pos", F.lit("table").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("level"), "rows", "headers", "tab")
    out = flow.withColumn("tab", F.lit(None).cast("string")).unionByName(both.withColumn("tab", F.col("tab").cast("string")))
    rn = F.row_number().over(Window.partitionBy(id_col).orderBy("pos", F.col("tab").asc_nulls_first()))
    none = F.lit(None)
    return out.withColumn("pos", rn).drop("tab").select("*", none.cast("array<string>").alias("items"), none.cast("boolean").alias("ordered"), none.cast("string").alias("caption"))


def embed(chunks: DataFrame, encode, key: str = "chunk_id", text: str = "text", batch: int = 100) -> DataFrame:
    """``chunk_id, point_id, embedding, error``: vectors of an injected ``encode(list of texts) -> list of vectors``, called with up to ``batch``
    texts. A call that fails leaves its rows without a vector and with the message, so that a run can be taken up again by them."""
    from collections.abc import Iterator

    import pandas as pd

    from ..functions.text import point_id

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                try:
                    vectors, error = [list(map(float, v)) for v in encode(part["t"].fillna("").tolist())], None
                    if len(vectors) != len(part):
                        raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                except Exception as e:  # noqa: BLE001  whatever the service raises is the row's error
                    vectors, error = [None] * len(part), f"{type(e).__name__}: {e}"[:500]
                yield pd.DataFrame({"k": part["k"], "v": pd.Series(vectors, index=part.index, dtype=object), "e": error})

    out = chunks.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, "k string, v array<double>, e string")
    return out.select(F.col("k").alias(key), point_id(F.col("k")).alias("point_id"), F.col("v").alias("embedding"), F.col("e").alias("error"))
