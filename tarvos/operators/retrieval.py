"""Exact vector search, variant merging, sibling expansion, contexts; lexical ranking and its evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_list

QUERY_BLOCK = 2_000  # query vectors held by a task at a time


def cosine_top_k(queries: DataFrame, points: DataFrame, k: int = 5, qid: str = "query_id", pid: str = "point_id", vec: str = "embedding", digits: int = 4, label: str | None = None, everyone: int = 0) -> DataFrame:
    """``query_id, point_id, score, rank``: every point against every query, in one scan of the points. Query vectors go to the tasks in
    blocks of ``QUERY_BLOCK``, one broadcast each; each Arrow batch of points keeps its own k best per query, so what is shuffled is k rows per
    query and batch; ranks break ties of the rounded score by point id. With ``label`` a query meets only points of its own label or of
    ``everyone``'s, by a test before the scoring. Null and zero vectors are no one's neighbour, and a query with one has none."""
    lab = F.col(label).cast("bigint") if label else F.lit(0).cast("bigint")
    q = queries.where(F.col(vec).isNotNull()).select(F.col(qid).cast("bigint").alias("q"), F.col(vec).alias("v"), lab.alias("l"))
    blocks, rows = [], []
    for r in q.orderBy("q").toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_BLOCK:
            blocks.append(_query_block(points, rows))
            rows = []
    if rows:
        blocks.append(_query_block(points, rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["v"].notna()]
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            n = np.linalg.norm(x, axis=1)
            ids, labels = pdf["p"].to_numpy(), pdf["l"].to_numpy()
            order = np.flatnonzero(n > 0)
            order = order[np.argsort(ids[order], kind="stable")]  # ties go to the smaller id
            x, ids, labels = x[order] / n[order, None], ids[order], labels[order]
            for shared in blocks:
                qids, q, ql = shared.value
                s = np.round(q @ x.T, digits)
                if label:
                    s[(ql[:, None] != labels[None]) & (labels[None] != everyone)] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(s, best, 1)
                row, col = np.nonzero(np.isfinite(score))
                yield pd.DataFrame({"query_id": qids[row], "point_id": ids[best[row, col]], "score": score[row, col]})

    p = points.select(F.col(pid).cast("bigint").alias("p"), F.col(vec).alias("v"), lab.alias("l"))
    out = p.mapInPandas(run, "query_id bigint, point_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _query_block(points: DataFrame, rows: list):
    v = np.array([r.v for r in rows], np.float64)
    n = np.linalg.norm(v, axis=1)
    ok = n > 0
    ids, labels = np.array([r.q for r in rows])[ok], np.array([-1 if r.l is None else r.l for r in rows])[ok]
    return points.sparkSession.sparkContext.broadcast((ids, v[ok] / n[ok, None], labels))


def merge_variants(hits: DataFrame, k: int = 5) -> DataFrame:
    """Hits ``(query_id, variant_no, point_id, score)`` of several wordings of a query: the best score of each point, the k best points."""
    m = hits.groupBy("query_id", "point_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))
    return m.withColumn("rank", rank).where(F.col("rank") <= k)


def expand_tables(top: DataFrame, chunks: DataFrame, budget: int = 1600, siblings: int = 64) -> DataFrame:
    """Table hits ``(query_id, rank, source_url, section_heading)`` to the section's table chunks in order, while the running tokens stay
    within the budget; the first always comes. One expansion per section and query."""
    one = top.groupBy("query_id", "source_url", "section_heading").agg(F.min("rank").alias("rank"))
    t = chunks.where("block_type = 'table'").select("source_url", "section_heading", "chunk_id", "page_number", "chunk_index", F.coalesce("token_count", F.lit(0)).alias("tokens"))
    w = Window.partitionBy("query_id", "source_url", "section_heading").orderBy(F.coalesce("page_number", F.lit(0)), F.coalesce("chunk_index", F.lit(0)), "chunk_id")
    x = one.join(t, ["source_url", "section_heading"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= siblings)
    run = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("running", run).where((F.col("n") == 1) | (F.col("running") <= budget)).select("query_id", "rank", "chunk_id", "n", "running")


def assemble_context(ranked: DataFrame, by: str = "query_id") -> DataFrame:
    """One text per query of its ranked chunks ``(rank, section, url, text)``."""
    part = F.concat(F.lit("[Chunk "), F.col("rank").cast("string"), F.lit(" | Section: "), F.coalesce("section", F.lit("")), F.lit(" | Source: "), F.coalesce("url", F.lit("")), F.lit("]\n"), F.coalesce("text", F.lit("")))
    lst = F.sort_array(F.collect_list(F.struct("rank", part.alias("t"))))
    return ranked.groupBy(by).agg(F.array_join(F.transform(lst, lambda r: r["t"]), "\n\n").alias("context"))


def first_rule(df: DataFrame, text: str, rules: list[tuple[str, list[str]]]) -> Column:
    """First rule (name, phrases) one of whose phrases is in the text, as one expression."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    x = None
    for name, phrases in rules:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(low, F.lit(p))
        x = F.when(hit, F.lit(name)) if x is None else x.when(hit, F.lit(name))
    return x.otherwise(F.lit(None).cast("string"))


def bm25_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``term, df`` over all documents; a document sends each term once and counts are combined before the shuffle."""
    t = docs.select(F.explode(F.array_distinct(word_list(F.col(text_col)))).alias("term"))
    return t.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))


def bm25_rank(queries: DataFrame, docs: DataFrame, k: int = 5, qid: str = "query_id", qtext: str = "query", id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, digits: int = 6, query_terms_limit: int = 200_000) -> DataFrame:
    """``query_id, doc_id, score, rank``. Postings are cut to query terms before any shuffle; inverse document frequencies below zero become
    epsilon times the mean over the vocabulary; a term counts as often as the query has it. The statistics of the collection (documents,
    mean length, frequencies, the floor) are computed once."""
    q = queries.select(F.col(qid).alias("query_id"), F.explode(word_list(F.col(qtext))).alias("term")).where("term <> ''").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    terms = q.select("term").distinct()
    d = docs.select(F.col(id_col).alias("doc_id"), word_list(F.col(text_col)).alias("w"))
    d = d.withColumn("len", F.when(F.element_at("w", 1) == "", 0).otherwise(F.size("w")))
    few = terms.limit(query_terms_limit + 1).count() <= query_terms_limit
    # one pass for frequencies, documents and length: the empty term stands for the documents
    t = d.select("len", F.explode(F.concat(F.array(F.lit("")), F.filter(F.array_distinct("w"), lambda x: x != ""))).alias("term"))
    df = t.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("len"))).alias("total"))
    every = df.where("term = ''").select(F.col("df").alias("n_docs"), (F.col("total") / F.col("df")).alias("avg_len"))
    df = df.where("term <> ''").crossJoin(F.broadcast(every)).withColumn("idf", F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))  # one row
    floor = df.agg((F.avg("idf") * epsilon).alias("floor"))
    idf = df.join(F.broadcast(terms) if few else terms, "term", "left_semi").crossJoin(F.broadcast(floor))  # one row
    idf = idf.select("term", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"), "avg_len")
    post = d.select("doc_id", "len", F.explode("w").alias("term")).join(F.broadcast(idf) if few else idf, "term")
    tf = post.groupBy("doc_id", "term", "len", "idf", "avg_len").agg(F.count("*").alias("tf"))
    s = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    sc = tf.join(q, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(s), digits).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return sc.withColumn("rank", rank).where(F.col("rank") <= k)


def retrieve(variants: DataFrame, points: DataFrame, chunks: DataFrame, k: int = 5, label: str | None = None, budget: int = 1600) -> tuple[DataFrame, DataFrame]:
    """(hits ``query_id, rank, chunk_id, score``, contexts ``query_id, context``) of queries in several wordings ``(query_id, variant_no, vec_id,
    embedding)``: each wording's best points by cosine, the best score of a point over the wordings, the k best points; a table among them
    comes with its section's other table chunks within the token budget."""
    v = variants.withColumn("_key", F.xxhash64("query_id", "variant_no"))
    near = cosine_top_k(v, points, k, "_key", "point_id", label=label).withColumnRenamed("query_id", "_key").drop("rank")
    top = merge_variants(near.join(v.select("_key", "query_id", "variant_no"), "_key"), k)
    c = points.select("point_id", "chunk_id").join(chunks, "chunk_id")
    hits = top.join(c, "point_id")
    tables = expand_tables(hits.where("block_type = 'table'").select("query_id", "source_url", "section_heading", "rank"), chunks, budget)
    more = tables.join(chunks, "chunk_id").select("query_id", "rank", F.col("n").alias("sub"), "chunk_id", "section_heading", "source_url", "text")
    own = hits.select("query_id", "rank", F.lit(0).alias("sub"), "chunk_id", "section_heading", "source_url", "text")
    both = own.join(more.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti").unionByName(more)
    w = Window.partitionBy("query_id").orderBy("rank", "sub", "chunk_id")
    both = both.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", F.col("section_heading").alias("section"), F.col("source_url").alias("url"), "text")
    return hits.select("query_id", "rank", "chunk_id", "score"), assemble_context(both)


def is_relevant(text: Column, url: Column, keywords: Column, fragment: Column) -> Column:
    """Any keyword in the text (none given: true) and the source fragment in the address (none given: true)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    any_kw = F.coalesce(F.size(F.filter(keywords, lambda w: F.contains(low, F.lower(w)))) > 0, F.lit(True)) | (F.coalesce(F.size(keywords), F.lit(0)) <= 0)
    return any_kw & F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(fragment, F.lit(""))))


def hit_and_mrr(judged: DataFrame, queries: DataFrame) -> DataFrame:
    """Hit@1, 3, 5 and mean reciprocal rank over all queries, from judged hits ``(query_id, rank, correct)``."""
    first = judged.where("correct").groupBy("query_id").agg(F.min("rank").alias("first"))
    x = queries.select("query_id").join(first, "query_id", "left")
    hit = lambda k: F.round(F.avg((F.coalesce(F.col("first") <= k, F.lit(False))).cast("double")), 6).alias(f"hit_{k}")
    return x.agg(F.count("*").alias("n"), hit(1), hit(3), hit(5), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def guard_ratio(answers: DataFrame, no_answer: Column) -> DataFrame:
    """``n, passed, ratio``: how many of the questions without an answer ``(answerable, answer)`` were turned down."""
    x = answers.where(~F.col("answerable"))
    return x.agg(F.count("*").alias("n"), F.count_if(no_answer).alias("passed")).withColumn("ratio", F.when(F.col("n") > 0, F.round(F.col("passed") / F.col("n"), 6)))


def curated_routing(questions: DataFrame, rules: DataFrame, texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """Contexts ``(query_id, context)`` with the curated texts ``(name, text)`` of every rule ``(name, pattern)`` that a question matches, in order
    of name, before them. Rules and curated texts are hand-written tables: more than 10,000 rules are refused."""
    if rules.limit(10_001).count() > 10_000:
        raise ValueError("rule tables hold at most 10,000 rules")
    hit = questions.join(F.broadcast(rules), F.rlike(F.lower("query"), F.col("pattern"))).select("query_id", "name").distinct().join(texts, "name")
    own = hit.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "text"))), lambda x: x["text"]), "\n\n").alias("_own"))
    x = contexts.join(own, "query_id", "left")
    return x.select("query_id", F.when(F.col("_own").isNull(), F.col("context")).otherwise(F.concat_ws("\n\n", "_own", "context")).alias("context"))
