"""The pN_ queries: each runs its operator with production parameters over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicate_pairs

    pairs = near_duplicate_pairs(read(spark, sf_dir, "chunks"), "chunk_id", "text", "document_title", threshold=0.5, shingle=3)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicate_groups

    return near_duplicate_groups(read(spark, sf_dir, "chunks"), "chunk_id", "text", "document_title", threshold=0.5, shingle=3)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .site_lines import line_table, repeated_lines, repeated_wordings

    h = read(spark, sf_dir, "html_corpus")
    lines = line_table(h)
    return repeated_lines(h, repeated_wordings(h, lines=lines), lines=lines).withColumnRenamed("id", "chunk_id")


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines of near-duplicate clusters with high document frequency."""
    from .site_lines import remove_repeated_lines, repeated_wordings

    h = read(spark, sf_dir, "html_corpus")
    return remove_repeated_lines(h, repeated_wordings(h, exact=False)).withColumnRenamed("id", "chunk_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_content import layout_lines, layout_paths

    h = read(spark, sf_dir, "html_corpus")
    return layout_lines(h, *layout_paths(h)).withColumnRenamed("id", "chunk_id")


def p3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_content import layout_lines, layout_paths

    h = read(spark, sf_dir, "html_corpus")
    return layout_lines(h, *layout_paths(h), extract=True).withColumnRenamed("id", "chunk_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_hmm import not_prose

    return not_prose(read(spark, sf_dir, "html_corpus")).withColumnRenamed("id", "chunk_id")


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_hmm import quality

    return quality(read(spark, sf_dir, "html_corpus")).withColumnRenamed("id", "chunk_id")


def p4_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_hmm import text_statistics

    return text_statistics(read(spark, sf_dir, "html_corpus")).withColumnRenamed("id", "chunk_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ocr_repair import repair

    return repair(read(spark, sf_dir, "chunks"), read(spark, sf_dir, "documents")).withColumnRenamed("id", "chunk_id")


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ocr_repair import repair

    return repair(read(spark, sf_dir, "chunks"), read(spark, sf_dir, "documents"), text=True).withColumnRenamed("id", "chunk_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .leaks import find_leaks

    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: the documents that hold its passage or question, and the longest shared run."""
    from .leaks import find_leaks

    hits = find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))
    return hits.groupBy("item_id", "part").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("shared_words").alias("longest_run"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from .mixing import TOKENIZER_DIR, mix

    folder = spark.conf.get("tarvos.tokenizers", TOKENIZER_DIR)
    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"), f"{folder}/byte_bpe_50k.tiktoken")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].where("short").select("source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p7_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentences import fit, split

    docs = read(spark, sf_dir, "documents")
    return split(docs, fit(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_clean, p3_found, p3_extract, p4_found, p4_labels, p4_statistics, p5_found, p5_repaired, p6_found, p6_report, p7_found, p7_report, p7_draws, p8_found)}
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
SHINGLES = "select distinct chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from (select chunk_id, " + WORDS.format("coalesce(document_title, '') || ' ' || coalesce(text, '')") + " as w from chunks) where len(w) >= 3"
SITE = r"lower(regexp_extract(source_url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/:?#\s]+)', 1))"
WORDING = r"regexp_replace(lower(line), '[^\p{L}]+', '', 'g')"
ITEM_WORDS = r"regexp_extract_all(lower(regexp_replace({0}, '(\p{{L}})[-\x{{ad}}\x{{2010}}\x{{2011}}\x{{ac}}][ \t]*\r?\n\s*(\p{{L}})', '\1\2', 'g')), '[\p{{L}}\p{{N}}]+')"
RUNS = "list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))"

CLASSES = f"""with recursive s as materialized ({SHINGLES}), n as materialized (select chunk_id, count(*) as n, md5(string_agg(g, '|' order by g)) as k from s group by 1),
e as materialized (select a.chunk_id as a, b.chunk_id as b from s a join s b on a.g = b.g and a.chunk_id <> b.chunk_id join n x on x.chunk_id = a.chunk_id join n y on y.chunk_id = b.chunk_id group by a.chunk_id, b.chunk_id, x.n, y.n having count(*) >= 0.5 * (x.n + y.n - count(*))),
r(x, y) as (select distinct chunk_id, chunk_id from chunks where chunk_id is not null union select r.x, e.b from r join e on e.a = r.y),
l as (select e.a, count(distinct y.k) as n_links from e join n x on x.chunk_id = e.a join n y on y.chunk_id = e.b where x.k <> y.k group by 1)
select x as id, min(y) as class_id, count(*) as class_size, coalesce(any_value(n_links), 0) as n_links from r left join l on l.a = r.x group by x""".replace("\n", " ")

# The common words, written out for the other engine.
COMMON = (
    "a an the and or but if of to in on at by for from with without under over after before during until while as is are was were be been has have had "
    "will shall should may might must can could not no any all each every this that these those which who whom whose when where it its their his her they "
    "he she we you i so than then once only also such per into about between up out off "
    "के का की को में से पर ने है हैं हो होने और या तक लिए बाद साथ द्वारा अनुसार यह वह एक इस उस कर करें करेंगे सकते जाएगा नहीं भी ही पहले भीतर दौरान"
)
STATISTICS = r"""with t as (select chunk_id, coalesce(text, '') as t from html_corpus), w as (select chunk_id, t, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') as l, length(regexp_replace(t, '\s+', '', 'g')) as c from t)
select chunk_id, len(w)::bigint as n_words, len(l)::bigint as n_lines, round(case when len(w) > 0 then c::double / len(w) else 0 end, 6) as mean_word_length, round(case when c > 0 then length(regexp_replace(t, '[\p{L}\p{M}\p{N}\s]+', '', 'g'))::double / c else 0 end, 6) as symbol_ratio,
round(case when len(l) > 0 then len(list_filter(l, lambda x: regexp_matches(x, '[.!?।॥。！？]\s*$')))::double / len(l) else 0 end, 6) as ends_in_punctuation, round(case when len(w) > 0 then len(list_filter(w, lambda x: list_contains(string_split('COMMON', ' '), lower(regexp_replace(x, '[^\p{L}\p{M}]', '', 'g')))))::double / len(w) else 0 end, 6) as common_share from w""".replace("\n", " ").replace("COMMON", COMMON)

SQL: dict[str, str] = {
    "p1_groups": CLASSES,
    "p4_statistics": STATISTICS,
    "p1_found": f"with s as materialized ({SHINGLES}), n as (select chunk_id, count(*) as n from s group by 1), c as (select a.chunk_id as a, b.chunk_id as b, count(*) as k from s a join s b on a.g = b.g and a.chunk_id < b.chunk_id group by 1, 2) select a as chunk_id_a, b as chunk_id_b from c join n x on x.chunk_id = a join n y on y.chunk_id = b where k >= 0.5 * (x.n + y.n - k)",
    "p2_found": f"with l as (select chunk_id, source_url, {SITE} as site, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from html_corpus where text is not null), w as (select *, {WORDING} as w from l where site <> ''), p as (select site, count(distinct source_url) as pages from (select {SITE} as site, source_url from html_corpus) where site <> '' group by 1), d as (select site, w, count(distinct source_url) as n from w where length(w) >= 3 group by 1, 2) select distinct chunk_id, line_no::int as line_no from w join d using (site, w) join p using (site) where d.n >= 3 and d.n >= 0.05 * p.pages",
    "p6_found": "with i as (select distinct id as item_id, unnest(" + RUNS + ") as g from (select id, " + ITEM_WORDS.format("passage") + " as w from eval_items union all select id, " + ITEM_WORDS.format("question") + " from eval_items) where len(w) >= 12), d as (select distinct doc_id, unnest(" + RUNS + ") as g from (select doc_id, " + ITEM_WORDS.format("text") + " as w from documents) where len(w) >= 12) select distinct doc_id, item_id from d join i using (g)",
    # token counts are beyond SQL; by the problem's statement the outcome is the same for any measure of size, here characters
    "p7_found": "with o as (select t.source, t.target_share, t.max_repeats, coalesce(sum(length(d.text)), 0) as own from mix_targets t left join documents d using (source) group by all) select source from o where target_share * (select sum(own) from o) > max_repeats * own",
}
