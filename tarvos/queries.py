"""Registry of the core queries: each name has a Spark plan and, where SQL can say it, DuckDB SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import chunking, classify, cleaning, grid, html, http, lines, manifest, quality, retrieval, urls
from .plans import pipeline
from .sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Tables:
    """Tables of a directory by attribute."""

    def __init__(self, spark: SparkSession, sf: str):
        self._spark, self._sf = spark, sf

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._sf}/{name}.parquet")


STAGES = manifest.STAGES
UNPIVOT = " union all ".join(f"select id, '{s}' as stage, {s}_status as status from manifest" for s in STAGES)
CHUNKS = "(select * from chunks qualify row_number() over (partition by chunk_id order by date_scraped desc nulls last, text desc) = 1)"
LINES = "(select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents where text is not null)"
WORDS = "list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[a-zA-Z0-9%@.]+'), lambda t: lower(t)), lambda t: length(t) > 1)"

# ---- manifest


@query("select url, stage, arg_max(status, (seq, ts, status)) as status, arg_max(notes, (seq, ts, notes)) filter (where coalesce(notes, '') <> '') as notes, count(*) as n_events, max(seq) as last_seq from stage_events group by url, stage")
def manifest_state_fold(spark, sf):
    return manifest.fold_events(Tables(spark, sf).stage_events)


@query("with f as (select url, stage, arg_max(status, (seq, ts, status)) as status from stage_events group by url, stage) select url, " + ", ".join(f"coalesce(max(case when stage = '{s}' then status end), 'pending') as {s}_status" for s in STAGES) + " from f group by url")
def manifest_state_table(spark, sf):
    return manifest.state_table(Tables(spark, sf).stage_events)


@query(f"select stage, status, count(*) as n from ({UNPIVOT}) group by stage, status")
def manifest_stage_counts(spark, sf):
    return manifest.stage_counts(Tables(spark, sf).manifest)


@query(f"select concat_ws(':', 'stage', stage, status) as metric, count(*) as n from ({UNPIVOT}) group by stage, status union all select 'category:' || coalesce(category, 'null'), count(*) from manifest group by category union all select 'total', count(*) from manifest union all select 'duplicates', count(*) filter (where is_duplicate) from manifest")
def manifest_dashboard(spark, sf):
    return manifest.dashboard(Tables(spark, sf).manifest)


@query("select c.url, c.http_status, c.etag from (select * from crawl_records where url is not null qualify row_number() over (partition by url order by crawl_timestamp asc nulls last, coalesce(http_status, 0), coalesce(etag, '')) = 1) c where not exists (select 1 from documents d where d.url = c.url)")
def manifest_insert_or_ignore(spark, sf):
    t = Tables(spark, sf)
    order = [F.col("crawl_timestamp").asc_nulls_last(), F.coalesce("http_status", F.lit(0)), F.coalesce("etag", F.lit(""))]
    return manifest.insert_or_ignore(t.documents, t.crawl_records, "url", order).select("url", "http_status", "etag")


@query("select id, " + ", ".join(f"case when {s}_status = 'running' then 'pending' else {s}_status end as {s}_status" for s in STAGES) + " from manifest")
def manifest_recover_pending(spark, sf):
    return manifest.recover(Tables(spark, sf).manifest).select("id", *[f"{s}_status" for s in STAGES])


@query("select id, url from manifest where embed_status = 'pending' order by id")
def manifest_queue(spark, sf):
    return manifest.queue(Tables(spark, sf).manifest, "embed").select("id", "url")


@query("select id, url from manifest where chunk_status = 'done' and embed_status = 'pending'")
def manifest_ready_to_embed(spark, sf):
    return manifest.ready_to_embed(Tables(spark, sf).manifest).select("id", "url")


@query("select id, epoch_us(date_scraped)::bigint as scraped_us from manifest where date_scraped >= (select max(date_scraped) from manifest) - interval 30 days")
def manifest_recent(spark, sf):
    return manifest.recent(Tables(spark, sf).manifest, 30).select("id", F.unix_micros("date_scraped").alias("scraped_us"))


@query("with f as (select file_hash, min(id) as fid from manifest where file_hash is not null group by file_hash), m as (select x.*, o.url as duplicate_of from manifest x left join f on f.file_hash = x.file_hash and f.fid <> x.id left join manifest o on o.id = f.fid) select id, duplicate_of, case when duplicate_of is not null then coalesce(scrape_notes, 'duplicate_of:' || duplicate_of) else scrape_notes end as scrape_notes, duplicate_of is not null or coalesce(is_duplicate, false) as is_duplicate, " + ", ".join(f"case when duplicate_of is not null and {s}_status in ('pending', 'running') then 'skipped' else {s}_status end as {s}_status" for s in STAGES[1:]) + " from m")
def manifest_duplicate_cascade(spark, sf):
    return manifest.mark_hash_duplicates(Tables(spark, sf).manifest).select("id", "duplicate_of", "scrape_notes", "is_duplicate", *[f"{s}_status" for s in STAGES[1:]])


@query(r"select id, category like '%\_pdf%' escape '\' as escaped, category like '%_pdf%' as wild from manifest")
def manifest_like_escape(spark, sf):
    return Tables(spark, sf).manifest.select("id", F.col("category").like(r"%\_pdf%").alias("escaped"), F.col("category").like("%_pdf%").alias("wild"))


@query("select id, url from manifest where index_status is distinct from 'done' and category in ('notice_html', 'hostel_html', 'library_html')")
def manifest_in_list_null_safe(spark, sf):
    return Tables(spark, sf).manifest.where(~F.col("index_status").eqNullSafe("done") & F.col("category").isin("notice_html", "hostel_html", "library_html")).select("id", "url")


@query("select category, id from manifest where file_path is not null order by category, id")
def manifest_corpus_scan(spark, sf):
    return Tables(spark, sf).manifest.where("file_path is not null").orderBy("category", "id").select("category", "id")


DOCTYPES = {"ordinance_pdf": "ordinance", "notice_pdf": "notice", "notice_html": "notice", "hostel_html": "hostel", "tnp_html": "placement", "syllabus_pdf": "syllabus", "admissions_html": "admissions", "scholarship_pdf": "scholarship", "exam_pdf": "exam", "anti_ragging_pdf": "policy", "dept_pdf": "dept", "library_html": "library"}


@query("with g as (select * from crawl_records where _corrupt_record is null and url is not null and trim(url) <> '' qualify row_number() over (partition by url order by crawl_timestamp asc nulls last, coalesce(http_status, 0), coalesce(category, '')) = 1) select url, coalesce(category, 'unknown') as category, case coalesce(category, '') " + " ".join(f"when '{k}' then '{v}'" for k, v in DOCTYPES.items()) + " else 'unknown' end as document_type, coalesce(nullif(link_date_label, ''), last_modified) as date_published, case when http_status = 200 then 'done' else 'failed' end as scrape_status, '{' || concat_ws(',', '\"http_status\":' || http_status, '\"content_type\":\"' || replace(content_type, '\"', '\\\"') || '\"', '\"etag\":\"' || replace(etag, '\"', '\\\"') || '\"', '\"content_length\":' || content_length) || '}' as scrape_notes from g")
def import_crawl(spark, sf):
    return manifest.import_crawl(Tables(spark, sf).crawl_records, DOCTYPES)


@query("select count(*) as n_rows, count(*) filter (where _corrupt_record is not null) as malformed, count(*) filter (where _corrupt_record is null and coalesce(trim(url), '') = '') as without_url, count(distinct case when _corrupt_record is null then nullif(trim(url), '') end) as addresses from crawl_records")
def import_jsonl_quality(spark, sf):
    return manifest.import_quality(Tables(spark, sf).crawl_records)


# ---- addresses and fetches


@query(r"select id, coalesce(regexp_matches(url, '(?i)\.pdf(\?.*)?$'), false) as is_pdf from manifest")
def url_is_pdf(spark, sf):
    return Tables(spark, sf).manifest.select("id", urls.is_pdf(F.col("url")).alias("is_pdf"))


CASE = "case when url is null then 'unknown' when " + " or ".join(f"regexp_matches(url, '{p}')" for p in urls.DENY) + " then 'denied' " + " ".join(f"when regexp_matches(url, '{p}') then '{n}'" for n, p in urls.ALLOW) + " else 'unknown' end"


@query(f"select id, {CASE} as found from manifest")
def url_classify_first_match(spark, sf):
    return Tables(spark, sf).manifest.select("id", urls.classify(F.col("url")).alias("found"))


@query(f"select chunk_id, source_url, {CASE.replace('url', 'source_url')} not in ('denied', 'unknown') as allowed from html_corpus")
def url_allow_deny(spark, sf):
    return Tables(spark, sf).html_corpus.select("chunk_id", "source_url", urls.allowed(F.col("source_url")).alias("allowed"))


@query("with r(rule_no, category, pattern) as (values " + ", ".join(f"({i}, '{n}', '{p}')" for i, (n, p) in enumerate(urls.ALLOW)) + ") select m.id, coalesce(arg_min(r.category, r.rule_no), 'unknown') as category_found from manifest m left join r on regexp_matches(m.url, r.pattern) group by m.id")
def url_rule_join(spark, sf):
    rules = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(urls.ALLOW)], "rule_no int, category string, pattern string")
    return urls.rule_join(Tables(spark, sf).manifest.select("id", "url"), "url", rules).select("id", "category_found")


PATH = "regexp_extract({0}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"


@query(f"select chunk_id, source_url, lower(regexp_extract(source_url, '^[A-Za-z]+://([^/?#]+)', 1)) as host, {PATH.format('source_url')} as path from html_corpus")
def url_host_path_parts(spark, sf):
    return Tables(spark, sf).html_corpus.select("chunk_id", "source_url", urls.host(F.col("source_url")).alias("host"), urls.path(F.col("source_url")).alias("path"))


@query(rf"select id, translate(regexp_replace(regexp_extract({PATH.format('url')}, '([^/]*)$', 1), '\.[A-Za-z0-9]+$', ''), '_-', '  ') as title from manifest")
def url_title_stem(spark, sf):
    return Tables(spark, sf).manifest.select("id", urls.title_of(F.col("url")).alias("title"))


@query(rf"select id, substring(trim(regexp_replace({PATH.format('url')}, '[^A-Za-z0-9_.\-]', '_', 'g'), '_'), 1, 120) as safe from manifest")
def url_safe_stem(spark, sf):
    return Tables(spark, sf).manifest.select("id", urls.safe_name(F.col("url")).alias("safe"))


@query(rf"with s as (select id, regexp_replace(regexp_extract({PATH.format('url')}, '([^/]*)$', 1), '\.[A-Za-z0-9]+$', '') as stem from manifest), n as (select *, row_number() over (partition by stem order by id) as rn from s) select id, case when rn = 1 then stem else stem || '_' || rn end as unique_name from n")
def url_collision_suffix(spark, sf):
    d = Tables(spark, sf).manifest.select("id", urls.stem(F.col("url")).alias("stem"))
    return urls.collision_suffix(d, "stem", "id").select("id", "unique_name")


MIME = "lower(trim(split_part(coalesce(content_type, ''), ';', 1)))"


@query(f"select outcome, count(*) as n from (select case when http_status is null then 'fatal' when http_status in (429, 500, 502, 503, 504) then 'retry' when http_status >= 400 then 'fatal' when http_status >= 300 then 'redirect' when {MIME} not in ('application/pdf', 'text/html', 'application/xhtml+xml', 'text/plain') then 'wrong_type' when content_length < 512 then 'too_small' else 'ok' end as outcome from crawl_records) group by outcome")
def http_outcome_classify(spark, sf):
    c = Tables(spark, sf).crawl_records
    return c.groupBy(http.outcome(F.col("http_status"), F.col("content_type"), F.col("content_length")).alias("outcome")).agg(F.count("*").alias("n"))


@query("select range as attempt, least(60.0, pow(2.0, range - 1)) as wait_s from range(1, 11)")
def backoff_schedule(spark, sf):
    return spark.range(1, 11).select(F.col("id").alias("attempt"), http.backoff(F.col("id")).alias("wait_s"))


@query("select url, coalesce(strftime(try_strptime(regexp_replace(last_modified, '^[A-Za-z]{3},\\s*', ''), '%d %b %Y %H:%M:%S GMT'), '%Y-%m-%dT%H:%M:%S'), last_modified) as modified, count(*) as n from crawl_records where url is not null group by 1, 2".replace("\\\\", "\\"))
def http_dates(spark, sf):
    c = Tables(spark, sf).crawl_records.where("url is not null")
    return c.groupBy("url", http.http_date(F.col("last_modified")).alias("modified")).agg(F.count("*").alias("n"))


@query("select doc_id as id, sha256(text) as content_hash, case when text is null then doc_id else min(doc_id) over (partition by sha256(text)) end as first_id from documents")
def content_hash_dedup(spark, sf):
    return http.content_duplicates(Tables(spark, sf).documents, "doc_id", "text")


@query("select id, substring(concat_ws(': ', 'error', scrape_notes), 1, 20) as note from manifest")
def note_truncate(spark, sf):
    return Tables(spark, sf).manifest.select("id", http.note("error", F.col("scrape_notes"), 20).alias("note"))


# ---- lines, sections, cleaning

SQUASHED_OF = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{0085}}\x{{1680}}]+', ' ', 'g'))"

REGULATION = r"(?i)^R\.\s*\d+\s*(\([A-Za-z]\))?\s*\.\s*\d+"
REFUSED = [
    r"[=∑σ≥≤±×÷→←∫∝∂]", r"[.…]{3,}", r"[-–—]{4,}", r"[.,:;)]$", r"^\d+\.?\d*\s*$", r"^\(", r"^\p{Ll}", r"(?i)^(note|provided|table|figure)", r"(?i)^([a-d]\)|(i|ii|iii|iv|v|vi|vii|viii|ix|x|xx|xxx)\))",
    r"(?i)\b(and|or|the|a|an|of|in|for|with|to|from|by|as|at|on|into|about|that|which|who|whose|when|where|if|but|nor|yet|so)\s*$", r"(?i)^([ivxlcdm]+\.|[a-z]\.)\s+.+\bshall mean\b",
]
MODAL = r"(?i)\b(shall|must|will|may|is|are|was|were)\b"
NEXT = "coalesce(" + ", ".join(f"lead(nullif(trim(line), ''), {k}) over w" for k in range(1, 6)) + ")"
TEXT_RULE = rf"(length(s) >= 5 and length(s) < 120 and regexp_matches(s, '[A-Za-z]') and coalesce(length(next_line) > length(s), false) and not (" + " or ".join(f"regexp_matches(s, '{p}')" for p in REFUSED) + rf") and (not regexp_matches(s, '{MODAL}') or regexp_matches(s, '(?i)^(\d|[IVXLCDM]+\.?\s)') or regexp_matches(s, '{REGULATION}')))"
JUNK = "(" + " or ".join(f"regexp_matches(s, '{p}')" for p in REFUSED[:3]) + ")"
HEADINGS = rf"""select doc_id, pos, line, cand and (n_body >= 3 or regexp_matches(s, '{REGULATION}')) as is_heading
from (select *, sum(case when not cand and s <> '' then 1 else 0 end) over (partition by doc_id, seg) as n_body from (select *, sum(cand::int) over (partition by doc_id order by pos) as seg from (select *, s <> '' and ((regexp_matches(s, '{REGULATION}') and not {JUNK}) or {TEXT_RULE}) as cand from (select doc_id, pos, line, trim(line) as s, {NEXT} as next_line from {LINES} window w as (partition by doc_id order by pos)))))"""


@query(f"select doc_id, pos, is_heading from ({HEADINGS})")
def heading_detect_lines(spark, sf):
    return lines.headings(lines.explode_lines(Tables(spark, sf).documents)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "is_heading")


SECTIONS = f"select doc_id, section_no, coalesce(heading, 'Preamble') as heading, body from (select doc_id, section_no, max(case when is_heading then trim(line) end) as heading, coalesce(string_agg(trim(line), chr(10) order by pos) filter (where not is_heading and trim(line) <> ''), '') as body from (select *, sum(is_heading::int) over (partition by doc_id order by pos)::bigint as section_no from ({HEADINGS})) group by doc_id, section_no) where body <> ''"


def _sections(t: Tables) -> DataFrame:
    return lines.sections(lines.headings(lines.explode_lines(t.documents)))


@query(SECTIONS)
def sections_by_heading(spark, sf):
    return _sections(Tables(spark, sf))


@query(f"select doc_id, section_no, length(body) // 4 >= 150 or regexp_matches(heading, '(?i)rules|policy|fee|eligibility|guidelines') as keep from ({SECTIONS})")
def thin_section_gate(spark, sf):
    s = _sections(Tables(spark, sf))
    return s.select("doc_id", "section_no", ((tx.token_estimate(F.col("body")) >= 150) | F.rlike("heading", F.lit("(?i)rules|policy|fee|eligibility|guidelines"))).alias("keep"))


@query(rf"with s as (select chunk_id, date_scraped, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') as ls from chunks) select chunk_id, len(ls) >= 4 and len(list_filter(ls, lambda x: regexp_matches(x, '\D\d{{1,3}}\s*$'))) >= 0.6 * len(ls) as is_contents from s")
def toc_section_reject(spark, sf):
    return Tables(spark, sf).chunks.select("chunk_id", lines.contents_share(F.coalesce("text", F.lit(""))).alias("is_contents"))


LEVEL = "case when section_no % 4 = 0 then 1 when section_no % 4 in (1, 2) then 2 else 3 end"


@query(f"""with h as (select doc_id, section_no as pos, heading as text, {LEVEL} as level from ({SECTIONS})), m as (select *, {', '.join(f"max(case when level = {k} then pos end) over w as p{k}, arg_max(text, pos) filter (where level = {k}) over w as t{k}" for k in (1, 2, 3))} from h window w as (partition by doc_id order by pos rows between unbounded preceding and current row)),
c as (select doc_id, pos, list_filter([t1, case when coalesce(p2, -1) > coalesce(p1, -1) then t2 end, case when coalesce(p3, -1) > greatest(coalesce(p1, -1), coalesce(p2, -1)) then t3 end], lambda x: x is not null) as f from m) select doc_id, pos, array_to_string(list_filter(f, lambda x, i: i = 1 or x <> f[i - 1]), ' > ') as breadcrumb from c""")
def section_breadcrumb(spark, sf):
    h = _sections(Tables(spark, sf)).select("doc_id", F.col("section_no").alias("pos"), F.col("heading").alias("text"), F.expr(LEVEL).alias("level"))
    return lines.breadcrumbs(h, levels=3).select("doc_id", "pos", "breadcrumb")


@query(r"with l as (select chunk_id, date_scraped, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from html_corpus), f as (select distinct chunk_id, pos, (length(line) - length(replace(line, '|', ''))) >= 2 as flag from l where line is not null), g as (select *, pos - sum(flag::int) over (partition by chunk_id order by pos) as grp from f) select chunk_id, min(pos) as first_pos, count(*) as n_lines from g where flag group by chunk_id, grp having count(*) >= 3")
def text_table_blocks(spark, sf):
    l = lines.explode_lines(Tables(spark, sf).html_corpus, "chunk_id").withColumn("flag", F.regexp_count("line", F.lit(r"\|")) >= 2).select("chunk_id", F.col("pos").cast("bigint").alias("pos"), "flag").distinct()
    return lines.runs(l, F.col("flag"), "chunk_id")


PARS = f"select doc_id, row_number() over (partition by doc_id order by first_pos) - 1 as par_no, text from (select doc_id, grp, min(pos) as first_pos, string_agg(trim(line), ' ' order by pos) as text from (select *, sum((trim(line) = '')::int) over (partition by doc_id order by pos) as grp from {LINES}) where trim(line) <> '' group by doc_id, grp)"


def _paragraphs(t: Tables) -> DataFrame:
    return lines.merge_paragraphs(lines.explode_lines(t.documents))


@query(PARS)
def paragraph_island_merge(spark, sf):
    return _paragraphs(Tables(spark, sf))


@query(f"select doc_id, par_no, text from ({PARS}) qualify row_number() over (partition by doc_id, lower(text) order by par_no) = 1")
def clean_within_doc_dedup(spark, sf):
    return lines.dedup_in_document(_paragraphs(Tables(spark, sf)))


CRUMB = r"[\p{L}\p{N}_\s.&''\-()]+"
BOILER = rf"(trim(coalesce(line, '')) = '' or regexp_matches(trim(line), '^https?://\S+$') or regexp_matches(trim(line), '^[\d\s.,;:\-–—|/\\()\[\]{{}}]+$') or (regexp_matches(trim(line), '^{CRUMB}([>|/»·]{CRUMB}){{2,}}$') and length(trim(line)) < 250))"


@query(f"with l as (select chunk_id, unnest(string_split(text, chr(10))) as line from html_corpus where text is not null) select chunk_id, count(*) as n_lines, count(*) filter (where {BOILER}) as n_boilerplate from l group by chunk_id")
def clean_boilerplate_flags(spark, sf):
    l = lines.explode_lines(Tables(spark, sf).html_corpus, "chunk_id")
    return l.groupBy("chunk_id").agg(F.count("*").alias("n_lines"), F.count_if(lines.boilerplate(F.col("line"))).alias("n_boilerplate"))


@query(f"select doc_id, count(*) as n_kept from ({PARS.replace(', text from (', ', text, text as line from (', 1)}) where length(text) >= 20 and not {BOILER} group by doc_id")
def clean_trivial_filter(spark, sf):
    p = _paragraphs(Tables(spark, sf)).withColumn("kind", F.lit("paragraph")).withColumn("items", F.lit(None).cast("array<string>"))
    return p.where(~cleaning.trivial()).groupBy("doc_id").agg(F.count("*").alias("n_kept"))


# the normal form of the characters that the tables hold: full width, Thai am, ligature, ellipsis, fixed blank
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).replace(chr(39), 2 * chr(39))
FORM = f"nfc_normalize(replace(replace(translate(text, '{WIDE}', '{NARROW}'), chr(3635), chr(3661) || chr(3634)), chr(64257), 'fi'))"
MAPPED = f"regexp_replace(replace(translate({FORM}, '‘’‚‛“”„‟•●◦', repeat(chr(39), 4) || repeat(chr(34), 4) || '---'), '…', '...'), '[–—]', ' - ', 'g')"


@query("select doc_id, sha256(" + SQUASHED_OF.format(r"regexp_replace(" + MAPPED + r", '[\x{ad}\x{200b}-\x{200d}\x{feff}]', '', 'g')") + ") as text_hash from documents")
def clean_normalize_nfkc(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.sha2(tx.normalize(F.col("text")), 256).alias("text_hash"))


@query(rf"with l as (select doc_id, pos, trim(line) as s from {LINES} where trim(line) <> ''), n as (select *, lead(s) over (partition by doc_id order by pos) as nxt from l) select doc_id, pos, coalesce(length(s) <= 90 and not regexp_matches(s, '[.,;]$') and (regexp_matches(s, '^[0-9]+[.)]\s+\S') or regexp_matches(s, '^[A-Z][A-Z\s\-/]{{4,}}$') or (length(s) <= 60 and regexp_matches(s, '^\p{{Lu}}') and length(nxt) > length(s) and not regexp_matches(s, '(?i)\b(the|and|of|in|for|to|a|an|is|are|has|was)\b'))), false) as is_heading from n")
def ocr_heading_lines(spark, sf):
    return lines.ocr_headings(lines.explode_lines(Tables(spark, sf).documents)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "is_heading")


# ---- grids

GRID = "(select l_orderkey as tab, l_linenumber - 1 as row, c.col, c.cell from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice), lateral (values (0, case when l_linenumber % 3 = 2 then '' else l_returnflag end), (1, l_tax::varchar), (2, case when l_linenumber % 2 = 0 then null else l_linestatus end)) c(col, cell))"


def _grid(t: Tables) -> DataFrame:
    l = io.latest(t.lineitem, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")])
    return l.select(F.col("l_orderkey").alias("tab"), (F.col("l_linenumber") - 1).alias("row"), F.expr("stack(3, 0, if(l_linenumber % 3 = 2, '', l_returnflag), 1, cast(l_tax as string), 2, if(l_linenumber % 2 = 0, null, l_linestatus)) as (col, cell)"))


@query(f"select tab, row, col, coalesce(last_value(nullif(trim(coalesce(cell, '')), '') ignore nulls) over (partition by tab, col order by row rows between unbounded preceding and current row), '') as filled from {GRID}")
def table_forward_fill(spark, sf):
    return grid.forward_fill(_grid(Tables(spark, sf))).select("tab", "row", "col", "filled")


START = f"(select tab, coalesce(min(case when row >= 1 and f * 2 > n then row end), max(row) + 1)::bigint as data_start from (select tab, row, count(nullif(trim(coalesce(cell, '')), '')) as f, count(*) as n from {GRID} group by tab, row) group by tab)"


@query(f"select tab, data_start from {START}")
def table_data_start(spark, sf):
    return grid.data_start(_grid(Tables(spark, sf)))


@query(f"select g.tab, g.col, coalesce(arg_min(nullif(trim(coalesce(cell, '')), ''), row) filter (where nullif(trim(coalesce(cell, '')), '') is not null), 'Col ' || (g.col + 1)) as header from {GRID} g join {START} s on s.tab = g.tab and g.row < s.data_start group by g.tab, g.col")
def table_header_combine(spark, sf):
    return grid.combine_headers(_grid(Tables(spark, sf)))


@query(f"select g.tab, g.row, count(*) filter (where lower(nullif(trim(coalesce(g.cell, '')), '')) = h.h) as same from {GRID} g join (select tab, col, lower(nullif(trim(coalesce(cell, '')), '')) as h from {GRID} where row = 0) h on h.tab = g.tab and h.col = g.col where g.row > 0 group by g.tab, g.row having count(*) filter (where lower(nullif(trim(coalesce(g.cell, '')), '')) = h.h) >= 2")
def table_header_repeat(spark, sf):
    return grid.header_repeats(_grid(Tables(spark, sf)))


@query("select n_nationkey, coalesce('Nations: ' || nullif(concat_ws(', ', case when regexp_matches(n_name, '[A-Za-z0-9]') then 'name: ' || n_name end, 'region: ' || n_regionkey), ''), '') as line from nation")
def table_linearize(spark, sf):
    n = Tables(spark, sf).nation
    return n.select("n_nationkey", grid.linearize(F.array(F.lit("name"), F.lit("region")), F.array("n_name", F.col("n_regionkey").cast("string")), F.lit("Nations")).alias("line"))


@query("select n_regionkey, string_agg(rn || '. ' || n_name, chr(10) order by n_name) as items from (select *, row_number() over (partition by n_regionkey order by n_name) as rn from nation) group by n_regionkey")
def list_render(spark, sf):
    g = Tables(spark, sf).nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("x"))
    return g.select("n_regionkey", chunking.list_text(F.col("x"), F.lit(True)).alias("items"))


# ---- chunking


@query("select doc_id, (length(coalesce(text, '')) // 4)::bigint as tokens from documents")
def token_estimate(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


SQUASHED = r"trim(regexp_replace(coalesce(text, ''), '[\s\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x{1680}]+', ' ', 'g'))"
STOPS = rf"regexp_replace(regexp_replace({SQUASHED}, '(?i)\b(i)\.(e)\.|\b(e)\.(g)\.', '\1\3~~\2\4~~', 'g'), '(?i)\b(Ph|M|B|Dr|Mr|Mrs|Ms|Prof|Sr|Jr|St|No|Sec|Reg|Vol|vs|etc|approx|dept|univ|govt|viz)\.', '\1~~', 'g')"
SENTS = rf"list_filter(list_transform(string_split(regexp_replace({STOPS}, '\.\s+', '.' || chr(1), 'g'), chr(1)), lambda s: trim(replace(s, '~~', '.'))), lambda s: s <> '')"


@query(f"select doc_id, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as pos from (select doc_id, {SENTS} as s from documents where text is not null)")
def sentence_split(spark, sf):
    d = Tables(spark, sf).documents.where("text is not null").select("doc_id", F.posexplode(tx.sentences(tx.squash(F.col("text")))).alias("pos", "sentence"))
    return d.select("doc_id", "sentence", F.col("pos").cast("bigint").alias("pos"))


PACKED = f"""with recursive u as (select doc_id, {SENTS} as s from documents where text is not null), p as (
select doc_id, s, 1 as i, [s[1]] as grp, length(s[1]) // 4 + 1 as n from u where len(s) > 0 union all
select doc_id, s, i + 1, case when n + length(s[i + 1]) // 4 + 1 > {{budget}} then list_append(grp, s[i + 1]) else list_append(grp[:len(grp) - 1], grp[len(grp)] || ' ' || s[i + 1]) end,
case when n + length(s[i + 1]) // 4 + 1 > {{budget}} then length(s[i + 1]) // 4 else n + length(s[i + 1]) // 4 + 1 end from p where i < len(s)) """


@query(PACKED.replace("{budget}", "128") + "select doc_id, unnest(grp) as piece, generate_subscripts(grp, 1) - 1 as pos from p where i = len(s)")
def greedy_pack(spark, sf):
    d = Tables(spark, sf).documents.where("text is not null").select("doc_id", F.posexplode(chunking.pack(tx.sentences(tx.squash(F.col("text"))), 128)).alias("pos", "piece"))
    return d.select("doc_id", "piece", F.col("pos").cast("bigint").alias("pos"))


def _overlapped(grp: str, target: int, most: int) -> str:
    tail = f"right({grp}[i - 1], {4 * most})"
    start = rf"regexp_extract({tail}, '(?s)\.\s([A-Z(].*)$', 1)"
    before = f"trim(case when length({grp}[i - 1]) // 4 <= {target} then {grp}[i - 1] when {start} <> '' then {start} else {tail} end)"
    return f"list_transform({grp}, lambda g, i: case when i = 1 or {before} = '' then g else {before} || ' ' || g end)"


@query(PACKED.replace("{budget}", "64") + f"select doc_id, unnest({_overlapped('grp', 50, 60)}) as piece from p where i = len(s)")
def pack_overlap_lag(spark, sf):
    g = chunking.with_overlap(chunking.pack(tx.sentences(tx.squash(F.col("text"))), 64), 50, 60)
    return Tables(spark, sf).documents.where("text is not null").select("doc_id", F.explode(g).alias("piece"))


@query("with recursive g as (select r_regionkey as k, list(n_name order by n_name) as s from nation join region on n_regionkey = r_regionkey group by r_regionkey), p as (select k, s, 1 as i, [s[1]] as grp from g union all select k, s, i + 1, case when length(s[i + 1]) // 4 < 2 then list_append(grp[:len(grp) - 1], grp[len(grp)] || chr(10) || s[i + 1]) else list_append(grp, s[i + 1]) end from p where i < len(s)) select k, array_to_string(grp, '#') as merged from p where i = len(s)")
def tiny_tail_merge(spark, sf):
    g = Tables(spark, sf).nation.groupBy(F.col("n_regionkey").alias("k")).agg(F.sort_array(F.collect_list("n_name")).alias("s"))
    return g.select("k", F.array_join(chunking.merge_tail(F.col("s"), 2), "#").alias("merged"))


@query("with recursive g as (select o_custkey as k, list(cast(o_orderkey as varchar) || ' ' || o_orderpriority || ' ' || o_orderstatus order by o_orderkey) as s from orders group by o_custkey), p as (select k, s, 1 as i, [s[1]] as grp, length(s[1]) // 4 + 1 as n from g union all select k, s, i + 1, case when n + length(s[i + 1]) // 4 + 1 > 20 then list_append(grp, s[i + 1]) else list_append(grp[:len(grp) - 1], grp[len(grp)] || chr(10) || s[i + 1]) end, case when n + length(s[i + 1]) // 4 + 1 > 20 then length(s[i + 1]) // 4 else n + length(s[i + 1]) // 4 + 1 end from p where i < len(s)) select k, len(grp)::bigint as n_groups, array_to_string(grp, '#') as groups from p where i = len(s)")
def table_row_pack(spark, sf):
    row = F.struct("o_orderkey", F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus").alias("r"))
    g = Tables(spark, sf).orders.groupBy(F.col("o_custkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"]).alias("s"))
    return g.select("k", chunking.pack(F.col("s"), 20, "\n").alias("p")).select("k", F.size("p").cast("bigint").alias("n_groups"), F.array_join("p", "#").alias("groups"))


@query("select chunk_id, document_title, coalesce(nullif(regexp_extract(coalesce(date_published, ''), '20(1[5-9]|2[0-9])'), ''), nullif(regexp_extract(coalesce(document_title, ''), '20(1[5-9]|2[0-9])'), ''), nullif(regexp_extract(source_url, '20(1[5-9]|2[0-9])'), ''), '0')::int as batch_year from chunks")
def batch_year_extract(spark, sf):
    return Tables(spark, sf).chunks.select("chunk_id", "document_title", chunking.batch_year(F.col("date_published"), F.col("document_title"), F.col("source_url")).alias("batch_year"))


MERGED = f""", o as (select doc_id, {_overlapped('grp', 100, 120)} as grp from p where i = len(s)), m(doc_id, s, i, grp) as (select doc_id, grp, 1, [grp[1]] from o union all
select doc_id, s, i + 1, case when length(s[i + 1]) // 4 < 100 then list_append(grp[:len(grp) - 1], grp[len(grp)] || ' ' || s[i + 1]) else list_append(grp, s[i + 1]) end from m where i < len(s)),
k as (select doc_id, list_filter(case when length({SQUASHED}) // 4 <= 512 then [{SQUASHED}] else m.grp end, lambda x: length(x) // 4 >= 15) as f from documents d join m using (doc_id) where m.i = len(m.s)),
c as (select k.doc_id, d.url, coalesce(d.title, d.url) as title, d.date_published, unnest(f) as text, generate_subscripts(f, 1) - 1 as chunk_index from k join documents d on d.doc_id = k.doc_id) """
CHUNKED = (PACKED.replace("{budget}", "512") + MERGED).replace("\n", " ")
CHUNK_ROWS = CHUNKED + "select 'c_' || substring(sha256(url || '::' || chunk_index), 1, 14) as chunk_id, doc_id, chunk_index, (length(text) // 4)::bigint as token_count, coalesce(nullif(regexp_extract(coalesce(date_published, ''), '20(1[5-9]|2[0-9])'), ''), nullif(regexp_extract(title, '20(1[5-9]|2[0-9])'), ''), nullif(regexp_extract(url, '20(1[5-9]|2[0-9])'), ''), '0')::int as batch_year, sha256(text) as text_hash from c qualify row_number() over (partition by doc_id, sha256(text) order by chunk_index) = 1"


@query(CHUNK_ROWS)
def chunk_documents(spark, sf):
    return chunking.chunk_documents(Tables(spark, sf).documents).select("chunk_id", "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "token_count", "batch_year", "text_hash")


@query(f"select chunk_id, row_number() over (partition by source_url order by chunk_id) as seq, row_number() over (partition by source_url, section_heading order by chunk_id) - 1 as in_section from {CHUNKS}")
def chunk_renumber(spark, sf):
    c = quality.current(Tables(spark, sf).chunks)
    return chunking.renumber(c, "source_url", "section_heading", "chunk_id").select("chunk_id", F.col("seq").cast("bigint").alias("seq"), F.col("in_section").cast("bigint").alias("in_section"))


@query(f"with c as (select *, row_number() over (partition by source_url, sha256(coalesce(text, '')) order by chunk_index, chunk_id) as rn from {CHUNKS}) select chunk_id, chunk_index from c where rn = 1")
def chunk_dedup_gap_index(spark, sf):
    c = quality.current(Tables(spark, sf).chunks).withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    return io.latest(c, ["source_url", "h"], [F.col("chunk_index"), F.col("chunk_id")]).select("chunk_id", "chunk_index")


CURATED = "(select id, 'Source: ' || coalesce(expect_source_contains, 'none') || chr(10) || '## ' || category || chr(10) || question || chr(10) || '## passage' || chr(10) || coalesce(passage, '') as md from eval_items)"


@query(f"with p as (select id, string_split(md, chr(10) || '## ') as parts from {CURATED}), s as (select id, unnest(parts[2:]) as s, generate_subscripts(parts[2:], 1) - 1 as section_no, trim(parts[1]) as pre from p) select id, section_no, trim(split_part(s, chr(10), 1)) as heading, '## ' || regexp_replace(s, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || pre as body from s")
def curated_split_sections(spark, sf):
    t = Tables(spark, sf).eval_items
    md = F.concat(F.lit("Source: "), F.coalesce("expect_source_contains", F.lit("none")), F.lit("\n## "), "category", F.lit("\n"), "question", F.lit("\n## passage\n"), F.coalesce("passage", F.lit("")))
    x = t.select("id", F.posexplode(chunking.split_curated(md)).alias("section_no", "s"))
    return x.select("id", F.col("section_no").cast("bigint").alias("section_no"), "s.heading", "s.body")


@query("with h as (select distinct chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) as h from chunks) select chunk_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][((instr('0123456789abcdef', substring(h, 17, 1)) - 1) % 4 + 1)::int] || substring(h, 18, 3) || '-' || substring(h, 21, 12) as point_id from h")
def point_id_uuid5(spark, sf):
    return Tables(spark, sf).chunks.select("chunk_id").distinct().select("chunk_id", tx.point_id(F.col("chunk_id")).alias("point_id"))


@query(f"select chunk_id, source_url, text, date_scraped::varchar as scraped from {CHUNKS}")
def upsert_latest(spark, sf):
    c = Tables(spark, sf).chunks
    old, new = c.where("token_count % 2 = 0"), c.where("not coalesce(token_count % 2 = 0, false)")  # a table and the changes to it
    return io.upsert(old, new, ["chunk_id"], "date_scraped", "text").select("chunk_id", "source_url", "text", F.col("date_scraped").cast("string").alias("scraped"))


@query(f"select block_type, count(*) as n, min(token_count) as least, sum(token_count)::bigint // count(token_count) as mean, max(token_count) as most from {CHUNKS} group by block_type")
def prose_histograms(spark, sf):
    g = quality.current(Tables(spark, sf).chunks).groupBy("block_type")
    return g.agg(F.count("*").alias("n"), F.min("token_count").alias("least"), F.floor(F.sum("token_count") / F.count("token_count")).cast("bigint").alias("mean"), F.max("token_count").alias("most"))


@query("select batch_year, count(*) as n from chunks group by batch_year order by batch_year")
def year_distribution(spark, sf):
    return Tables(spark, sf).chunks.groupBy("batch_year").agg(F.count("*").alias("n")).orderBy("batch_year")


@query("select m.category, count(*) as n, floor(sum(length(d.text) // 4) / count(*))::bigint as mean_tokens, max(length(d.text) // 4)::bigint as most_tokens, count(*) - count(distinct sha256(d.text)) as repeats from documents d join manifest m on m.id = d.doc_id where d.text is not null group by m.category")
def corpus_category_stats(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.where("text is not null").join(t.manifest.select(F.col("id").alias("doc_id"), F.col("category").alias("cat")), "doc_id").withColumn("tok", tx.token_estimate(F.col("text"))).withColumn("h", F.sha2("text", 256))
    return d.groupBy(F.col("cat").alias("category")).agg(F.count("*").alias("n"), F.floor(F.sum("tok") / F.count("*")).cast("bigint").alias("mean_tokens"), F.max("tok").alias("most_tokens"), (F.count("*") - F.countDistinct("h")).alias("repeats"))


@query()
def corpus_rollup(spark, sf):
    """Documents and characters per (source, language) with subtotals."""
    d = Tables(spark, sf).documents.select(F.coalesce("source", F.lit("-")).alias("source"), F.lower(F.coalesce("lang", F.lit("-"))).alias("lang"), "n_chars")
    return d.rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


SQL["corpus_rollup"] = "select source, lang, count(*) as n, sum(n_chars)::bigint as chars from (select coalesce(source, '-') as source, lower(coalesce(lang, '-')) as lang, n_chars from documents) group by rollup (source, lang)"

# ---- classification


def _any(*patterns: str) -> str:
    return " and ".join(f"regexp_matches(text, '{p}')" for p in patterns)


def _often(pattern: str, n: int) -> str:
    return f"len(regexp_extract_all(text, '{pattern}')) >= {n}"


# The cascade, written out for the other engine: (label, signals needed, signals).
CASCADE = [
    ("syllabus", 3, [_any(r"\bL\s*/?\s*T\s*/?\s*P\b"), _any(r"\d+\.\s+[A-Z]{2,4}-?\d{3}"), _any("Credit Hours|Contact Hours"), _any("Reading List|Reference Books|Text Books"), _any("Name of Books|Authors/Publisher"), _often(r"(?m)^\d+\.\s+[A-Z]", 3)]),
    ("policy", 1, [_any("(?i)transcript", "(?i)fee|verification|duplicate")]),
    ("policy", 1, [_any(r"National Cadet Corps|National Service Scheme|\bNCC\b|\bNSS\b")]),
    ("form", 2, [_any("FORM OF APPLICATION"), _any("Proposed Project Title"), _any("Signature of"), _any(r"Roll Number\s*:"), _often(r"\bDate\s*:", 2)]),
    ("contact", 3, [_often("PROFESSOR", 3), _often("ASSISTANT PROFESSOR", 2), _often(r"Ph\.D", 3), _any(r"\bDesignation\b")]),
    ("notice", 2, [_any(r"Circular No|F\.\s*No|Ref:-"), _any("All Students|all students"), _any("last date|Last Date|due date"), _any("Dean Academic|Associate Dean"), _any("(?i)academic calendar"), _often(r"\d{2}\.\d{2}\.\d{4}", 4)]),
    ("placement", 2, [
        _any("(?i)placement highlight|placement stat|placement record"), _any(r"(?i)No\.?\s*of Offers|number of offers"), _any("(?i)Average CTC|Median CTC|Highest CTC|Maximum CTC|LPA|lakh per annum"), _any("(?i)Students Registered for Placement|eligible students"),
        _any("(?i)placement coordinator|Training.*Placement|T&P|TPC|TNP"), _any("(?i)campus recruit|on.campus|off.campus"), _any("(?i)placement brochure|placement policy|placement procedure"), _any("(?i)top recruiter|hiring partner|dream offer|super dream"),
        _any("(?i)final.?placement.?report|placement.?season|placement.?overview"), _any(r"\bCTC\b", "(?i)placement|MBA|package|salary"), _any("(?i)recruiters?|recruiting companies|companies? visit", "(?i)campus|placement"), _any(r"(?i)\bplaced\b", "(?i)placement|T&P|students"),
    ]),
    ("admissions", 2, [
        _any("(?i)joint admission|JAC Delhi|admission counsell"), _any("(?i)seat matrix|choice filling|allotment"), _any("(?i)JEE Main|JEE rank|All India Rank|opening rank|closing rank"), _any("(?i)online registration", "(?i)admission|rank|seat|counsel"),
        _any(r"(?i)B\.?\s*Tech", "(?i)admission|counsel|seat|programme|eligib"), _any("(?i)eligibility criteria|document verification|reporting"),
    ]),
    ("policy", 2, [_any("(?i)hostel"), _any("(?i)warden|allottee|allotment"), _any("(?i)resident|inmate|hosteller"), _any("(?i)mess"), _any("(?i)ragging")]),
    ("policy", 1, [_any("(?i)ragging")]),
    ("policy", 1, [_any(r"(?i)rules\s+for\s+\w+") + " and " + _often(r"(?m)^\d+\.\s+[A-Z]", 2)]),
    ("policy", 2, [
        _any(r"Regulation|Ordinance|R\.\s*1\s*\(B\)"), _often(r"\bshall be\b", 3), _any(r"Dean \(UG\)|Dean \(PG\)|COE\b|HOD\b"), _any(r"(?is)\battendance\b.*(percentage|75%)|(percentage|75%).*\battendance\b"), _any("CGPA|grade point|SGPA"),
        _any("CGPA|grade point|SGPA", "(?i)percentage"), _any(r"(?i)letter\s*grade|numerical\s*grade", "(?i)outstanding|excellent|formula|grade.?point|SGPA|CGPA"), _any(r"(?i)minimum\s*credits|maximum\s*credits|programme\s*credits"),
        _any("(?i)annexure", "(?i)guidelines|procedure|regulation|student"), _any("(?i)financial support|merit scholarship|scholarship to"), _any("(?i)penalty|penalties", "(?i)student"), _any("(?i)industrial training|field training", "(?i)evaluation|procedure"),
        _any("(?i)unfair means"), _any("(?i)semester away|summer semester", "(?i)register|credits"),
    ]),
]
CLASS = "case " + " ".join(f"when {' + '.join(f'({x})::int' for x in sig)} >= {need} then '{label}'" for label, need, sig in CASCADE) + " else 'skip' end"


@query(f"select chunk_id, source_url, {CLASS} as page_class from (select chunk_id, source_url, coalesce(text, '') as text from {CHUNKS})")
def page_classify_signals(spark, sf):
    return quality.current(Tables(spark, sf).chunks).select("chunk_id", "source_url", classify.classify_page(F.col("text")).alias("page_class"))


@query(f"with p as (select source_url, coalesce(chunk_index, 0) as page, {CLASS} as label from (select source_url, chunk_index, coalesce(text, '') as text from {CHUNKS})), c as (select source_url, label, count(*) as n, min(page) as f from p group by 1, 2), a as (select source_url, sum(n) filter (where label <> 'skip') as kept, arg_max(label, (n, -f)) filter (where label <> 'skip') as best, sum(n) filter (where label = 'policy') as np, sum(n) filter (where label = 'syllabus') as ns from c group by 1) select source_url, case when np > 0.4 * kept then 'policy' when ns > 0.3 * kept then 'syllabus' else coalesce(best, 'skip') end as document_class from a")
def document_class_vote(spark, sf):
    p = quality.current(Tables(spark, sf).chunks).select("source_url", F.coalesce("chunk_index", F.lit(0)).alias("page"), classify.classify_page(F.col("text")).alias("label"))
    return classify.document_vote(p, "source_url", "page", "label")


GLYPHS = "(select o_custkey as doc, o_orderkey % 97 * 1.3 as top, 8 + o_orderkey % 5 as size, substring(o_orderstatus, 1, 1) as char, o_orderkey as x from orders)"


@query(f"select doc, round_even(top / 2, 0) * 2 as line_top, round(avg(size), 6) as font, string_agg(char, '' order by x, char) as line from (select doc, top::double as top, size, char, x from {GLYPHS}) group by 1, 2")
def pdf_line_fonts(spark, sf):
    g = Tables(spark, sf).orders.select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 97 * F.expr("cast(1.3 as decimal(2, 1))")).cast("double").alias("top"), (8 + F.col("o_orderkey") % 5).alias("size"), F.substring("o_orderstatus", 1, 1).alias("char"), F.col("o_orderkey").alias("x"))
    return classify.line_fonts(g, ["doc"]).select("doc", "line_top", F.round("font", 6).alias("font"), "line")


# ---- joins


@query("select m.id, m.url from manifest m where not exists (select 1 from html_corpus h where h.source_url = m.url) and m.url not in (select source_url from chunks where block_type = 'table' and source_url is not null)")
def superseded_anti_join(spark, sf):
    t = Tables(spark, sf)
    gone = t.html_corpus.select(F.col("source_url").alias("url")).unionByName(t.chunks.where("block_type = 'table'").select(F.col("source_url").alias("url"))).distinct()
    return t.manifest.select("id", "url").join(gone, "url", "left_anti").select("id", "url")


@query(f"with h as (select doc_id, pos, is_heading from ({HEADINGS})) select l.doc_id, l.pos, coalesce(h.is_heading, false) as marked from {LINES} l left join (select * from h where is_heading) h on h.doc_id = l.doc_id and h.pos = l.pos where trim(l.line) <> ''")
def heading_lookup_left_join(spark, sf):
    l = lines.explode_lines(Tables(spark, sf).documents)
    h = lines.headings(l).where("is_heading").select("doc_id", "pos", F.lit(True).alias("marked"))
    return l.where("trim(line) <> ''").join(h, ["doc_id", "pos"], "left").select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce("marked", F.lit(False)).alias("marked"))


@query(f"with t as (select source_url, page_number, count(*) as n_tables from {CHUNKS} where block_type = 'table' and page_number is not null group by 1, 2), f as (select source_url, page_number, min(chunk_id) as first_prose from {CHUNKS} where block_type = 'prose' and page_number is not null group by 1, 2) select t.source_url, t.page_number, t.n_tables, f.first_prose as claimed_by from t left join f using (source_url, page_number)")
def page_table_claim(spark, sf):
    c = quality.current(Tables(spark, sf).chunks).where("page_number is not null").select("source_url", "page_number", "block_type", "chunk_id")
    prose = c.where("block_type = 'prose'").select("source_url", "page_number", F.col("chunk_id").alias("claimed_by"))
    claimed, left = classify.claim_tables(prose, c.where("block_type = 'table'"), ["source_url", "page_number"], "claimed_by")
    both = claimed.select("source_url", "page_number", "claimed_by").unionByName(left.select("source_url", "page_number", F.lit(None).cast("string").alias("claimed_by")))
    return both.groupBy("source_url", "page_number").agg(F.count("*").alias("n_tables"), F.max("claimed_by").alias("claimed_by"))


INTENTS = [("fees", ["fee", "refund", "fine"]), ("hostel", ["hostel", "hall", "room"]), ("exams", ["exam", "marks", "grade"]), ("people", ["officer", "marshal", "fellow", "warden"])]
INTENT_SQL = "case " + " ".join("when " + " or ".join(f"contains(lower(coalesce(question, '')), '{p}')" for p in ps) + f" then '{n}'" for n, ps in INTENTS) + " end"


@query(f"select id, {INTENT_SQL} as intent from eval_items")
def redirect_first_match(spark, sf):
    return Tables(spark, sf).eval_items.select("id", retrieval.first_rule(None, "question", INTENTS).alias("intent"))


@query("with r(intent, phrase) as (values " + ", ".join(f"('{n}', '{p}')" for n, ps in INTENTS for p in ps) + ") select e.id, r.intent, count(*) as hits from eval_items e join r on regexp_matches(lower(e.question), r.phrase) group by e.id, r.intent")
def intent_regex_theta_join(spark, sf):
    rules = spark.createDataFrame([(n, p) for n, ps in INTENTS for p in ps], "intent string, phrase string")  # a fixed table
    e = Tables(spark, sf).eval_items
    return e.join(F.broadcast(rules), F.rlike(F.lower("question"), F.col("phrase"))).groupBy("id", "intent").agg(F.count("*").alias("hits"))


# ---- vectors, contexts, ranking, evaluation

TOP = "select q.vec_id as query_id, p.vec_id as point_id, round(list_cosine_similarity(q.embedding::double[], p.embedding::double[]), 4) as score from embeddings q, embeddings p where q.vec_id % 20 = 0"


def _top(t: Tables, k: int = 5) -> DataFrame:
    e = t.embeddings
    return retrieval.cosine_top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, k, pid="vec_id")


@query(f"select query_id, point_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from ({TOP})) where rank <= 5")
def vector_topk(spark, sf):
    return _top(Tables(spark, sf)).select("query_id", "point_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"select query_id, point_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from ({TOP} and (p.label = q.label or p.label = 0))) where rank <= 5")
def vector_topk_year_filter(spark, sf):
    """Per query only points of its own label or label 0; the filter is applied before scoring, in the one scan of the points."""
    e = Tables(spark, sf).embeddings
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return retrieval.cosine_top_k(q, e, pid="vec_id", label="label").select("query_id", "point_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("with v as (select q.vec_id - q.vec_id % 40 as query_id, p.vec_id as point_id, round(list_cosine_similarity(q.embedding::double[], p.embedding::double[]), 4) as score from embeddings q, embeddings p where q.vec_id % 20 = 0), m as (select query_id, point_id, max(score) as score from v group by 1, 2) select query_id, point_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from m) where rank <= 5")
def multi_variant_max_merge(spark, sf):
    """Two query vectors per query: their k best points each hold the k best of the merged list."""
    hits = _top(Tables(spark, sf)).withColumn("variant_no", F.col("query_id") % 40).withColumn("query_id", F.col("query_id") - F.col("query_id") % 40)
    return retrieval.merge_variants(hits).select("query_id", "point_id", "score", F.col("rank").cast("bigint").alias("rank"))


EXPAND = f"with c as {CHUNKS}, top as (select distinct category as query_id, source_url, section_heading, 1 as rank from c join (select distinct category from eval_items) e on true where block_type = 'table' and lower(coalesce(document_title, '')) like '%' || left(category, 4) || '%'), x as (select t.query_id, t.rank, c.chunk_id, row_number() over w as n, sum(coalesce(token_count, 0)) over (partition by t.query_id, c.source_url, c.section_heading order by coalesce(page_number, 0), coalesce(chunk_index, 0), chunk_id rows between unbounded preceding and current row) as running from top t join c on c.source_url = t.source_url and c.section_heading = t.section_heading where c.block_type = 'table' window w as (partition by t.query_id, c.source_url, c.section_heading order by coalesce(page_number, 0), coalesce(chunk_index, 0), chunk_id)) select query_id, chunk_id, n, running::bigint as running from x where n <= 64 and (n = 1 or running <= 1600)"


@query(EXPAND)
def table_expand_running_budget(spark, sf):
    t = Tables(spark, sf)
    c = quality.current(t.chunks)
    cats = t.eval_items.select(F.col("category").alias("query_id")).distinct()  # a fixed table
    top = c.where("block_type = 'table'").join(F.broadcast(cats), F.contains(F.lower(F.coalesce("document_title", F.lit(""))), F.left("query_id", F.lit(4)))).select("query_id", "source_url", "section_heading", F.lit(1).alias("rank")).distinct()
    return retrieval.expand_tables(top, c).select("query_id", "chunk_id", F.col("n").cast("bigint").alias("n"), "running")


@query("select source_url, string_agg('[Chunk ' || rank || ' | Section: ' || coalesce(section_heading, '') || ' | Source: ' || source_url || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by rank) as context from (select *, row_number() over (partition by source_url order by chunk_index, chunk_id) as rank from " + CHUNKS + ") where rank <= 5 group by source_url")
def context_assemble(spark, sf):
    c = quality.current(Tables(spark, sf).chunks)
    from pyspark.sql import Window

    r = c.withColumn("rank", F.row_number().over(Window.partitionBy("source_url").orderBy("chunk_index", "chunk_id"))).where("rank <= 5")
    return retrieval.assemble_context(r.select("source_url", "rank", F.col("section_heading").alias("section"), F.col("source_url").alias("url"), "text"), "source_url")


@query(f"select chunk_id, document_title, substring(text, 1, 250) as preview from {CHUNKS}")
def source_preview(spark, sf):
    return quality.current(Tables(spark, sf).chunks).select("chunk_id", "document_title", F.substring("text", 1, 250).alias("preview"))


@query("select doc_id, " + " or ".join(f"contains(lower(coalesce(text, '')), '{p}')" for p in ("i could not find this information", "don''t have information", "not mentioned in", "not available in", "cannot find", "no information", "not covered", "not found in", "does not contain", "i cannot answer", "outside the scope", "not in the provided")) + " as no_answer, " + " or ".join(f"contains(lower(coalesce(text, '')), '{p}')" for p in ("i could not find this information", "could not find", "not available in", "no information", "not found in", "does not contain")) + " as no_answer_eval from documents")
def no_answer_flag(spark, sf):
    t = F.col("text")
    return Tables(spark, sf).documents.select("doc_id", tx.no_answer(t).alias("no_answer"), tx.no_answer(t, tx.NO_ANSWER_EVAL).alias("no_answer_eval"))


@query("select count(*) as n, count(*) filter (where p) as passed, round(count(*) filter (where p) / count(*), 6) as ratio from (select contains(lower(question), 'no information') or contains(lower(question), 'not available in') or contains(lower(question), 'could not find') or contains(lower(question), 'not found in') or contains(lower(question), 'does not contain') or contains(lower(question), 'room') as p from eval_items where not answerable)")
def guard_pass_ratio(spark, sf):
    """Questions without an answer that were turned down; the questions stand in for answers, and mention of a room counts as well."""
    e = Tables(spark, sf).eval_items.select("answerable", F.col("question").alias("answer"))
    return retrieval.guard_ratio(e, tx.no_answer(F.col("answer"), [*tx.NO_ANSWER_EVAL, "room"]))


@query(f"select query_id, max(score) < 0.3 as low from ({TOP} and p.vec_id <> q.vec_id) group by query_id")
def low_score_flag(spark, sf):
    t = _top(Tables(spark, sf), 6).where("query_id <> point_id")
    return t.groupBy("query_id").agg((F.max("score") < 0.3).alias("low"))


@query(f"select doc_id, array_to_string({WORDS.format('text')}, ' ') as words from documents")
def bm25_tokenize(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.array_join(tx.words(F.col("text")), " ").alias("words"))


@query(f"select term, count(*) as df from (select distinct doc_id, unnest({WORDS.format('text')}) as term from documents) group by term")
def bm25_stats(spark, sf):
    return retrieval.bm25_statistics(Tables(spark, sf).documents, "doc_id", "text")


def _bm25_sql(q: str, docs: str, k: int = 5) -> str:
    return f"""dw as (select doc_id, {WORDS.format('text')} as w from {docs}), st as (select count(*) as n, avg(len(w)) as al from dw), tf as (select doc_id, term, count(*) as tf, any_value(l) as l from (select doc_id, unnest(w) as term, len(w) as l from dw) group by doc_id, term), df as (select term, count(*) as df from tf group by term), idf as (select term, ln(n - df + 0.5) - ln(df + 0.5) as idf from df, st), fl as (select 0.25 * avg(idf) as f from idf), ii as (select term, case when idf < 0 then f else idf end as idf from idf, fl), qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({WORDS.format('query')}) as term from {q}) group by 1, 2), sc as (select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / al))), 6) as score from qt join ii using (term) join tf using (term), st group by 1, 2), rk as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc qualify rank <= {k})"""


@query("with " + _bm25_sql("(select id as query_id, question as query from eval_items)", "documents") + " select query_id, doc_id, score, rank from rk")
def bm25_rank(spark, sf):
    t = Tables(spark, sf)
    q = t.eval_items.select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    return retrieval.bm25_rank(q, t.documents).select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


JUDGE = "(coalesce(len(list_filter(expect_keywords_any, lambda w: contains(lower(coalesce(text, '')), lower(w)))) > 0, true) or coalesce(len(expect_keywords_any), 0) = 0) and contains(lower(coalesce(url, '')), lower(coalesce(expect_source_contains, '')))"


@query(f"select e.id, count(*) filter (where {JUDGE}) as n_relevant from eval_items e left join documents d on true group by e.id")
def relevance_judge(spark, sf):
    """Relevant documents per item: the fixed item table against all documents, counted where they are."""
    t = Tables(spark, sf)
    e = t.eval_items.select("id", "expect_keywords_any", "expect_source_contains")
    x = t.documents.select("text", "url").join(F.broadcast(e))  # the stated query set against all rows; items are a fixed table
    n = x.where(retrieval.is_relevant(F.col("text"), F.col("url"), F.col("expect_keywords_any"), F.col("expect_source_contains"))).groupBy("id").agg(F.count("*").alias("n"))
    return e.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_relevant"))


def _eval_sql(query: str) -> str:
    rows = CHUNKED + ", ch as (select 'c_' || substring(sha256(url || '::' || chunk_index), 1, 14) as doc_id, url, text from c qualify row_number() over (partition by doc_id, sha256(text) order by chunk_index) = 1), qs as (select id as query_id, " + query + " as query from eval_items where answerable), "
    return rows + _bm25_sql("qs", "ch") + f", jd as (select rk.query_id, min(rank) filter (where {JUDGE}) as f from rk join ch using (doc_id) join eval_items e on e.id = rk.query_id group by rk.query_id) select count(*) as n, round(avg(coalesce((f <= 1)::int, 0)), 6) as hit_1, round(avg(coalesce((f <= 3)::int, 0)), 6) as hit_3, round(avg(coalesce((f <= 5)::int, 0)), 6) as hit_5, round(avg(coalesce(1.0::double / f, 0)), 6) as mrr from qs left join jd using (query_id)"


@query(_eval_sql("concat_ws(' ', question, array_to_string(expect_keywords_any, ' '))"))
def hit_mrr(spark, sf):
    t = Tables(spark, sf)
    return pipeline.evaluate_lexical(t.documents, t.eval_items)


@query(_eval_sql("question"))
def hit_mrr_question_only(spark, sf):
    t = Tables(spark, sf)
    return pipeline.evaluate_lexical(t.documents, t.eval_items, with_keywords=False)


# ---- quality

DENSITY = r"case when n < 60 then 99.0 else round(100.0::double * len(regexp_extract_all(text, '[.!?]\s')) / n, 6) end"


@query(rf"select chunk_id, text, {DENSITY} as density from (select chunk_id, coalesce(text, '') as text, len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\s+'), lambda w: w <> '')) as n from chunks)")
def audit_sentence_density(spark, sf):
    return Tables(spark, sf).chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"), tx.sentence_end_density(F.coalesce("text", F.lit(""))).alias("density"))


BODY = "case when instr(coalesce(text, ''), chr(10) || chr(10)) > 0 then substring(text, instr(text, chr(10) || chr(10)) + 2) else coalesce(text, '') end"
NAV = r"(?i)\b(Home|About Us|Contact Us|Sitemap|Login|Click here|Read More|Quick Links|Important Links)\b"
ISSUES = ["empty_meta", "tiny", "huge", "multi_faculty", "interleaved_or_runon", "nav_junk", "dup_text"]
# what the tables have too little of is made of their columns, by the same expression in both engines
AUDITED = "select chunk_id, source_url, document_title, token_count, case when token_count % 13 = 0 then 'dept_faculty' else document_type end as document_type, block_type, date_scraped, case when token_count % 13 = 0 then 'Designation: A, Designation : B ' || text when token_count % 11 = 0 then 'Home | About Us | Login | Sitemap ' || text else text end as text from chunks"


@query(rf"with c0 as (select * from ({AUDITED}) qualify row_number() over (partition by chunk_id order by date_scraped desc nulls last, text desc) = 1), c1 as (select *, {BODY} as body from c0), c as (select *, len(list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '')) as n, min(chunk_id) over (partition by sha256(body)) as first_id from c1), f as (select chunk_id, unnest(['{"', '".join(ISSUES)}']) as issue, unnest([coalesce(source_url, '') = '' or coalesce(document_title, '') = '', coalesce(token_count, 0) > 0 and coalesce(token_count, 0) < 20, coalesce(token_count, 0) > 700, document_type = 'dept_faculty' and len(regexp_extract_all(body, '(?i)Designation\s*:')) > 1, block_type = 'prose' and {DENSITY.replace('text', 'body')} < 1.2 and n > 120, len(regexp_extract_all(body, '{NAV}')) >= 4, chunk_id > first_id]) as hit from c) select chunk_id, issue from f where hit")
def audit_flags(spark, sf):
    Tables(spark, sf).chunks.createOrReplaceTempView("_chunks_audited")
    c = spark.sql(AUDITED.replace("from chunks", "from _chunks_audited"))
    return quality.audit(quality.current(c))


SQL["audit_issue_counts"] = "select issue, count(*) as n from (" + SQL["audit_flags"] + ") group by issue"


@query(SQL["audit_issue_counts"])
def audit_issue_counts(spark, sf):
    return audit_flags(spark, sf).groupBy("issue").agg(F.count("*").alias("n"))


VALID = ["required", "token_count", "bounds", "heading", "prefix", "dup_id", "dup_text", "order"]


@query("""with c as (select *, trim(coalesce(section_heading, '')) as h, count(*) over (partition by chunk_id) as by_id, count(*) over (partition by sha256(coalesce(text, ''))) as by_text, row_number() over (partition by source_url order by chunk_index asc nulls first, chunk_id asc nulls first) - 1 as idx from chunks), f as (select chunk_id is null or text is null or source_url is null or document_title is null or section_heading is null or document_type is null or chunk_index is null or token_count is null as required, abs(coalesce(token_count, 0) - length(coalesce(text, '')) // 4) > 5 as token_count, not coalesce(token_count, 0) between 50 and 700 as bounds, h = '' or regexp_matches(h, '^[0-9]+$') or length(h) < 4 as heading, not starts_with(coalesce(text, ''), 'Section: ') as prefix, by_id > 1 as dup_id, by_text > 1 as dup_text, coalesce(chunk_index, -1) <> idx as "order" from c) """ + " union all ".join(f"select '{n}' as \"check\", count(*) filter (where \"{n}\") as n from f" for n in VALID) + r""" union all select 'sequence', coalesce(max(k) + 1 - count(*), 0)::bigint from (select distinct regexp_extract(chunk_id, '^auto_(\d+)$', 1)::bigint as k from chunks where regexp_matches(chunk_id, '^auto_\d+$'))""")
def chunk_validator(spark, sf):
    return quality.validate(Tables(spark, sf).chunks)


# points of a few documents a year and site, with the headings that the rules look for
POINTS = """select chunk_id, text, date_scraped, block_type, chunk_index, case when token_count % 17 = 0 then 'curated_stats' else document_type end as document_type,
'https://' || lower(regexp_extract(source_url, '^[A-Za-z]+://([^/?#]+)', 1)) || case when coalesce(token_count, 0) % 4 = 3 then '/notice/' else '/ordinance/' end || cast(2014 + coalesce(token_count, 0) % 3 as string) || '.pdf' as source_url,
case when token_count % 7 = 0 then 'R. 1(B).' || cast(token_count % 5 as string) || ' Conduct' when token_count % 11 = 0 then 'Unfair  Means penalties' when token_count % 5 = 0 then 'About  the Institute' when token_count % 3 = 0 then 'Code Title' else section_heading end as section_heading from chunks""".replace("\n", " ")
RULES_SQL = rf"""p as (select * from ({POINTS}) qualify row_number() over (partition by chunk_id order by date_scraped desc nulls last, text desc) = 1), o as (select *, coalesce(section_heading, '') as h, coalesce(regexp_extract(source_url, '20\d{{2}}'), '0')::int as y from p where contains(lower(coalesce(source_url, '')), 'ordinance') and document_type is distinct from 'curated_stats'),
r1 as (select chunk_id from o where not regexp_matches(h, '(?i)unfair\s*means') and (regexp_matches(h, '(?i)R\.?\s*1?\s*\(B\)\.?\s*\d+|^REGULATIONS\b') or regexp_matches(left(coalesce(text, ''), 400), 'R\.\s*1\s*\(B\)\.\s*\d+\s+[A-Z]'))),
a2 as (select *, lower(regexp_replace(trim(h), '\s+', ' ', 'g')) as hh from o where chunk_id not in (select chunk_id from r1) and block_type is distinct from 'table'), r2 as (select chunk_id from (select *, max(y) over (partition by hh) as top from a2 where length(hh) >= 4) where y < top),
a3 as (select *, lower(trim(h)) as hh from o where chunk_id not in (select chunk_id from r1) and chunk_id not in (select chunk_id from r2)), r3 as (select chunk_id from (select *, count(*) over (partition by source_url, hh) as n, row_number() over (partition by source_url, hh order by coalesce(chunk_index, 0), chunk_id) as rn from a3 where length(hh) >= 4) where n > 15 and rn > 3),
r4 as (select chunk_id from a3 where chunk_id not in (select chunk_id from r3) and block_type is distinct from 'table' and not regexp_matches(h, '(?i)unfair\s*means')),
r as (select chunk_id, 1 as rule_no from r1 union all select chunk_id, 2 from r2 union all select chunk_id, 3 from r3 union all select chunk_id, 4 from r4)""".replace("\n", " ")


def _points(spark, sf) -> DataFrame:
    Tables(spark, sf).chunks.createOrReplaceTempView("_chunks_points")
    return quality.current(spark.sql(POINTS.replace("from chunks", "from _chunks_points")))


def _rule(n: int):
    def run(spark, sf):
        return quality.retired(_points(spark, sf)).where(F.col("rule_no") == n)

    run.__name__ = f"retire_rule{n}"
    return query(f"with {RULES_SQL} select chunk_id, rule_no from r where rule_no = {n}")(run)


for _n in (1, 2, 3, 4):
    _rule(_n)


@query(f"with {RULES_SQL} select chunk_id from p where chunk_id not in (select chunk_id from r)")
def retire_all(spark, sf):
    c = _points(spark, sf)
    return quality.retire(c, quality.retired(c)).select("chunk_id")


@query(f"with {RULES_SQL} select rule_no, count(*) as n from r group by rule_no")
def retire_dry_run(spark, sf):
    return quality.retired(_points(spark, sf)).groupBy("rule_no").agg(F.count("*").alias("n"))


@query("select source_url, count(*) as n from chunks group by source_url order by n desc, source_url limit 25")
def most_chunks(spark, sf):
    return Tables(spark, sf).chunks.groupBy("source_url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_url").limit(25)


# ---- HTML: pages are made of the corpus' text by the same expression in both engines

ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
PAGE = "'<html><head><title>' || " + ESC.format("coalesce(document_title, '')") + " || ' | Portal</title></head><body><nav><ul><li><a href=\"/\">Home</a></li></ul></nav><main><h2>' || " + ESC.format("coalesce(section_heading, '')") + " || '</h2><p>' || replace(" + ESC.format("coalesce(text, '')") + ", chr(10), '</p><ul><li>one</li><li>two</li></ul><p>') || '</p></main><footer>end</footer></body></html>'"
PAGES = "html_corpus"


def _pages(t: Tables) -> DataFrame:
    return t.html_corpus.selectExpr("chunk_id", "source_url", "date_scraped", f"{PAGE.replace('chr(10)', 'char(10)')} as html", "text", "section_heading").distinct()


@query()
def html_blocks(spark, sf):
    b = html.html_blocks(_pages(Tables(spark, sf)), "chunk_id", "html", "source_url", ("Portal",))
    return b.select("chunk_id", F.col("pos").cast("bigint").alias("pos"), "kind", "text", "level", F.array_join("items", "|").alias("list_items"))


@query("""with l as (select distinct chunk_id, date_scraped, text, section_heading from html_corpus), k as (select chunk_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, 1 as one from l) select 'heading' as kind, count(*) as n from l where trim(coalesce(section_heading, '')) <> '' union all select 'paragraph', count(*) from k where regexp_matches(line, '\\S') union all select 'list', (select sum(len(string_split(coalesce(text, ''), chr(10))) - 1)::bigint from l)""".replace("\\\\", "\\"))
def html_block_kind_counts(spark, sf):
    b = html.html_blocks(_pages(Tables(spark, sf)), "chunk_id", "html", "source_url", ("Portal",))
    return b.groupBy("kind").agg(F.count("*").alias("n"))


@query("select chunk_id, '/' as href, lower(regexp_extract(source_url, '^([A-Za-z]+):', 1)) || '://' || regexp_extract(source_url, '^[A-Za-z]+://([^/?#]+)', 1) || '/' as url, 'Home' as label from (select distinct chunk_id, source_url, date_scraped, text from html_corpus)")
def html_links(spark, sf):
    l = html.html_links(_pages(Tables(spark, sf)), "chunk_id", "html", "source_url")
    return l.select("chunk_id", "href", "url", F.col("text").alias("label"))


@query("select s_suppkey, array_to_string(list_filter(['' || s_name, 'Balance: ' || s_acctbal::varchar, 'Nation: ' || s_nationkey], lambda x: x is not null), ' — ') as line from supplier")
def labelled_field_split(spark, sf):
    c = F.concat("s_name", F.lit(" Balance: "), F.col("s_acctbal").cast("string"), F.lit(" Nation: "), F.col("s_nationkey").cast("string"), F.lit(" Email:"))
    return Tables(spark, sf).supplier.select("s_suppkey", html.labelled_fields(c, ["Balance", "Nation", "Email"]).alias("line"))


# ---- event log analogues


@query("select event_type, epoch(date_trunc('hour', ts))::bigint as hour, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_hour_windows(spark, sf):
    from .streaming.ingest import event_windows

    w = event_windows(Tables(spark, sf).events)
    return w.select("event_type", F.unix_seconds(F.col("window.start").cast("timestamp")).alias("hour"), "n", F.round("total", 4).alias("total"))


@query()
def streaming_stage_state(spark, sf):
    """The stage log read as a stream and folded; its end state is that of the batch fold."""
    from .streaming.ingest import folded, stage_state

    path = f"{sf}/stage_events.parquet"
    schema = spark.read.parquet(path).schema
    import os
    import tempfile
    import uuid

    folder, pattern = os.path.split(path)
    r = spark.readStream.schema(schema)
    s = (r.parquet(path) if os.path.isdir(path) else r.option("pathGlobFilter", pattern).parquet(folder))
    # the state goes to a table of the shared folder, update by update, and not to the driver
    at = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tarvos-")
    at = f"{at.rstrip('/')}/stage_state-{uuid.uuid4().hex}"

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{at}/v{epoch}")

    q = stage_state(s).writeStream.outputMode("update").option("checkpointLocation", f"{at}/log").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return folded(spark, at, ["url", "stage"], "last_seq")


SQL["streaming_stage_state"] = "select url, stage, arg_max(status, (seq, ts, status)) as status, max(seq) as last_seq from stage_events group by url, stage"


@query()
def run_pipeline(spark, sf):
    t = Tables(spark, sf)
    return pipeline.run_pipeline(t.documents, t.eval_items.select(F.col("id").alias("query_id"), F.col("question").alias("query")))


from . import queries_documents  # noqa: E402, F401  the second part adds to the same registry
