"""Registry, second part: manifest writes, addresses, pages, parsed blocks, HTML, corpora. Where the tables have too little of a case, rows are
made of their columns by SQL text that both engines run, so that a slip cannot hide in one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import chunking, classify, cleaning, grid, html, http, lines, manifest, quality, retrieval, urls
from .plans import pipeline
from .queries import CHUNKS, CLASS, GRID, LINES, RULES_SQL, Tables, _grid, _points, query


def made(spark, sf: str, sql: str, *tables: str) -> DataFrame:
    """Rows of a statement over the test tables, for statements in the words that both engines know."""
    for t in tables:
        getattr(Tables(spark, sf), t).createOrReplaceTempView(f"_{t}")
        sql = sql.replace(f"from {t}", f"from _{t}")
    return spark.sql(sql)


# ---- manifest

EVENTS = "select url, seq, ts, case when seq % 9 = 0 then 'cook' else stage end as stage, case when seq % 7 = 0 then 'fine' else status end as status, notes from stage_events"


@query(f"select url, stage, arg_max(status, (seq, ts, status)) as status, max(seq) as last_seq from ({EVENTS}) where url is not null and stage in ('scrape', 'download', 'parse', 'clean', 'chunk', 'embed', 'index') and status in ('pending', 'running', 'done', 'failed', 'skipped') group by url, stage")
def manifest_valid_events(spark, sf):
    return manifest.fold_events(manifest.valid_events(made(spark, sf, EVENTS, "stage_events"))).select("url", "stage", "status", "last_seq")


@query("select m.id, coalesce('f/' || d.doc_id, m.file_path) as file_path, coalesce(d.n_chars, m.file_size) as file_size, coalesce(sha256(d.text), m.file_hash) as file_hash, case when d.url is not null then 'done' else m.download_status end as download_status, case when d.url is not null then 'f/' || d.doc_id else m.download_notes end as download_notes from manifest m left join documents d on d.url = m.url")
def manifest_finalize_download(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select("url", F.col("doc_id").alias("seq"), F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("n_chars").alias("file_size"), F.sha2("text", 256).alias("file_hash"))
    return manifest.apply_updates(t.manifest, manifest.finalized(d)).select("id", "file_path", "file_size", "file_hash", "download_status", "download_notes")


@query("select x.id, (select arg_min(m.url, m.id) from manifest m where m.file_hash = x.file_hash and m.url <> x.url and m.download_status = 'done') as known_url from manifest x")
def manifest_known_by_hash(spark, sf):
    m = Tables(spark, sf).manifest
    return manifest.known_by_hash(m, m.select("id", "url", "file_hash")).select("id", "known_url")


@query("select id, url from manifest where document_type = 'notice' order by id")
def manifest_by_document_type(spark, sf):
    return manifest.by_document_type(Tables(spark, sf).manifest, "notice").select("id", "url")


@query(r"select id, url from manifest where download_status = 'done' and category like '%\_pdf%' escape '\' and file_path is not null and index_status is distinct from 'done' and url not in (select source_url from html_corpus where source_url is not null) order by id")
def manifest_pdf_work(spark, sf):
    t = Tables(spark, sf)
    return manifest.pdf_work(t.manifest, t.html_corpus.select(F.col("source_url").alias("url"))).select("id", "url")


# pages of the table have no file and few notes
FILED = "select id, url, scrape_status, category, 'f' || cast(id as string) as file_path, case when id % 5 = 0 then 'html_done' else index_notes end as index_notes from manifest"


@query(f"select id, url from ({FILED}) where scrape_status = 'done' and category in ('notice_html', 'hostel_html', 'tnp_html', 'admissions_html', 'library_html') and file_path is not null and index_notes is distinct from 'html_done' order by id")
def manifest_html_work(spark, sf):
    return manifest.html_work(made(spark, sf, FILED, "manifest"), ["notice_html", "hostel_html", "tnp_html", "admissions_html", "library_html"]).select("id", "url")


# ---- addresses

FACULTY = "select id, url, 'https://x.example/Web/' || case when id % 3 = 0 then 'departments/' when id % 3 = 1 then 'Departments/' else 'Dept/' end || coalesce(category, '') || '/Faculty/p.php' as page from manifest"


@query(f"select id, nullif(regexp_extract(page, '(?i)Departments/([^/]+)/faculty', 1), '') as department, sha256(url) as url_hash from ({FACULTY})")
def url_department_and_hash(spark, sf):
    return made(spark, sf, FACULTY, "manifest").select("id", urls.department(F.col("page")).alias("department"), urls.url_hash(F.col("url")).alias("url_hash"))


# the rules, written out for the other engine
FOUND = r"""case when regexp_matches(url, '(?i)/(login|register|admin|result|marksheet)[/.]') or regexp_matches(url, '(?i)^(mailto|javascript):') or regexp_matches(url, '(?i)[?&]session=') then 'denied'
when regexp_matches(url, '(?i)/ordinance/.*\.pdf') then 'ordinance_pdf' when regexp_matches(url, '(?i)/ordinance/') then 'ordinance_html' when regexp_matches(url, '(?i)/notice/.*\.pdf') then 'notice_pdf' when regexp_matches(url, '(?i)/notice/') then 'notice_html'
when regexp_matches(url, '(?i)/scholarship/') then 'scholarship_pdf' when regexp_matches(url, '(?i)/syllabus/') then 'syllabus_pdf' when regexp_matches(url, '(?i)/exam/') then 'exam_pdf' when regexp_matches(url, '(?i)/anti_ragging/') then 'anti_ragging_pdf'
when regexp_matches(url, '(?i)/dept/') then 'dept_pdf' when regexp_matches(url, '(?i)/hostel/') then 'hostel_html' when regexp_matches(url, '(?i)/(tnp|placement)/') then 'tnp_html' when regexp_matches(url, '(?i)/admissions?/') then 'admissions_html'
when regexp_matches(url, '(?i)/library/') then 'library_html' when regexp_matches(url, '(?i)\.php([?#].*)?$') then 'page_html' else 'unknown' end""".replace("\n", " ")
LINKS = f"(select distinct url, {FOUND} as category from crawl_records where url is not null)"
PDF = r"regexp_matches(url, '(?i)\.pdf(\?.*)?$')"


@query(f"select url, category, 'any' as how from {LINKS} where category not in ('denied', 'unknown') union all select url, category, 'pdf' from {LINKS} where category not in ('denied', 'unknown') and {PDF} union all select url, category, 'some' from {LINKS} where category not in ('denied', 'unknown') and (category in ('hostel_html', 'notice_html') or {PDF}) union all select url, category, 'drop' from {LINKS} where category not in ('denied', 'unknown') and not regexp_matches(url, '(?i)notice')")
def follow_links(spark, sf):
    l = Tables(spark, sf).crawl_records.select("url").where("url is not null").distinct()
    ways = {"any": {}, "pdf": {"pdf_only": True}, "some": {"categories": ["hostel_html", "notice_html"]}, "drop": {"drop": "(?i)notice"}}
    out = None
    for name, kw in ways.items():
        x = urls.follow(l, **kw).select("url", "category", F.lit(name).alias("how"))
        out = x if out is None else out.unionByName(x)
    return out


@query("select url, try_cast(trim(case when http_status % 2 = 0 then ' ' || content_length else etag end) as bigint) as n, count(*) as rows_ from crawl_records where url is not null group by 1, 2")
def http_content_length(spark, sf):
    c = Tables(spark, sf).crawl_records.where("url is not null")
    header = F.when(F.col("http_status") % 2 == 0, F.concat(F.lit(" "), F.col("content_length").cast("string"))).otherwise(F.col("etag"))
    return c.groupBy("url", http.content_length(header).alias("n")).agg(F.count("*").alias("rows_"))


# ---- pages

PAGES = f"(select source_url as doc_id, coalesce(chunk_index, 0) as page, chunk_id, text from {CHUNKS} where source_url is not null)"
GATED = f"(select doc_id, page, chunk_id, {CLASS} as page_class, (h is null or page = min(page) over (partition by doc_id, h)) and length(trim(text)) >= 100 and {CLASS} not in ('syllabus', 'contact', 'form', 'skip') as kept from (select doc_id, page, chunk_id, coalesce(text, '') as text, case when trim(coalesce(text, '')) <> '' then sha256(trim(text)) end as h from {PAGES}))"


def _pages(spark, sf) -> DataFrame:
    c = quality.current(Tables(spark, sf).chunks).where("source_url is not null")
    return c.select(F.col("source_url").alias("doc_id"), F.coalesce("chunk_index", F.lit(0)).alias("page"), "chunk_id", "text")


@query(f"select doc_id, chunk_id, page_class, kept from {GATED}")
def page_gates(spark, sf):
    return classify.page_gates(_pages(spark, sf)).select("doc_id", "chunk_id", "page_class", "kept")


@query(f"select doc_id, page_class, count(*) as n_pages, count(*) filter (where kept) as n_kept from {GATED} group by 1, 2")
def page_class_counts(spark, sf):
    return classify.class_counts(classify.page_gates(_pages(spark, sf)))


REPEATED = "select doc_id, page, case when page % 3 = 2 then cast(doc_id % 5 as string) || 'x' when page % 3 = 1 then '' else cast(doc_id as string) end as text from (select o_custkey as doc_id, o_orderkey as page from orders)"


@query(f"select doc_id, page, text from (select *, min(page) over (partition by doc_id, trim(text)) as f from ({REPEATED})) where trim(text) = '' or page = f")
def page_dedup(spark, sf):
    return lines.drop_repeated_pages(made(spark, sf, REPEATED, "orders"))


@query(f"select doc_id, count(*) as n_pages, sum((length(trim(coalesce(text, ''))) >= 300)::int) < 0.5 * count(*) as scanned from {PAGES} group by 1")
def scanned_documents(spark, sf):
    return lines.scanned_documents(_pages(spark, sf), least=300)


OCR = r"(length(s) <= 90 and not regexp_matches(s, '[.,;]$') and (regexp_matches(s, '^[0-9]+[.)]\s+\S') or regexp_matches(s, '^[A-Z][A-Z\s\-/]{4,}$') or (length(s) <= 60 and regexp_matches(s, '^\p{Lu}') and length(nxt) > length(s) and not regexp_matches(s, '(?i)\b(the|and|of|in|for|to|a|an|is|are|has|was)\b'))))"


@query(f"with l as (select l.doc_id, l.pos // 12 as page, l.pos, trim(l.line) as s from {LINES} l join documents d on d.doc_id = l.doc_id and d.is_ocr where trim(l.line) <> ''), n as (select *, lead(s) over (partition by doc_id, page order by pos) as nxt from l), h as (select *, coalesce({OCR}, false) as h from n), p as (select *, h::int + coalesce(lag(h::int) over (partition by doc_id, page order by pos), 0) as c from h), g as (select *, sum(c) over (partition by doc_id, page order by pos) as g from p) select doc_id, page, min(pos) as pos, case when bool_or(h) then 'heading' else 'paragraph' end as kind, string_agg(s, ' ' order by pos) as text from g group by doc_id, page, g")
def ocr_blocks(spark, sf):
    d = Tables(spark, sf).documents.where("is_ocr")
    l = lines.explode_lines(d).withColumn("page", F.floor(F.col("pos") / 12))
    return lines.ocr_blocks(l).select("doc_id", "page", F.col("pos").cast("bigint").alias("pos"), "kind", "text")


# ---- grids and blocks


@query(f"""with g as (select tab, row, col, case when col = 2 then cell || 'xx' else cell end as cell from {GRID}), s as (select tab, coalesce(min(case when row >= 1 and f * 2 > n then row end), max(row) + 1)::bigint as data_start from (select tab, row, count(nullif(trim(coalesce(cell, '')), '')) as f, count(*) as n from g group by tab, row) group by tab), f as (select tab, row, col, coalesce(last_value(nullif(trim(coalesce(cell, '')), '') ignore nulls) over (partition by tab, col order by row rows between unbounded preceding and current row), '') as v from g),
h as (select g.tab, g.col, coalesce(arg_min(nullif(trim(coalesce(cell, '')), ''), row) filter (where nullif(trim(coalesce(cell, '')), '') is not null), 'Col ' || (g.col + 1)) as h from g join s on s.tab = g.tab and g.row < s.data_start group by g.tab, g.col),
r as (select f.tab, f.row, string_agg(f.v, '|' order by f.col) as cells, count(*) filter (where lower(f.v) = lower(h.h)) as same, bool_or(regexp_matches(f.v, '[A-Za-z]{{3,}}')) as word from f join h on h.tab = f.tab and h.col = f.col join s on s.tab = f.tab and f.row >= s.data_start group by f.tab, f.row)
select r.tab, (select string_agg(h, '|' order by col) from h where h.tab = r.tab) as headers, string_agg(cells, '#' order by row) as rows_ from r where same < 2 and word group by r.tab""".replace("\n", " "))
def table_to_block(spark, sf):
    """Grids whose third column is written with two letters more, so that rows hold a word."""
    g = _grid(Tables(spark, sf)).withColumn("cell", F.when(F.col("col") == 2, F.concat("cell", F.lit("xx"))).otherwise(F.col("cell")))
    b = grid.to_block(g)
    return b.select("tab", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "#").alias("rows_"))


# parsed documents: each chunk gives a heading and a block; a table's lines are its rows, each second paragraph comes as a list
BLOCKS = """select source_url as doc_id, 2 * rn as pos, 'heading' as kind, coalesce(section_heading, 'Part ' || cast(rn % 3 as string)) as text, 1 + cast(rn % 3 as int) as level, cast(null as string) as body, page_number as page from (select *, row_number() over (partition by source_url order by coalesce(chunk_index, 0), chunk_id) as rn from CURRENT) where rn % 4 <> 1
union all select source_url, 2 * rn + 1, case when block_type = 'table' then 'table' when rn % 2 = 0 then 'list' else 'paragraph' end, cast(null as string), cast(null as int), coalesce(text, ''), page_number from (select *, row_number() over (partition by source_url order by coalesce(chunk_index, 0), chunk_id) as rn from CURRENT)""".replace("\n", " ")
DUCK_BLOCKS = BLOCKS.replace("CURRENT", CHUNKS)
HEAD = "max(case when kind = 'heading' and level = {k} then pos end) over w as p{k}, arg_max(text, pos) filter (where kind = 'heading' and level = {k}) over w as t{k}"
TOK = "length({0}) // 4"
_ST = r"regexp_replace(regexp_replace(b, '(?i)\b(i)\.(e)\.|\b(e)\.(g)\.', '\1\3~~\2\4~~', 'g'), '(?i)\b(Ph|M|B|Dr|Mr|Mrs|Ms|Prof|Sr|Jr|St|No|Sec|Reg|Vol|vs|etc|approx|dept|univ|govt|viz)\.', '\1~~', 'g')"
_SENT = rf"list_filter(list_transform(string_split(regexp_replace({_ST}, '\.\s+', '.' || chr(1), 'g'), chr(1)), lambda s: trim(replace(s, '~~', '.'))), lambda s: s <> '')"
_TAIL = "right(grp[i - 1], 480)"
_START = rf"regexp_extract({_TAIL}, '(?s)\.\s([A-Z(].*)$', 1)"
_LEAD = f"trim(case when length(grp[i - 1]) // 4 <= 100 then grp[i - 1] when {_START} <> '' then {_START} else {_TAIL} end)"
BLOCK_CHUNKS = f"""with recursive bl as materialized ({DUCK_BLOCKS}), h as (select b.*, {', '.join(HEAD.format(k=k) for k in (1, 2, 3))}, max(case when kind = 'heading' then pos end) over w as hp, arg_max(text, pos) filter (where kind = 'heading') over w as ht, sum((kind = 'heading')::int) over w as section, t.title from bl b join (select source_url as u, max(document_title) as title from {CHUNKS} group by 1) t on t.u = b.doc_id window w as (partition by doc_id order by pos rows between unbounded preceding and current row)),
c as (select doc_id, pos, kind, body, section, coalesce(ht, nullif(title, ''), 'Preamble') as heading, list_filter([nullif(title, ''), t1, case when coalesce(p2, -1) > coalesce(p1, -1) then t2 end, case when coalesce(p3, -1) > greatest(coalesce(p1, -1), coalesce(p2, -1)) then t3 end, case when ht is null then coalesce(nullif(title, ''), 'Preamble') end], lambda x: x is not null) as f from h where kind <> 'heading'),
d as (select doc_id, pos, kind, body, section, heading, array_to_string(list_filter(f, lambda x, i: i = 1 or x <> f[i - 1]), ' > ') as crumb, (kind = 'table' or coalesce(lag(kind = 'table') over (partition by doc_id, section order by pos), false))::int as cut from c),
e as (select *, sum(cut) over (partition by doc_id, section order by pos) as seg from d),
g as (select doc_id, section, seg, max(heading) as heading, max(crumb) as crumb, bool_or(kind = 'table') as tab, regexp_replace(string_agg(case when kind = 'list' then array_to_string(list_transform(string_split(body, chr(10)), lambda x, i: '- ' || x), chr(10)) else body end, chr(10) order by pos), '^\\s+|\\s+$', '', 'g') as blob, any_value(body) as body from e group by 1, 2, 3),
k as (select *, case when not tab and trim(heading) <> '' and starts_with(blob, trim(heading)) then regexp_replace(substring(blob, length(trim(heading)) + 1), '^[ :\\-\\n]+', '') else blob end as b, 512 - length(crumb) // 4 - 2 as room from g),
u as (select *, case when tab then list_filter(list_transform(string_split(body, chr(10)), lambda l: array_to_string(list_filter(list_transform(string_split(l, ', '), lambda x: trim(x)), lambda x: regexp_matches(x, '[A-Za-z0-9]')), ', ')), lambda l: l <> '') else {_SENT} end as s from k),
p(doc_id, section, seg, s, i, grp, n) as (select doc_id, section, seg, s, 1, [s[1]], (case when tab then length(crumb) // 4 + 2 else 0 end) + length(s[1]) // 4 + 1 from u where len(s) > 0 union all select p.doc_id, p.section, p.seg, p.s, i + 1,
case when n + length(p.s[i + 1]) // 4 + 1 > (case when u.tab then 512 else u.room end) then list_append(grp, p.s[i + 1]) else list_append(grp[:len(grp) - 1], grp[len(grp)] || (case when u.tab then chr(10) else ' ' end) || p.s[i + 1]) end,
case when n + length(p.s[i + 1]) // 4 + 1 > (case when u.tab then 512 else u.room end) then (case when u.tab then length(u.crumb) // 4 + 2 + 1 else 0 end) + length(p.s[i + 1]) // 4 else n + length(p.s[i + 1]) // 4 + 1 end from p join u on u.doc_id = p.doc_id and u.section = p.section and u.seg = p.seg where i < len(p.s)),
o as (select doc_id, section, seg, grp as raw, list_transform(grp, lambda g, i: case when i = 1 or {_LEAD} = '' then g else {_LEAD} || ' ' || g end) as grp from p where i = len(s)),
m(doc_id, section, seg, s, i, grp) as (select doc_id, section, seg, grp, 1, [grp[1]] from o union all select doc_id, section, seg, s, i + 1, case when length(s[i + 1]) // 4 < 100 then list_append(grp[:len(grp) - 1], grp[len(grp)] || ' ' || s[i + 1]) else list_append(grp, s[i + 1]) end from m where i < len(s)),
q as (select u.doc_id, u.section, u.seg, u.crumb, u.heading, u.tab, case when u.tab then o.raw when length(u.b) // 4 <= u.room then list_filter([u.b], lambda x: x <> '' and length(x) // 4 >= 15) else list_filter(m.grp, lambda x: length(x) // 4 >= 15) end as pieces from u join o on o.doc_id = u.doc_id and o.section = u.section and o.seg = u.seg join m on m.doc_id = u.doc_id and m.section = u.section and m.seg = u.seg and m.i = len(m.s)),
r as (select doc_id, section, seg, crumb, heading, tab, unnest(pieces) as piece, generate_subscripts(pieces, 1) as j from q),
z as (select *, row_number() over (partition by doc_id order by section, seg, j) - 1 as idx, crumb || chr(10) || chr(10) || piece as full_text from r)
select 'c_' || substring(sha256(doc_id || '::' || idx), 1, 14) as chunk_id, doc_id, idx as chunk_index, heading as section_heading, crumb as breadcrumb, case when tab then 'table' else 'prose' end as block_type, (length(full_text) // 4)::bigint as token_count, sha256(full_text) as text_hash from z qualify row_number() over (partition by doc_id, full_text order by idx) = 1""".replace("\n", " ")


def block_table(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(blocks, documents) made of the chunk table."""
    c = quality.current(Tables(spark, sf).chunks)
    c.createOrReplaceTempView("_chunks_current")
    b = spark.sql(BLOCKS.replace("CURRENT", "_chunks_current"))
    split_lines = F.split("body", "\n")
    none = F.lit(None)
    b = b.select(
        "doc_id", "pos", "kind", F.when(F.col("kind") == "paragraph", F.col("body")).otherwise(F.col("text")).alias("text"), "level", F.when(F.col("kind") == "list", split_lines).alias("items"), F.lit(False).alias("ordered"),
        F.when(F.col("kind") == "table", F.transform(split_lines, lambda l: F.split(l, ", "))).alias("rows"), none.cast("array<string>").alias("headers"), none.cast("string").alias("caption"), "page",
    )
    docs = c.groupBy(F.col("source_url").alias("doc_id")).agg(F.max("document_title").alias("title"), F.max("document_type").alias("document_type"), F.max("date_published").alias("date_published"), F.max("date_scraped").alias("date_scraped"), F.max("source_format").alias("source_format")).withColumn("url", F.col("doc_id"))
    return b, docs


@query(BLOCK_CHUNKS)
def chunk_blocks(spark, sf):
    c = chunking.chunk_blocks(*block_table(spark, sf))
    return c.select("chunk_id", "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "section_heading", "breadcrumb", "block_type", "token_count", F.sha2("text", 256).alias("text_hash"))


# blocks of plain letters, for which the normal form is the text itself
PLAIN = """select o_custkey as doc_id, o_orderkey as pos, case when o_orderkey % 5 = 0 then 'heading' when o_orderkey % 5 = 1 then 'list' when o_orderkey % 5 = 2 then 'table' else 'paragraph' end as kind,
case when o_orderkey % 11 = 0 then 'Home > ' || o_orderpriority || ' > ' || o_orderstatus when o_orderkey % 5 = 4 and o_orderkey % 2 = 0 then '  short  ' else ' Order  of priority ' || o_orderpriority || case when o_orderkey % 3 = 0 then '  with STATUS ' else ' with status ' end || o_orderstatus || ' ' end as txt from orders""".replace("\n", " ")
_T = r"trim(regexp_replace(txt, '\s+', ' ', 'g'))"


@query(rf"with n as (select doc_id, pos, kind, {_T} as t from ({PLAIN})), k as (select *, case kind when 'heading' then 'h:' || lower(t) when 'paragraph' then 'p:' || lower(t) when 'list' then 'l:' || lower(t) || ' | x' end as fp from n where case kind when 'paragraph' then length(t) >= 20 and not regexp_matches(t, '^[\p{{L}}\p{{N}}_\s.&''\-()]+([>|/»·][\p{{L}}\p{{N}}_\s.&''\-()]+){{2,}}$') when 'list' then length(t) >= 20 when 'heading' then length(t) >= 2 else true end) select doc_id, pos, kind, case when kind in ('heading', 'paragraph') then t else '' end as text, case when kind = 'list' then t || '|x' end as items from k where fp is null or pos in (select min(pos) from k k2 where k2.doc_id = k.doc_id and k2.fp = k.fp)")
def clean_blocks(spark, sf):
    """The pass over headings, paragraphs, lists of two items and tables of one row."""
    p = made(spark, sf, PLAIN, "orders")
    none = F.lit(None)
    flow = F.col("kind").isin("heading", "paragraph")
    b = p.select(
        "doc_id", "pos", "kind", F.when(flow, F.col("txt")).alias("text"), F.when(F.col("kind") == "heading", 1).alias("level"), F.when(F.col("kind") == "list", F.array("txt", F.lit(" "), F.lit("x"))).alias("items"), none.cast("boolean").alias("ordered"),
        F.when(F.col("kind") == "table", F.array(F.array("txt", F.lit("")), F.array(F.lit(""), F.lit(" ")))).alias("rows"), none.cast("array<string>").alias("headers"), none.cast("string").alias("caption"), none.cast("int").alias("page"),
    )
    return cleaning.clean_blocks(b).select("doc_id", "pos", "kind", "text", F.array_join("items", "|").alias("items"))


MD = "select id, '# ' || category || chr(10) || case when answerable then 'Source: https://s.example/' || id || chr(10) else '' end || 'About it' || chr(10) || '## Question' || chr(10) || coalesce(question, '') || chr(10) || '## Passage' || chr(10) || 'Batch-year: ' || cast(2015 + length(id) % 9 as string) || chr(10) || coalesce(passage, '') as md from eval_items"


@query(rf"with p as (select id, md, string_split(md, chr(10) || '## ') as parts from ({MD})), s as (select id, split_part(parts[1], chr(10), 1)[3:] as title, trim(parts[1]) as pre, unnest(parts[2:]) as s, generate_subscripts(parts[2:], 1) - 1 as i from p), b as (select id, title, i, trim(split_part(s, chr(10), 1)) as heading, '## ' || regexp_replace(s, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || pre as body from s) select sha256('curated::' || id || '::' || i) as chunk_id, title || ' > ' || heading || chr(10) || chr(10) || body as text, coalesce(nullif(regexp_extract(body, '(?m)^Source:\s*(\S+)', 1), ''), 'https://d.example/') as source_url, heading as section_heading, coalesce(nullif(regexp_extract(body, '(?m)^Batch-year:\s*(\d{{4}})', 1), ''), '0')::int as batch_year from b")
def curated_records(spark, sf):
    f = made(spark, sf, MD.replace("chr(10)", "char(10)"), "eval_items").withColumnRenamed("id", "name")
    return chunking.curated_records(f, default_url="https://d.example/").select("chunk_id", "text", "source_url", "section_heading", "batch_year")


# ---- HTML

ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
TABLED = "select distinct chunk_id, source_url, text, document_title, '<html><head><title>' || " + ESC.format("coalesce(document_title, '')") + " || ' | Portal</title></head><body><nav><ul><li><a href=\"/\">Home</a></li></ul></nav><div style=\"display: none\">spam<ul><li>x</li></ul></div><ul><li><a href=\"/a\">About us</a></li><li><a href=\"/b\">Rooms and halls of residence</a></li><li><a href=\"/c\">Login</a></li></ul><table><caption>Lines</caption><thead><tr><th>Key</th><th>Value</th></tr></thead><tbody><tr><td></td><td> </td></tr><tr><td>first</td><td>' || replace(" + ESC.format("coalesce(text, '')") + ", chr(10), '</td></tr><tr><td>next</td><td>') || '</td></tr></tbody></table></body></html>' as html from html_corpus"
SQUASH = r"trim(regexp_replace({0}, '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{0085}}\x{{1680}}\x{{1c}}-\x{{1f}}]+', ' ', 'g'))"


def _tabled(spark, sf) -> DataFrame:
    return made(spark, sf, TABLED.replace("chr(10)", "char(10)"), "html_corpus")


@query("select chunk_id, source_url, text, 3 as n_lists, 3 as n_menus from (select distinct chunk_id, source_url, text, document_title from html_corpus)")
def html_nav_dropped(spark, sf):
    """All three lists of a page go: one in the navigation, one hidden, one of links with a menu's label."""
    p = _tabled(spark, sf)
    m = html.menus(p.withColumn("k", F.struct("chunk_id", "source_url", "text")), "k", "html")
    return m.select("k.chunk_id", "k.source_url", "k.text", "n_lists", "n_menus")


T1 = SQUASH.format("coalesce(document_title, '')")


@query(rf"with t as (select chunk_id, source_url, text, trim({T1}, ' |»-–—') as t from (select distinct chunk_id, source_url, text, document_title from html_corpus)) select chunk_id, text, coalesce(nullif(case when contains(t, '|') then trim(substring(t, instr(t, '|') + 1), ' |»-–—') else t end, ''), source_url, '') as title from t")
def html_title(spark, sf):
    p = _tabled(spark, sf).withColumn("k", F.struct("chunk_id", "text"))
    return html.html_titles(p, "k", "html", "source_url", ("Portal",)).select("k.chunk_id", "k.text", "title")


@query(rf"with l as (select chunk_id, source_url, text, string_split(coalesce(text, ''), chr(10)) as ls from (select distinct chunk_id, source_url, text, document_title from html_corpus)) select chunk_id, text, len(ls) as n_rows, 'Key|Value' as headers, 'Lines' as caption, array_to_string(list_transform(ls, lambda x, i: (case when i = 1 then 'first' else 'next' end) || '=' || {SQUASH.format('x')}), '#') as cells from l")
def html_tables(spark, sf):
    p = _tabled(spark, sf).withColumn("k", F.struct("chunk_id", "text"))
    b = html.html_blocks(p, "k", "html", "source_url", ("Portal",)).where("kind = 'table'")
    return b.select("k.chunk_id", "k.text", F.size("rows").cast("bigint").alias("n_rows"), F.array_join("headers", "|").alias("headers"), "caption", F.array_join(F.transform("rows", lambda r: F.concat(r[0], F.lit("="), r[1])), "#").alias("cells"))


STAFF = "select s_nationkey, s_suppkey, '<tr><td>' || case when s_suppkey % 4 = 0 then 'Associate Professor' else s_name || '</td><td>Designation: Lecturer ' || case when s_suppkey % 3 = 0 then 'Email:' else 'Email: s' || cast(s_suppkey as string) || '[at]x[dot]example' end || ' Specialization: Maths' end || '</td></tr>' as r, case when s_suppkey % 4 = 0 then 'Associate Professor' else s_name || ' — Designation: Lecturer — ' || case when s_suppkey % 3 = 0 then '' else 'Email: s' || cast(s_suppkey as string) || '@x.example — ' end || 'Specialization: Maths — Department: D' || cast(s_nationkey as string) end as said from supplier"


@query(f"select s_nationkey as page, row_number() over (partition by s_nationkey order by s_suppkey) as pos, said as text from ({STAFF}) where s_nationkey in (select s_nationkey from supplier where s_suppkey % 4 <> 0)")
def faculty_records(spark, sf):
    s = made(spark, sf, STAFF, "supplier")
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "r"))), lambda x: x["r"]), "")
    p = s.groupBy(F.col("s_nationkey").alias("page")).agg(F.concat(F.lit("<table><tr><td>menu<table>"), rows, F.lit("</table></td></tr></table>")).alias("html")).withColumn("dept", F.concat(F.lit("D"), F.col("page").cast("string")))
    b = html.faculty_blocks(p, "page", "html", "dept").where("pos > 0")
    return b.select("page", F.col("pos").cast("bigint").alias("pos"), "text")


# ---- corpora, retrieval, samples


CORPUS = f"(select document_type as category, 0 as part, chunk_id, text, token_count from {CHUNKS} union all select document_type, 1, chunk_id, text, token_count from (select * from html_corpus qualify row_number() over (partition by chunk_id order by date_scraped desc nulls last, text desc) = 1))"


@query(f"with c as (select *, row_number() over (partition by sha256(text) order by part, chunk_id) as rn from {CORPUS} where text is not null) select category, count(*) filter (where rn = 1) as n, floor(sum(token_count) filter (where rn = 1) / count(token_count) filter (where rn = 1))::bigint as mean_tokens, max(token_count) filter (where rn = 1) as most_tokens, count(*) filter (where rn > 1) as repeats from c group by category")
def corpus_build(spark, sf):
    t = Tables(spark, sf)
    parts = [quality.current(x).select(F.col("document_type").alias("category"), "chunk_id", "text", "token_count") for x in (t.chunks, t.html_corpus)]
    return pipeline.corpus_statistics(pipeline.build_corpus(parts))


@query("with v as (select q.vec_id - q.vec_id % 40 as query_id, p.vec_id as point_id, round(list_cosine_similarity(q.embedding::double[], p.embedding::double[]), 4) as score from embeddings q, embeddings p where q.vec_id % 20 = 0 and (p.label = q.label or p.label = 0)), m as (select query_id, point_id, max(score) as score from v group by 1, 2) select query_id, 'c' || point_id as chunk_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, point_id) as rank from m) where rank <= 5")
def retrieve_hits(spark, sf):
    """Two wordings per query over points of its label or 0, best score per point, five best points with their chunks."""
    e = Tables(spark, sf).embeddings
    v = e.where("vec_id % 20 = 0").select((F.col("vec_id") - F.col("vec_id") % 40).alias("query_id"), (F.col("vec_id") % 40).alias("variant_no"), "embedding", "label")
    p = e.select(F.col("vec_id").alias("point_id"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"), "embedding", "label")
    c = p.select("chunk_id", F.lit("u").alias("source_url"), F.lit("s").alias("section_heading"), F.lit("prose").alias("block_type"), F.lit("t").alias("text"), F.lit(0).alias("page_number"), F.lit(0).alias("chunk_index"), F.lit(1).alias("token_count"))
    hits, _ = retrieval.retrieve(v, p, c, label="label")
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"with {RULES_SQL} select distinct r.rule_no, p.section_heading from r join p using (chunk_id) order by rule_no, section_heading nulls last limit 8")
def retire_samples(spark, sf):
    c = _points(spark, sf)
    return quality.retired(c).join(c.select("chunk_id", "section_heading"), "chunk_id").select("rule_no", "section_heading").distinct().orderBy("rule_no", F.asc_nulls_last("section_heading")).limit(8)


@query("select chunk_id from (select distinct chunk_id from chunks) order by md5('7' || chunk_id), chunk_id limit 5")
def seeded_sample(spark, sf):
    c = Tables(spark, sf).chunks.select("chunk_id").distinct()
    return c.orderBy(F.md5(F.concat(F.lit("7"), "chunk_id")), "chunk_id").limit(5)


@query(r"with l as (select chunk_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from (select distinct chunk_id, text from html_corpus) where text is not null), f as (select *, case when length(line) - length(replace(line, '|', '')) >= 2 then 'pipe' when regexp_matches(line, '\S+\s{3,}\S+') then 'aligned' end as kind from (select distinct chunk_id, pos, line from l)), g as (select *, pos - row_number() over (partition by chunk_id, kind order by pos) as grp from f where kind is not null), r as (select chunk_id, kind, min(pos) as first_pos, count(*) as n_lines from g group by chunk_id, kind, grp) select chunk_id, kind, first_pos, n_lines from r where kind = 'pipe' or n_lines >= 3")
def text_tables(spark, sf):
    p = Tables(spark, sf).html_corpus.select("chunk_id", "text").distinct()
    l = lines.explode_lines(p, "chunk_id").select("chunk_id", F.col("pos").cast("bigint").alias("pos"), "line").distinct()
    return lines.text_tables(l, "chunk_id")


DOCTYPE = "case category when 'ordinance_pdf' then 'ordinance' when 'notice_pdf' then 'notice' when 'hostel_html' then 'hostel' else 'unknown' end"
READER = "case when regexp_matches(url, '(?i)\\.pdf(\\?.*)?$') then 'register' else case category when 'ordinance_html' then 'pdf_index' when 'scholarship_pdf' then 'pdf_index' when 'notice_html' then 'notice_index' when 'dept_pdf' then 'department' when 'hostel_html' then 'hostel' when 'tnp_html' then 'placement' when 'admissions_html' then 'admissions' when 'exam_pdf' then 'exam_portal' else 'generic' end end"


@query(f"select url, category, {DOCTYPE} as doc_type, http_status, case when not regexp_matches(url, '(?i)\\.pdf(\\?.*)?$') then sha256(url) || '.html' end as html_body_path, {READER} as reader, count(*) as n from (select url, http_status, {FOUND} as category from crawl_records where url is not null) group by all")
def crawl_records(spark, sf):
    c = Tables(spark, sf).crawl_records.where("url is not null").select("url", "http_status")
    r = urls.crawl_record(c, {"ordinance_pdf": "ordinance", "notice_pdf": "notice", "hostel_html": "hostel"})
    return r.groupBy(*r.columns).agg(F.count("*").alias("n"))


@query("select log, count(*) as n from (select '{\"level\":\"' || case when http_status is null then 'error' when http_status in (429, 500, 502, 503, 504) then 'warning' when http_status >= 400 then 'error' when http_status >= 300 then 'warning' else 'info' end || '\",\"message\":\"fetched\"' || coalesce(',\"status\":' || http_status, '') || '}' as log from crawl_records) group by log")
def http_log_lines(spark, sf):
    c = Tables(spark, sf).crawl_records
    level = http.log_level(http.outcome(F.col("http_status"), F.lit("text/html"), F.lit(9999)))
    return c.groupBy(http.log_line(level, F.lit("fetched"), status=F.col("http_status")).alias("log")).agg(F.count("*").alias("n"))


@query("select doc, round_even(top / 2, 0) * 2 as line_top, count(*) as n from (select o_custkey as doc, (o_orderkey % 97)::double as top, o_orderkey % 50 - 5 as x, case when o_orderkey % 7 = 0 then null else o_orderkey % 3 <> 0 end as upright from orders) where x between 0 and 40 and top between 0 and 90 and coalesce(upright, true) group by 1, 2")
def pdf_visible_glyphs(spark, sf):
    g = Tables(spark, sf).orders.select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 97).cast("double").alias("top"), (F.col("o_orderkey") % 50 - 5).alias("x"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 3 != 0).alias("upright"), F.lit(40).alias("page_width"), F.lit(90).alias("page_height"))
    return classify.visible_glyphs(g).groupBy("doc", (F.bround(F.col("top") / 2) * 2).alias("line_top")).agg(F.count("*").alias("n"))


@query("with h as (select distinct e.id, r.name from eval_items e join (values ('fees', 'fee|fine'), ('hostel', 'hostel|hall|room')) r(name, pattern) on regexp_matches(lower(e.question), r.pattern)) select e.id as query_id, concat_ws(chr(10) || chr(10), (select string_agg('about ' || h.name, chr(10) || chr(10) order by h.name) from h where h.id = e.id), 'context of ' || e.id) as context from eval_items e")
def curated_routing(spark, sf):
    e = Tables(spark, sf).eval_items
    rules = spark.createDataFrame([("fees", "fee|fine"), ("hostel", "hostel|hall|room")], "name string, pattern string")
    texts = rules.select("name", F.concat(F.lit("about "), "name").alias("text"))
    return retrieval.curated_routing(e.select(F.col("id").alias("query_id"), F.col("question").alias("query")), rules, texts, e.select(F.col("id").alias("query_id"), F.concat(F.lit("context of "), "id").alias("context")))
