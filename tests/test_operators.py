"""Behaviour of single operators on small cases."""

import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarvos.functions import text as tx
from tarvos.operators import chunking, grid, html, http, lines, manifest, quality, retrieval, urls
from tarvos.sources import io


def test_insert_or_ignore_first_writer_wins(spark):
    old = spark.createDataFrame([("a",)], "url string")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "url string, n int")
    assert [tuple(r) for r in manifest.insert_or_ignore(old, new, "url", [F.col("n")]).collect()] == [("b", 2)]


def test_fold_takes_the_last_sequence_not_the_last_time(spark):
    e = spark.sql("select * from values ('u','parse','done',2,timestamp'2024-01-01','x'), ('u','parse','running',1,timestamp'2024-02-01',null), ('u','parse','failed',3,timestamp'2023-01-01','') as t(url,stage,status,seq,ts,notes)")
    r = manifest.fold_events(e).first()
    assert (r.status, r.notes, r.n_events) == ("failed", "x", 3)


def _manifest(spark, rows):
    st_ = ", ".join(f"{s}_status string" for s in manifest.STAGES)
    return spark.createDataFrame([(i, f"u{i}", h, None, *([status] * 7)) for i, h, status in rows], f"id bigint, url string, file_hash string, scrape_notes string, {st_}")


def test_duplicate_cascade_from_pending_and_running(spark):
    m = manifest.mark_hash_duplicates(_manifest(spark, [(1, "h", "done"), (2, "h", "pending"), (3, "h", "running"), (4, None, "pending"), (5, None, "pending")]))
    r = {x.id: x for x in m.collect()}
    assert r[1].duplicate_of is None and r[2].duplicate_of == "u1" and r[4].duplicate_of is None
    assert r[2].parse_status == "skipped" and r[3].index_status == "skipped" and r[3].scrape_notes == "duplicate_of:u1"


def test_recover_is_idempotent(spark):
    m = _manifest(spark, [(1, "a", "running"), (2, "b", "done")])
    once = manifest.recover(m)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, manifest.recover(once).collect()), key=str)
    assert {r.id: r.parse_status for r in once.collect()} == {1: "pending", 2: "done"}


def test_url_rules_deny_first_then_order(spark):
    d = spark.createDataFrame([("https://x.example/notice/2020/a.pdf",), ("https://x.example/notice/",), ("https://x.example/login/notice/a.pdf",), ("https://x.example/zzz",), (None,)], "u string")
    got = [r[0] for r in d.select(urls.classify(F.col("u"))).collect()]
    assert got == ["notice_pdf", "notice_html", "denied", "unknown", "unknown"]
    rules = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(urls.ALLOW)], "rule_no int, category string, pattern string")
    j = {r.u: r.category_found for r in urls.rule_join(d.where("u is not null"), "u", rules).collect()}
    assert j["https://x.example/notice/2020/a.pdf"] == "notice_pdf"


def test_http_outcomes(spark):
    d = spark.createDataFrame([(200, "application/pdf; x=1", 9000), (503, None, None), (404, None, None), (200, "image/png", 9000), (200, "text/html", 3), (None, None, None)], "s int, c string, n bigint")
    assert [r[0] for r in d.select(http.outcome(F.col("s"), F.col("c"), F.col("n"))).collect()] == ["ok", "retry", "fatal", "wrong_type", "too_small", "fatal"]


def test_point_id_is_uuid5(spark):
    ids = ["c_1", "c_äöü", "x" * 200]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(tx.point_id(F.col("i"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, i)) for i in ids]


def pack_by_hand(units, budget):
    tok = lambda s: len(s) // 4
    out, cur, n = [], [], 0
    for s in units:
        if cur and n + tok(s) + 1 > budget:
            out.append(" ".join(cur))
            cur, n = [s], tok(s)
        else:
            cur.append(s)
            n += tok(s) + 1
    return out + ([" ".join(cur)] if cur else [])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abc ", min_size=1, max_size=60), max_size=12), st.integers(1, 40))
def test_packing_matches_the_loop(spark, units, budget):
    d = spark.createDataFrame([(units,)], "u array<string>")
    assert d.select(chunking.pack(F.col("u"), budget)).first()[0] == pack_by_hand(units, budget)


def test_merge_tail_and_overlap(spark):
    d = spark.createDataFrame([(["a" * 400, "b" * 8, "c" * 400],)], "u array<string>")
    assert d.select(chunking.merge_tail(F.col("u"))).first()[0] == ["a" * 400 + "\n" + "b" * 8, "c" * 400]
    assert d.select(chunking.with_overlap(F.col("u"), 1, 1)).first()[0][2] == "b" * 4 + " " + "c" * 400
    before = "x" * 300 + ". the last words here. The rule (a) stands. It ends"
    got = spark.createDataFrame([([before, "next"],)], "u array<string>").select(chunking.with_overlap(F.col("u"), 5, 20)).first()[0]
    assert got == [before, "The rule (a) stands. It ends next"]


def test_chunk_documents_edges(spark):
    d = spark.createDataFrame([(1, "u1", None, None, "One two three four five. " * 200), (2, "u2", "t", "2019", ""), (3, "u3", "t", "2019", None)], "doc_id bigint, url string, title string, date_published string, text string")
    c = chunking.chunk_documents(d).collect()
    assert {r.doc_id for r in c} == {1} and len({r.chunk_id for r in c}) == len(c)
    assert all(r.token_count <= 512 + 128 for r in c)


def stack_breadcrumbs(heads):
    out, stack = [], []
    for level, text in heads:
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, text))
        chain = []
        for _, t in stack:
            if not chain or chain[-1] != t:
                chain.append(t)
        out.append(" > ".join(chain))
    return out


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.sampled_from("abcd")), min_size=1, max_size=15))
def test_breadcrumbs_match_the_stack(spark, heads):
    d = spark.createDataFrame([(1, i, l, t) for i, (l, t) in enumerate(heads)], "doc_id int, pos int, level int, text string")
    got = [r.breadcrumb for r in lines.breadcrumbs(d, levels=4).orderBy("pos").collect()]
    assert got == stack_breadcrumbs(heads)


def test_linearize(spark):
    d = spark.createDataFrame([(["h1", "-", "h3"], ["a", "b", "--", "d"])], "h array<string>, c array<string>")
    assert d.select(grid.linearize(F.col("h"), F.col("c"), F.lit("Cap"))).first()[0] == "Cap: h1: a, b"


def test_html_blocks_of_broken_page():
    page = "<html><head><title>T | Site</title></head><body><nav><a>x</a></nav><h1>Head</h1><p>one<b> two</b><p>three<br>four<ul><li>item a long one<li>item b</ul><table><tr><th>N<th>V<tr><td>a<td>1</table><div style='display:none'>spam</div><ol><li>1. x y z</li><li>2. k</li></ol><ul><li><a href=1>Home</a><li><a href=2>About</a><li><a href=3>News</a></ul></body>"
    b = html.blocks_of(page, "u")
    assert [(x["kind"], x.get("text") or x.get("items") or x.get("rows")) for x in b] == [
        ("heading", "Head"), ("paragraph", "one two three four"), ("list", ["item a long one", "item b"]), ("table", [["a", "1"]]), ("list", ["x y z", "k"])]
    assert html.blocks_of("<p>only text", "u1")[0] == {"kind": "heading", "text": "u1", "level": 1}
    assert html.blocks_of(None) == [] and html.blocks_of("") == []


def test_links_resolve_and_carry_the_row_label():
    got = html.links_of("<table><tr><td>3 May<td><a href='../a.pdf'>doc</a></table><a href='//h.example/x'>y</a>", "https://s.example/n/i.php")
    assert [(x["url"], x["date_label"]) for x in got] == [("https://s.example/a.pdf", "3 May"), ("https://h.example/x", None)]


def test_vector_search_edges(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [0.0, 2.0])], "point_id bigint, embedding array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id bigint, embedding array<double>")
    assert [(r.point_id, r.score) for r in retrieval.cosine_top_k(q, p, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (5, 0.0)]
    assert retrieval.cosine_top_k(q.limit(0), p).count() == 0


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, v int, x string")
    c = spark.createDataFrame([(2, 2, "c"), (3, 1, "d"), (1, 0, "old")], "id int, v int, x string")
    once = io.upsert(t, c, ["id"], "v")
    assert sorted(map(tuple, once.collect())) == [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]
    assert sorted(map(tuple, io.upsert(once, c, ["id"], "v").collect())) == sorted(map(tuple, once.collect()))


def test_crawl_log_source(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"url": "https://a.example", "http_status": 200}\n\n{bad\n{"http_status": 404}\n')
    r = manifest.import_quality(io.read_crawl_log(spark, str(tmp_path)).cache()).first()
    assert (r.n_rows, r.malformed, r.without_url, r.addresses) == (3, 1, 1, 1)


def test_stream_upsert(spark, tmp_path):
    from tarvos.streaming import ingest

    src, dst = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.json").write_text('{"url": "u", "http_status": 200, "content_length": 1}\n{"url": "u", "http_status": 404, "content_length": 2}\n')
    for _ in range(2):
        ingest.upsert_stream(ingest.crawl_stream(spark, str(src)).select("url", "http_status", "content_length"), str(dst), ["url"], "content_length", str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{dst}/v0").collect()] == [("u", 404, 2)]


def test_retire_rules_are_disjoint_from_what_stays(spark):
    c = spark.createDataFrame([(f"c{i}", "s", "Rules", i, 2019 + i % 2) for i in range(20)], "chunk_id string, source_url string, section_heading string, chunk_index int, batch_year int")
    old, flood = quality.newest_year_only(c, "section_heading", "batch_year"), quality.floods(c)
    left = {r.chunk_id for r in quality.retire(c, old, flood).collect()}
    gone = {r.chunk_id for r in old.collect()} | {r.chunk_id for r in flood.collect()}
    assert left.isdisjoint(gone) and len(left | gone) == 20 and flood.count() == 17


def test_page_rules_and_document_vote(spark):
    from tarvos.operators import classify

    cases = {
        "1. CS-101 Title L T P Credit Hours 4": "syllabus", "nothing here": "skip", None: "skip", "The warden of the hostel": "policy", "Transcript fee Rs. 500; Signature of student, Roll Number : 1": "policy",
        "FORM OF APPLICATION\nSignature of student": "form", "PROFESSOR PROFESSOR ASSISTANT PROFESSOR ASSISTANT PROFESSOR Designation": "contact", "Circular No 5. All Students": "notice",
        "Average CTC of campus recruits 2019": "placement", "JEE Main counselling, seat matrix": "admissions", "Join the NCC": "policy", "Rules for rechecking\n1. Apply\n2. Pay": "policy", "unfair means and CGPA": "policy", "CGPA": "skip",
    }
    d = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in d.select(classify.classify_page(F.col("t"))).collect()] == list(cases.values())
    p = spark.createDataFrame([("a", 0, "policy"), ("a", 1, "notice"), ("b", 0, "form"), ("b", 1, "notice"), ("c", 0, "skip"), ("d", 0, "syllabus"), ("d", 1, "form"), ("d", 2, "form"), ("d", 3, "skip")], "doc string, page int, label string")
    got = {r.doc: r.document_class for r in classify.document_vote(p, "doc", "page", "label").collect()}
    assert got == {"a": "policy", "b": "form", "c": "skip", "d": "syllabus"}


def test_sentences_keep_abbreviations_whole_words_only(spark):
    cases = {
        "Read the whole text. The board meets next. It ends at the app. Done.": ["Read the whole text.", "The board meets next.", "It ends at the app.", "Done."],
        "Dr. A and PROF. B met, i.e. Sec. 4 of the act. E.g. this.": ["Dr. A and PROF. B met, i.e. Sec. 4 of the act.", "E.g. this."], "": [],
    }
    d = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in d.select(tx.sentences(F.col("t"))).collect()] == list(cases.values())


def test_normalize_map(spark):
    d = spark.createDataFrame([("\u201ca\u2019s\u201d\u2014b\u2026 \u2022 c\u200bd\u00ad \ufb01n\u00a0x",)], "t string")
    assert d.select(tx.normalize(F.col("t"))).first()[0] == "\"a's\" - b... - cd fin x"


def test_headings(spark):
    body = ["the first line of a body that is long enough here", "and another", "and a third"]
    doc = ["General Rules", *body, "Short heading", "one longer line of a body below it", "two", "R. 1(B).3 Fees", "x", "Ends with the", *body, "Students shall pay", *body, "12.5", "NOTE on this", *body, "=== A = B", *body]
    d = spark.createDataFrame([("d", i, x) for i, x in enumerate(doc)], "doc_id string, pos int, line string")
    assert [r.line for r in lines.headings(d).where("is_heading").orderBy("pos").collect()] == ["General Rules", "R. 1(B).3 Fees"]
    f = d.withColumn("font", F.when(F.col("line") == "two", 14.0).otherwise(10.0)).withColumn("mean", F.lit(10.0)).withColumn("page", F.lit(1))
    assert "two" not in {r.line for r in lines.headings(f, page="page", font="font", page_font="mean").where("is_heading").collect()}  # no body of three lines
    assert "two" in {r.line for r in lines.headings(f, least_body=0, page="page", font="font", page_font="mean").where("is_heading").collect()}


def test_duplicate_flag_is_never_taken_back(spark):
    m = _manifest(spark, [(1, "h", "done"), (2, "h", "pending"), (3, "x", "pending")]).withColumn("is_duplicate", F.col("id") == 3)
    assert {r.id: r.is_duplicate for r in manifest.mark_hash_duplicates(m).collect()} == {1: False, 2: True, 3: True}


def hot(n=600):
    """Half of the rows under one key, some under none, the rest apart."""
    return [(i, "hot" if i % 2 else None if i % 10 == 0 else f"k{i}") for i in range(n)]


def test_hot_keys_and_nulls(spark, monkeypatch):
    from tarvos.operators import skew

    for few in (True, False):  # with the repeated keys broadcast, and joined with salts
        monkeypatch.setattr(skew, "small", lambda df, limit=0, few=few: few)
        d = spark.createDataFrame(hot(), "id int, text string")
        got = {r.id: r.first_id for r in http.content_duplicates(d, "id", "text").collect()}
        assert got == {i: 1 if k == "hot" else i for i, k in hot()}
        m = _manifest(spark, [(i, k, "pending") for i, k in hot()])
        assert {r.id for r in manifest.mark_hash_duplicates(m).where("duplicate_of is not null").collect()} == {i for i, k in hot() if k == "hot" and i != 1}
        c = spark.createDataFrame([(f"c{i:04}", "u", k, i, 2000 + (i == 1), k) for i, k in hot()], "chunk_id string, source_url string, section_heading string, chunk_index int, batch_year int, text string")
        assert quality.newest_year_only(c.where("section_heading = 'hot'").withColumn("section_heading", F.lit("Heading"))).count() == 299
        assert {r.chunk_id for r in quality.floods(c.withColumn("section_heading", F.concat("section_heading", F.lit("ing")))).collect()} == {f"c{i:04}" for i, k in hot() if k == "hot"} - {"c0001", "c0003", "c0005"}
        full = c.select("*", F.lit(0).alias("token_count"), F.lit("t").alias("document_title"), F.lit("x").alias("document_type"), F.lit("prose").alias("block_type"))
        dup = {r.chunk_id for r in quality.audit(full.where("text is not null")).where("issue = 'dup_text'").collect()}
        assert dup == {f"c{i:04}" for i, k in hot() if k == "hot" and i != 1}
    n = {r.issue: r.n for r in quality.validate(full).withColumnRenamed("check", "issue").collect()}
    assert n["dup_text"] == 300 + 60 and n["dup_id"] == 0


def test_collision_names_of_a_hot_name(spark):
    rows = hot()
    want, seen = {}, {}
    for i, k in rows:
        if k is None:
            want[i] = None
        else:
            seen[k] = seen.get(k, 0) + 1
            want[i] = k if seen[k] == 1 else f"{k}_{seen[k]}"
    d = spark.createDataFrame(rows, "id int, name string")
    for limit in (10, 100_000):
        assert {r.id: r.unique_name for r in urls.collision_suffix(d, "name", "id", limit).collect()} == want


def test_rule_join_keeps_repeated_rows(spark):
    rules = spark.createDataFrame([(0, "a", "x"), (1, "b", ".")], "rule_no int, category string, pattern string")
    d = spark.createDataFrame([("x1",), ("x1",), ("y",), (None,)], "u string")
    assert sorted((r.u or "", r.category_found) for r in urls.rule_join(d, "u", rules).collect()) == [("", "unknown"), ("x1", "a"), ("x1", "a"), ("y", "b")]


def test_updates_and_lookups(spark):
    m = spark.createDataFrame([(1, "u1", "h", "done", None, None), (2, "u2", "h", "pending", "p", None), (3, "u3", None, "pending", None, None)], "id int, url string, file_hash string, download_status string, file_path string, download_notes string")
    d = spark.createDataFrame([("u2", 1, "/a", 5, "x"), ("u2", 2, "/b", None, "y"), ("zz", 1, "/c", 1, "z"), (None, 1, "/d", 1, "z")], "url string, seq int, file_path string, file_size bigint, file_hash string")
    got = {r.url: tuple(r) for r in manifest.apply_updates(m, manifest.finalized(d.drop("file_size").withColumn("file_size", F.lit(1))).drop("file_size")).collect()}
    assert got["u2"] == (2, "u2", "y", "done", "/b", "/b") and got["u1"] == (1, "u1", "h", "done", None, None) and len(got) == 3
    k = {r.url: r.known_url for r in manifest.known_by_hash(m, m.select("url", "file_hash")).collect()}
    assert k == {"u1": None, "u2": "u1", "u3": None}
    import pytest

    with pytest.raises(ValueError, match="no such stage"):
        manifest.stage_event("cook", "done", F.lit("u"), F.lit(1), F.current_timestamp())
    with pytest.raises(ValueError, match="no such status"):
        manifest.stage_event("parse", "fine", F.lit("u"), F.lit(1), F.current_timestamp())


def test_deep_and_hidden_html():
    deep = "<div>" * 5000 + "<p>deep text<ul><li>a long item here<li>b</ul>" + "</div>" * 5000
    assert [b["kind"] for b in html.blocks_of(deep, "u")] == ["heading", "paragraph", "list"]
    assert len(html.links_of("<div>" * 3000 + "<a href='/x'>y</a>", "https://h.example/")) == 1
    noisy = "<body><h1>T</h1><div class='ddsmoothmenu'>menu</div><p style='font-size:0'>spam</p><div id='page-nav'>x</div><div class='content'>kept</div><table><tr><td><table><tr><th>K<th>V<tr><td>a<td>b</table></td></tr></table></body>"
    assert [(b["kind"], b.get("text") or b.get("headers")) for b in html.blocks_of(noisy, "u")] == [("heading", "T"), ("paragraph", "kept"), ("table", ["K", "V"])]


def test_faculty_pages():
    page = "<table><tr><td>menu<table><tr><td>Associate Professor</td></tr><tr><td>Dr. A</td><td>Designation: Lecturer Email: a[at]b[dot]c Specialization:</td></tr><tr><td>note</td></tr><td>B Designation: Head</td></table></td></tr></table>"
    got = [(b["kind"], b["text"]) for b in html.faculty_blocks_of(page, "Physics")]
    assert got == [("heading", "Physics — Faculty"), ("heading", "Associate Professor"), ("paragraph", "Dr. A — Designation: Lecturer — Email: a@b.c — Department: Physics"), ("paragraph", "B — Designation: Head — Department: Physics")]
    assert [b["text"] for b in html.faculty_blocks_of("<p>none</p>")] == ["Faculty — Faculty"] and len(html.faculty_blocks_of(None)) == 1


BLOCKS = "doc_id int, pos int, kind string, text string, level int, items array<string>, ordered boolean, rows array<array<string>>, headers array<string>, caption string, page int"


def test_cleaning_pass(spark):
    from tarvos.operators import cleaning

    n = None
    rows = [
        (1, 0, "heading", "Fees\u00a0", 1, n, n, n, n, n, 1), (1, 1, "paragraph", "A paragraph of twenty and more letters", n, n, n, n, n, n, 1), (1, 2, "paragraph", "a PARAGRAPH of twenty and more\u00a0letters", n, n, n, n, n, n, 1),
        (1, 3, "paragraph", "Home > Academics > Fees and rules", n, n, n, n, n, n, 1), (1, 4, "paragraph", "12.5, 7", n, n, n, n, n, n, 1), (1, 5, "paragraph", None, n, n, n, n, n, n, 1), (1, 6, "list", n, n, ["an item of twenty letters", " ", "b"], False, n, n, n, 1),
        (1, 7, "list", n, n, ["short", "b"], False, n, n, n, 1), (1, 8, "table", n, n, n, n, [["a ", ""], ["", " "]], ["\ufb01ne", "v"], " ", 2), (1, 9, "table", n, n, n, n, [["a ", ""]], [], n, 2), (1, 10, "table", n, n, n, n, [["", ""]], ["h"], n, 2), (2, 0, "heading", "Fees", 1, n, n, n, n, n, 1),
    ]
    got = [(r.doc_id, r.pos, r.text, r["items"], r.rows, r.headers, r.caption) for r in cleaning.clean_blocks(spark.createDataFrame(rows, BLOCKS)).orderBy("doc_id", "pos").collect()]
    assert got == [
        (1, 0, "Fees", n, n, n, n), (1, 1, "A paragraph of twenty and more letters", n, n, n, n), (1, 6, "", ["an item of twenty letters", "b"], n, n, n), (1, 8, "", n, [["a", ""]], ["fine", "v"], n), (1, 9, "", n, [["a", ""]], [], n), (2, 0, "Fees", n, n, n, n),
    ]


def chunks_by_hand(blocks, title, kind, budget):
    """Sections, segments and packing by plain loops."""
    tok = lambda s: len(s) // 4
    stack, cur, body, out, sections = [], title or "Preamble", [], [], []

    def crumbs():
        chain = ([title] if title else []) + [t for _, t in stack] + ([] if stack else [cur])
        return " > ".join(c for i, c in enumerate(chain) if not i or chain[i - 1] != c)

    for b in blocks:
        if b[2] == "heading":
            if body:
                sections.append((cur, crumbs(), body))
            body = []
            while stack and stack[-1][0] >= b[4]:
                stack.pop()
            stack.append((b[4], b[3]))
            cur = b[3]
        else:
            body.append(b)
    if body:
        sections.append((cur, crumbs(), body))
    for head, crumb, body in sections:
        buf = []

        def flush(buf=buf, head=head, crumb=crumb):
            blob = "\n".join(buf).strip()
            buf.clear()
            if head and blob.startswith(head):
                blob = blob[len(head) :].lstrip(" :-\n")
            if blob and tok(blob) >= 15:
                out.append((crumb, blob, "prose"))

        for b in body:
            if b[2] == "table":
                flush()
                cur_rows, n = [], tok(crumb) + 2
                for r in b[7]:
                    line = ", ".join(f"{h}: {c}" for h, c in zip(b[8], r)) if b[8] else ", ".join(r)
                    if cur_rows and n + tok(line) + 1 > budget:
                        out.append((crumb, "\n".join(cur_rows), "table"))
                        cur_rows, n = [], tok(crumb) + 2
                    cur_rows.append(line)
                    n += tok(line) + 1
                if cur_rows:
                    out.append((crumb, "\n".join(cur_rows), "table"))
            elif b[2] == "list":
                buf.append("\n".join(f"{i}. {x}" if b[6] else f"- {x}" for i, x in enumerate(b[5], 1)))
            else:
                buf.append(b[3])
                if kind == "dept_faculty":
                    flush()
        flush()
    seen, kept = set(), []
    for i, (crumb, x, what) in enumerate(out):
        if (crumb, x) not in seen:
            seen.add((crumb, x))
            kept.append((i, f"{crumb}\n\n{x}", what))
    return kept


def test_chunks_of_blocks_match_the_loop(spark):
    import random

    rng, n = random.Random(4), None
    docs, blocks = [], {}
    for d in range(12):
        docs.append((d, f"u{d}", f"Title {d}" if d % 3 else n, "dept_faculty" if d % 4 == 1 else "notice", n, "2024-01-01", "html"))
        bs = []
        for pos in range(rng.randrange(1, 14)):
            k = rng.choice(["heading", "paragraph", "paragraph", "list", "table"])
            text = "Title 1" if rng.random() < 0.1 else f"{rng.choice(['Fees', 'Rules'])} {'word ' * rng.randrange(1, 30)}".strip()
            bs.append({"heading": (d, pos, k, text[:20].strip(), rng.randrange(1, 4), n, n, n, n, n, pos), "paragraph": (d, pos, k, text, n, n, n, n, n, n, pos), "list": (d, pos, k, n, n, ["one item", text], rng.random() < 0.5, n, n, n, pos),
                       "table": (d, pos, k, n, n, n, n, [[f"a{x}", text] for x in range(rng.randrange(1, 60))], rng.choice([["k", "v"], []]), n, pos)}[k])
        blocks[d] = bs
    got = {}
    df = spark.createDataFrame([b for bs in blocks.values() for b in bs], BLOCKS)
    dd = spark.createDataFrame(docs, "doc_id int, url string, title string, document_type string, date_published string, date_scraped string, source_format string")
    rows = chunking.chunk_blocks(df, dd, 500).collect()
    for r in sorted(rows, key=lambda r: r.chunk_index):
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.text, r.block_type))
    for d, bs in blocks.items():
        want = chunks_by_hand(bs, docs[d][2], docs[d][3], 500)
        assert got.get(d, []) == want, [x for x in zip(got.get(d, []), want) if x[0] != x[1]][:1]
    assert rows and set(chunking.RECORD) <= set(rows[0].asDict())


def test_grids_become_blocks(spark):
    g = [["Code", None, "Hours"], ["", "L", None], ["C1", "three words", "4"], [None, "more words", "5"], ["code", "l", "hours"], ["1", "2", "3"], [None, None, None]]
    d = spark.createDataFrame([(1, r, c, x) for r, row in enumerate(g) for c, x in enumerate(row)], "tab int, row int, col int, cell string")
    got = grid.to_block(d).first()
    assert got.headers == ["Code", "L", "Hours"] and got.rows == [["C1", "three words", "4"], ["C1", "more words", "5"]]


def test_scanned_pages(spark):
    p = spark.createDataFrame([("d", 1, "x" * 90), ("d", 2, " " + "x" * 90), ("d", 3, ""), ("d", 4, None), ("e", 1, "")], "doc_id string, page int, text string")
    assert sorted((r.doc_id, r.page) for r in lines.drop_repeated_pages(p).collect()) == [("d", 1), ("d", 3), ("d", 4), ("e", 1)]
    assert {r.doc_id: r.scanned for r in lines.scanned_documents(p).collect()} == {"d": False, "e": True}
    page = ["1. Scope of rules", "the rules apply", "to all", "FEES AND FINES", "all pay", "Library Hours", "a line that is longer than its title"]
    l = spark.createDataFrame([("d", 1, i, x) for i, x in enumerate(page)] + [("d", 2, 0, "on the next page")], "doc_id string, page int, pos int, line string")
    got = [(r.kind, r.text) for r in lines.ocr_blocks(l).orderBy("page", "pos").collect()]
    assert got == [("heading", "1. Scope of rules"), ("paragraph", "the rules apply to all"), ("heading", "FEES AND FINES"), ("paragraph", "all pay"), ("heading", "Library Hours"), ("paragraph", "a line that is longer than its title"), ("paragraph", "on the next page")]


def test_curated_records(spark):
    md = "# Hostels\nSource: https://h.example/x\n\n## Fees\nBatch-year: 2024\nRs. 5\n## Rooms\nSingle"
    got = chunking.curated_records(spark.createDataFrame([("hostel", md), ("none", "# T\n## A\nb")], "name string, md string"), default_url="https://d.example/").orderBy("document_title", "chunk_index").collect()
    assert [(r.section_heading, r.source_url, r.batch_year) for r in got] == [("Fees", "https://h.example/x", 2024), ("Rooms", "https://h.example/x", 0), ("A", "https://d.example/", 0)]
    assert got[0].text.startswith("Hostels > Fees\n\n## Fees\nBatch-year: 2024") and got[0].text.endswith("# Hostels\nSource: https://h.example/x")


def test_retrieval_with_variants_and_tables(spark):
    pts = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.9, 0.1]), (3, "t1", [0.0, 1.0])], "point_id bigint, chunk_id string, embedding array<double>")
    c = spark.createDataFrame([("a", "u", "H", "prose", "text a", 1, 0, 10), ("b", "u", "H", "prose", "text b", 1, 1, 10), ("t1", "u", "T", "table", "row 1", 1, 2, 10), ("t2", "u", "T", "table", "row 2", 1, 3, 10)], "chunk_id string, source_url string, section_heading string, block_type string, text string, page_number int, chunk_index int, token_count int")
    v = spark.createDataFrame([(7, 0, [1.0, 0.0]), (7, 1, [0.0, 1.0])], "query_id bigint, variant_no int, embedding array<double>")
    hits, ctx = retrieval.retrieve(v, pts, c, 2)
    assert [(r.rank, r.chunk_id) for r in hits.orderBy("rank").collect()] == [(1, "a"), (2, "t1")]
    text = ctx.first().context
    assert text.index("text a") < text.index("row 1") < text.index("row 2") and "text b" not in text


def test_more_labels_than_a_thousand(spark):
    n = 1_200
    pts = spark.createDataFrame([(i, [1.0, float(i)], i) for i in range(1, n + 1)], "point_id bigint, embedding array<double>, label int")
    q = pts.withColumnRenamed("point_id", "query_id")
    got = retrieval.cosine_top_k(q, pts, 1, label="label").collect()
    assert len(got) == n and all(r.query_id == r.point_id for r in got)


def test_claimed_tables(spark):
    from tarvos.operators import classify

    s = spark.createDataFrame([("u", 1, "s1"), ("u", 1, "s2")], "url string, page int, section string")
    t = spark.createDataFrame([("u", 1, "t1"), ("u", 2, "t2")], "url string, page int, tab string")
    taken, left = classify.claim_tables(s, t, ["url", "page"], "section")
    assert [(r.tab, r.section) for r in taken.collect()] == [("t1", "s1")] and [r.tab for r in left.collect()] == ["t2"]


def test_stream_table_folds_and_compacts(spark, tmp_path):
    from tarvos.streaming import ingest

    dst, ran = str(tmp_path / "out"), []
    for n, rows in enumerate(([("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")], [("a", 1, "old"), ("c", 1, "w")], [("b", 1, "again")])):
        src = tmp_path / f"in{n}"
        src.mkdir()
        spark.createDataFrame(rows, "k string, v int, x string").coalesce(1).write.mode("overwrite").parquet(str(src))
        batch = spark.read.parquet(str(src))
        io.latest(batch, ["k"], [F.desc("v")]).write.mode("overwrite").parquet(f"{dst}/v{n}")
    want = {("a", 2, "z"), ("b", 1, "again"), ("c", 1, "w")}
    assert {tuple(r) for r in ingest.folded(spark, dst, ["k"], "v").collect()} == want
    for _ in range(2):
        ingest.compact(spark, dst, ["k"], "v")
        assert ingest.versions(spark, dst) == [2, 3] and {tuple(r) for r in ingest.folded(spark, dst, ["k"], "v").collect()} == want
    stream = spark.readStream.schema("k string, v int, x string").parquet(str(tmp_path / "in0"))
    known = spark.createDataFrame([("x",), (None,)], "x string")
    q = ingest.upsert_stream(ingest.without_known_content(stream, known, "x"), str(tmp_path / "o2"), ["k"], "v", str(tmp_path / "cp"), after=lambda s, e: ran.append(e))
    q.awaitTermination()
    assert [tuple(r) for r in ingest.folded(spark, str(tmp_path / "o2"), ["k"], "v").collect()] == [("b", 1, "y")] and ran == [0]


def test_index_of_saved_pages(spark):
    from tarvos.plans import pipeline

    docs = spark.createDataFrame([(1, "https://s.example/ordinance/2020.html", "Rules", "ordinance"), (2, "https://s.example/Departments/CS/faculty.php", "Staff", "dept_faculty"), (3, "https://s.example/a", None, "notice")], "doc_id int, url string, title string, document_type string")
    docs = docs.withColumn("date_published", F.lit(None).cast("string")).withColumn("date_scraped", F.lit("2024-01-01")).withColumn("source_format", F.lit("html"))
    long = "Students of the hall return all the forms to the office in time for the next term. " * 3
    staff = "<table><tr><td>Professor</td></tr><tr><td>Dr A</td><td>Designation: Lecturer Qualification: Ph.D. from a university far away Specialization: Networks</td></tr></table>"
    pages = spark.createDataFrame([(1, "https://s.example/ordinance/2020.html", f"<h2>Hall</h2><p>{long}"), (2, "https://s.example/Departments/CS/faculty.php", staff), (3, "https://s.example/a", f"<h1>Notice</h1><p>{long}<table><tr><th>K<th>V<tr><td>a<td>b</table>")], "doc_id int, url string, html string")
    once = pipeline.index_html(pages, docs)
    rows = {(r.document_type, r.block_type) for r in once.collect()}
    assert rows == {("dept_faculty", "prose"), ("notice", "prose"), ("notice", "table")}  # ordinance prose is retired
    again = pipeline.index(once, once)
    assert sorted(r.chunk_id for r in again.collect()) == sorted(r.chunk_id for r in once.collect())
    assert "Department: CS" in once.where("document_type = 'dept_faculty'").first().text
    assert {r.batch_year for r in pipeline.backfill_year(once).collect()} == {0}


def test_parsed_pages_and_scans(spark):
    from tarvos.plans import pipeline

    body = "Attendance of the hostel residents and of the warden is taken and all the students shall be there"
    page1 = "\n".join(["Hostel Attendance", *[f"{i} {body}" for i in range(9)]])
    pages = spark.createDataFrame([("d", 1, page1), ("d", 2, page1), ("d", 3, "x"), ("d", 4, "hostel warden " * 9)], "doc_id string, page int, text string")
    cells = [("d", p, t, r, c, x) for p, t in ((1, 0), (3, 0), (4, 1)) for r, row in enumerate([["Code", "Name"], ["C1", "three words"]]) for c, x in enumerate(row)]
    tables = spark.createDataFrame(cells, "doc_id string, page int, tab int, row int, col int, cell string")
    got = pipeline.parse_pages(pages, tables).orderBy("pos").collect()
    assert [(r.kind, r.page) for r in got] == [("heading", 1), ("paragraph", 1), ("table", 1), ("table", 4)]  # page 2 repeats, page 3 is empty, page 4 is thin
    assert got[0].text == "Hostel Attendance" and got[2].rows == [["C1", "three words"]]
    s = pipeline.parse_scans(spark.createDataFrame([("d", 1, "HOSTEL RULES\nthe warden of the hostel\nsees all the mess rules and the residents of it"), ("d", 2, "short")], "doc_id string, page int, text string"))
    assert [(r.kind, r.text) for r in s.orderBy("pos").collect()] == [("heading", "HOSTEL RULES"), ("paragraph", "the warden of the hostel sees all the mess rules and the residents of it")]


def test_plain_text_tables(spark):
    doc = ["a | b | c", "x", "k    v", "a    1", "b    2", "one    two", "", "p | q | r", "s | t | u"]
    d = spark.createDataFrame([("d", i, x) for i, x in enumerate(doc)], "doc_id string, pos int, line string")
    assert {(r.kind, r.first_pos, r.n_lines) for r in lines.text_tables(d).collect()} == {("pipe", 0, 1), ("aligned", 2, 4), ("pipe", 7, 2)}


def test_embedding_hook_keeps_errors(spark):
    from tarvos.plans import pipeline

    def encode(texts):
        if "bad" in texts:
            raise RuntimeError("service down")
        return [[float(len(t)), 1.0] for t in texts]

    d = spark.createDataFrame([("a", "xx"), ("b", None), ("c", "bad"), ("d", "y")], "chunk_id string, text string").coalesce(1)
    got = {r.chunk_id: (r.embedding, r.error, r.point_id) for r in pipeline.embed(d, encode, batch=2).collect()}
    assert got["a"][:2] == ([2.0, 1.0], None) and got["b"][0] == [0.0, 1.0] and got["c"][0] is None and got["d"][1] == "RuntimeError: service down"
    assert got["a"][2] == str(uuid.uuid5(uuid.NAMESPACE_URL, "a"))


def test_fetch_settings_are_checked():
    import pytest

    assert http.FetchConfig().concurrency == 4
    for bad in ({"concurrency": 0}, {"max_retries": -1}, {"base_delay": 5.0, "max_delay": 1.0}, {"timeout": 0}):
        with pytest.raises(ValueError):
            http.FetchConfig(**bad)


def test_syllabus_tables(spark):
    from tarvos.operators import classify

    text = "Teaching Scheme\n1. CS-101 Networks L T P\nCredit Hours 4\n2. MA-102 Algebra\n3. PH-103 Optics and the rest of the page" + " x" * 30
    pages = spark.createDataFrame([("d", 1, text), ("d", 2, text), ("d", 3, "nothing of the kind on this page, which is long enough to be looked at all the same" * 2)], "doc_id string, page int, text string")
    cells = [("d", p, t, 0, c, "x") for p, t, n in ((1, 0, 3), (1, 1, 16), (2, 2, 3), (3, 3, 3)) for c in range(n)]
    got = classify.syllabus_tables(pages, spark.createDataFrame(cells, "doc_id string, page int, tab int, row int, col int, cell string")).collect()
    assert [(r.page, r.tab, r.heading) for r in got] == [(1, 0, "Teaching Scheme")]


def test_older_section_chunker(spark):
    prose = "A sentence of the rules that stands here. " * 80
    table = "\n".join(["Code | Name | Fee"] + [f"C{i} | {'word ' * 30}| {i}" for i in range(14)])
    body = f"{prose}\n{table}\nafter the table"
    s = spark.createDataFrame([("d", 0, "Small", 1, "few words"), ("d", 1, "Big", 2, body), ("d", 2, "Small", 1, "few words")], "doc_id string, section_no int, heading string, page int, body string")
    got = chunking.chunk_sections(s, spark.createDataFrame([("d",)], "doc_id string")).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == [f"auto_{i:03}" for i in range(len(got))] and got[0].text == "Section: Small\n\nfew words"
    groups = [r.text for r in got if "[Headers: " in r.text]
    assert len(groups) == 3 and all(t.startswith("Section: Big\n\n[Headers: Code | Name | Fee]\nC") for t in groups) and [t.count("| ") - 2 for t in groups] == [12, 12, 4]
    assert got[-1].text.endswith("after the table") and [r.chunk_index for r in got if r.section_heading == "Big"] == list(range(len(got) - 1))
    assert chunking.chunk_statistics(spark.createDataFrame([(50,), (700,), (150,)], "token_count bigint")).first().asDict() == {"n": 3, "mean_tokens": 300, "least_tokens": 50, "most_tokens": 700, "over": 1, "under": 1}
