"""Repeated lines, main content and line labels."""

import numpy as np
from pyspark.sql import functions as F

from tarvos.llm import line_hmm as hm
from tarvos.llm import main_content as mc
from tarvos.llm import site_lines as sl

SCHEMA = "chunk_id string, source_url string, text string, document_title string, host string, w int"


def pages(n=40):
    rows = []
    for i in range(n):
        body = f"The warden of hall {i} shall return the form number {i} before the vacation begins in week {i}."
        lines = ["Home", "» About Us", f"Posted by the desk on {i}.1.2020", f"Title {i} of this page", body, "Tags: a, b", f"Popular now: Other page {i}", f"› Some other page {i} (new)", "© 2020 the web team"]
        rows.append((f"c{i}", f"HTTPS://Site.example/p{i}.php", "\n".join(lines), f"Title {i} of this page", "x", 1))
    return rows


EDGES = [("e1", None, "Home", None, "x", 1), ("e2", "http://site.example/q", None, None, "x", 1), ("e3", "not an address", "Home", None, "x", 1), (None, "http://site.example/z", "Home", None, "x", 1), ("e5", "http://other.example/a", "", None, "x", 1), ("e6", "http://other.example/b", "word " * 200_000, None, "x", 1)]


def test_repeated_lines_match_brute_force(spark):
    rows = pages() + EDGES + pages(3)
    d = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in sl.repeated_lines(d, sl.repeated_wordings(d)).collect()}
    want = {(f"c{i}", k) for i in range(40) for k in (0, 1, 2, 3, 4, 5, 6, 7, 8)}  # digits do not count, so all wordings recur
    assert got == want | {(None, 0)}
    t = {r.id: r for r in sl.remove_repeated_lines(d, sl.repeated_wordings(d)).collect()}
    assert t["c1"].text == "" and t["e1"].text == "Home" and t["e2"].text is None


def test_rare_wordings_stay(spark):
    rows = [(f"c{i}", f"http://s.example/{i}", "Twice here" if i < 2 else f"{'abcdefghijklmnop'[i % 16] * (i + 3)} other", None, "x", 1) for i in range(30)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert sl.repeated_lines(d, sl.repeated_wordings(d)).count() == 0
    assert sl.repeated_wordings(d.limit(0)).count() == 0


def test_flags_beyond_the_broadcast_limit_are_joined(spark, monkeypatch):
    d = spark.createDataFrame(pages(), SCHEMA)
    flagged = sl.repeated_wordings(d)
    want = {tuple(r) for r in sl.repeated_lines(d, flagged).collect()}
    clean = {tuple(r) for r in sl.remove_repeated_lines(d, flagged).collect()}
    monkeypatch.setattr(sl, "site_flags", lambda f: None)
    monkeypatch.setattr(sl, "small", lambda f, limit=0: False)
    assert {tuple(r) for r in sl.repeated_lines(d, flagged).collect()} == want
    assert {tuple(r) for r in sl.remove_repeated_lines(d, flagged).collect()} == clean
    assert {tuple(r) for r in sl.repeated_lines(d, sl.repeated_wordings(d)).collect()} == want


def test_layout_lines(spark):
    d = spark.createDataFrame(pages() + EDGES, SCHEMA)
    words, heads = mc.layout_paths(d)
    got = {tuple(r) for r in mc.layout_lines(d, words, heads).where("id like 'c%'").collect()}
    assert got == {(f"c{i}", k) for i in range(40) for k in (0, 1, 2, 5, 6, 7, 8)}
    text = {r.id: r.text for r in mc.layout_lines(d, words, heads, extract=True).collect()}
    assert text["c3"].split("\n")[0] == "Title 3 of this page" and len(text["c3"].split("\n")) == 2 and text["e2"] is None and text["e5"] == ""
    assert mc.layout_lines(d.limit(0), *mc.layout_paths(d.limit(0))).count() == 0


def test_clusters_count_pages_not_wordings(spark):
    odd = "\n".join(f"{c}9{c * 3} 7{c}{c}" for c in "bcdfghjklm")  # unlike lines of one mask, all on one page
    rows = [(f"c{i}", f"http://s.example/{i}", f"{'abcdefghijklmnop'[i % 16] * (i + 3)} body" + ("\n" + odd if i == 0 else ""), None, "x", 1) for i in range(30)]
    rows += [(f"d{i}", f"http://s.example/d{i}", f"Ask Room {'abcdefghij'[i] * 4}{i} soon", None, "x", 1) for i in range(10)]  # near-duplicates on ten pages
    d = spark.createDataFrame(rows, SCHEMA)
    flagged = sl.repeated_wordings(d, exact=False)
    t = {r.id: r for r in sl.remove_repeated_lines(d, flagged).collect()}
    assert t["c0"].n_removed == 0 and all(t[f"d{i}"].n_removed == 1 for i in range(10))
    assert max(r.cluster_pages for r in flagged.collect()) == 10


def test_only_lines_of_frequent_clusters_are_checked(spark):
    d = spark.createDataFrame(pages(), SCHEMA)
    want = sl.repeated_lines(d, sl.repeated_wordings(d)).count()
    assert want == 40 * 9
    lines = sl.line_table(d).toPandas()
    rng = np.random.default_rng(1)
    lines["b0"], lines["b1"] = rng.integers(1 << 60, size=len(lines)), rng.integers(1 << 60, size=len(lines))
    apart = spark.createDataFrame(lines)  # no two lines share a band: there is no cluster, so nothing is found
    assert sl.repeated_wordings(d, lines=apart).count() == 0


def letters_of(i):
    return "".join("abcdefghij"[int(c)] for c in f"{i:03d}")


def test_sentences_on_every_page_are_layout(spark):
    line = "These small files help us to keep you signed in on all devices."
    rows = [(f"c{i}", f"http://s.example/{i}", f"The {letters_of(i)} warden shall return the form before the vacation.\n{line}", None, "x", 1) for i in range(30)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in mc.layout_lines(d, *mc.layout_paths(d)).collect()} == {(f"c{i}", 1) for i in range(30)}


def test_the_word_list_only_scores(spark):
    rows = [(f"c{i}", f"http://s.example/{i}", f"The store of {letters_of(i)} keeps every {'cookie' if i < 2 else 'biscuit'} for the hostel.", None, "x", 1) for i in range(30)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert mc.layout_lines(d, *mc.layout_paths(d)).count() == 0  # the path is content, whatever words two of its lines hold


def test_without_winning_heads_no_cue_labels_a_line(spark):
    rows = [(f"c{i}", f"http://s.example/{i}", f"Share this page: {letters_of(i)} {letters_of(i * 7 % 1000)}\nThe {letters_of(i)} warden shall return the form before the vacation.", None, "x", 1) for i in range(30)]
    d = spark.createDataFrame(rows, SCHEMA)
    words, heads = mc.layout_paths(d)
    assert {tuple(r) for r in mc.layout_lines(d, words, heads).collect()} == {(f"c{i}", 0) for i in range(30)}
    assert mc.layout_lines(d, words, heads.limit(0)).count() == 0  # the votes off: the word list alone labels nothing


def test_heads_are_voted_per_site(spark, monkeypatch):
    def layout_site(h):
        return [(f"{h}{i}", f"http://{h}.example/{i}", f"Notice: {'cookie ' if i < 20 else ''}{letters_of(i)} {h}", None, "x", 1) for i in range(24)]

    def content_site(h):
        return [(f"{h}{i}", f"http://{h}.example/{i}", f"Notice: {letters_of(i)} shall return the form of {h}{'.' if i < 20 else ''}", None, "x", 1) for i in range(24)]

    one = spark.createDataFrame(layout_site("a") + content_site("b") + content_site("c"), SCHEMA)  # layout on one site only
    most = spark.createDataFrame([r for h in "adefgh" for r in layout_site(h)] + content_site("b"), SCHEMA)  # content on one site only
    want = {id(one): {(f"a{i}", 0) for i in range(24)}, id(most): {(f"{h}{i}", 0) for h in "adefgh" for i in range(24)}}
    for d in (one, most):
        assert {tuple(r) for r in mc.layout_lines(d, *mc.layout_paths(d)).collect()} == want[id(d)]
    words, heads = mc.layout_paths(most)
    monkeypatch.setattr(mc, "small", lambda d: False)  # verdicts beyond the broadcast limit
    assert {tuple(r) for r in mc.layout_lines(most, words, heads).collect()} == want[id(most)]


def test_seeds_speak_for_themselves():
    sent = "The warden shall return the form before the vacation begins in May."
    cases = {sent: "prose", "Name | Grade | Remarks | Room": "table", "5.02 | abc def | CS-555 | thotho": "table", "1. Attendance notice in Rislunhi Hall": "list", "+*/~>*:<>-+=|=~:||:+<:___*.=++": "junk"}
    for line, label in cases.items():
        assert hm.LABELS[hm.seed_label(hm.symbol(hm.line_stats(line)))] == label, line
    for line in ("card form merit batch code scheme portal code syllabus admit roll", "Notes on the use of the hall and of the rooms in it"):
        assert hm.seed_label(hm.symbol(hm.line_stats(line))) is None


def test_the_model_decides_what_seeds_leave_open(spark):
    item, unclear = "Library hours", "Notes on the use of the hall and of the rooms in it"
    sent = "The warden of the hall shall return the form before the vacation begins, as the rules say."
    other = {"l": item, "t": "5.02 | abc def | CS-555 | thotho", "j": "+*/~>*:<>-+=|=~:||:+<:___*.=++"}
    rows = [(f"{k}{i}", "u", "\n".join([x] * 4 + [unclear if k == "l" else x] * 3 + [x] * 4), None, "x", 1) for k, x in other.items() for i in range(60)] + [(f"p{i}", "u", sent, None, "x", 1) for i in range(60)]
    d = spark.createDataFrame(rows + [("open", "u", "\n".join([unclear] * 4), None, "x", 1)], SCHEMA)
    t = hm.symbol_table(d, "chunk_id", "text")
    label = lambda model: {r.id: r.prose_share for r in hm.line_shares(t, model).collect()}["open"]
    assert label(hm.fit(t, rounds=0)) > 0.45 > label(hm.fit(t)) and {r.id for r in hm.not_prose(d).collect()} == {"open"} | {f"{k}{i}" for k in other for i in range(60)}


def forward_backward_by_hand(h, seq):
    """Posteriors by summing over all label paths."""
    from itertools import product

    p = np.zeros((len(seq), 4))
    for path in product(range(4), repeat=len(seq)):
        w = h.start[path[0]] * h.emit[path[0], seq[0]]
        for t in range(1, len(seq)):
            w *= h.move[path[t - 1], path[t]] * h.emit[path[t], seq[t]]
        for t, k in enumerate(path):
            p[t, k] += w
    return p / p.sum(1, keepdims=True)


def test_posteriors_match_enumeration():
    h = hm.Hmm.first()
    seqs = [np.array([3, 200, 41, 77]), np.array([5]), np.array([], int), np.array([700, 1])]
    for s, p in zip(seqs, h.posteriors(seqs)):
        if len(s):
            assert np.allclose(p, forward_backward_by_hand(h, s))
    start, move, emit = h.posteriors(seqs, counts=True)
    assert np.isclose(start.sum(), 3) and np.isclose(move.sum(), 4) and np.isclose(emit.sum(), 7)


def test_not_prose(spark):
    prose = "\n".join(["The warden of the hall shall return the form before the vacation begins, as the rules say."] * 6)
    table = "\n".join(f"{i}.02 | abc def | CS-5{i} | thotho" for i in range(9))
    rows = [("p", "u", prose, None, "x", 1), ("t", "u", table, None, "x", 1), ("t", "u", table, None, "x", 1), ("n", "u", None, None, "x", 1), ("b", "u", " \n ", None, "x", 1), ("long", "u", prose * 3000, None, "x", 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert {r.id for r in hm.not_prose(d).collect()} == {"t", "n", "b"} and hm.not_prose(d).count() == 3
    q = {r.id: r for r in hm.quality(d).collect()}
    assert q["p"].label == "prose" and q["t"].label == "table" and q["n"].label is None and q["n"].n_lines == 0
    assert hm.quality(d.limit(0)).count() == 0


def test_statistics(spark):
    d = spark.createDataFrame([("a", "u", "The cat sat.\nIt ran", None, "x", 1), ("n", "u", None, None, "x", 1)], SCHEMA)
    r = {x.id: x for x in hm.text_statistics(d).collect()}
    assert (r["a"].n_words, r["a"].n_lines, r["a"].ends_in_punctuation, r["a"].common_share) == (5, 2, 0.5, 0.4)
    assert r["n"].n_words == 0 and r["n"].mean_word_length == 0.0


def test_labels_agree_with_people(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        return
    q = hm.quality(spark.read.parquet(f"{sf}/html_corpus.parquet")).select("id", "label").distinct()
    votes = spark.read.parquet(f"{sf}/quality_labels.parquet").where("label is not null").groupBy("chunk_id").agg(F.mode("label", True).alias("human"))
    x = q.join(votes, q.id == votes.chunk_id).select((F.col("label") == F.col("human")).cast("int").alias("ok")).agg(F.avg("ok"), F.count("*")).first()
    assert x[1] > 50 and x[0] >= 0.9
