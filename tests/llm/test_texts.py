"""Leaks, mixing, sentences and scanned text."""

import os
import random

import numpy as np
import pytest

from tarvos.llm import leaks, mixing, ocr_repair, sentences


def test_leaks_match_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(300)]
    items = [(f"i{k}", " ".join(rng.choice(vocab) for _ in range(70)), " ".join(rng.choice(vocab) for _ in range(18))) for k in range(20)] + [("n", None, "too short"), (None, "a b", "c")]
    docs = []
    for d in range(120):
        w = [rng.choice(vocab + ["zz", "yy"]) for _ in range(80)]
        if d % 3 == 0:
            src = items[d % 20][1].split()
            n = rng.choice([8, 11, 12, 20])
            at = rng.randrange(70 - n)
            w[30:30] = [x.upper() + "," for x in src[at : at + n]]
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "k " * 50_000), (503, items[0][2].replace("v", "v-\nv", 0))]
    grams = {}
    for i, p, q in items:
        for t in (p, q):
            w = leaks.tokens(t or "")
            for k in range(len(w) - 11):
                grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    split = {d: leaks.tokens(t) for d, t in docs if t}
    want = {(d, i) for d, w in split.items() for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "id string, passage string, question string")
    for limit in (8_000_000, 4_000):  # one shard, several shards
        assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(dd, ii, max_index_chars=limit).collect()} == want
    assert leaks.find_leaks(dd, ii.limit(0)).count() == 0 and leaks.find_leaks(dd.limit(0), ii).count() == 0


def test_hyphen_at_line_end_is_joined():
    assert leaks.tokens("an inven-\n  tory and CS-\n12, re-do") == ["an", "inventory", "and", "cs", "12", "re", "do"]


def test_bounds_never_lose_a_run():
    rng = random.Random(4)
    texts = [(str(k), [f"t{rng.randrange(60)}" for _ in range(40)]) for k in range(30)]
    ix = leaks.Index(texts)
    docs = []
    for _ in range(200):
        w = [f"t{rng.randrange(90)}" for _ in range(rng.randrange(5, 60))]
        j = rng.randrange(30)
        at = rng.randrange(28)
        w[3:3] = texts[j][1][at : at + 12]
        docs.append(w)
    ids = [ix.ids(w) for w in docs]
    hits = {(d, j) for d, j, _ in ix.search(ids)}
    assert all((d, j) in hits for d, x in enumerate(ids) for j in ix.shared(x))


def random_index(n=400, words=60, vocab=4000, seed=6):
    rng = random.Random(seed)
    pick = lambda k: [f"t{int(vocab ** rng.random())}" for _ in range(k)]
    return rng, pick, leaks.Index([(str(k), pick(words)) for k in range(n)])


def test_search_equals_exhaustive_scoring():
    rng, pick, ix = random_index()
    docs = [ix.ids(pick(24)) for _ in range(60)] + [ix.flat[k : k + 24].astype(np.int32) for k in range(0, 3000, 75)]
    want = set()
    of = np.repeat(np.arange(len(ix.term)), [ix.blk_n[a : a + n].sum() for a, n in zip(ix.term_at, ix.term_n[:-1])])
    w = np.zeros((len(ix.term), len(ix)))
    w[of, ix.list_doc] = ix.list_w
    for d, x in enumerate(docs):  # one window each
        score = w[sorted(set(x[x >= 0].tolist()))].sum(0)
        want |= {(d, j) for j in np.flatnonzero(score >= ix.low)}
    got = {(d, j) for d, j, _ in ix.search(docs, width=24, stride=24)}
    assert got == want and len(want) >= 40


def test_bounds_skip_windows_and_blocks():
    rng, pick, ix = random_index()
    docs = [ix.ids([w if rng.random() < 0.12 else "other" for w in pick(300)]) for _ in range(50)] + [ix.ids(pick(300)) for _ in range(3)]
    ix.search(docs)
    assert 0 < ix.stats["live_windows"] < 0.8 * ix.stats["windows"] and 0 < ix.stats["live_blocks"] < 0.8 * ix.stats["blocks"]
    ix.stats.clear()  # with the bounds off, all of them are gone through
    ix.low[:], ix.block_low[:] = 0, 0
    ix.search(docs)
    assert ix.stats["live_windows"] == ix.stats["windows"] and ix.stats["live_blocks"] >= ix.stats["blocks"]


def test_index_of_a_full_shard_is_small():
    import pickle

    rng = np.random.default_rng(3)
    words = np.array([f"w{k:05}" for k in range(50_000)])
    texts = [(str(k), words[np.minimum(rng.zipf(1.3, 60) - 1, 49_999)].tolist()) for k in range(19_000)]
    assert sum(len(w) + 1 for _, t in texts for w in t) > 7_900_000
    assert len(pickle.dumps(leaks.Index(texts), protocol=5)) < 120_000_000


VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
has_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary here")


@has_vocab
def test_mixing_cuts_at_the_budget(spark):
    rng = random.Random(5)
    docs = [(i, "a" if i % 3 == 0 else "b" if i % 3 == 1 else "c", "word " * rng.randrange(1, 40)) for i in range(600)] + [(900, None, "x"), (901, "d", "not listed"), (902, "a", None)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 4), ("c", 0.1, 1), ("void", 0.0, 1)], "source string, target_share double, max_repeats int")
    draws, rep = mixing.mix(d, t, VOCAB)
    rep = {r.source: r for r in rep.collect()}
    got = draws.collect()
    assert {r.source for r in got} == {"a", "b", "c"} and 902 not in {r.id for r in got if r.tokens} and all(r.copies <= 2 for r in got if r.source == "a")
    for s in "abc":
        own = sum(r.tokens * r.copies for r in got if r.source == s)
        assert own == rep[s].drawn_tokens <= rep[s].target_tokens < own + 60
    assert not any(r.short for r in rep.values()) and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    again = {(r.id, r.copies) for r in mixing.mix(d.repartition(7), t, VOCAB)[0].collect()}
    assert again == {(r.id, r.copies) for r in got}


@has_vocab
def test_mixing_with_many_ranges_and_shortfall(spark):
    d = spark.createDataFrame([(i, "a" if i < 5 else "b", "one two three") for i in range(300)], "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    tokens = mixing.token_counts(d, "doc_id", "source", "text", VOCAB)
    plan = mixing.plan_budgets(tokens, t)
    few, many = ({(r.id, r.copies) for r in mixing.draw(tokens, plan, docs_per_range=n).collect()} for n in (10**6, 10))
    assert few == many
    rep = {r.source: r for r in mixing.mix(d, t, VOCAB)[1].collect()}
    assert rep["a"].short and rep["a"].most_copies == 3 and not rep["b"].short
    with pytest.raises(Exception, match="two targets"):
        mixing.mix(d, t.unionByName(t), VOCAB)[1].collect()


TRAIN = ["Dr. Gelu Ruk shall return the form by 5.30 p.m. on Monday. The board met at 9.15 a.m. in the hall.", "The rate is 2.50 as per Sec. 4.1 of the act. Prof. A. Banu said so.", "If the average drops to 4.48, the board must act. The fee of Rs. 300 is due at 4 p.m.", "He may defer the fine. The board met. If it rains, the hall is closed.", "He may defer the fine. The board met."]


def units(spark, text, train=None):
    rows = [(i, t) for i, t in enumerate(TRAIN * 30)] + [(10**6, text)] + [(10**6 + 1 + i, t) for i, t in enumerate(train or [])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    m = sentences.fit(d)
    return [text[a:b].strip() for a, b in zip([0, *m.units(text)], m.units(text))]


def test_sentences_in_latin_script(spark):
    assert units(spark, "Heading without a stop\n\nDr. Gelu Ruk met at 9.15 a.m. in the hall. The board\nmet.If it rains, “the hall is closed.” The fee of Rs. 300 is due.\n\n(a) one;\n \n(b) two;") == [
        "Heading without a stop", "Dr. Gelu Ruk met at 9.15 a.m. in the hall.", "The board\nmet.", "If it rains, “the hall is closed.”", "The fee of Rs. 300 is due.", "(a) one;", "(b) two;"]


def test_sentences_in_other_scripts(spark):
    ja = ["図書館は学生証を掲示します。試験課は登録用紙を提出してください。", "留学生は座席表を確認します。"] * 20
    assert units(spark, "図書館は学生証を掲示します。試験課は登録用紙を確認します。", ja) == ["図書館は学生証を掲示します。", "試験課は登録用紙を確認します。"]
    hi = ["छात्र प्रपत्र जमा करेंगे। मेस समिति सूची जाँच लें।"] * 20
    assert units(spark, "मेस समिति प्रपत्र जमा करेंगे। छात्र सूची जाँच लें।", hi) == ["मेस समिति प्रपत्र जमा करेंगे।", "छात्र सूची जाँच लें।"]
    th = ["ห้องสมุดต้องส่งตารางสอบ ฝ่ายสอบควรตรวจสอบ"] * 20
    assert units(spark, "ฝ่ายสอบต้องส่งตารางสอบ ห้องสมุดควรตรวจสอบ", th) == ["ฝ่ายสอบต้องส่งตารางสอบ", "ห้องสมุดควรตรวจสอบ"]


def test_sentence_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n "), (4, "x"), (4, "x"), (5, "The board met. " * 20_000)], "doc_id bigint, text string")
    got = [tuple(r) for r in sentences.split(d, sentences.fit(d)).where("doc_id < 5").collect()]
    assert got == [(4, 1), (4, 1)]
    assert sentences.split(d.limit(0), sentences.fit(d.limit(0))).count() == 0


def test_contexts_beyond_the_limit_count_by_shape(spark, monkeypatch):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TRAIN * 2)], "doc_id bigint, text string")
    kept = []
    monkeypatch.setattr(sentences, "Model", lambda rows, voc: kept.append(rows))
    for limit in (10**6, 60, 20, 5):  # all kept, cuts at rows with ties
        sentences.fit(d, max_contexts=limit)
    total = [{k: sum(r[4] for r in rows if r[0] == k) for k in "secu"} for rows in kept]
    assert total[0]["c"] > 0 and all(t == total[0] for t in total[1:])


def test_posteriors_match_enumeration():
    from itertools import product

    rng = random.Random(8)
    odds = [0.0] + [rng.uniform(-3, 3) for _ in range(sentences.LONGEST)]
    for n, most in ((1, 20), (4, 8), (7, 60), (6, 120)):
        score, words = [rng.uniform(-4, 4) for _ in range(n)], [rng.randrange(most) for _ in range(n + 1)]
        score[n // 2] = rng.choice([score[n // 2], 16.0, -16.0])
        total, mass = 0.0, [0.0] * n
        for on in product((0, 1), repeat=n):
            x, unit = 0.0, 0
            for k, w in enumerate(words):
                unit += w
                if k == n or on[k]:
                    x += odds[min(unit, sentences.LONGEST)] + (score[k] if k < n else 0)
                    unit = 0
            total += np.exp(x)
            mass = [m + np.exp(x) * o for m, o in zip(mass, on)]
        got = sentences.posteriors(score, words, odds)
        assert np.allclose(got, [m / total for m in mass], atol=1e-2 if abs(score[n // 2]) > 10 else 1e-9)


def test_unit_lengths_decide_a_boundary(spark):
    """A mark that could be either is a boundary where the units have their usual lengths with it, and is none where they have not."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("kmnprst") for _ in range(3))
    unit = lambda k: " ".join([word().capitalize()] + [word() for _ in range(k - 1)])
    d = spark.createDataFrame([(i, " ".join(unit(rng.randrange(9, 13)) + "." for _ in range(8))) for i in range(300)], "doc_id bigint, text string")
    m = sentences.fit(d)
    odds = m.by_length["<latin>"]
    assert odds[10] > 1 > -1 > odds[30] and odds[1] < -1
    m.cls, m.score = lambda w: w, lambda left, mark, right: -0.5 if left == "Pek" else 30.0
    usual, short = f"{unit(9)} Pek. {unit(10)}.", f"{unit(3)} Pek. {unit(6)}."
    cut = usual.index("Pek. ") + 4
    assert m.units(usual) == [cut, len(usual)] and m.units(short) == [len(short)]
    m.by_length = {}  # the coupling off: the event stands alone
    assert m.units(usual) == [len(usual)]


def test_em_turns_what_the_start_supposes(spark):
    """The start takes a short unknown word with a mark for an abbreviation; the words that follow it are those that begin units."""
    rng = random.Random(2)
    heads = ["The", "This", "Every", "No", "Such", "Any"]
    unit = lambda: f"{rng.choice(heads)} {rng.choice(['hall', 'gate', 'room', 'board', 'court'])} {rng.choice(['was', 'is', 'stays'])} {rng.choice(['open', 'shut', 'green', 'locked', 'let'])}."
    d = spark.createDataFrame([(i, " ".join([unit() for _ in range(5)] + ["They met at the inn."] * (i % 40 == 0) + [unit()])) for i in range(400)], "doc_id bigint, text string")
    m = sentences.fit(d)
    assert m._first("inn", ".", "The", 0, 0, 10) < 0.5 < 1 / (1 + np.exp(-m.score("inn", ".", "The")))


def test_space_between_unmarked_cjk_units(spark):
    a, b = "図書館は学生証を掲示します", "試験課は登録用紙を確認します"
    train = [f"{a}。{b}。", f"{b}。{a}。"] * 40 + [f"{a} {b}", f"{b} {a}"] * 10
    assert units(spark, f"{a} {b}", train) == [a, b]


def scanned(spark):
    body = "The committee shall record the minutes of the meeting under the revised scheme."
    clean = [(f"k{i}", body, "u0", None, None, 0) for i in range(60)]
    page = "Section heading here\n\nThe cornmittee shall rec0rd the min-\nPage 3 of 9\nKeban campus handbook\nutes of the meeting under\nthe revised scheme.\nKeban campus handb0ok    4"
    chunks = clean + [("s1", page, "u1", "Section heading here", "2024-01-02", 0), ("s1", "old", "u1", None, "2023-01-02", 0), ("s2", None, "u1", None, None, 0), (None, body, "u1", None, None, 0), ("s3", "", "u1", None, None, 0), ("s4", body, None, None, None, 0)]
    c = spark.createDataFrame(chunks, "chunk_id string, text string, source_url string, section_heading string, date_scraped string, url int")
    d = spark.createDataFrame([("u1", True), ("u0", False), ("u2", None), (None, True), ("u1", True)], "url string, is_ocr boolean")
    return c, d


def test_scan_noise(spark):
    c, d = scanned(spark)
    got = {tuple(r) for r in ocr_repair.repair(c, d).collect()}
    assert got == {("s1", 2, "misread"), ("s1", 2, "hyphen"), ("s1", 3, "page_no"), ("s1", 4, "header"), ("s1", 7, "header")}
    text = {r.id: r.text for r in ocr_repair.repair(c, d, text=True).collect()}
    assert text["s1"] == "Section heading here\n\nThe committee shall record the minutes of the meeting under the revised scheme."
    assert ocr_repair.repair(c.limit(0), d).count() == 0 and ocr_repair.repair(c, d.limit(0)).count() == 0


def test_glyph_edits_and_page_numbers():
    for read, printed in (("rernain", "remain"), ("c0mmittee", "committee"), ("sliall", "shall"), ("coiirse", "course"), ("inhmation", "intimation"), ("0f", "of")):
        assert printed in ocr_repair.edits(read)
    assert all(ocr_repair.PAGE_NO.match(x) for x in ("28", "- 33 -", "~ 32 ~", "[35]", "Pg. 32", "Page 37 of 44", "13 |")) and not any(ocr_repair.PAGE_NO.match(x) for x in ("2015.", "Rs. 28", "12 seats", "Section 4"))


def test_skip_gram_vectors_group_words_of_like_contexts():
    rng = np.random.default_rng(0)
    m = np.zeros((40, 40))
    for i in range(40):  # two topics
        for j in range(40):
            m[i, j] = 50 + rng.integers(5) if (i < 20) == (j < 20) else 1
    w, _ = ocr_repair.skip_gram_vectors((m + m.T).astype(float), 4)
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert cos(w[0], w[5]) > 0.9 > 0.5 > cos(w[0], w[30])


def linked(counts, *words):
    """Links as the engine joins them, from a dictionary of counts."""
    out = {}
    for w in words:
        n = counts.get(w, 1)
        near = [(c, counts[c], None) for c in sorted(ocr_repair.edits(w)) if counts.get(c, 0) >= max(ocr_repair.LEAST, ocr_repair.WIDEST * n)]
        if near:
            out[w] = (n, None, near)
    return ocr_repair.Lexicon(out, ocr_repair.Model())


def test_misreadings_are_told_by_ratio_not_by_count():
    lex = linked({"shall": 1_000_000, "sliall": 9_000, "hall": 300_000, "office": 50}, "sliall", "hall", "officc", "cs185")
    assert lex.correct("sliall", []) == "shall" and lex.correct("hall", []) is None and lex.correct("officc", []) == "office" and lex.correct("CS185", []) is None


def farm_and_form(spark):
    chunks = [(f"k{i}", "please fill the application form and submit it to the office before noon", "u0", None, None) for i in range(400)]
    chunks += [(f"f{i}", "some cows graze on a quiet farm beside our river near every village field", "u0", None, None) for i in range(25)]
    chunks += [("s1", "some cows graze on a quiet farm beside our river", "u1", None, None), ("s2", "please fill the application farm and submit it", "u1", None, None)]
    return spark.createDataFrame(chunks, "chunk_id string, text string, source_url string, section_heading string, date_scraped string"), spark.createDataFrame([("u1", True)], "url string, is_ocr boolean")


def test_the_vectors_decide_links(spark, monkeypatch):
    c, d = farm_and_form(spark)
    assert {tuple(r) for r in ocr_repair.repair(c, d).collect()} == {("s2", 0, "misread")}
    limited = ocr_repair.small
    monkeypatch.setattr(ocr_repair, "small", lambda df, limit=0: False)  # tables beyond every broadcast limit
    assert {tuple(r) for r in ocr_repair.repair(c, d).collect()} == {("s2", 0, "misread")}
    monkeypatch.setattr(ocr_repair, "small", limited)
    monkeypatch.setattr(ocr_repair, "learn", lambda *a, **k: ocr_repair.Model())  # vectors off: the ratio alone takes both
    assert {tuple(r) for r in ocr_repair.repair(c, d).collect()} == {("s1", 0, "misread"), ("s2", 0, "misread")}


def test_header_marks_have_no_limit(spark):
    chunks = []
    for k in range(2_003):  # as many openings and closings, each on three documents
        name = "".join("bcdfghjklm"[int(x)] for x in f"{k:04d}")
        chunks += [(f"c{k}_{u}_{j}", f"A{name} Campus E{name}\nthe minutes are kept", f"u{k % 7}_{u}", None) for u in range(3) for j in range(2)]
    c = spark.createDataFrame(chunks, "id string, text string, url string, heading string")
    e = ocr_repair.header_evidence(c)
    assert e.where("size(openings) = 1 and size(closings) = 1 and size(hs) = 1").count() == len(chunks)


def test_a_line_broken_at_both_ends_is_repaired_once():
    lines = "the commit-\ntee shall pub-\nlish, the list."
    cases, fixed = ocr_repair.find_noise(lines, ["text"] * 3, ocr_repair.Lexicon({}, ocr_repair.Model()))
    assert cases == [(0, "hyphen"), (1, "hyphen")] and fixed == ["the committee", "shall publish,", "the list."]


def test_long_lines_take_no_long_time():
    import time

    for t in ("." * 300_000, "a" * 300_000, "ab-" * 100_000, "1" * 300_000, "x" + " " * 300_000 + "y", "Abc 12. " * 40_000):
        began = time.time()
        kind = ocr_repair.classify(t.split("\n"), "", set(), set(), set())
        assert kind == ["text"] and ocr_repair.words_to_link(t, kind) is not None and ocr_repair.find_noise(t, kind, ocr_repair.Lexicon({}, ocr_repair.Model()))[0] == []
        assert sentences.events(t) is not None and leaks.tokens(t) is not None and time.time() - began < 5
