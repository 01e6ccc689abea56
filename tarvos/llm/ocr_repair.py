"""Noise in text from scanned pages: misread words, hyphenated line ends, running headers, page numbers.

Word counts are taken over all chunks. Skip-gram vectors of the ``embedded`` most frequent words come from the co-occurrence counts of all
chunks (the factorisation of the shifted positive PMI matrix, which the skip-gram objective with negative sampling has as its optimum). A
word of a scan is linked to more frequent words that one plausible glyph edit turns it into; words and edits are joined with the counts
in Spark, whatever their number. Every linked word, frequent or not, gets a vector from the contexts it stands in over all chunks: their mean
context vector, taken by the linear map that sends the embedded words' mean contexts to their vectors, and shrunk where it was seen
seldom. A link is followed where the frequent word, by count and by fit with the words around, beats the word that was read: with equal
fits it has to be ``RATIO`` times as frequent, a read word that suits its place better stays, one that suits it worse falls sooner.
Running headers are title-like lines that recur within their document, open or end like the corpus's recurring ones, or stand in the flow
of a sentence; then furniture is removed and paragraphs are joined.

Bound, of the model and none of the data: the ``embedded`` words, whose context vectors every task holds.

Defined results: null or blank text gives nothing; of rows repeated under one id the one scraped last counts (ties: largest text); null urls
match no document; rows of documents without a true OCR flag are left alone; extra columns are ignored; with an empty corpus no word is misread.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .site_lines import salted, small

RATIO, LEAST = 8.0, 5  # how often a word must be for another to be its misreading, by itself and against the other
SHRINK = 20.0  # words of context that a word's vector is taken to have had without any tendency
WIDEST = 3.0  # links below this ratio are not looked at in any context

# What scanners read for what is printed (read, printed).
GLYPHS = [
    ("0", "o"), ("@", "a"), ("5", "s"), ("1", "l"), ("1", "i"), ("9", "g"), ("6", "b"), ("3", "e"), ("8", "b"), ("$", "s"), ("|", "l"),
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"),
    ("h", "ti"), ("ti", "h"), ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("f", "t"), ("t", "f"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("tl", "d"), ("ln", "m"), ("nn", "m"), ("o", "c"), ("a", "o"),
]
HYPHENS = "-­¬‐‑"
LETTER = "[^\\W\\d_]"
JOIN = re.compile(rf"(?<={LETTER})[{HYPHENS}][ \t]*\n\s*(?=[a-z])")
WORD = re.compile(f"{LETTER}+")
TOKEN = re.compile(r"[0-9A-Za-z@$|ﬀ-ﬆ]+")
LINK = re.compile(r"(?:https?://|www\.|\S+@\S+\.)\S*|\S+/\S+/\S*", re.I)
PAGE_NO = re.compile(r"^[\s\-–—~\[\](){}|*.<>_]*(?:page|pg|p)?[\s.:#]*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?[\s\-–—~\[\](){}|*<>_]*$", re.I)
BREAK_END = re.compile(rf"((?:{LETTER}|[ऀ-෿])+)[{HYPHENS}]\s*$")
SENTENCE_END = re.compile(r"[.!?।॥。！？:;][\"'”’)\]]*\s*$")
VERB = re.compile(r"\b(?:shall|must|will|may|can|should|is|are|was|were|has|have|had|be|been)\b", re.I)
NUMBERED = re.compile(r"\S\s{2,}\d{1,4}\s*$")
OUTER_NO = re.compile(r"^\W*\d{1,4}\W+|\W+\d{1,4}\W*$")
LOOSE_NO = re.compile(r"(?<![a-z@$|])[\d.,/\-]*\d(?![a-z@$|])")
SENTENCE_START = re.compile(r"\W*(?:the|a|an|in|on|for|if|when|where|under|upon|since|before|every|besides|with|as|at|during|from|notwithstanding|dr|prof|shri)\b", re.I)
FOLD = str.maketrans("0@15968$|", "oalsgbbsl")
DIGIT_IN_WORD = re.compile(r"^[A-Za-z]*[A-Za-z][01569@$][a-z]{2,}$|^[A-Z]?[a-z]{2,}[01569@$][a-z]*$|^[015@][a-z]{3,}$")


def fold(s: str) -> str:
    """Lower case without free-standing numbers, digits inside words as the letters they are read for."""
    return LOOSE_NO.sub(" ", s.lower()).translate(FOLD)


def letters(line: str) -> str:
    """A line's wording with scanner confusions folded and outer page numbers and case dropped."""
    s = OUTER_NO.sub("", line.strip())
    s = "".join(WORD.findall(fold(s)))
    return s.replace("rn", "m").replace("ii", "u").replace("ri", "n").replace("cl", "d").replace("vv", "w").replace("li", "h").replace("ti", "h").replace("c", "e").replace("i", "l")


def title_like(line: str) -> bool:
    s = line.strip()
    if not 8 <= len(s) <= 120 or PAGE_NO.match(s) or VERB.search(s) or SENTENCE_START.match(s):
        return False
    first = next((c for c in s if c.isalnum() or c == "@"), "")
    return (first.isupper() or first.isdigit()) and not re.search(r"[!?;:,]$", s) and ". " not in OUTER_NO.sub("", s)


def ends(line: str) -> tuple[str, str]:
    """The words that a running header is known by across documents: its opening two and its last."""
    w = WORD.findall(fold(OUTER_NO.sub("", line.strip())))
    return " ".join(w[:2]), (w[-1] if w else "")


def edits(w: str) -> set[str]:
    """Words that one glyph edit makes of a read word."""
    out = set()
    for read, printed in GLYPHS:
        at = w.find(read)
        while at >= 0:
            out.add(w[:at] + printed + w[at + len(read) :])
            at = w.find(read, at + 1)
    if len(set(w) & set("0@1596$")) == 1:  # the same glyph misread throughout
        c = next(iter(set(w) & set("0@1596$")))
        out |= {w.replace(c, p) for r, p in GLYPHS if r == c}
    out.discard(w)
    return out


class Model:
    """Context vectors of the embedded words, and the map from mean contexts to word vectors."""

    def __init__(self, words: list[str] = (), ctx: np.ndarray | None = None, induce: np.ndarray | None = None):
        self.at = {w: i for i, w in enumerate(words)}
        self.ctx, self.induce = ctx, induce

    def fit(self, vec, around: list[str]) -> float:
        """Mean association of a word with the words around it, 0 where nothing is known."""
        js = [self.at[a] for a in around if a in self.at]
        return float(np.asarray(vec) @ self.ctx[js].mean(0)) if js and vec is not None and len(vec) else 0.0


class Lexicon:
    """Links of the words of a text: read word -> (its count, its vector, [(frequent word, count, vector)])."""

    def __init__(self, links: dict[str, tuple], model: Model, weight: float = 2.0):
        self.links, self.model, self.weight = links, model, weight

    def correct(self, token: str, around: list[str]) -> str | None:
        """The word a token misreads, the token itself with its glyphs replaced if it is a name, or None if it is no misreading."""
        low = token.lower()
        plain = low.isalpha() and low.isascii()
        if plain and len(low) < 3 or not any(c.isalpha() for c in low) or not plain and token[0].isupper() and token.isupper():
            return None
        link = self.links.get(low)
        if link is not None:
            n, vec, near = link
            m, a = self.model, self.weight
            own = np.log(RATIO * max(n, 1)) + a * m.fit(vec, around)
            best = max(((np.log(k) + a * m.fit(v, around), k, c) for c, k, v in near), default=(own - 1, 0, ""))
            if best[0] >= own:
                return best[2]
        if not plain and DIGIT_IN_WORD.match(token) and sum(c.isalpha() for c in token) >= 3:
            return token.translate(FOLD)
        return None


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    c: Counter = Counter()
    for pdf in batches:
        for t in pdf["text"]:
            if t:
                c.update(WORD.findall(JOIN.sub("", t).lower()))
        if len(c) > 300_000:
            yield pd.DataFrame({"w": list(c.keys()), "n": list(c.values())})
            c.clear()
    if c:
        yield pd.DataFrame({"w": list(c.keys()), "n": list(c.values())})


def word_counts(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """``w, n`` over all rows."""
    d = chunks.select(F.col(text_col).cast("string").alias("text"))
    return materialize(d.mapInPandas(_word_counts, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")), "counts")


def learn(chunks: DataFrame, counts: DataFrame, text_col: str = "text", embedded: int = 1_000, window: int = 3, dims: int = 32) -> Model:
    """Vectors of the most frequent words, over all rows; the driver holds an ``embedded`` x ``embedded`` table at most."""
    d = chunks.select(F.col(text_col).cast("string").alias("text"))
    words = [r.w for r in counts.where("n >= 2").orderBy(F.desc("n"), "w").limit(embedded).collect()]
    if len(words) < 10:
        return Model()
    ids, size = {w: i for i, w in enumerate(words)}, len(words)
    shared = chunks.sparkSession.sparkContext.broadcast(ids)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, m = shared.value.get, np.zeros(size * size, np.int64)
        for pdf in batches:
            flat: list[int] = []
            for t in pdf["text"]:
                if t:
                    flat.extend([get(w, -1) for w in WORD.findall(JOIN.sub("", t).lower())])
                    flat.extend([-1] * window)
            x = np.array(flat, np.int64)
            for k in range(1, window + 1):
                a, b = x[:-k], x[k:]
                ok = (a >= 0) & (b >= 0)
                m += np.bincount(a[ok] * size + b[ok], minlength=size * size)
        at = np.flatnonzero(m)
        if len(at):
            yield pd.DataFrame({"k": at, "n": m[at]})

    co = d.mapInPandas(pairs, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    m = np.zeros(size * size)
    m[co["k"].to_numpy()] = co["n"].to_numpy()
    m = m.reshape(size, size)
    m = m + m.T
    word, ctx = skip_gram_vectors(m, dims)
    mean = (m @ ctx) / np.maximum(m.sum(1, keepdims=True), 1)
    return Model(words, ctx, np.linalg.lstsq(mean, word, rcond=None)[0])


def induced_vectors(chunks: DataFrame, wanted: DataFrame, model: Model, text_col: str = "text", window: int = 3, limit: int = 300_000) -> DataFrame:
    """``w, vec`` of the wanted words, each from all places it stands in. Beyond ``limit`` words the sums of all words are taken and joined."""
    d = chunks.select(F.col(text_col).cast("string").alias("text"))
    if not model.at:
        return wanted.select("w", F.lit(None).cast("array<double>").alias("vec"))
    dims = model.ctx.shape[1]
    few = {r.w: i for i, r in enumerate(wanted.collect())} if small(wanted, limit) else None
    shared = chunks.sparkSession.sparkContext.broadcast((few, model))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        few, model = shared.value
        ids: dict[str, int] = few if few is not None else {}
        ctx = np.vstack([model.ctx, np.zeros((1, dims))]).astype(np.float32)  # the last row stands for words without a vector
        known = np.append(np.ones(len(model.ctx), np.float32), np.float32(0))
        none, get = len(model.ctx), model.at.get
        total, n = np.zeros((1024, dims)), np.zeros(1024)

        def out():
            seen = np.flatnonzero(n[: len(ids)])
            names = np.array(list(ids), object)[seen]
            return pd.DataFrame({"w": names, "n": n[seen], "v": pd.Series(list(total[seen]), dtype=object)})

        for big in batches:
            for lo in range(0, len(big), 1000):
                flat, target = [], []
                for t in big["text"].iloc[lo : lo + 1000]:
                    if t:
                        ws = WORD.findall(JOIN.sub("", t).lower())
                        flat.extend([get(w, none) for w in ws])
                        flat.extend([none] * window)
                        target.extend([ids.get(w, -1) for w in ws] if few is not None else [ids.setdefault(w, len(ids)) for w in ws])
                        target.extend([-1] * window)
                if not flat:
                    continue
                x, y = np.array([none] * window + flat + [none] * window), np.array(target)
                at = np.flatnonzero(y >= 0)
                s, k = np.zeros((len(at), dims), np.float32), np.zeros(len(at))
                for step in (*range(-window, 0), *range(1, window + 1)):
                    z = x[at + window + step]
                    s += ctx[z]
                    k += known[z]
                if len(ids) > len(n):
                    more = max(len(ids), 2 * len(n)) - len(n)
                    total, n = np.vstack([total, np.zeros((more, dims))]), np.append(n, np.zeros(more))
                order = np.argsort(y[at], kind="stable")
                who = y[at][order]
                cut = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.empty(0, int)
                if len(cut):
                    total[who[cut]] += np.add.reduceat(s[order], cut, axis=0)
                    n[who[cut]] += np.add.reduceat(k[order], cut)
            if few is None and len(ids) > 200_000:
                yield out()
                ids, total, n = {}, np.zeros((1024, dims)), np.zeros(1024)
        yield out()

    vs = [F.sum(F.element_at("v", i + 1)).alias(f"v{i}") for i in range(dims)]
    s = d.mapInPandas(sums, "w string, n double, v array<double>").groupBy("w").agg(F.sum("n").alias("n"), *vs)
    if few is None:
        s = s.join(wanted, "w", "left_semi")

    def induce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value[1]
        for pdf in batches:
            v = (pdf[[f"v{i}" for i in range(dims)]].to_numpy() @ model.induce) / (pdf[["n"]].to_numpy() + SHRINK)
            yield pd.DataFrame({"w": pdf["w"], "vec": pd.Series(list(v), dtype=object)})

    return s.mapInPandas(induce, "w string, vec array<double>")


def word_links(words: DataFrame, counts: DataFrame, chunks: DataFrame, model: Model) -> DataFrame:
    """``w, n, vec, near`` of the words (distinct, column ``w``) that one glyph edit turns into words ``WIDEST`` times as frequent."""

    def edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            e = [sorted(edits(w)) for w in pdf["w"]]
            yield pd.DataFrame({"w": np.repeat(pdf["w"].to_numpy(), [len(x) for x in e]), "c": [c for x in e for c in x]})

    pairs = words.mapInPandas(edited, "w string, c string")
    pairs = pairs.join(counts.where(F.col("n") >= LEAST).select(F.col("w").alias("c"), F.col("n").alias("k")), "c")
    pairs = pairs.join(counts, "w", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    pairs = materialize(pairs.where(F.col("k") >= WIDEST * F.col("n")), "links")
    vec = materialize(induced_vectors(chunks, pairs.select(F.explode(F.array("w", "c")).alias("w")).distinct(), model), "vectors")
    near = pairs.join(vec.select(F.col("w").alias("c"), F.col("vec").alias("v")), "c", "left").groupBy("w").agg(F.min("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "k", "v"))).alias("near"))
    return materialize(near.join(vec, "w", "left").select("w", "n", "vec", "near"), "lexicon")


def skip_gram_vectors(m: np.ndarray, dims: int, negatives: float = 2.0, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(word, context) vectors whose products approach PMI - log(negatives), by randomised subspace iteration on the positive part."""
    total = m.sum() or 1.0
    row, col = m.sum(1, keepdims=True) + 1e-9, (m.sum(0, keepdims=True) + 1e-9) ** 0.75
    col = col / col.sum() * total
    with np.errstate(divide="ignore"):
        x = np.maximum(np.log(m * total / (row * col) + 1e-12) - np.log(negatives), 0)
    q = np.random.default_rng(seed).standard_normal((len(m), min(dims + 8, len(m))))
    for _ in range(4):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    u, s, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    k = min(dims, len(s))
    r = np.sqrt(s[:k])
    return (q @ u[:, :k]) * r, vt[:k].T * r


def scanned_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``id, url, heading, text``: one row per chunk id of documents whose OCR flag is true."""
    urls = documents.where("is_ocr").select(F.col("url").cast("string").alias("url")).where("url is not null").distinct()
    c = chunks.select(F.col("chunk_id").cast("string").alias("id"), F.col("source_url").cast("string").alias("url"), F.col("section_heading").cast("string").alias("heading"), F.col("text").cast("string").alias("text"), F.col("date_scraped").alias("at"))
    c = c.where("id is not null and text is not null").join(F.broadcast(urls) if small(urls, 200_000) else urls, "url", "left_semi")
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc_nulls_last("at"), F.desc("text")))
    return materialize(c.withColumn("rn", last).where("rn = 1").select("id", "url", "heading", "text"), "scanned")


def header_evidence(scans: DataFrame, least_docs: int = 3) -> DataFrame:
    """``id, hs, openings, closings``: of each row's title-like lines, the wordings found twice or more in its document, and the openings
    and last words that such lines share over ``least_docs`` documents and that mostly belong to such lines."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, u, head, t in zip(pdf["id"], pdf["url"], pdf["heading"], pdf["text"]):
                own = letters(head or "")
                for line in t.split("\n"):
                    if title_like(line):
                        h = letters(line)
                        out.append((i, u, h, *ends(line), bool(h) and h != own and len(h) >= 8))
            if out:
                yield pd.DataFrame(out, columns=["id", "url", "h", "opening", "closing", "counts"])

    long = materialize(scans.mapInPandas(lines, "id string, url string, h string, opening string, closing string, counts boolean"), "titles")
    rec = long.where("counts").groupBy("url", "h").agg(F.count("*").alias("n"), F.min("opening").alias("opening"), F.min("closing").alias("closing"))
    rec = materialize(rec, "recurring")
    marks = rec.select("url", "n", F.explode(F.array(F.struct(F.lit("o").alias("k"), F.col("opening").alias("v")), F.struct(F.lit("c").alias("k"), F.col("closing").alias("v")))).alias("m")).select("url", "n", "m.k", "m.v")
    per = marks.groupBy("k", "v").agg(F.countDistinct(F.when(F.col("n") > 1, F.col("url"))).alias("docs"), F.countDistinct("url").alias("every"))
    won = materialize(per.where((F.col("docs") >= least_docs) & (F.col("docs") >= 0.5 * F.col("every")) & (F.col("v") != "")).select("k", "v"), "marks")

    def known(table: DataFrame, keys: list[str], kind: str) -> DataFrame:
        x = long.select("id", *keys)
        x = x.join(F.broadcast(table), keys) if small(table) else salted(x, table, keys, "id")
        return x.select("id", F.lit(kind).alias("kind"), F.col(keys[-1]).alias("v"))

    hits = known(rec.where("n > 1").select("url", "h"), ["url", "h"], "h")
    hits = hits.unionByName(known(won.where("k = 'o'").select(F.col("v").alias("opening")), ["opening"], "o"))
    hits = hits.unionByName(known(won.where("k = 'c'").select(F.col("v").alias("closing")), ["closing"], "c"))
    of = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("v")))
    return hits.groupBy("id").agg(of("h").alias("hs"), of("o").alias("openings"), of("c").alias("closings"))


def classify(lines: list[str], heading: str | None, recurring: set[str], openings: set[str], closings: set[str]) -> list[str]:
    """Per line: '' (blank), 'page_no', 'header' or 'text'."""
    # a line of over 200 characters is no page number, whatever its marks
    kind = ["" if not x.strip() else "page_no" if len(x) <= 200 and PAGE_NO.match(x) else "text" for x in lines]
    own = letters(heading or "")
    cand = [k == "text" and title_like(x) for k, x in zip(kind, lines)]
    full = [i for i, k in enumerate(kind) if k]
    where = {i: p for p, i in enumerate(full)}
    for i in full:
        if not cand[i]:
            continue
        h = letters(lines[i])
        p = where[i]
        before, after = (full[p - 1] if p else None), (full[p + 1] if p + 1 < len(full) else None)
        alone = (i == 0 or not lines[i - 1].strip()) and (i + 1 == len(lines) or not lines[i + 1].strip())
        if h == own and (p == 0 or alone):
            continue
        if h in recurring:
            kind[i] = "header"
            continue
        o, c = ends(lines[i])
        known = o in openings or c in closings
        near_no = (before is not None and kind[before] == "page_no") or (after is not None and kind[after] == "page_no")
        prev = next((lines[full[q]] for q in range(p - 1, -1, -1) if kind[full[q]] == "text"), None)
        nxt = next((lines[full[q]] for q in range(p + 1, len(full)) if kind[full[q]] == "text"), None)
        cut = prev is not None and not SENTENCE_END.search(prev) and nxt is not None and nxt.lstrip()[:1].islower()
        short = len(WORD.findall(lines[i])) <= 14
        numbered = _closed(lines[i]) and NUMBERED.search(lines[i]) is not None
        last = after is None and p > 0 and not alone and _closed(lines[i])
        if short and (numbered or last):
            kind[i] = "header"
        elif known and short and (near_no or cut or not (p == 0 and alone)):
            kind[i] = "header"
        elif short and not alone and (cut and _closed(lines[i]) or near_no and _closed(lines[i])):
            kind[i] = "header"
    return kind


def _closed(line: str) -> bool:
    """Ends like a title: on a number, a bracket or a capitalised word, and none of its words is a sentence's."""
    s = OUTER_NO.sub("", line.strip()) if not re.search(r"\d{4}-\d\d\W*$", line) else line.strip()
    w = s.split()
    return bool(w) and (s.endswith(")") or w[-1][:1].isupper() or w[-1][:1].isdigit()) and len(w) >= 3


def broken_words(lines: list[str], kind: list[str]) -> dict[int, tuple[int, int, str, str, int]]:
    """Line -> (next line of text, where the word begins, its two parts, where the second ends) of every word broken at a line end."""
    run, out = [i for i, k in enumerate(kind) if k == "text"], {}
    for i, j in zip(run, run[1:]):
        m = BREAK_END.search(lines[i])
        nxt = m and re.match(rf"\s*((?:{LETTER}|[ऀ-෿]|[@01569])+)", lines[j])
        if nxt and (nxt.group(1)[0].islower() or not nxt.group(1)[0].isupper() or m.group(1).isupper()):
            pre = re.search(r"[0-9A-Za-z@]+$", lines[i][: m.end(1)])
            out[i] = j, (pre or m).start(0 if pre else 1), pre.group() if pre else m.group(1), nxt.group(1), nxt.end()
    return out


def words_to_link(text: str, kind: list[str]) -> list[str]:
    """Distinct words of the lines of text, broken ones joined, in lower case."""
    lines = text.split("\n")
    out = {m.lower() for x, k in zip(lines, kind) if k == "text" for m in TOKEN.findall(x)}
    out |= {(b[2] + b[3]).lower() for b in broken_words(lines, kind).values()}
    return sorted(w for w in out if len(w) >= 2 and not w.isdigit())


def find_noise(text: str, kind: list[str], lex: Lexicon) -> tuple[list[tuple[int, str]], list[str]]:
    """((line number, kind) of every case, repaired lines with furniture as empty strings)."""
    lines = text.split("\n")
    out = [(i, k) for i, k in enumerate(kind) if k in ("page_no", "header")]
    fixed = [x if k == "text" else "" for x, k in zip(lines, kind)]
    broken, begin, bad = broken_words(lines, kind), {}, set()
    for i, k in enumerate(kind):
        if k != "text":
            continue
        line = lines[i]
        body = line
        if i in broken:
            j, at, first, rest, end = broken[i]
            out.append((i, "hyphen"))
            body, tail = line[:at], lines[j][end:]
            whole = first + rest
            c = lex.correct(whole, [x.lower() for x in TOKEN.findall(body)[-3:] + TOKEN.findall(tail)[:3]])
            if c and c != whole.lower():
                where = next((q for q, (x, y) in enumerate(zip(whole.lower(), c)) if x != y), len(whole) - 1)
                bad.add(i if where < len(first) else j)
            cling = re.match(r"(\S*)\s?", tail)  # marks after the word move with it
            fixed[i] = line[begin.get(i, 0) : at] + (c or whole) + cling.group(1)
            begin[j] = end + cling.end()
            fixed[j] = lines[j][begin[j] :]
        spans = [(x.start(), x.end()) for x in LINK.finditer(body)] if "/" in body or "www" in body else []
        toks = list(TOKEN.finditer(body))
        if i in begin and toks:
            toks = toks[1:]
        lows = [x.group().lower() for x in toks]
        for q, t in enumerate(toks):
            w = t.group()
            if (lows[q] not in lex.links and w.isalpha()) or any(a <= t.start() < b for a, b in spans):
                continue
            c = lex.correct(w, lows[max(0, q - 3) : q] + lows[q + 1 : q + 4])
            if c:
                bad.add(i)
                fixed[i] = fixed[i].replace(w, c.capitalize() if w[:1].isupper() else c, 1)
    out += [(i, "misread") for i in bad]
    return out, fixed


def reflow(lines: list[str], kinds_blank: list[bool]) -> str:
    """Joins lines to paragraphs; a blank line ends one only after a finished sentence or a title, so breaks at page turns heal."""
    paras, cur = [], ""
    for x, blank in zip(lines, kinds_blank):
        s = " ".join(x.split())
        if s:
            cur = f"{cur} {s}" if cur else s
        elif blank and cur and (SENTENCE_END.search(cur) or title_like(cur)):
            paras.append(cur)
            cur = ""
    if cur:
        paras.append(cur)
    return "\n\n".join(paras)


def repair(chunks: DataFrame, documents: DataFrame, text: bool = False) -> DataFrame:
    """``id, line_no, kind`` of the noise in scanned chunks, or with ``text`` ``id, text`` repaired."""
    scans = scanned_chunks(chunks, documents)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [[set(x) if x is not None else set() for x in pdf[c]] for c in ("hs", "openings", "closings")]
            kinds = [classify(t.split("\n"), head, *known) for head, t, *known in zip(pdf["heading"], pdf["text"], *sets)]
            yield pd.DataFrame({"id": pdf["id"], "text": pdf["text"], "kinds": kinds, "words": [words_to_link(t, k) for t, k in zip(pdf["text"], kinds)]})

    lines = scans.join(header_evidence(scans), "id", "left").mapInPandas(read, "id string, text string, kinds array<string>, words array<string>")
    lines = materialize(lines, "read")
    counts = word_counts(chunks)
    model = learn(chunks, counts)
    words = lines.select("id", F.explode("words").alias("w"))
    links = word_links(words.select("w").distinct(), counts, chunks, model)
    found = words.join(F.broadcast(links), "w") if small(links, 20_000) else salted(words, links, ["w"], "id")
    found = found.groupBy("id").agg(F.collect_list(F.struct("w", "n", "vec", "near")).alias("links"))
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            out = []
            for i, t, kinds, links in zip(pdf["id"], pdf["text"], pdf["kinds"], pdf["links"]):
                table = {x["w"]: (x["n"], x["vec"], [(y["c"], y["k"], y["v"]) for y in x["near"]]) for x in links} if links is not None else {}
                cases, fixed = find_noise(t, list(kinds), Lexicon(table, model))
                if text:
                    out.append((i, reflow(fixed, [not x.strip() for x in t.split("\n")])))
                else:
                    out.extend((i, n, k) for n, k in cases)
            if out:
                yield pd.DataFrame(out, columns=["id", "text"] if text else ["id", "line_no", "kind"])

    d = lines.join(found, "id", "left").select("id", "text", "kinds", "links")
    return d.mapInPandas(run, "id string, text string" if text else "id string, line_no int, kind string")
