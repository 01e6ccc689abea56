"""Sentence boundaries by a hidden-event n-gram language model.

Places where a boundary token may stand between two words (after terminal marks, at spaces inside scripts that write none between words) are
the hidden events; blank lines and the end of the text are observed ones. The model is counted over all documents: how often a left word
with its mark is followed by an event, the words that follow an event, the words that follow each left word without one, and how many
words units have between boundaries that are beyond doubt. Expectation maximisation starts from the observed events and runs on the
aggregated n-gram counts. Forward-backward posteriors over each paragraph's events decide: the length of the unit between one boundary
and the next, against what chance would give, couples all of them.

Bounds, all of the model and none of the data: words outside the ``vocabulary`` most frequent ones count by their shape, and of the
contexts the ``max_contexts`` most frequent keep their words while the rest count by shape; unit lengths count up to ``LONGEST`` words.

Defined results: null or blank text has no unit; a unit ends after its last visible character; repeated document ids give the units of
each row once; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CLOSE = "\"'”’)\\]»」』）】›"
CLOSERS = CLOSE.replace("\\", "")
OPEN = "\"'“‘(\\[«「『（【‹"
WIDE = "。！？｡"
CJK = "぀-ヿ㐀-鿿"
NOSPACE = re.compile("[฀-໿က-႟ក-៿]")
BREAK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
MARK = re.compile(rf"[.!?…؟۔।॥{WIDE}]+[{CLOSE}]*")
SPACE_EVENT = re.compile("(?<=[฀-໿က-႟ក-៿])[  ​　]+(?=\\S)")
CJK_SPACE = re.compile(f"(?<=[{CJK}])[ \u3000]+(?=[{CJK}])")
LONGEST = 96
DIGITS = re.compile(r"\d+")
RIGHT = re.compile(rf"\s*[{OPEN}]*(\S+)")
LETTER = re.compile(r"[^\W\d_]")
IS_CJK = re.compile(f"[{CJK}]")


@lru_cache(200_000)
def shape(w: str) -> str:
    """Class of a word: script, case, digits, length (short or not), inner marks."""
    if not w:
        return "<>"
    if w[0] == "<" and w[-1] == ">" and len(w) < 9:
        return w
    c = w[0]
    if IS_CJK.match(c):
        return "<cjk>"
    if ord(c) > 0x0370:
        return f"<o{ord(c) >> 7}>"
    kind = "0" if c.isdigit() else "X" if c.isupper() else "x" if c.islower() else "#"
    n = "1" if len(w.rstrip(".")) == 1 else "s" if len(w) <= 4 else "l"
    return f"<{kind}{n}{'.' if '.' in w.rstrip('.') else ''}>"


@lru_cache(200_000)
def script(w: str) -> str:
    c = shape(w)
    return c if c == "<cjk>" or c.startswith("<o") else "<latin>"


def right_word(text: str, at: int) -> str:
    m = RIGHT.match(text, at, at + 48)
    if not m:
        return ""
    return clip(m.group(1))


def clip(w: str) -> str:
    """A word as the model counts it: digits as 0, end marks inside a unit dropped; of scripts without spaces its first characters."""
    if w.isascii():
        w = w.rstrip(",;:")
        return w[:24] if w.isalpha() else DIGITS.sub("0", w)[:24]
    if IS_CJK.match(w):
        return w[:2]
    if NOSPACE.match(w):
        return w[:4]
    return DIGITS.sub("0", w.rstrip(",;:"))[:24]


def left_word(text: str, start: int) -> str:
    w = text[max(0, start - 24) : start]
    if not w or w[-1].isspace():
        return ""
    w = w.split()[-1]
    if not w.isascii() and (IS_CJK.match(w[-1]) or NOSPACE.match(w[-1])):
        return w[-2:]
    return w if w.isalpha() else DIGITS.sub("0", w.lstrip("(\"'“‘[«「"))


def events(text: str) -> list[tuple[int, str, str, str]]:
    """Possible boundaries inside a paragraph without white space around it: (offset after the mark and closers, left word, mark class, right word)."""
    out = []
    n = len(text)
    for m in MARK.finditer(text):
        i, j = m.span()
        mark = m.group()
        if j < n and not text[j].isspace():
            nxt = text[j]
            if mark[0] in ".!?…" and not IS_CJK.match(nxt) and (i == 0 or not IS_CJK.match(text[i - 1])):
                # a space may be missing, but only between a word and a word that can begin a unit
                if i == 0 or text[i - 1].isspace() or len(mark) > 2 or not (nxt.isupper() or nxt in "\"“(" or ord(nxt) > 0x0900) or not (text[i - 1].islower() or text[i - 1].isdigit() or text[i - 1] in CLOSE):
                    continue
        if j >= n:
            continue
        core = mark.rstrip(CLOSERS) if len(mark) > 1 else mark
        cls = ("E" if core[:2] in ("..", "…", "……") or core[0] == "…" else core[-1]) + ("q" if len(core) < len(mark) else "") + ("" if text[j].isspace() else "j")
        out.append((j, left_word(text, i), cls, right_word(text, j)))
    if text.isascii():
        return out
    if NOSPACE.search(text):
        for m in SPACE_EVENT.finditer(text):
            out.append((m.start(), left_word(text, m.start()), "_", right_word(text, m.end())))
        out.sort()
    if IS_CJK.search(text):
        more = [(m.start(), left_word(text, m.start()), "~", right_word(text, m.end())) for m in CJK_SPACE.finditer(text)]
        if more:
            out = sorted(out + more)
    return out


def sure(left: str, mark: str, right: str) -> bool | None:
    """Whether a place is, or is no, boundary beyond doubt by its form alone; None if it may be either."""
    if right[:1].islower():
        return False
    if mark[0] in "।॥۔؟。！？":
        return None if "q" in mark else True
    if mark in ("!", "?"):
        return True
    return True if mark == "." and len(left) > 3 and left.isalpha() and left.islower() and right[:1].isupper() else None


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what blank lines separate, without white space around."""
    at = 0
    for m in BREAK.finditer(text):
        yield from _strip(text, at, m.start())
        at = m.end()
    yield from _strip(text, at, len(text))


def _strip(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    part = text[a:b]
    core = part.strip()
    if core:
        s = a + len(part) - len(part.lstrip())
        yield s, s + len(core)


def _last(par: str) -> tuple[str, str]:
    """Left word and mark class of a paragraph's observed end."""
    core = par.rstrip("\"'”’)]»」』）】›")
    stem = core.rstrip(".!?…؟۔।॥" + WIDE)
    mark = core[len(stem) :]
    if not mark:
        return left_word(par, len(par)), "0"
    return left_word(stem, len(stem)), ("E" if mark[:2] == ".." or mark[0] == "…" else mark[-1]) + ("q" if len(core) < len(par) else "")


def spaced(par: str) -> str:
    """The script of a paragraph with spaces between its words, by its first letter; empty if it has another kind of script."""
    if par.isascii():
        return "<latin>"
    if IS_CJK.search(par) or NOSPACE.search(par):
        return ""
    m = LETTER.search(par)
    return script(m.group()) if m else "<latin>"


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    c: Counter = Counter()

    def out():
        keys = list(c)
        return pd.DataFrame({"kind": [k[0] for k in keys], "l": [k[1] for k in keys], "mark": [k[2] for k in keys], "r": [k[3] for k in keys], "n": [c[k] for k in keys]})

    for pdf in batches:
        words: Counter = Counter()
        for text in pdf["text"]:
            if not text:
                continue
            for a, b in paragraphs(text):
                par = text[a:b]
                w = par.split()
                words.update(w)
                c["s", "", "", right_word(par, 0)] += 1
                left, mark = _last(par)
                if mark != "0":
                    c["e", left, mark, ""] += 1
                ev = events(par)
                for _, left, mark, right in ev:
                    c["c", left, mark, right] += 1
                if ev and (kind := spaced(par)):
                    begin, clean, inner = 0, True, False
                    for at, left, mark, right in ev:
                        known = sure(left, mark, right)
                        if known:
                            if clean:
                                c["d", kind, str(min(len(par[begin:at].split()), LONGEST)), ""] += 1
                            begin, clean, inner = at, True, True
                        elif known is None:
                            clean = False
                    if clean and inner:
                        c["d", kind, str(min(len(par[begin:].split()), LONGEST)), ""] += 1
        for w, n in words.items():
            w = w.lstrip("\"'“‘([«「『（")
            if not w.isascii() and IS_CJK.match(w):  # no spaces: every pair of characters
                for k in range(len(w) - 1):
                    c["u", "", "", w[k : k + 2]] += n
                continue
            c["u", "", "", clip(w)] += n
        if len(c) > 200_000:
            yield out()
            c.clear()
    if c:
        yield out()


class Model:
    """Event model: P(event | left, mark), P(right | event), P(right | left, no event) with back-off to shapes."""

    def __init__(self, rows: list[tuple[str, str, str, str, int]], vocabulary: set[str], rounds: int = 8):
        self.voc = vocabulary
        self.uni, self.all_shape = Counter(), Counter()
        start, ends, ctx, lengths = Counter(), Counter(), Counter(), {}
        for kind, left, mark, right, n in rows:
            if kind == "s":
                start[right] += n
            elif kind == "d":
                lengths.setdefault(left, Counter())[int(mark)] += n
            elif kind == "u":
                self.uni[right] += n
                self.all_shape[shape(right)] += n
            elif kind == "e":
                ends[left, mark] += n
            else:
                ctx[left, mark, right] += n
        self.by_length = {k: length_odds(c) for k, c in lengths.items()}
        keys = list(ctx)
        n = np.array([ctx[k] for k in keys], float)
        left_seen, left_all = Counter(), Counter()
        for (a, m), k in ends.items():
            left_seen[a] += k
            left_all[a] += k
        for (a, m, r), k in ctx.items():
            left_all[a] += k
        # start: a left word that almost never ends a paragraph is taken for an abbreviation, a lower-case right word for no beginning
        post = np.array([self._first(a, m, r, ends[a, m.rstrip("jq")], left_seen[a], left_all[a]) for a, m, r in keys])
        clear = post > 0.99  # kept as seeds: else fixed phrases across a boundary would be learnt as phrases
        fixed = self._counts(start, ends)
        self._add(fixed, [k for k, x in zip(keys, clear) if x], n[clear], post[clear])
        keys, n, post = [k for k, x in zip(keys, clear) if not x], n[~clear], post[~clear]
        for _ in range(rounds):
            now = tuple(x.copy() for x in fixed)
            self._add(now, keys, n, post)
            self._fit(now)
            new = np.array([1 / (1 + math.exp(-self.score(*k))) for k in keys])
            moved = float(np.abs(new - post) @ n) if keys else 0.0
            post = new
            if moved <= 1e-4 * n.sum():
                break

    @staticmethod
    def _first(a: str, m: str, r: str, same: int, seen: int, every: int) -> float:
        if m == "~":  # a space in a script that has its own marks
            return 0.1
        if m == "_" or m[0] in "。！？؟۔।॥":
            return 0.5 if "q" in m else 0.995
        if m[0] == "E":
            return 0.7 if same else 0.05
        if not r or r[:1].islower():
            return 0.02
        if m[0] in "!?":
            return 0.99
        return 0.02 if every >= 20 and seen < 0.02 * every and (len(a) <= 6 or "." in a) else 0.3 if len(a) <= 3 and seen < 0.05 * every + 1 else 0.995

    @staticmethod
    def _counts(start: Counter, ends: Counter) -> tuple[Counter, ...]:
        """(events, places, begins, followers inside units, followers in all) of what is observed."""
        ev, every = Counter(), Counter()
        for (a, m), k in ends.items():  # an observed end counts as an event of its left word
            for x in ((a, m), (shape(a), m)):
                ev[x] += k
                every[x] += k
        return ev, every, Counter(start), Counter(), Counter()

    @staticmethod
    def _add(counts: tuple[Counter, ...], keys, n, post) -> None:
        ev, every, st, no, no_l = counts
        for (a, m, r), k, p in zip(keys, n.tolist(), post.tolist()):
            core, sa, sr, g = m.rstrip("j"), shape(a), shape(r), script(r)
            e, q, t = k * p, k * (1 - p), "q" in m
            for x in ((a, core), (sa, m), ("*", m), *(((sa, core),) if core != m else ())):
                ev[x] += e
                every[x] += k
            st[r] += e
            for left in (a, sa):
                no[left, t, r] += q
                no[left, t, sr] += q
                no_l[left, t, g] += q

    def _fit(self, counts: tuple[Counter, ...]) -> None:
        self.ev, self.all, self.st, self.no, self.no_l = counts
        # words are compared within their script, which an event does not change
        self.n_st, self.n_uni, self.st_shape, self.uni_shape = Counter(), Counter(), Counter(), Counter()
        for r, k in self.st.items():
            self.st_shape[shape(r)] += k
            self.n_st[script(r)] += k
        # inside units: what is left of all words once those after events are taken away
        self.inner = {r: max(k - self.st[r], 0.0) for r, k in self.uni.items()}
        for r, k in self.inner.items():
            self.uni_shape[shape(r)] += k
            self.n_uni[script(r)] += k

    def score(self, a: str, m: str, r: str) -> float:
        """Log odds of an event between left word and right word, as if no other event were near."""
        mark, t, g, sa, sr = m.rstrip("j"), "q" in m, script(r), shape(a), shape(r)
        base = (self.ev["*", m] + 1) / (self.all["*", m] + 2)
        p = (self.ev[sa, m] + 4 * base) / (self.all[sa, m] + 4)
        p = (self.ev[a, mark] + 3 * p) / (self.all[a, mark] + 3)
        p = min(max(p, 1e-4), 1 - 1e-4)
        inner = self.inner.get(r, 0.0)
        of_shape = (self.uni[r] + 0.5) / (self.all_shape[sr] + 50)  # the word within its shape
        u = (inner + 2 * self.uni_shape[sr] / (self.n_uni[g] + 1) * of_shape) / (self.n_uni[g] + 2)
        s = (self.st[r] + 2 * (self.st_shape[sr] + 0.01) / (self.n_st[g] + 1) * of_shape) / (self.n_st[g] + 2)
        c = (self.no[sa, t, r] + 100 * u) / (self.no_l[sa, t, g] + 100)
        c = (self.no[a, t, r] + 0.3 * self.no[a, t, sr] * of_shape + 10 * (c + u) / 2) / (self.no_l[a, t, g] * 1.3 + 10)
        return math.log(p / (1 - p)) + math.log((s + 1e-9) / (c + 1e-9))

    def cls(self, w: str) -> str:
        return w if w in self.voc else shape(w)

    def units(self, text: str) -> list[int]:
        out = []
        memo = self.__dict__.setdefault("memo", {})
        for a, b in paragraphs(text):
            par = text[a:b]
            ev = events(par)
            if ev:
                sc = []
                for _, left, mark, right in ev:
                    k = (left, mark, right)
                    x = memo.get(k)
                    if x is None:
                        if len(memo) > 300_000:
                            memo.clear()
                        x = memo[k] = self.score(self.cls(left), mark, self.cls(right))
                    sc.append(x)
                words, odds = None, None
                if any(abs(x) < SURE for x in sc) and (odds := self.by_length.get(spaced(par))):
                    cut = [0, *(x[0] for x in ev), len(par)]
                    words = [len(par[x:y].split()) for x, y in zip(cut, cut[1:])]
                for (end, *_), p in zip(ev, posteriors(sc, words, odds)):
                    if p > 0.5:
                        out.append(a + end)
            out.append(b)
        return out


def length_odds(lengths: Counter) -> list[float]:
    """Log odds of a unit's number of words, against boundaries that fall by chance with the same mean length. Neighbouring lengths are
    taken together, more of them the longer they are."""
    total = sum(lengths.values())
    if total < 100:
        return [0.0] * (LONGEST + 1)
    p = min(max(total / sum(k * n for k, n in lengths.items()), 1e-3), 0.99)
    out = [0.0]
    for k in range(1, LONGEST + 1):
        lo, hi = max(1, k - k // 4), min(LONGEST, k + k // 4)
        seen = sum(lengths[x] for x in range(lo, hi + 1))
        chance = (1 - p) ** (lo - 1) - (0 if hi == LONGEST else (1 - p) ** hi)
        out.append(min(max(math.log((seen + 2 * chance) / ((total + 2) * chance)), -2.0), 2.0))
    return out


SURE = 6.0  # log odds beyond which no unit length can turn an event: it touches three lengths, each of 2 at most


def add_logs(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def posteriors(score: list[float], words: list[int] | None, by_length: list[float] | None) -> list[float]:
    """Forward-backward over a paragraph's events: ``score`` are their own log odds, ``words`` the words before, between and after them,
    ``by_length`` the log odds of a unit by its words. Without words the events stand alone. Sure boundaries part the paragraph; between two
    of them every way to place the others is summed up, units longer than the table alike."""
    out = [1 / (1 + math.exp(-min(max(x, -60), 60))) for x in score]
    if words is None:
        return out
    at = [words[0]]
    for w in words[1:]:
        at.append(at[-1] + w)
    edges = [(-1, 0)] + [(i, at[i]) for i, x in enumerate(score) if x >= SURE] + [(len(score), at[-1])]
    for (a, begin), (b, end) in zip(edges, edges[1:]):
        open_ = [i for i in range(a + 1, b) if score[i] > -SURE]
        if open_:
            for i, p in zip(open_, _chain([score[i] for i in open_], [begin, *(at[i] for i in open_), end], by_length)):
                out[i] = p
    return out


def _chain(score: list[float], at: list[int], by_length: list[float]) -> list[float]:
    def forward(score, at):
        logs, far, k = [0.0], -math.inf, 0  # far: all begins too far back for the table to tell them apart
        for j in range(1, len(at)):
            while k < j and at[j] - at[k] >= LONGEST:
                far = add_logs(far, logs[k])
                k += 1
            x = far + by_length[LONGEST]
            for i in range(k, j):
                x = add_logs(x, logs[i] + by_length[at[j] - at[i]])
            logs.append(x + (score[j - 1] if j <= len(score) else 0.0))
        return logs

    f = forward(score, at)
    b = forward(score[::-1], [at[-1] - x for x in reversed(at)])[::-1]
    return [math.exp(min(f[i + 1] + b[i + 1] - x - f[-1], 0.0)) for i, x in enumerate(score)]


def fit(docs: DataFrame, text_col: str = "text", vocabulary: int = 20_000, max_contexts: int = 200_000) -> Model:
    """Counts over all documents in Spark; only the bounded tables of the model come to the driver."""
    raw = materialize(docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(_count, "kind string, l string, mark string, r string, n bigint").groupBy("kind", "l", "mark", "r").agg(F.sum("n").alias("n")), "ngrams")
    seen = raw.where("kind = 'u'").select(F.col("r").alias("w"), "n").unionByName(raw.where("kind in ('c','e')").groupBy(F.col("l").alias("w")).agg(F.sum("n").alias("n")))
    voc = {x.w for x in seen.groupBy("w").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.desc("n"), "w").limit(vocabulary).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(voc)

    @F.pandas_udf("string")
    def cls(s: pd.Series) -> pd.Series:
        v = shared.value
        return s.map(lambda w: w if w in v or w == "" else shape(w))

    rows = raw.select("kind", cls("l").alias("l"), "mark", cls("r").alias("r"), "n").groupBy("kind", "l", "mark", "r").agg(F.sum("n").alias("n"))
    rows = materialize(rows, "contexts")
    top = [tuple(x) for x in rows.orderBy(F.desc("n"), "kind", "l", "mark", "r").limit(max_contexts).collect()]
    rest = rows.count() - len(top)
    if rest > 0:  # what does not fit counts by shape
        @F.pandas_udf("string")
        def by_shape(s: pd.Series) -> pd.Series:
            return s.map(lambda w: w if w == "" or w[0] == "<" else shape(w))

        # the rows after the last kept one in the same order, so ties at the cut count as well
        *at, least = top[-1]
        key = F.struct("kind", "l", "mark", "r")
        after = (F.col("n") < least) | ((F.col("n") == least) & (key > F.struct(*[F.lit(x).alias(k) for k, x in zip(("kind", "l", "mark", "r"), at)])))
        tail = rows.where(after).select("kind", by_shape("l").alias("l"), "mark", by_shape("r").alias("r"), "n")
        top += [tuple(x) for x in tail.groupBy("kind", "l", "mark", "r").agg(F.sum("n").alias("n")).collect()]
    return Model(top, voc)


def split(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, end_char``: one row per unit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            ids, ends = [], []
            for d, text in zip(pdf["doc_id"], pdf["text"]):
                if text:
                    u = model.units(text)
                    ids.extend([d] * len(u))
                    ends.extend(u)
            if ids:
                yield pd.DataFrame({"doc_id": ids, "end_char": ends})

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return d.mapInPandas(run, "doc_id bigint, end_char bigint")
