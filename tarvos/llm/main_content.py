"""Main content of web pages by consensus paths per site.

The pages here come as text, one block a line, so a container is a line and its generalised tag-class path is what identifies its slot in a
layout whatever the page: the line's wording (digits, case and marks dropped; a sentence keeps its digits), and two heads, the short one
its first two words, the long one what stands before a colon or else its first four words, with the site's own name masked. Every
container is scored by itself: a fixed word list scores layout, a finished sentence or a long line content. Scores only vote: a wording
that stands on a share of a site's pages, or a head most of whose scored containers on the site score as layout, wins as layout; sites
with too few scored containers under a head go by the votes of all sites. Pages are then read again and each line, sentences too, goes by
the winning path, its wording before its long head before its short one; a line without a winning path is content, whatever words it holds.
A teaser's items go with their label.

Defined results: blank lines are neither; rows without text or host have no layout lines; repeated rows are reported once; extra columns are
ignored; a site with fewer than ``least`` pages is judged by the votes over all sites.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .site_lines import key, rows_of, salted, site, site_sizes, small, with_flags, wording

# Words that head layout blocks of web pages, by kind.
BREADCRUMB = r"(?:you are here|home\s*[>»/›:]|breadcrumbs?\b)"
LIST_LABEL = r"(?:popular now|most (?:read|popular|viewed)|see also|also read|read also|read more|related(?: links| pages| articles| stories)?|in this section|more from|recommended|you may also like|latest news)\b"
LABEL = r"(?:quick poll|trending(?: now)?|sponsored(?: content)?|advertisement|advert|promoted|webcast of|watch live)\b"
TAGS = r"(?:tags?|keywords|filed under|categories|topics)\s*:"
PAGER = r"(?:previous|next|older|newer)\s*(?::|page\b|post\b)"
SHARE = r"(?:share (?:this|on|via)|print\s*\||follow us|subscribe to|like what you read|like us|tell a friend|was this page|email this|sign up for)"
BYLINE = r"(?:posted (?:by|on)\b|published (?:under|by|on)\b|written by\b|last (?:updated|modified|reviewed)\b|page (?:reviewed|updated)\b|updated on\b|visitors? (?:to|count)\b)"
LEGAL = r"(?:©|\(c\) \d{4}|copyright\b|all rights reserved|disclaimer\b\s*:|site managed by|designed and (?:hosted|developed)|content (?:owned|managed|provided) by|powered by|terms (?:of use|and conditions)|privacy policy)"
HEADS = re.compile("|".join(f"(?:{k})" for k in (BREADCRUMB, LIST_LABEL, LABEL, TAGS, PAGER, SHARE, BYLINE, LEGAL)))
INSIDE = ("cookie", "accept all", "manage choices", "consent settings", "consent preferences", "your privacy matters", "your privacy is important", "close this banner", "preferences may be changed")
INSIDE_RE = re.compile(r"^follow\b.*\bfor updates$|^join the .*\bchannel$|\bread [\d,]+ times$|\bterms of use apply$")
ENDINGS = ("for updates", "channel", "times", "terms of use apply")  # every alternative of the pattern ends so
TEASER = re.compile(LIST_LABEL)
EDGES = "-*|»›•·!.,:;>«"
TRAILERS = "|»›!.•·«"
STOPS = frozenset(".!?।॥。！？")
CLOSERS = "'\")”’]"
BULLET = re.compile(r"^\s*[›»>]\s*\S")
NUMBERED = re.compile(r"^\d+[.)]\s|\d\s*[KM]B\)\s*$", re.I)
DIGITS = re.compile(r"\d+")
NOT_WORD = re.compile(r"[\W_]+")
FRESH = re.compile(r"\s*\((?:new|updated|hot)\)\s*$|\s+\d{1,4}[/.\-]\d{1,2}[/.\-]\d{1,4}\s*$", re.I)


def core(line: str) -> str:
    """A line without bullets, bars and stray marks around it."""
    s = line.strip()
    if s and s[0] in EDGES:
        s = s.lstrip(EDGES + " \t") or s
    while len(s) > 1 and s[-1] in TRAILERS and (s[-1] in "|»›•·«" or s[-2].isspace()):
        s = s[:-1].rstrip()
    return " ".join(s.split()) if "  " in s or "\t" in s else s


def cue(low: str) -> bool:
    """Whether a lower-case core opens or reads like layout."""
    if HEADS.match(low):
        return True
    for k in INSIDE:
        if k in low:
            return True
    return low.endswith(ENDINGS) and INSIDE_RE.search(low) is not None


def is_sentence(c: str, n: int) -> bool:
    last = c[-1] if c[-1] not in CLOSERS else c.rstrip(CLOSERS)[-1:]
    return n >= 6 and last in STOPS


class Reader:
    """(core, sentence, score, wording key, short head key, long head key) of lines; short lines are remembered, as layout repeats."""

    def __init__(self):
        self.memo: dict[tuple[str, str], tuple] = {}

    def __call__(self, line: str, names: str) -> tuple:
        k = (line, names)
        got = self.memo.get(k)
        if got is None:
            got = self.read(line, names)
            if len(line) < 140:
                if len(self.memo) > 300_000:
                    self.memo.clear()
                self.memo[k] = got
        return got

    @staticmethod
    def read(line: str, names: str) -> tuple:
        c = core(line)
        if not c:
            return c, False, 0, None, None, None
        n = c.count(" ") + 1
        sentence = is_sentence(c, n)
        # negative for layout, positive for content
        value = -1 if cue(c.lower()) else 1 if sentence or n > 25 else 0
        w = NOT_WORD.sub("", c.lower()) if sentence else wording(c)
        short, long = heads_of(c, names)
        return c, sentence, value, key(w) if len(w) >= 3 else None, key(short), key(long)


def heads_of(c: str, name: str) -> tuple[str, str]:
    """Generalised heads of a line, the site's name as @, digits as 0: its first two words, and what stands before a colon within its
    first words or else its first four words."""
    low = " ".join(c.split(None, 4)[:4]).lower()
    if name:
        low = low.replace(name, "@")
    low = DIGITS.sub("0", low)
    k = low.find(":")
    short = " ".join(low.split(None, 2)[:2])
    return short, "long " + (low[:k] if 0 < k and low.count(" ", 0, k) <= 2 else low)


def site_name(host: str) -> str:
    part = host.split(".")[0]
    return part if len(part) > 3 else ""


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Votes per task: wordings by page (kind 0: page, wording) and long heads with their short ones by score (kind 2: score, head)."""
    read, c = Reader(), Counter()

    def out():
        ks = list(c)
        return pd.DataFrame({"kind": [k[0] for k in ks], "host": [k[1] for k in ks], "page": [k[2] for k in ks], "k": [k[3] for k in ks], "parent": [k[4] for k in ks], "n": list(c.values())})

    for pdf in batches:
        for h, p, s, text in zip(pdf["host"], pdf["page"], pdf["site"], pdf["text"]):
            name = site_name(s)
            for line in text.split("\n"):
                x, _, value, w, short, long = read(line, name)
                if x:
                    c[2, h, value, long, short] += 1
                    if w is not None:
                        c[0, h, p, w, 0] += 1
            if len(c) > 200_000:
                yield out()
                c.clear()
    if c:
        yield out()


def layout_paths(df: DataFrame, url_col: str = "source_url", text_col: str = "text", share: float = 0.05, least: int = 3, lead: float = 0.8, cue_weight: int = 8) -> tuple[DataFrame, DataFrame]:
    """(wordings ``host, w`` that win as layout by their share of the site's pages, heads ``host, w, layout`` with their verdict): each site
    votes by the scores of its containers under the head. A site with ``least`` scored containers goes by its own vote, with ``lead`` of them and
    half of all containers to win as layout; the other sites go by the votes of all, where a head wins with ``lead`` of the sites with an
    opinion and ``least`` containers. A head without a verdict has no row, nor has one won as content that nothing contests, neither a
    layout score nor the verdict on its short head. Cues seldom stand in content but miss much layout, so under a long head, which is one
    slot's own, a layout score weighs ``cue_weight`` content scores; short heads are shared by many slots and weigh them alike."""
    d = rows_of(df, url_col, url_col, text_col).select(F.xxhash64("site").alias("host"), F.xxhash64("url").alias("page"), "site", "text")
    v = d.mapInPandas(_votes, "kind int, host bigint, page bigint, k bigint, parent bigint, n bigint")
    # one aggregation for all kinds; the distinct count is taken per (host, path, page) first, so no path meets in one task
    of_score = [F.sum(F.when((F.col("kind") > 0) & (F.col("page") == x), F.col("n")).otherwise(0)).alias(name) for x, name in ((-1, "neg"), (1, "pos"))]
    votes = v.groupBy("kind", "host", "k", "parent").agg(F.countDistinct("page").alias("n_pages"), F.sum("n").alias("n"), *of_score)
    votes = materialize(votes.where(f"kind > 0 or n_pages >= {least}"), "votes")
    long = votes.where("kind = 2").select("kind", "host", "k", "parent", "n", "neg", "pos")
    short = long.groupBy("host", F.col("parent").alias("k")).agg(*[F.sum(x).alias(x) for x in ("n", "neg", "pos")]).select(F.lit(1).alias("kind"), "host", "k", F.lit(0).cast("bigint").alias("parent"), "n", "neg", "pos")
    sizes = site_sizes(df, url_col, text_col)
    words = votes.where("kind = 0").join(F.broadcast(sizes) if small(sizes) else sizes, "host").where(F.col("n_pages") >= F.col("site_pages") * share)
    # a head counts if a cue stood under it on some site, or under its short head: of the others no verdict can come, nor be overruled
    every = long.unionByName(short)
    cued = materialize(every.where("neg > 0").select("k").distinct(), "cued")
    few = small(cued)
    for c in ("k", "parent"):
        mark = cued.select(F.col("k").alias(c), F.lit(True).alias(f"{c}_cued"))
        every = every.join(F.broadcast(mark), c, "left") if few else salted(every, mark, [c], "host", how="left")
    own = materialize(every.where("k_cued or parent_cued").drop("k_cued", "parent_cued"), "heads_cued")
    scored = F.col("neg") + F.col("pos")
    against = F.col("neg") * F.when(F.col("kind") == 2, cue_weight).otherwise(1)
    per = own.groupBy("k").agg(F.sum("n").alias("n"), F.sum((against > F.col("pos")).cast("int")).alias("layout"), F.sum((against < F.col("pos")).cast("int")).alias("content"))
    won = per.where((F.col("n") >= least) & (F.col("layout") > 0) & (F.col("layout") >= lead * (F.col("layout") + F.col("content"))))
    own = own.join(won.select("k", F.lit(True).alias("pooled")), "k", "left")
    verdict = (
        F.when((scored >= least) & (against >= lead * (against + F.col("pos"))) & (2 * against >= F.col("n")), True)
        .when((scored >= least) & (F.col("pos") >= lead * (against + F.col("pos"))), False)
        .otherwise(F.col("pooled"))
    )
    own = own.select("kind", "host", "k", "parent", verdict.alias("layout"), "neg").where("layout is not null")
    above = own.where("kind = 1 and layout").select("host", F.col("k").alias("parent"), F.lit(True).alias("above"))
    heads = own.join(above, ["host", "parent"], "left").where("layout or neg > 0 or above")
    return materialize(words.select("host", F.col("k").alias("w"), "n_pages"), "wordings"), materialize(heads.select("host", F.col("k").alias("w"), "layout"), "heads")


def with_heads(d: DataFrame, heads: DataFrame) -> tuple[DataFrame, object]:
    """Rows with the verdicts on their site's heads: through a broadcast within its limit, else as a map joined by site."""
    if small(heads):
        out: dict[int, dict[int, bool]] = {}
        for r in heads.collect():
            out.setdefault(r.host, {})[r.w] = r.layout
        return d.withColumn("hs", F.lit(None).cast("array<struct<w:bigint,layout:boolean>>")), d.sparkSession.sparkContext.broadcast(out)
    per = heads.groupBy("host").agg(F.collect_list(F.struct("w", "layout")).alias("hs"))
    return salted(d, per, ["host"], "text", how="left"), None


def label_lines(lines: list[str], title: str | None, known: set[int], heads: dict[int, bool], name: str, read: Reader) -> list[bool]:
    """True for layout lines: by the wording if it won, else by the verdict on the long head, else on the short one."""
    out, teaser = [], False
    t = wording(title or "")
    t = key(t) if len(t) >= 3 else None
    for line in lines:
        c, sentence, _, w, short, long = read(line, name)
        if not c:
            out.append(False)
            continue
        if t is not None and w == t:
            out.append(False)
            teaser = False
            continue
        path = True if w is not None and w in known else heads.get(long)
        layout = bool(heads.get(short) if path is None else path)
        if not layout and not sentence and "|" in c:
            cells = [p for p in c.split("|") if p.strip()]
            layout = len(cells) >= 3 and sum(key(wording(p)) in known for p in cells) >= 0.5 * len(cells)
        if layout and TEASER.match(c.lower()):
            teaser = True
        elif not layout and teaser:
            # items of a teaser list: bulleted or marked as fresh, or bare titles; a sentence or a row of cells ends it
            bare = not sentence and c[-1] not in STOPS and c.count("|") < 2 and c.count(":") < 2 and 2 <= c.count(" ") <= 16 and not NUMBERED.search(c)
            if BULLET.match(line) or FRESH.search(c) or bare:
                layout = True
            else:
                teaser = False
        elif layout:
            teaser = False
        elif not sentence and BULLET.match(line) and FRESH.search(c):
            layout = True
        out.append(layout)
    return out


def layout_lines(df: DataFrame, words: DataFrame, heads: DataFrame, id_col: str = "chunk_id", url_col: str = "source_url", text_col: str = "text", title_col: str | None = "document_title", extract: bool = False) -> DataFrame:
    """``id, line_no`` of layout lines, or with ``extract`` one row ``id, text`` per input row holding the main content."""
    d = df.select(F.col(id_col).cast("string").alias("id"), site(url_col).alias("site"), (F.col(title_col) if title_col else F.lit(None)).cast("string").alias("title"), F.col(text_col).cast("string").alias("text"))
    if not extract:
        d = d.where("text is not null and site is not null")
    d, shared = with_flags(d, words)
    d, won = with_heads(d, heads)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Reader()
        for pdf in batches:
            ids, nos, texts = [], [], []
            for i, h, s, t, text, ws, hs in zip(pdf["id"], pdf["host"], pdf["site"], pdf["title"], pdf["text"], pdf["ws"], pdf["hs"]):
                if not text or not s:
                    ids.append(i)
                    texts.append(text)
                    continue
                known = (shared.value.get(h) if shared is not None else set(ws) if ws is not None else None) or set()
                heads = (won.value.get(h) if won is not None else {x["w"]: x["layout"] for x in hs} if hs is not None else None) or {}
                lines = text.split("\n")
                flags = label_lines(lines, t, known, heads, site_name(s), read)
                if extract:
                    ids.append(i)
                    texts.append("\n".join(x for x, f in zip(lines, flags) if not f))
                else:
                    for n, f in enumerate(flags):
                        if f:
                            ids.append(i)
                            nos.append(n)
            if extract:
                yield pd.DataFrame({"id": ids, "text": texts})
            elif nos:
                yield pd.DataFrame({"id": ids, "line_no": nos})

    cols = d.select("id", "host", "site", "title", "text", "ws", "hs")
    if extract:
        return cols.mapInPandas(run, "id string, text string")
    return cols.where("text <> ''").mapInPandas(run, "id string, line_no int").distinct()
