"""Lines repeated across one site's pages.

Every line becomes one row of a line table: its site, page and number, its wording (letters in lower case) and the bands of its masked form
(numbers, dates and names masked; minima of one permutation split in bins, grouped in bands). Lines of a site that share a band form a
near-duplicate cluster, and a cluster's document frequency is the number of distinct pages that hold any of its lines. The number of lines
bounds it, so it is counted, with partial sums, for the clusters whose lines are many enough, and only those clusters are counted by pages.
``p2_clean`` removes the lines of the clusters that reach the threshold. ``p2_found`` asks for equal wordings, so an exact check follows:
of the lines in those clusters, and of no others, wordings are counted by distinct pages. A wording that reaches the threshold lies in a
cluster that does, as its cluster's pages include its own.

Defined results: rows without text or host give nothing; wordings under ``min_letters`` letters are ignored; repeated rows and rows of one
page count the page once; every occurrence is reported with its line number; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64

NOT_LETTER = re.compile(r"[\W\d_]+")
WORD = re.compile(r"[^\W_]+")
MONTH = re.compile(r"^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*$")
BROADCAST_LIMIT = 400_000  # (site, wording) pairs of 16 bytes that may go to every executor; more are joined


def site(url_col: str):
    """Host of an address in lower case, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.col(url_col), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/:?#\s]+)", 1)), F.lit(""))


def wording(line: str) -> str:
    return NOT_LETTER.sub("", line.lower())


def key(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w) - (1 << 63)


def masks(w: str) -> tuple[str, str]:
    """A word's masked form where capitals count for nothing and where a capital makes a name."""
    if any(c.isdigit() for c in w):
        return "0", "0"
    low = w.lower()
    if MONTH.match(low):
        return "0", "N" if w[0].isupper() else "0"
    return low, "N" if w[0].isupper() else low


class Sketch:
    """Bands of minima of pairs of masked words, one hash per pair, its low bits choosing the bin."""

    ZERO, NAME = (xxhash.xxh3_64_intdigest(x) >> 1 for x in "0N")

    def __init__(self, bands: int = 2, rows: int = 4):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.words: dict[str, tuple[int, int]] = {}

    def masked(self, line: str) -> list[int]:
        """Hashes of a line's words with numbers and months as 0 and names (capitalised words after the first) as N; case and marks are
        dropped, runs of 0 or N count once."""
        get, out, last, plain = self.words, [], None, line.isupper()
        for i, w in enumerate(WORD.findall(line)):
            h = get.get(w)
            if h is None:
                if len(get) > 500_000:
                    get.clear()
                a, b = masks(w)
                h = get[w] = xxhash.xxh3_64_intdigest(a) >> 1, xxhash.xxh3_64_intdigest(b) >> 1
            x = h[0] if plain or not i else h[1]
            if x != last or (x != self.ZERO and x != self.NAME):
                out.append(x)
                last = x
        return out

    def __call__(self, lines: list[list[int]]) -> np.ndarray:
        """Bands of lines of word hashes."""
        flat, size = [], []
        for hs in lines:
            flat.extend(hs or [1])
            size.append(max(1, len(hs)))
        if not size:
            return np.empty((0, self.bands), np.int64)
        h = np.array(flat, np.uint64)
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        with np.errstate(over="ignore"):
            pair = h.copy()
            first = np.zeros(len(h), bool)
            first[at] = True
            pair[1:] = np.where(first[1:], h[1:], h[1:] * np.uint64(31) + h[:-1])
            p = mix64(pair)
            bin_of = p & np.uint64(self.bins - 1)
            low = [np.minimum.reduceat(np.where(bin_of == np.uint64(k), p, np.uint64(2**64 - 1)), at) for k in range(self.bins)]
            for k in range(self.bins):  # an empty bin borrows from the next
                for step in range(1, self.bins):
                    low[k] = np.where(low[k] == np.uint64(2**64 - 1), low[(k + step) % self.bins] + np.uint64(step), low[k])
            out = []
            for b in range(self.bands):
                x = np.full(len(at), b + 1, np.uint64)
                for r in range(self.rows):
                    x = mix64(x ^ low[b * self.rows + r])
                out.append(x.view(np.int64))
        return np.stack(out, 1)


def _line_rows(min_letters: int, bands: int, rows: int):
    """Rows of the line table; what short lines come to is remembered, as the sought ones repeat."""
    bs = [f"b{i}" for i in range(bands)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, memo = Sketch(bands, rows), {}
        for big in batches:
            for lo in range(0, len(big), 1000):
                pdf = big.iloc[lo : lo + 1000]
                row, nos, ks, at, fresh, fresh_k, fresh_masked = [], [], [], [], {}, [], []
                if len(memo) > 300_000:
                    memo.clear()
                known: list[tuple] = []
                for r, text in enumerate(pdf["text"]):
                    for n, line in enumerate(text.split("\n")):
                        got = memo.get(line)
                        if got is None:
                            k = fresh.get(line)
                            if k is None:
                                w = wording(line)
                                if len(w) < min_letters:
                                    if len(line) < 200:
                                        memo[line] = ()
                                    continue
                                k = fresh[line] = len(fresh_k)
                                fresh_k.append(key(w))
                                fresh_masked.append(sketch.masked(line))
                            at.append(k)
                        elif not got:
                            continue
                        else:
                            at.append(-1 - len(known))
                            known.append(got)
                        row.append(r)
                        nos.append(n)
                if not row:
                    continue
                new = np.column_stack([np.array(fresh_k, np.int64), sketch(fresh_masked)]) if fresh_k else np.empty((0, 1 + bands), np.int64)
                old = np.array(known, np.int64).reshape(-1, 1 + bands)
                where = np.array(at)
                values = np.empty((len(where), 1 + bands), np.int64)
                values[where >= 0], values[where < 0] = new[where[where >= 0]], old[-1 - where[where < 0]]
                for line, k in fresh.items():
                    if len(line) < 200:
                        memo[line] = tuple(new[k].tolist())
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "line_no": nos, "host": pdf["host"].to_numpy()[row], "page": pdf["page"].to_numpy()[row], "w": values[:, 0], **{b: values[:, 1 + i] for i, b in enumerate(bs)}})

    return run


def rows_of(df: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    d = df.select(F.col(id_col).cast("string").alias("id"), site(url_col).alias("site"), F.col(url_col).cast("string").alias("url"), F.col(text_col).cast("string").alias("text"))
    return d.where("text is not null and site is not null and text <> ''")


def line_table(df: DataFrame, id_col: str = "chunk_id", url_col: str = "source_url", text_col: str = "text", min_letters: int = 3, bands: int = 2, rows: int = 4) -> DataFrame:
    """``id, line_no, host, page, w, b0..`` (hashes) of every line that has a wording, written once."""
    d = rows_of(df, id_col, url_col, text_col).select("id", F.xxhash64("site").alias("host"), F.xxhash64("url").alias("page"), "text")
    cols = ", ".join(f"b{i} bigint" for i in range(bands))
    return materialize(d.mapInPandas(_line_rows(min_letters, bands, rows), f"id string, line_no int, host bigint, page bigint, w bigint, {cols}"), "lines")


def site_sizes(df: DataFrame, url_col: str = "source_url", text_col: str = "text") -> DataFrame:
    d = df.select(F.xxhash64(site(url_col)).alias("host"), site(url_col).alias("site"), F.col(url_col).alias("url")).where("site is not null")
    return d.groupBy("host").agg(F.countDistinct("url").alias("site_pages"))


def frequent_clusters(lines: DataFrame, sizes: DataFrame, share: float = 0.05, least: int = 3) -> DataFrame:
    """``host, band, cluster_pages, site_pages`` of the clusters on at least ``least`` pages and a ``share`` of their site's."""
    bands = F.explode(F.array(*[c for c in lines.columns if re.fullmatch(r"b\d+", c)])).alias("band")
    n = lines.select("host", bands).groupBy("host", "band").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    n = n.join(F.broadcast(sizes) if small(sizes) else sizes, "host").where(F.col("n") >= F.col("site_pages") * share)
    n = materialize(n.select("host", "band", "site_pages"), "clusters")
    pages = lines.select("host", "page", bands).join(F.broadcast(n) if small(n) else n, ["host", "band"])
    # distinct (site, band, page) first, then counts: a cluster on a third of all pages never meets in one task
    c = pages.groupBy("host", "band").agg(F.countDistinct("page").alias("cluster_pages"), F.min("site_pages").alias("site_pages"))
    return materialize(c.where((F.col("cluster_pages") >= least) & (F.col("cluster_pages") >= F.col("site_pages") * share)), "frequent")


def repeated_wordings(df: DataFrame, url_col: str = "source_url", text_col: str = "text", share: float = 0.05, least: int = 3, min_letters: int = 3, exact: bool = True, bands: int = 2, rows: int = 4, lines: DataFrame | None = None) -> DataFrame:
    """``host, w, n_pages, cluster_pages``: wordings of clusters whose document frequency reaches the threshold; with ``exact``, those of
    them that reach it themselves. ``lines`` is the line table, if there is one already."""
    if lines is None:
        lines = line_table(df, url_col, url_col, text_col, min_letters, bands, rows)
    won = frequent_clusters(lines, site_sizes(df, url_col, text_col), share, least)
    band = F.explode(F.array(*[c for c in lines.columns if re.fullmatch(r"b\d+", c)])).alias("band")
    m = lines.select("host", "w", "page", band).join(F.broadcast(won) if small(won) else won, ["host", "band"])
    m = m.groupBy("host", "w").agg(F.countDistinct("page").alias("n_pages"), F.max("cluster_pages").alias("cluster_pages"), F.max("site_pages").alias("site_pages"))
    if exact:
        m = m.where((F.col("n_pages") >= least) & (F.col("n_pages") >= F.col("site_pages") * share))
    return materialize(m.drop("site_pages"), "repeated")


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    return df.limit(limit + 1).count() <= limit


def site_flags(flagged: DataFrame):
    """The flagged (site, wording) pairs as a broadcast dictionary if they are few enough, else None."""
    if not small(flagged):
        return None
    out: dict[int, set[int]] = {}
    for r in flagged.select("host", "w").collect():
        out.setdefault(r.host, set()).add(r.w)
    return flagged.sparkSession.sparkContext.broadcast(out)


def salted(d: DataFrame, other: DataFrame, keys: list[str], spread: str, salts: int = 32, how: str = "inner") -> DataFrame:
    """Join of ``d`` with a table of unique keys too large to broadcast: each key's rows are spread over ``salts`` tasks."""
    o = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return d.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(o, [*keys, "_salt"], how).drop("_salt")


def with_flags(d: DataFrame, flagged: DataFrame) -> tuple[DataFrame, object]:
    """Rows with their site's flagged wordings: through a broadcast within its limit, else as an array joined by site. A site has at most
    lines a page / share of them; its rows are spread."""
    d = d.withColumn("host", F.xxhash64("site"))
    shared = site_flags(flagged)
    if shared is not None:
        return d.withColumn("ws", F.lit(None).cast("array<bigint>")), shared
    per = flagged.groupBy("host").agg(F.collect_set("w").alias("ws"))
    return salted(d, per, ["host"], "text", how="left"), None


def repeated_lines(df: DataFrame, flagged: DataFrame, id_col: str = "chunk_id", url_col: str = "source_url", text_col: str = "text", min_letters: int = 3, lines: DataFrame | None = None) -> DataFrame:
    """``id, line_no`` of every occurrence of a flagged wording."""
    if lines is None:
        lines = line_table(df, id_col, url_col, text_col, min_letters)
    l, f = lines.select("id", "line_no", "host", "w"), flagged.select("host", "w")
    out = l.join(F.broadcast(f), ["host", "w"]) if small(f) else salted(l, f, ["host", "w"], "id")
    return out.select("id", "line_no").distinct()


def remove_repeated_lines(df: DataFrame, flagged: DataFrame, id_col: str = "chunk_id", url_col: str = "source_url", text_col: str = "text", min_letters: int = 3) -> DataFrame:
    """``id, text, n_removed``: each row's text without lines of flagged clusters; one output row per input row with an id."""
    base = df.select(F.col(id_col).cast("string").alias("id"), site(url_col).alias("site"), F.col(text_col).cast("string").alias("text"))
    d, shared = with_flags(base, flagged)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, removed = [], []
            for h, text, ws in zip(pdf["host"], pdf["text"], pdf["ws"]):
                known = shared.value.get(h) if shared is not None else set(ws) if ws is not None else None
                if not text or not known:
                    texts.append(text)
                    removed.append(0)
                    continue
                lines = text.split("\n")
                keep = [x for x in lines if len(w := wording(x)) < min_letters or key(w) not in known]
                texts.append("\n".join(keep))
                removed.append(len(lines) - len(keep))
            yield pd.DataFrame({"id": pdf["id"], "text": texts, "n_removed": removed})

    return d.select("id", "host", "text", "ws").mapInPandas(run, "id string, text string, n_removed int")
