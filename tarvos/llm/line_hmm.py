"""Per-document text quality: a hidden Markov model labels each line prose, list, table or junk.

Each line becomes one symbol, its binned statistics (words, ending, share of common words, fields, symbols, damage, bullet). Symbol
sequences of all rows are written once; Baum-Welch rounds over them run in Spark until the tables settle, each task summing expected counts
and only the fixed-size tables of the model reaching the driver. Symbols that speak for themselves (a finished sentence with common words,
several fields, damaged characters, a bullet or a word or two) are seeds: they give the states their meaning and count in every round as a
prior of as many lines as there are. All other symbols start without a label and get theirs from the lines they stand among. Posteriors
give every line's label; characters per label give the shares of a row.

Defined results: null or blank text has no line of content, all shares 0 and counts 0; blank lines have no symbol; repeated rows are reported
once per row by the statistics and once per id by ``not_prose``; extra columns are ignored; an empty table keeps the first model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LABELS = ("prose", "list", "table", "junk")
# Common function words (English, Hindi).
COMMON = set(
    "a an the and or but if of to in on at by for from with without under over after before during until while as is are was were be been has have had "
    "will shall should may might must can could not no any all each every this that these those which who whom whose when where it its their his her they "
    "he she we you i so than then once only also such per into about between up out off "
    "के का की को में से पर ने है हैं हो होने और या तक लिए बाद साथ द्वारा अनुसार यह वह एक इस उस कर करें करेंगे सकते जाएगा नहीं भी ही पहले भीतर दौरान".split()
)
SEP = re.compile(r"\s*(?:\||\t|;| {2,})\s*")
FIELD = re.compile(r"\b[A-Z][A-Za-z ]{1,20}:\s")
BULLET = re.compile(r"^(?:[-*•·–›»]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s")
BROKEN = re.compile("[ÃÂâ�¿½¤€ð]")
MARK = re.compile(r"[^\w\s\u0900-\u0DFF\u0E00-\u0EFF]")
STOPS = frozenset(".!?।॥。！？")
CLOSERS = "'\")”’]"
SIZES = (5, 2, 3, 3, 3, 2, 2)  # words, end, common, fields, symbols, damage, bullet
N_SYMBOLS = int(np.prod(SIZES))


def line_stats(line: str) -> tuple[int, int, float, float, int, int, int]:
    """(words, ends in punctuation, common share, symbol share, fields, damaged, bullet) of a non-blank line."""
    s = line.strip()
    words = s.lower().split()
    n = len(words)
    common = sum(map(COMMON.__contains__, words)) / n
    chars = len(s) - n + 1
    symbols = len(MARK.findall(s)) / max(chars, 1)
    fields = len(SEP.findall(s)) if "|" in s or "\t" in s or "  " in s or ";" in s else 0
    colons, commas = s.count(": "), s.count(", ")
    if colons > 1:
        fields = max(fields, len(FIELD.findall(s)))
    if commas >= 2 and n <= 2.6 * (commas + 1):  # values set apart by commas: few words each
        fields = max(fields, commas)
    damaged = symbols > 0.5 or n > 5 and chars < 1.7 * n or chars > 40 and max(map(len, words)) > 40 and not s.startswith("http") or not s.isascii() and len(BROKEN.findall(s)) > 0.02 * len(s)
    last = s[-1] if s[-1] not in CLOSERS else s.rstrip(CLOSERS)[-1:]
    bullet = not (s[0].isalpha() and s[1:2] not in ".)") and BULLET.match(s) is not None
    return n, int(last in STOPS), common, symbols, fields, int(damaged), int(bullet)


def symbol(stats: tuple) -> int:
    n, end, common, symbols, fields, damaged, bullet = stats
    bins = (0 if n <= 2 else 1 if n <= 7 else 2 if n <= 14 else 3 if n <= 24 else 4, end, 0 if common == 0 else 1 if common < 0.12 else 2, min(fields, 2), 0 if symbols < 0.12 else 1 if symbols < 0.25 else 2, damaged, bullet)
    k = 0
    for b, size in zip(bins, SIZES):
        k = k * size + b
    return k


def seed_label(k: int) -> int | None:
    """The label of a symbol that speaks for itself, else None."""
    n, end, common, fields, symbols, damaged, bullet = np.unravel_index(k, SIZES)
    if damaged:
        return 3
    if fields == 2:
        return 2
    if end:
        return 0 if n >= 2 and common == 2 else None
    return 1 if n <= 1 and fields == 0 or bullet and n <= 3 else None


def text_symbols(text: str) -> tuple[list[int], list[int]]:
    """Symbols and lengths in characters of the non-blank lines."""
    ks, size = [], []
    for line in text.split("\n"):
        if line and not line.isspace():
            ks.append(symbol(line_stats(line)))
            size.append(len(line))
    return ks, size


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, counts: np.ndarray | None = None) -> Hmm:
        """Seeds with their labels, the other symbols alike in all states; ``counts`` are the symbols' numbers of lines."""
        share = np.full((len(LABELS), N_SYMBOLS), 0.25)
        for k in range(N_SYMBOLS):
            label = seed_label(k)
            if label is not None:
                share[:, k] = 0.01
                share[label, k] = 0.97
        emit = share * ((np.zeros(N_SYMBOLS) if counts is None else counts) + 0.01)
        move = np.full((4, 4), 0.06) + np.eye(4) * 0.76
        return cls(np.full(4, 0.25), move, emit / emit.sum(1, keepdims=True))

    def posteriors(self, seqs: list[np.ndarray], counts: bool = False):
        """Posterior rows of each sequence; with ``counts`` the expected (start, move, emit) counts instead."""
        post: list = [None] * len(seqs)
        total = np.zeros(4), np.zeros((4, 4)), np.zeros((4, N_SYMBOLS))
        order = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: len(seqs[i]))
        at = 0
        while at < len(order):
            end, longest = at, 0
            while end < len(order) and (end == at or (end - at + 1) * len(seqs[order[end]]) <= 200_000):
                longest = len(seqs[order[end]])
                end += 1
            self._block([seqs[i] for i in order[at:end]], order[at:end], longest, post, total, counts)
            at = end
        return total if counts else post

    def _block(self, seqs, where, T, post, total, counts) -> None:
        R = len(seqs)
        size = np.array([len(s) for s in seqs])
        obs = np.zeros((R, T), np.int64)
        for r, s in enumerate(seqs):
            obs[r, : len(s)] = s
        live = np.arange(T)[None] < size[:, None]
        e = self.emit.T[obs]
        e[~live] = 1.0
        f, scale = np.empty((R, T, 4)), np.empty((R, T))
        x = self.start * e[:, 0]
        for t in range(T):
            if t:
                x = (f[:, t - 1] @ self.move) * e[:, t]
            z = x.sum(1)
            f[:, t], scale[:, t] = x / z[:, None], z
        b = np.ones((R, T, 4))
        for t in range(T - 2, -1, -1):
            nxt = (e[:, t + 1] * b[:, t + 1]) @ self.move.T / scale[:, t + 1][:, None]
            b[:, t] = np.where(live[:, t + 1][:, None], nxt, 1.0)
        g = f * b
        g /= g.sum(2, keepdims=True)
        if counts:
            total[0][:] += g[:, 0].sum(0)
            for t in range(T - 1):
                ok = live[:, t + 1]
                if ok.any():
                    w = (e[ok, t + 1] * b[ok, t + 1]) / scale[ok, t + 1][:, None]
                    total[1][:] += (f[ok, t].T @ w) * self.move
            flat = obs[live]
            for k in range(4):
                total[2][k] += np.bincount(flat, weights=g[..., k][live], minlength=N_SYMBOLS)
        else:
            for r, i in enumerate(where):
                post[i] = g[r, : size[r]]


def symbol_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n_chars, ks, size`` of every row, written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                both = [text_symbols(t) if t else ([], []) for t in part["text"]]
                yield pd.DataFrame({"id": part["id"], "n_chars": [len(t) if t else 0 for t in part["text"]], "ks": [x[0] for x in both], "size": [x[1] for x in both]})

    d = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(d.mapInPandas(run, "id string, n_chars bigint, ks array<smallint>, size array<int>"), "symbols")


def _summed(table: DataFrame, size: int, of) -> np.ndarray:
    """Sum over all rows of vectors that ``of`` makes of each batch's symbol sequences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(size)
        for pdf in batches:
            sums += of([np.asarray(k, np.int64) for k in pdf["ks"]])
        at = np.flatnonzero(sums)
        if len(at):
            yield pd.DataFrame({"k": at, "v": sums[at]})

    v = np.zeros(size)
    for r in table.select("ks").mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        v[r.k] = r.v
    return v


def fit(table: DataFrame, rounds: int = 10, prior: float = 1.0, settled: float = 0.02) -> Hmm:
    """Baum-Welch over all rows until no state's emissions move by more than ``settled`` in all. The first emissions weigh ``prior``
    times the lines of the table in every round."""
    counts = _summed(table, N_SYMBOLS, lambda seqs: np.bincount(np.concatenate(seqs), minlength=N_SYMBOLS) if seqs else np.zeros(N_SYMBOLS))
    first = hmm = Hmm.first(counts)
    for _ in range(rounds):
        shared = table.sparkSession.sparkContext.broadcast(hmm)
        v = _summed(table, 20 + 4 * N_SYMBOLS, lambda seqs: np.concatenate([x.ravel() for x in shared.value.posteriors(seqs, counts=True)]))  # noqa: B023
        s, m, e = v[:4] + 1, v[4:20].reshape(4, 4) + 1, v[20:].reshape(4, N_SYMBOLS)
        e = e + prior * counts.sum() / len(LABELS) * first.emit + 0.01
        new = Hmm(s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(1, keepdims=True))
        moved = np.abs(new.emit - hmm.emit).sum(1).max()
        hmm = new
        if moved <= settled:
            break
    return hmm


def line_shares(table: DataFrame, hmm: Hmm) -> DataFrame:
    """Per row: lines, and the share of the text's characters on lines of each label."""
    shared = table.sparkSession.sparkContext.broadcast(hmm)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            post = shared.value.posteriors([np.asarray(k, np.int64) for k in pdf["ks"]])
            share = np.zeros((len(pdf), 4))
            for i, (p, size, n) in enumerate(zip(post, pdf["size"], pdf["n_chars"])):
                if p is not None and n:
                    share[i] = np.bincount(p.argmax(1), weights=np.asarray(size, float), minlength=4) / n
            yield pd.DataFrame({"id": pdf["id"], "n_lines": [len(k) for k in pdf["ks"]], **{f"{x}_share": share[:, j] for j, x in enumerate(LABELS)}})

    return table.mapInPandas(run, "id string, n_lines int, " + ", ".join(f"{x}_share double" for x in LABELS))


def quality(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """Label shares per row and the label with the largest share (null for rows without lines)."""
    t = symbol_table(df, id_col, text_col)
    s = line_shares(t, fit(t))
    best = F.array_max(F.array(*[F.struct(F.col(f"{x}_share").alias("share"), F.lit(x).alias("name")) for x in LABELS]))
    return s.withColumn("label", F.when(F.col("n_lines") > 0, best["name"]))


def not_prose(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", below: float = 0.45) -> DataFrame:
    """``id`` of rows whose prose lines hold less than ``below`` of the characters: between the third that is asked for and the half
    that prose reaches, nearer the half, as sentences of the layout count as prose here."""
    t = symbol_table(df, id_col, text_col)
    return line_shares(t, fit(t)).where(F.col("prose_share") < below).select("id").distinct()


def text_statistics(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """Word count, mean word length, symbol ratio, share of lines ending in punctuation and share of common words; built-in
    expressions only. Null text counts as empty; ratios of nothing are 0."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text", t)
    d = d.withColumn("words", F.filter(F.split("text", r"\s+"), lambda w: w != "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    n, m = F.size("words"), F.size("lines")
    chars = F.length(F.regexp_replace("text", r"\s+", ""))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    common = F.array(*[F.lit(w) for w in sorted(COMMON)])
    hits = F.size(F.filter("words", lambda w: F.array_contains(common, F.lower(F.regexp_replace(w, r"[^\p{L}\p{M}]", "")))))
    return d.select(
        "id", n.cast("bigint").alias("n_words"), m.cast("bigint").alias("n_lines"),
        F.round(ratio(chars.cast("double"), n), 6).alias("mean_word_length"),
        F.round(ratio(F.length(F.regexp_replace("text", r"[\p{L}\p{M}\p{N}\s]+", "")).cast("double"), chars), 6).alias("symbol_ratio"),
        F.round(ratio(F.size(F.filter("lines", lambda x: F.rlike(x, F.lit(r"[.!?।॥。！？]\s*$")))).cast("double"), m), 6).alias("ends_in_punctuation"),
        F.round(ratio(hits.cast("double"), n), 6).alias("common_share"),
    )
