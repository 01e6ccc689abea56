"""Evaluation texts in training text: a BM25 inverted index of the items' passages and questions, searched with block-max WAND.

Index side: each item part (passage or question) is an indexed text. Texts are numbered by their thresholds and stand in blocks of ``block``;
a term's inverted list holds (text, weight) in that order, and beside it its block list holds (block, largest weight, where the block's
entries begin). Everything lies in flat arrays, so an index takes some 30 bytes per indexed word. Query side: every overlapping window of
every document is a query. WAND's bounds are applied to many windows at a time: a window whose terms' largest weights do not add up to the
lowest threshold is skipped; of the rest, the block lists alone are added up, and a block whose sum stays under the block's lowest
threshold is skipped; only the entries of the blocks that are left are scored. The threshold of a text is the lowest score any
``min_words`` consecutive words of it have, so no window that holds such a run can score below it. Retrieved pairs are verified on the
words themselves.

An index holds up to ``max_index_chars`` characters of items. A larger item table is split in shards by hash; the driver holds the shard it
is building, and the corpus is read once, each batch going through all shards.

Defined results: items or documents that are null or shorter than ``min_words`` give nothing; repeated item ids or document ids are
joined by id; words split by a hyphen at a line end are joined; comparison is on case-folded runs of letters and digits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

SPLIT_WORD = re.compile(r"[-\u00ad\u2010\u2011\u00ac](?<=[^\W\d_].)[ \t]*\r?\n\s*(?=[^\W\d_])")
WORD = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return WORD.findall(SPLIT_WORD.sub("", text).casefold())


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions first[i] .. first[i] + count[i] - 1 of every range, and the number of the range each belongs to."""
    of = np.repeat(np.arange(len(count)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of], of


class Index:
    """Inverted lists with block maxima, and a lossless threshold per text."""

    def __init__(self, texts: list[tuple[str, list[str]]], min_words: int = 12, block: int = 8, k1: float = 1.2, b: float = 0.75):
        self.min_words, self.block = min_words, block
        texts = [(i, w) for i, w in texts if len(w) >= min_words]
        self.term = {t: k for k, t in enumerate(sorted({t for _, w in texts for t in w}))}
        self.stats = Counter()
        n, terms = len(texts), len(self.term)
        self.names = [i for i, _ in texts]
        if not n:
            return
        size = np.array([len(w) for _, w in texts])
        flat = np.concatenate([self.ids(w) for _, w in texts])
        doc = np.repeat(np.arange(n), size)
        key, inv, tf = np.unique(doc * terms + flat, return_inverse=True, return_counts=True)
        in_doc, of_term = key // terms, key % terms
        df = np.bincount(of_term, minlength=terms)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weight = idf[of_term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[in_doc] / size.mean()))
        # thresholds: the least sum over the distinct words of any min_words words in a row
        start = np.concatenate([[0], np.cumsum(size)])
        runs = np.flatnonzero(np.arange(len(flat)) + min_words <= start[1:][doc])
        sums = np.empty(len(runs))
        for lo in range(0, len(runs), 50_000):
            at = runs[lo : lo + 50_000, None] + np.arange(min_words)
            order = np.argsort(flat[at], axis=1, kind="stable")
            ts, ws = np.take_along_axis(flat[at], order, 1), np.take_along_axis(weight[inv[at]], order, 1)
            ws[:, 1:][ts[:, 1:] == ts[:, :-1]] = 0.0
            sums[lo : lo + 50_000] = ws.sum(1)
        low = np.minimum.reduceat(sums, np.searchsorted(doc[runs], np.arange(n))) * (1 - 1e-4)
        # texts of like thresholds share a block, so that a block's lowest threshold says much about each of them
        by_low = np.argsort(low, kind="stable")
        rank = np.empty(n, np.int64)
        rank[by_low] = np.arange(n)
        self.names = [self.names[j] for j in by_low]
        self.low = low[by_low]
        self.n_blocks = -(-n // block)
        self.block_low = np.minimum.reduceat(self.low, np.arange(0, n, block))
        # inverted lists, and block lists over them
        order = np.lexsort((rank[in_doc], of_term))
        term, self.list_doc, self.list_w = of_term[order], rank[in_doc][order].astype(np.int32), weight[order].astype(np.float32)
        cut = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (self.list_doc[1:] // block != self.list_doc[:-1] // block)]))
        self.blk_at, self.blk_n = cut, np.diff(np.concatenate([cut, [len(term)]]))
        self.blk_id = (self.list_doc[cut] // block).astype(np.int32)
        self.blk_max = np.maximum.reduceat(self.list_w, cut)
        # of each term: where its block list begins and how long it is; the last entry stands for words outside the index
        n_blk = np.bincount(term[cut], minlength=terms)
        self.term_at, self.term_n = np.concatenate([[0], np.cumsum(n_blk)]), np.concatenate([n_blk, [0]])
        self.top = np.concatenate([np.maximum.reduceat(self.list_w, np.searchsorted(term, np.arange(terms))), [0.0]])
        # runs of min_words words for the verification, by hash, with the place they stand at
        self.flat, self.doc = flat, rank[doc].astype(np.int32)
        h = self.run_hashes(flat, runs)
        order = np.argsort(h, kind="stable")
        self.run_hash, self.run_at = h[order], runs[order].astype(np.int32)

    def __len__(self) -> int:
        return len(self.names)

    def ids(self, words: list[str]) -> np.ndarray:
        """Term numbers, -1 for words outside the index."""
        get = self.term.get
        return np.array([get(w, -1) for w in words], np.int32)

    def run_hashes(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(self.min_words):
            h = mix64(h ^ ids[at + k].astype(np.uint64))
        return h

    def search(self, docs: list[np.ndarray], width: int = 24, stride: int = 12) -> list[tuple[int, int, float]]:
        """(document, text, best score) of every window of the documents' term numbers that reaches a text's threshold.
        ``width - stride`` is at least ``min_words``, so every run of that length lies in a window."""
        size = np.array([len(x) for x in docs], np.int64)
        if not len(self) or not size.sum():
            return []
        none, n = len(self.term), len(self)
        flat = np.concatenate(docs).astype(np.int64)
        flat[flat < 0] = none
        doc, base = np.repeat(np.arange(len(docs)), size), np.concatenate([[0], np.cumsum(size)])
        starts = np.flatnonzero((np.arange(len(flat)) - base[doc]) % stride == 0)
        ends = np.minimum(starts + width, base[doc[starts] + 1])
        best: dict[tuple[int, int], float] = {}
        step = int(max(64, min(4096, 4_000_000 // self.n_blocks)))
        for lo in range(0, len(starts), step):
            s, e = starts[lo : lo + step], ends[lo : lo + step]
            at = s[:, None] + np.arange(width)
            terms = np.sort(np.where(at < e[:, None], flat[np.minimum(at, len(flat) - 1)], none), 1)
            terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = none  # each term once
            live = np.flatnonzero(self.top[terms].sum(1) >= self.block_low[0])
            self.stats.update(windows=len(s), live_windows=len(live))
            if not len(live):
                continue
            terms = terms[live]
            row, col = np.nonzero(terms < none)
            t = terms[row, col]
            entry, of = spread(self.term_at[t], self.term_n[t])  # block lists of every (window, term)
            cell = row[of] * self.n_blocks + self.blk_id[entry]
            bound = np.bincount(cell, weights=self.blk_max[entry], minlength=len(live) * self.n_blocks)
            good = bound >= np.tile(self.block_low, len(live))
            self.stats.update(blocks=int(np.count_nonzero(bound)), live_blocks=int(good.sum()))
            keep = good[cell]
            if not keep.any():
                continue
            entry, of = entry[keep], of[keep]
            post, p = spread(self.blk_at[entry], self.blk_n[entry])
            pair, back = np.unique(row[of[p]] * n + self.list_doc[post], return_inverse=True)
            score = np.bincount(back, weights=self.list_w[post])
            ok = score >= self.low[pair % n]
            for k, x in zip(pair[ok].tolist(), score[ok].tolist()):
                at2 = (int(doc[s[live[k // n]]]), k % n)
                best[at2] = max(best.get(at2, 0.0), x)
        self.stats.update(retrieved=len(best))
        return [(d, j, s) for (d, j), s in best.items()]

    def shared(self, ids: np.ndarray) -> dict[int, int]:
        """Text -> longest run of at least ``min_words`` consecutive words that the document shares with it."""
        m = self.min_words
        if len(ids) < m or not len(self):
            return {}
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        at = np.flatnonzero(unknown[m:] == unknown[:-m])
        h = self.run_hashes(ids, at)
        first, last = np.searchsorted(self.run_hash, h, "left"), np.searchsorted(self.run_hash, h, "right")
        k, of = spread(first, last - first)
        i, p = at[of], self.run_at[k].astype(np.int64)
        same = (ids[i[:, None] + np.arange(m)] == self.flat[p[:, None] + np.arange(m)]).all(1)
        i, p = i[same], p[same]
        out: dict[int, int] = {}
        if len(i):
            j, order = self.doc[p], np.lexsort((i, i - p))  # a shared run goes on along one diagonal, inside one text
            i, p, j = i[order], p[order], j[order]
            new = np.concatenate([[True], (i[1:] != i[:-1] + 1) | (p[1:] != p[:-1] + 1) | (j[1:] != j[:-1])])
            cut = np.flatnonzero(new)
            for text, length in zip(j[cut].tolist(), np.diff(np.concatenate([cut, [len(i)]])).tolist()):
                out[text] = max(out.get(text, 0), length + m - 1)
        return out


def item_parts(items: DataFrame, item_id: str, parts: tuple[str, ...]) -> DataFrame:
    part = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).cast("string").alias("txt")) for p in parts])).alias("x")
    return items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item_id"), part).select("item_id", "x.part", "x.txt").where("txt is not null")


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "id", parts: tuple[str, ...] = ("passage", "question"), min_words: int = 12, max_index_chars: int = 8_000_000) -> DataFrame:
    """``doc_id, item_id, part, score, shared_words``: every document and item part with a verified shared run."""
    spark = docs.sparkSession
    long = item_parts(items, item_id, parts)
    size = long.agg(F.coalesce(F.sum(F.length("txt")), F.lit(0))).first()[0]
    shards = max(1, -(-int(size) // max_index_chars))
    built = []
    for s in range(shards):
        rows = long.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(shards)) == s).orderBy("item_id", "part", "txt")
        built.append(spark.sparkContext.broadcast(Index([(f"{r.item_id}\x00{r.part}", tokens(r.txt)) for r in rows.toLocalIterator()], min_words)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, words = pdf["doc_id"].tolist(), [tokens(t) for t in pdf["text"]]
            for shared in built:
                ix = shared.value
                for lo in range(0, len(ids), 500):
                    part = [ix.ids(w) for w in words[lo : lo + 500]]
                    out, runs = [], {}
                    for k, j, score in ix.search(part):
                        if k not in runs:
                            runs[k] = ix.shared(part[k])
                        if j in runs[k]:
                            item, what = ix.names[j].split("\x00")
                            out.append((ids[lo + k], item, what, score, runs[k][j]))
                    if out:
                        yield pd.DataFrame(out, columns=["doc_id", "item_id", "part", "score", "shared_words"])
                if len(built) > 1:  # a worker holds one shard at a time; the next batch reads it from its file again
                    del ix
                    shared.__dict__.pop("_value", None)

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    out = d.mapInPandas(run, "doc_id bigint, item_id string, part string, score double, shared_words int")
    return out.groupBy("doc_id", "item_id", "part").agg(F.max("score").alias("score"), F.max("shared_words").cast("int").alias("shared_words"))
