"""Near-duplicate records: min-max hashing of word shingles, banding, exact verification, classes.

Every permutation gives two signature values, the minimum and the maximum of the permuted shingle hashes, so ``bands * rows``
values cost half as many hash evaluations. At a similarity equal to a threshold of 0.5 the bands find 0.94 of the pairs, at 0.58 0.995, at 0.8 all but one
in 10^10; fewer ``rows`` find more at the price of more chance meetings. Exact copies (equal shingle sets) are folded to one representative before banding.
Buckets up to ``bucket_cap``
representatives are compared while they stream by in sorted order, larger ones are split in blocks whose pairs are compared in tasks of
their own, and what a task knows to belong to such a bucket never goes to the bucket's one place; a pair becomes a candidate if its 128-bit sketches, bits of the same signatures, can belong to the threshold. No bucket is
held whole above the cap, none is cut.

Defined results: a record with fewer than ``shingle`` words has no shingles and is similar to nothing (own class); nulls count as
empty text; repeated rows of one id count once; an id with several texts is a member of several; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix64
from .site_lines import small

WORD = re.compile(r"[^\W_]+")


def words(title: str | None, text: str | None) -> list[str]:
    return WORD.findall(f"{title or ''} {text or ''}".lower())


def shingle_set(title: str | None, text: str | None, n: int = 3) -> set[tuple[str, ...]]:
    w = words(title, text)
    return set(zip(*(w[i:] for i in range(n))))


class Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, w: str) -> int:
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


class Signer:
    """Signatures of whole batches: all shingles of a batch lie in one array, minima and maxima come from ``reduceat``."""

    def __init__(self, shingle: int, bands: int, rows: int, sketch: int = 0, seed: int = 7):
        self.n, self.bands, self.rows, self.seen = shingle, bands, rows, Hashes()
        self.values = max(bands * rows, sketch)
        rng = np.random.default_rng(seed)
        k = (self.values + 1) // 2
        self.a = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, k, dtype=np.uint64)

    def word_hashes(self, w: list[str]) -> np.ndarray:
        if len(self.seen) > 500_000:
            self.seen.clear()
        return np.fromiter(map(self.seen.__getitem__, w), np.uint64, len(w))

    def shingles(self, w: list[str]) -> np.ndarray:
        """Sorted 64-bit values of the distinct shingles of a list of words."""
        n = self.n
        if len(w) < n:
            return np.empty(0, np.uint64)
        h = self.word_hashes(w)
        s = h[: len(h) - n + 1].copy()
        with np.errstate(over="ignore"):
            for j in range(1, n):
                s = s * np.uint64(0x100000001B3) ^ h[j : len(h) - n + 1 + j]
        s.sort()  # the values that differ from the one before
        return s[np.append(True, s[1:] != s[:-1])]

    def __call__(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which docs have shingles, a fingerprint of each one's shingle set, and its signature (docs x values)."""
        n, parts, keep = self.n, [], []
        with np.errstate(over="ignore"):
            for i, w in enumerate(docs):
                if len(w) < n:
                    continue
                parts.append(self.shingles(w))
                keep.append(i)
            if not keep:
                return np.empty(0, int), np.empty(0, np.uint64), np.empty((0, self.values), np.uint64)
            flat, size = mix64(np.concatenate(parts)), np.array([len(p) for p in parts])
            at = np.concatenate([[0], np.cumsum(size)[:-1]])
            fp = mix64(np.add.reduceat(mix64(flat), at) ^ size.astype(np.uint64))
            sig = np.empty((len(keep), 2 * len(self.a)), np.uint64)
            for k in range(len(self.a)):
                p = flat * self.a[k] + self.b[k]
                p ^= p >> np.uint64(29)
                sig[:, 2 * k], sig[:, 2 * k + 1] = np.minimum.reduceat(p, at), np.maximum.reduceat(p, at)
        return np.array(keep), fp, sig[:, : self.values]

    def band_hashes(self, sig: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            s = sig[:, : self.bands * self.rows].reshape(len(sig), self.bands, self.rows)
            h = np.broadcast_to(mix64(np.arange(self.bands, dtype=np.uint64)), s.shape[:2])
            for r in range(self.rows):
                h = mix64(h ^ s[:, :, r])
            return h


def _chunks_of(pdf: pd.DataFrame, n: int = 2000) -> Iterator[pd.DataFrame]:
    for i in range(0, len(pdf), n):
        yield pdf.iloc[i : i + n]


def sketch_bits(sig: np.ndarray) -> np.ndarray:
    """128 bits of each signature, one of each of its last values: two records agree in (1 + similarity) / 2 of them on average."""
    bits = (sig[:, -128:] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64).view(np.int64).reshape(len(sig), 2)


def least_agreement(threshold: float, deviations: float = 3.0) -> int:
    """Bits out of 128 that all but about one in 700 pairs at the threshold agree in, and nearly every pair above it."""
    p = (1 + threshold) / 2
    return int(128 * p - deviations * (128 * p * (1 - p)) ** 0.5)


def band_recall(similarity: float, bands: int, rows: int) -> float:
    """Share of pairs of a similarity that meet in a band."""
    return 1 - (1 - similarity**rows) ** bands


MARK = -(2**63)  # fingerprint of the row that says a bucket is hot


def _sign(shingle: int, bands: int, rows: int, hot_limit: int):
    """Rows ``h, fp, s1, s2, id``: one per band with a null id and one with the id (its h only spreads it). Copies met again in a
    task send their bands once. A bucket that has had more than ``hot_limit`` members in a task is hot: its further members go to tasks of
    their own by fingerprint (the bucket's hash stands in the id, after a null character), and a mark goes to the bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer, done = Signer(shingle, bands, rows, 128), set()
        load, marked = np.zeros(1 << 20, np.int64), set()  # members by bucket, buckets that share a cell counted together
        for big in batches:
            for pdf in _chunks_of(big):
                keep, fp, sig = signer([words(t, x) for t, x in zip(pdf["title"], pdf["text"])])
                if not len(keep):
                    continue
                h, fps, bits = signer.band_hashes(sig).view(np.int64), fp.view(np.int64), sketch_bits(sig)
                fresh = np.zeros(len(fps), bool)
                for i, f in enumerate(fps.tolist()):
                    if f not in done:
                        fresh[i] = True
                        if len(done) > 1_000_000:
                            done.clear()
                        done.add(f)
                ids = pdf["id"].to_numpy()[keep]
                spread = mix64(fp + np.arange(len(fp), dtype=np.uint64)).view(np.int64)
                again = lambda x: np.repeat(x[fresh], bands)
                hs, f, s1, s2 = h[fresh].ravel(), again(fps), again(bits[:, 0]), again(bits[:, 1])
                name = np.full(len(hs), None, object)
                cell = hs & ((1 << 20) - 1)
                load += np.bincount(cell, minlength=1 << 20)
                at = np.flatnonzero(load[cell] > hot_limit)
                marks = sorted({x for x in hs[at].tolist()} - marked)
                if len(at):
                    marked.update(marks)
                    name[at] = [f"\x00{x}" for x in hs[at].tolist()]
                    hs = hs.copy()
                    hs[at] = mix64(hs[at].view(np.uint64) ^ mix64(f[at].view(np.uint64) & np.uint64(0xFFF))).view(np.int64)
                zero, none = np.zeros(len(fps), np.int64), np.zeros(len(marks), np.int64)
                yield pd.DataFrame({
                    "h": np.concatenate([spread, hs, np.array(marks, np.int64)]), "fp": np.concatenate([fps, f, none + MARK]), "s1": np.concatenate([zero, s1, none]),
                    "s2": np.concatenate([zero, s2, none]), "id": np.concatenate([ids, name, np.full(len(marks), None, object)]),
                })

    return run


def _same_fingerprint(shingle: int):
    """Rows of ids with one text (n = 1) pass; of the others only the text with the wanted fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(shingle, 1, 1)
        for pdf in batches:
            several = pdf["n"].to_numpy() > 1
            if several.any():
                at = np.flatnonzero(several)
                keep, fp, _ = signer([words(t, x) for t, x in zip(pdf["title"].iloc[at], pdf["text"].iloc[at])])
                good = ~several
                good[at[keep[fp.view(np.int64) == pdf["fp"].to_numpy()[at][keep]]]] = True
                pdf = pdf[good]
            yield pdf

    return run


def _agreeing(x: np.ndarray, y: np.ndarray | None, least: int, step: int = 512) -> np.ndarray:
    """(a, b) of the pairs within ``x``, or between ``x`` and ``y``, whose sketches agree in ``least`` bits; rows are (fp, s1, s2)."""
    out = []
    other = x if y is None else y
    for lo in range(0, len(x), step):
        a = x[lo : lo + step]
        same = 128 - (np.bitwise_count(a[:, None, 1].view(np.uint64) ^ other[None, :, 1].view(np.uint64)).astype(np.int16) + np.bitwise_count(a[:, None, 2].view(np.uint64) ^ other[None, :, 2].view(np.uint64)))
        i, j = np.nonzero(same >= least)
        ok = (j > i + lo) if y is None else a[i, 0] != other[j, 0]
        p = np.stack([a[i[ok], 0], other[j[ok], 0]], 1)
        out.append(np.stack([p.min(1), p.max(1)], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _once(rows: np.ndarray) -> np.ndarray:
    """Rows with each fingerprint once, without marks."""
    rows = rows[rows[:, 0] != MARK]
    return rows[np.unique(rows[:, 0], return_index=True)[1]]


def _alike(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """(smaller, larger) fingerprints of the pairs a[..] and b[..] that differ and whose sketches agree."""
    same = 128 - (np.bitwise_count((a[..., 1] ^ b[..., 1]).view(np.uint64)).astype(np.int16) + np.bitwise_count((a[..., 2] ^ b[..., 2]).view(np.uint64)))
    ok = (same >= least) & (a[..., 0] != b[..., 0])
    return np.sort(np.stack([a[..., 0][ok], b[..., 0][ok]], 1), axis=1)


def _bucket_pairs(cap: int, least: int):
    """Pairs of each run of equal bucket hashes in a stream sorted by them whose sketches agree (kind 0: a, b); members of runs above the cap
    or with a mark (kind 1: bucket, fingerprint, sketch); rows with an id pass (kind 2: fingerprint, id). Members of a run come in any order,
    copies of one from several tasks among them."""
    none = {"s1": 0, "s2": 0, "id": None}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_h, held, size, hot = None, [], 0, False

        near: list[np.ndarray] = []

        def small(rows: np.ndarray) -> None:
            rows = _once(rows)
            if len(rows) > 1:
                near.append(_agreeing(rows, None, least))

        def drain() -> Iterator[pd.DataFrame]:
            p = np.concatenate(near) if near else np.empty((0, 2), np.int64)
            near.clear()
            if len(p):
                yield pd.DataFrame({"kind": 0, "a": p[:, 0], "b": p[:, 1], **none})

        def large(h: int, rows: np.ndarray) -> Iterator[pd.DataFrame]:
            if len(rows):
                yield pd.DataFrame({"kind": 1, "a": h, "b": rows[:, 0], "s1": rows[:, 1], "s2": rows[:, 2], "id": None})

        for pdf in batches:
            named = pdf["id"].notna().to_numpy()
            if named.any():
                n = pdf[named]
                member = n["id"].str.startswith("\x00").to_numpy(bool)
                yield pd.DataFrame({"kind": 2, "a": n["fp"].to_numpy()[~member], "b": 0, "s1": 0, "s2": 0, "id": n["id"].to_numpy()[~member]})
                if member.any():
                    n = n[member]
                    yield pd.DataFrame({"kind": 1, "a": [int(x[1:]) for x in n["id"]], "b": n["fp"], "s1": n["s1"], "s2": n["s2"], "id": None})
            h, x = pdf["h"].to_numpy()[~named], pdf[["fp", "s1", "s2"]].to_numpy(np.int64)[~named]
            if not len(h):
                continue
            cut = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            count = np.diff(cut)
            marked = np.add.reduceat((x[:, 0] == MARK).astype(np.int64), cut[:-1]) > 0
            inner = np.arange(1, len(count) - 1)
            hots = inner[marked[inner]]
            inner = inner[~marked[inner]]
            two = cut[inner[count[inner] == 2]]
            if len(two):
                near.append(_alike(x[two], x[two + 1], least))
            # runs of one length are compared together
            for n in np.unique(count[inner][(count[inner] > 2) & (count[inner] <= 32)]):
                rows = x[cut[inner[count[inner] == n]][:, None] + np.arange(n)]
                i, j = np.triu_indices(n, 1)
                for lo in range(0, len(rows), 4096):
                    near.append(_alike(rows[lo : lo + 4096, i], rows[lo : lo + 4096, j], least))
            for k in sorted({0, len(count) - 1, *inner[count[inner] > 32].tolist(), *hots.tolist()}):
                rows, hk = x[cut[k] : cut[k + 1]], h[cut[k]]
                if k not in (0, len(count) - 1):
                    if marked[k] or len(rows) > cap and len(_once(rows)) > cap:
                        yield from large(hk, _once(rows))
                    else:
                        small(rows)
                    continue
                if held_h != hk:  # the first and last run of a batch may go on in its neighbours
                    if not hot and held:
                        small(np.concatenate(held))
                    held_h, held, size, hot = hk, [], 0, False
                if not hot:
                    held.append(rows)
                    size += len(rows)
                    if size > cap:  # copies do not make a run large
                        held = [_once(np.concatenate(held))]
                        size = len(held[0])
                    hot = bool(marked[k]) or size > cap
                    rows = np.concatenate(held) if hot else rows
                    held = [] if hot else held
                if hot:
                    yield from large(hk, _once(rows))
            if len(near) > 64:
                yield from drain()
        if not hot and held:
            small(np.concatenate(held))
        yield from drain()

    return run


def _hot_pairs(hot: DataFrame, block: int, least: int) -> DataFrame:
    """Pairs of hot buckets: members fall in blocks of about ``block``, and each pair of blocks is compared in a task of its
    own by sketches, of which only agreeing pairs come out. A bucket of n different texts takes n / block copies of each member."""
    sizes = hot.groupBy("h").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))
    m = hot.join(F.broadcast(sizes) if small(sizes) else sizes, "h").withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    m = m.select("h", "fp", "s1", "s2", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        side = lambda k: pdf.loc[pdf["blk"] == k, ["fp", "s1", "s2"]].to_numpy(np.int64)
        p = _agreeing(side(i), None if i == j else side(j), least)
        return pd.DataFrame({"a": p[:, 0], "b": p[:, 1]})

    return m.groupBy("h", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def similar_sets(df: DataFrame, id_col: str, text_col: str, title_col: str | None = None, threshold: float = 0.8, shingle: int = 5, bands: int = 44, rows: int = 4, bucket_cap: int = 4096, hot_block: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """(members, links): members ``id, fp`` with one fingerprint per distinct shingle set; links ``a, b, similarity`` between
    fingerprints of different sets whose exact Jaccard similarity is at least ``threshold``."""
    docs = df.select(F.col(id_col).cast("string").alias("id"), (F.col(title_col) if title_col else F.lit(None).cast("string")).cast("string").alias("title"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    least = least_agreement(threshold)
    signed = docs.mapInPandas(_sign(shingle, bands, rows, bucket_cap), "h bigint, fp bigint, s1 bigint, s2 bigint, id string")
    stream = signed.repartition("h").sortWithinPartitions("h")  # one integer key: a radix sort
    found = materialize(stream.mapInPandas(_bucket_pairs(bucket_cap, least), "kind int, a bigint, b bigint, s1 bigint, s2 bigint, id string"), "candidates")
    members = found.where("kind = 2").select("id", F.col("a").alias("fp")).distinct()
    cand = found.where("kind = 0").select("a", "b")
    hot = found.where("kind = 1").select(F.col("a").alias("h"), F.col("b").alias("fp"), "s1", "s2")
    if not hot.isEmpty():
        cand = cand.unionByName(_hot_pairs(hot.dropDuplicates(["h", "fp"]), min(hot_block, 4 * bucket_cap), least))
    cand = materialize(cand.distinct(), "pairs")
    wanted = cand.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    own = members.groupBy("id").agg(F.count("*").alias("n"))
    rep = members.join(wanted, "fp", "left_semi").join(own, "id").groupBy("fp").agg(F.min(F.struct("n", "id")).alias("r")).select("fp", "r.n", "r.id")
    sets = docs.join(rep, "id")
    # an id with several texts: only the text with the wanted fingerprint stands for it
    sets = sets.mapInPandas(_same_fingerprint(shingle), sets.schema).dropDuplicates(["fp"])

    def jaccard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(shingle, 1, 1)
        for pdf in batches:
            sim, sets = [], {}  # a text's shingles are taken once a batch
            for a, ta, xa, b, tb, xb in zip(pdf["a"], pdf["ta"], pdf["xa"], pdf["b"], pdf["tb"], pdf["xb"]):
                for f, t, x in ((a, ta, xa), (b, tb, xb)):
                    if f not in sets:
                        sets[f] = signer.shingles(words(t, x))
                n = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                sim.append(n / (len(sets[a]) + len(sets[b]) - n) if n else 0.0)
            pdf = pdf[["a", "b"]].assign(similarity=sim)
            yield pdf[pdf["similarity"] >= threshold]

    sa = sets.select(F.col("fp").alias("a"), F.col("title").alias("ta"), F.col("text").alias("xa"))
    sb = sets.select(F.col("fp").alias("b"), F.col("title").alias("tb"), F.col("text").alias("xb"))
    links = cand.join(sa, "a").join(sb, "b").mapInPandas(jaccard, "a bigint, b bigint, similarity double")
    return members, links


def expand_pairs(members: DataFrame, links: DataFrame, block: int = 4_096) -> DataFrame:
    """All pairs of ids of linked sets and of copies. A set under more than ``block`` ids is split: each pair of its blocks is a key."""
    n = members.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > block).select("fp", F.ceil(F.col("n") / block).cast("int").alias("n_blk"))
    m = members.join(F.broadcast(n) if small(n) else n, "fp", "left").withColumn("n_blk", F.coalesce("n_blk", F.lit(1)))
    m = m.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("n_blk")).cast("int"))
    x = m.select("fp", F.col("id").alias("ia"), F.col("blk").alias("i"), F.explode(F.sequence("blk", F.col("n_blk") - 1)).alias("j"))
    y = m.select("fp", F.col("id").alias("ib"), F.explode(F.sequence(F.lit(0), "blk")).alias("i"), F.col("blk").alias("j"))
    copies = x.join(y, ["fp", "i", "j"]).where("i < j and ia <> ib or ia < ib").select("ia", "ib")
    a, b = members.select(F.col("id").alias("ia"), F.col("fp").alias("a")), members.select(F.col("id").alias("ib"), F.col("fp").alias("b"))
    near = links.join(a, "a").join(b, "b").where("ia <> ib").select("ia", "ib")
    return near.unionByName(copies).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def near_duplicate_links(df: DataFrame, id_col: str, text_col: str, title_col: str | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """(pairs ``id_a, id_b, similarity`` of class representatives, membership ``id, representative``): a representative is the smallest id of
    the records with one set of shingles, so copies are rows of the membership and not pairs."""
    members, links = similar_sets(df, id_col, text_col, title_col, **kw)
    names = members.groupBy("fp").agg(F.min("id").alias("representative"))
    a, b = names.select(F.col("fp").alias("a"), F.col("representative").alias("ra")), names.select(F.col("fp").alias("b"), F.col("representative").alias("rb"))
    pairs = links.join(a, "a").join(b, "b").where("ra <> rb")
    return pairs.select(F.least("ra", "rb").alias("id_a"), F.greatest("ra", "rb").alias("id_b"), "similarity"), members.join(names, "fp").select("id", "representative")


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, title_col: str | None = None, **kw) -> DataFrame:
    """All pairs ``id_a < id_b`` at or above the threshold, pairs of exact copies included."""
    members, links = similar_sets(df, id_col, text_col, title_col, **kw)
    return expand_pairs(members, materialize(links, "links"))


def connected_components(nodes: DataFrame, links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``node, class``: smallest node reachable. Labels are passed along links and shortcut (label of the label) each round, with a
    durable cut per round; rounds grow with the logarithm of the longest chain."""
    edges = materialize(links.select(F.col("a").alias("s"), F.col("b").alias("d")).unionByName(links.select(F.col("b").alias("s"), F.col("a").alias("d"))).where("s <> d").distinct(), "edges")
    spark = links.sparkSession
    cut = lab = materialize(edges.select(F.col("s").alias("node")).distinct().withColumn("class", F.col("node")), "labels")
    for _ in range(max_rounds):
        low = edges.join(lab, edges.s == lab.node).groupBy("d").agg(F.min("class").alias("m"))
        step = lab.join(low, lab.node == low.d, "left").select("node", F.col("class").alias("old"), F.least("class", F.coalesce("m", "class")).alias("class"))
        up = step.select(F.col("node").alias("n2"), F.col("class").alias("c2"))
        nxt = materialize(step.join(up, step["class"] == up.n2, "left").select("node", "old", F.least("class", F.coalesce("c2", "class")).alias("class")), "labels")
        done = nxt.where("old <> class").isEmpty()
        discard(spark, cut)
        cut, lab = nxt, nxt.select("node", "class")
        if done:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return nodes.join(lab, "node", "left").select("node", F.coalesce("class", "node").alias("class"))


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, title_col: str | None = None, **kw) -> DataFrame:
    """One row per id: ``id, class_id`` (smallest id of its class), ``class_size``, ``n_links`` (its set's links to other sets)."""
    members, links = similar_sets(df, id_col, text_col, title_col, **kw)
    links = materialize(links, "links")
    comp = connected_components(members.select(F.col("fp").alias("node")).distinct(), links)
    deg = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    m = members.join(comp.withColumnRenamed("node", "fp"), "fp").join(deg, "fp", "left")
    m = m.groupBy("id").agg(F.min("class").alias("class"), F.coalesce(F.sum("n_links"), F.lit(0)).cast("bigint").alias("n_links"))
    names = m.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    ids = df.select(F.col(id_col).cast("string").alias("id")).where("id is not null").distinct()
    out = m.join(names, "class").select("id", "class_id", "class_size", "n_links")
    return ids.join(out, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
