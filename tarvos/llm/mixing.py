"""Mixing sources to target weights.

Every document gets a hash-random key; the key's leading bits range-partition a source, sums of token counts per (source, range) are
prefix-summed and added to the running sum inside a range, so a source of any size is cut at its exact budget without one task
holding it. A source is repeated in whole epochs plus one cut epoch, at most ``max_repeats`` epochs in all.

Defined results: null text counts 0 tokens; documents of unlisted or null sources are left out; a listed source without documents has 0
tokens and falls short unless its target is 0; duplicate target rows of a source are an error raised as such; ties of keys break by id;
repeated document ids are separate documents; null shares or repeats count as 0; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the published split pattern of the byte-level vocabularies.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a list of texts to token counts, for a .tiktoken, .json or .model vocabulary file."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        enc = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]


def token_counts(docs: DataFrame, id_col: str, source_col: str, text_col: str, vocabulary: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = encoder(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "tokens": count(pdf["text"].fillna("").tolist())})

    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return d.mapInPandas(run, "id bigint, source string, tokens bigint")


def plan_budgets(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: own tokens, the target of the total, the budget it can fill, whole epochs and the rest to cut."""
    t = targets.where("source is not null").select("source", F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)).alias("max_repeats"))
    t = t.withColumn("target_share", F.when(F.count("*").over(Window.partitionBy("source")) > 1, F.raise_error("a source has two targets").cast("double")).otherwise(F.col("target_share")))
    own = tokens.groupBy("source").agg(F.sum("tokens").alias("own_tokens"), F.count("*").alias("n_docs"))
    p = t.join(own, "source", "left").fillna(0, ["own_tokens", "n_docs"])
    total = F.sum("own_tokens").over(Window.partitionBy(F.lit(1)))  # one row per target, a bounded table
    p = p.withColumn("target_tokens", F.col("target_share") * total)
    p = p.withColumn("budget", F.least("target_tokens", F.col("max_repeats") * F.col("own_tokens").cast("double")))
    p = p.withColumn("epochs", F.when(F.col("own_tokens") > 0, F.floor(F.col("budget") / F.col("own_tokens"))).otherwise(F.lit(0)).cast("int"))
    return p.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("own_tokens"))


def draw(tokens: DataFrame, plan: DataFrame, seed: int = 13, docs_per_range: int = 50_000) -> DataFrame:
    """``id, source, tokens, copies``: each drawn document and how often. The cut epoch takes the documents in key order whose
    running sum stays within the rest."""
    k = tokens.withColumn("key", F.xxhash64(F.lit(seed), "id"))
    ranges = plan.select("source", "epochs", "rest", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / docs_per_range)).cast("bigint").alias("n_ranges"))
    # unsigned leading bits of the key, scaled to the source's number of ranges
    k = k.join(ranges, "source").withColumn("range", F.floor(F.shiftrightunsigned("key", 33) * F.col("n_ranges") / F.lit(2.0**31)).cast("bigint"))
    per = k.groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))
    before = per.select("source", "range", (F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range")).alias("before"))
    run = F.col("before") + F.sum("tokens").over(Window.partitionBy("source", "range").orderBy(F.shiftrightunsigned("key", 1), "key", "id", "tokens").rowsBetween(Window.unboundedPreceding, 0))
    out = k.join(before, ["source", "range"]).withColumn("running", run)
    return out.select("id", "source", "tokens", (F.col("epochs") + (F.col("running") <= F.col("rest")).cast("int")).alias("copies")).where("copies > 0")


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """(draws, report). The report has, per source, the target, the tokens drawn, the share reached and whether it falls short
    because ``max_repeats`` epochs of all its documents do not reach the target."""
    listed = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    names = targets.select("source").where("source is not null").distinct()
    listed = listed.join(F.broadcast(names) if _small(targets) else names, "source", "left_semi")
    tokens = materialize(token_counts(listed, "id", "source", "text", vocabulary), "tokens")
    plan = materialize(plan_budgets(tokens, targets), "mixplan")
    draws = draw(tokens, plan, seed)
    got = draws.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"))
    rep = plan.join(got, "source", "left").fillna(0, ["drawn_tokens", "most_copies"])
    all_drawn = F.sum("drawn_tokens").over(Window.partitionBy(F.lit(1)))
    exhausted = F.col("drawn_tokens") >= F.col("max_repeats") * F.col("own_tokens")
    rep = rep.withColumn("short", exhausted & (F.col("target_tokens") > F.col("drawn_tokens")))
    rep = rep.withColumn("actual_share", F.when(all_drawn > 0, F.col("drawn_tokens") / all_drawn).otherwise(F.lit(0.0)))
    return draws, rep.select("source", "target_share", "max_repeats", "n_docs", "own_tokens", "target_tokens", "drawn_tokens", "most_copies", "actual_share", "short")


def _small(targets: DataFrame, limit: int = 100_000) -> bool:
    return targets.limit(limit + 1).count() <= limit
