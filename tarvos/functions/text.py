"""Scalar text expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that normalisation replaces, one for one and by other strings.
SINGLE = "‘’‚‛“”„‟\u00a0\u202f•●◦"
PLAIN = "'" * 4 + '"' * 4 + "  ---"
DASHES = "–—"
NOTHING = "\u00ad\u200b\u200c\u200d\ufeff"
# Words whose full stop ends no sentence, in any case; i.e. and e.g. have two.
ABBREVIATIONS = ["Ph", "M", "B", "Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "St", "No", "Sec", "Reg", "Vol", "vs", "etc", "approx", "dept", "univ", "govt", "viz"]
# Phrases of answers that answer nothing, in the application and in the evaluation.
NO_ANSWER = ["i could not find this information", "don't have information", "not mentioned in", "not available in", "cannot find", "no information", "not covered", "not found in", "does not contain", "i cannot answer", "outside the scope", "not in the provided"]
NO_ANSWER_EVAL = ["i could not find this information", "could not find", "not available in", "no information", "not found in", "does not contain"]
DOT = "\x01"


def squash(c: Column) -> Column:
    """White space runs to one blank, trimmed; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def normalize(c: Column) -> Column:
    """NFKC, plain quotes, bullets as hyphens, spaced dashes, three dots for an ellipsis, no zero-width characters, squashed."""
    x = F.translate(nfkc(c), SINGLE, PLAIN)
    x = F.regexp_replace(F.replace(x, F.lit("…"), F.lit("...")), f"[{DASHES}]", " - ")
    return squash(F.regexp_replace(x, f"[{NOTHING}]", ""))


def token_estimate(c: Column) -> Column:
    """The default tokenizer-free count: a token per four characters."""
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4).cast("bigint")


def sentences(c: Column) -> Column:
    """Array of sentences: breaks after a full stop and white space, the stops of abbreviations (whole words, any case) protected."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\b(i)\.(e)\.|\b(e)\.(g)\.", f"$1$3{DOT}$2$4{DOT}")
    x = F.regexp_replace(x, rf"(?i)\b({'|'.join(ABBREVIATIONS)})\.", f"$1{DOT}")
    parts = F.split(x, r"(?<=\.)\s+")
    return F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit(DOT), F.lit(".")))), lambda p: p != "")


def words(c: Column) -> Column:
    """Lexical tokens of the ranking functions: ASCII letters, digits, %, @ and dots, lower case, longer than one character."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[a-zA-Z0-9%@.]+"), 0), lambda t: F.lower(t)), lambda t: F.length(t) > 1)


def word_list(c: Column) -> Column:
    """The same tokens without lambdas, for large inputs: an array that is [''] where there is none."""
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[a-zA-Z0-9%@.]{2,}"), 0)
    return F.split(F.lower(F.array_join(raw, " ")), " ")


def sentence_end_density(c: Column) -> Column:
    """Sentence ends per 100 words, 99 for texts under 60 words."""
    n = F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    return F.when(n < 60, F.lit(99.0)).otherwise(F.round(F.lit(100.0) * F.regexp_count(c, F.lit(r"[.!?]\s")) / n, 6))


def first_year(c: Column) -> Column:
    """First year 2015 to 2029, null if none."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"20(?:1[5-9]|2[0-9])", 0), F.lit("")).cast("int")


def point_id(c: Column) -> Column:
    """UUID version 5 in the URL namespace, by expressions only."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(c, "utf-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def no_answer(c: Column, phrases: list[str] = NO_ANSWER) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    x = F.lit(False)
    for p in phrases:
        x = x | F.contains(low, F.lit(p))
    return x
