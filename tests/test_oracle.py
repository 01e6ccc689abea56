"""Every core query against its SQL in DuckDB, on the smallest tables."""

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from tarvos.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings manifest stage_events crawl_records chunks html_corpus quality_labels eval_items mix_targets".split()
# What no SQL can say, and what its rows must be instead: a number of rows and a test on each.
CHECKED = {
    "html_blocks": (1_100, lambda r: r.kind in ("heading", "paragraph", "list") and (r.kind != "list" or r.list_items == "one|two")),
    "run_pipeline": (120, lambda r: r.context.startswith("[Chunk 1 | Section: ")),
}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    if name not in SQL:
        least, good = CHECKED[name]  # a query has SQL or a check
        rows = df.collect()
        assert len(rows) >= least and all(good(r) for r in rows)
        return
    got = Counter(repr([cell(r[c]) for c in cols]) for r in df.collect())
    res = duck.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = Counter(repr([cell(r[names.index(c)]) for c in cols]) for r in res.fetchall())
    assert got == want
