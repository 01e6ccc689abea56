"""Near duplicates against brute force, the path of large buckets, and edge cases."""

import random
from itertools import combinations

from tarvos.llm import near_dup as nd

SCHEMA = "chunk_id string, text string, document_title string, fp int, h int"


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(n):
        base = [rng.choice(vocab) for _ in range(60)]
        for k in range(rng.choice([1, 1, 2, 3])):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((f"c{g}_{k}", " ".join(w), f"title {g}", 1, 2))
    return rows


def brute(rows, n, threshold):
    out = set()
    for a, b in combinations(rows, 2):
        x, y = nd.shingle_set(a[2], a[1], n), nd.shingle_set(b[2], b[1], n)
        if a[0] != b[0] and x and y and len(x & y) / len(x | y) >= threshold:
            out.add(tuple(sorted((a[0], b[0]))))
    return out


def found(spark, rows, **kw):
    d = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in nd.near_duplicate_pairs(d, "chunk_id", "text", "document_title", **kw).collect()}


def test_pairs_match_brute_force(spark):
    rows = corpus()
    want = brute(rows, 3, 0.5)
    assert want and found(spark, rows, threshold=0.5, shingle=3) == want


def test_large_buckets_lose_no_pair(spark):
    base = [f"w{i}" for i in range(50)]
    rows = []
    for k in range(30):  # one family of 30 different texts, and a copy of one of them many times over
        w = list(base)
        w[k] = f"x{k}"
        rows.append((f"a{k:02}", " ".join(w), None, 1, 2))
    rows += [(f"z{i:02}", rows[0][1], None, 1, 2) for i in range(15)]
    want = brute(rows, 3, 0.5)
    assert found(spark, rows, threshold=0.5, shingle=3, bucket_cap=4) == want
    assert found(spark, rows, threshold=0.5, shingle=3) == want


def test_a_hot_bucket_is_split_before_the_shuffle(spark, monkeypatch):
    """Members of a bucket beyond the limit go to tasks of their own, and all pairs with those that stayed are found."""
    import numpy as np
    import pandas as pd

    base = [f"w{i}" for i in range(50)]
    rows = []
    for k in range(40):
        w = list(base)
        w[k] = f"x{k}"
        rows.append((f"a{k:02}", " ".join(w), None, 1, 2))
    pdf = pd.DataFrame([(r[0], r[2], r[1]) for r in rows], columns=["id", "title", "text"])
    out = pd.concat(nd._sign(3, 36, 3, 5)(iter([pdf])))
    moved, marks = out[out["id"].fillna("").str.startswith("\x00")], out[out["fp"] == nd.MARK]
    assert len(marks) and set(marks["h"]) == {int(x[1:]) for x in moved["id"]} and np.mean(~moved["h"].isin(marks["h"])) == 1
    want = brute(rows, 3, 0.5)
    for cap in (3, 10, 4096):
        assert found(spark, rows, threshold=0.5, shingle=3, bucket_cap=cap) == want


def test_representatives_and_membership(spark):
    a = [f"w{i}" for i in range(40)]
    rows = [(f"z{i}", " ".join(a), None, 1, 2) for i in range(20)] + [("y", " ".join(a[:-2]), None, 1, 2), ("q", "p q r s t u", None, 1, 2)]
    pairs, members = nd.near_duplicate_links(spark.createDataFrame(rows, SCHEMA), "chunk_id", "text", threshold=0.5, shingle=3)
    assert [tuple(r)[:2] for r in pairs.collect()] == [("y", "z0")]
    assert {tuple(r) for r in members.collect()} == {(f"z{i}", "z0") for i in range(20)} | {("y", "y"), ("q", "q")}
    m, l = nd.similar_sets(spark.createDataFrame(rows, SCHEMA), "chunk_id", "text", threshold=0.5, shingle=3)
    want = {tuple(r) for r in nd.expand_pairs(m, l).collect()}
    assert len(want) == 20 * 19 // 2 + 20 and {tuple(r) for r in nd.expand_pairs(m, l, block=3).collect()} == want  # copies in blocks


def test_groups_join_all_pairs_of_the_problem(spark):
    import os

    from tarvos.llm.queries import p1_found, p1_groups

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    of = {r.id: r.class_id for r in p1_groups(spark, sf).collect()}
    pairs = p1_found(spark, sf).collect()
    assert pairs and all(of[r.chunk_id_a] == of[r.chunk_id_b] for r in pairs)


def test_edges_and_repeats(spark):
    rows = [("a", None, None, 1, 2), ("b", "", "", 1, 2), ("c", "one two", None, 1, 2), (None, "x y z k", None, 1, 2), ("d", "p q r s t u v", None, 1, 2), ("d", "p q r s t u v", None, 1, 2), ("e", "P, q-r s. t u V", None, 1, 2), ("long", "lorem ipsum " * 100_000, "t", 1, 2)]
    assert found(spark, rows, threshold=0.5, shingle=3) == {("d", "e")}
    g = {r.id: r for r in nd.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), "chunk_id", "text", "document_title").collect()}
    assert set(g) == {"a", "b", "c", "d", "e", "long"} and g["e"].class_id == "d" and g["d"].class_size == 2 and g["a"].class_size == 1
    assert found(spark, rows[:0] or [], threshold=0.5) == set()


def test_groups_join_chains(spark):
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(6):
        rows.append((f"c{k}", " ".join(base), None, 1, 2))
        base = base[6:] + [f"n{k}_{j}" for j in range(6)]
    g = nd.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), "chunk_id", "text", threshold=0.7, shingle=2).collect()
    assert {r.class_id for r in g} == {"c0"} and sorted(r.n_links for r in g) == [2, 2, 3, 3, 4, 4]  # two steps along the chain still pass


def test_minmax_estimates_are_unbiased():
    import numpy as np

    rng = random.Random(3)
    a = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    b = a[:150] + [f"v{rng.randrange(10**6)}" for _ in range(150)]
    x, y = nd.shingle_set(None, " ".join(a), 1), nd.shingle_set(None, " ".join(b), 1)
    _, _, sig = nd.Signer(1, 250, 4)([a, b])
    assert abs(np.mean(sig[0] == sig[1]) - len(x & y) / len(x | y)) < 0.05


def test_one_id_with_two_texts(spark):
    a, b = [" ".join(f"{x}{i}" for i in range(40)) for x in "pq"]
    rows = [("two", a, None, 1, 2), ("two", b, None, 1, 2), ("x", a + " more", None, 1, 2), ("y", b + " more", None, 1, 2)]
    assert found(spark, rows, threshold=0.5, shingle=3) == {("two", "x"), ("two", "y")}
