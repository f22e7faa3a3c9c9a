import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import plain
from viewtide.llm import ball_search as B, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rank(docs, items, top):
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, words = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 100 - 50 + (50 * c.total() * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:top], start=1)]
    return sorted(out, key=repr)


def tables(spark, docs, items):
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumns({c: F.lit("x") for c in ("q", "rank", "doc_id")})
    return plain.documents(spark, docs).withColumns({c: F.lit("x") for c in ("terms", "tf", "n", "q")}), benchmark


def some_texts(rng, n):
    words = [f"w{i}" for i in range(60)] + ["É", "é", "naïve", "x\x85y"]
    return [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randint(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("tree, leaf, block", [(B.TREE, B.LEAF, B.ITEMS), (16, 2, 3)])
def test_against_definition(spark, monkeypatch, tree, leaf, block):
    rng = random.Random(tree)
    docs = list(enumerate(some_texts(rng, 250)))
    docs += [(900, None), (901, ""), (902, " .,!"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (903, "W1-w2_w3 w1w2")] + docs[:20]
    items = list(enumerate(some_texts(rng, 7))) + [(50, None), (51, "!"), (52, "nowhere"), (None, "w1 w40"), (0, "w5 w5 w6")]
    for name, value in (("TREE", tree), ("LEAF", leaf), ("ITEMS", block), ("PROBE", 4)):
        monkeypatch.setattr(B, name, value)
    for top in (50, 3):
        got = B.search(*tables(spark, docs, items), top=top)
        assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == rank(docs, items, top)


def random_tree(rng, n, width):
    rows = []
    for i in range(n):      # ten kinds of documents with terms of their own, and some terms of all
        own = np.arange(width) % 10 == i % 10
        t = np.flatnonzero(rng.random(width) < np.where(own, 0.9, 0.02))
        t = t if len(t) else np.array([0])
        rows.append((t, rng.integers(0, 10**10, len(t))))
    bands = np.sort(rng.integers(0, B.BANDS, width))
    return rows, bands, B.Tree.build(list(range(n)), rows, bands)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    rows, bands, tree = random_tree(rng, 500, 40)
    assert sorted(tree.docs) == list(range(500))
    scored = 0
    for _ in range(20):
        item = np.arange(rng.integers(10), 40, 10)
        chosen = np.isin(np.arange(40), item)
        truth = [int(v[chosen[t]].sum()) for t, v in rows]
        for node in range(len(tree.lo)):
            assert tree.bound(node, item, bands) >= max(truth[d] for d in tree.docs[tree.lo[node]:tree.hi[node]])
        best = []
        scored += tree.search(item, chosen, bands, best, 5, 1)
        assert sorted(best) == sorted((s, -d) for s, d in sorted(((s, d) for d, s in enumerate(truth) if s), key=lambda x: (-x[0], x[1]))[:5])
        floor = sorted(truth)[-5]
        again = []
        tree.search(item, chosen, bands, again, 5, floor)
        assert sorted(again) == sorted(best)
    assert scored < 0.5 * 20 * 500


def test_one_leaf_and_equal_documents():
    rows = [(np.array([1, 3]), np.array([7, 9]))] * 100
    tree = B.Tree.build(list(range(100)), rows, np.zeros(4, dtype=int))
    best, chosen = [], np.array([False, True, False, False])
    tree.search(np.array([1]), chosen, np.zeros(4, dtype=int), best, 3, 1)
    assert sorted(best, reverse=True) == [(7, 0), (7, -1), (7, -2)]


def test_very_long_text(spark):
    docs = [(1, "alpha beta " * 400_000), (2, "alpha gamma"), (3, "delta")]
    items = [(0, "alpha beta"), (1, "gamma")]
    got = B.search(*tables(spark, docs, items))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == rank(docs, items, 50)


def test_empty_tables(spark):
    for docs, items in (([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])):
        got = B.search(*tables(spark, docs, items))
        assert got.count() == 0 and got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = con.sql(queries.SQL["op12_ball_tree_search"])
    got = queries.op12_ball_tree_search(spark, SF)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
