import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidebar.llm import search

ITEMS = "item_id long, text string, rank string, score int, doc_id int, _group string"
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top=50):
    """The contract over lists of (doc_id, text) and (item_id, text)."""
    split = lambda t: _TERM.findall((t or "").translate(_LOWER))
    own = [(i, Counter(split(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for item, wanted in asked.items():
        hits = []
        for i, c in own:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total if c else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted & set(c))
            if s > 0:
                hits.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(hits)[:top])]
    return sorted(out, key=repr)


def items_of(rng):
    words = "the of and river stone idea walks under bright signal harbour quiet engine paper north winter glass little orchard seven 日本 12345".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for i in range(12)]
    return [*rows, (3, "glass Glass, winter"), (None, "THE river"), (40, None), (41, ""), (42, "unheard-of zzz"), (43, "zzz")]


@pytest.mark.parametrize("sizes", [{}, {"top": 3, "block": 64, "leaf": 1}, {"top": 5, "leaf": 4, "block_terms": 3, "pass_terms": 10}])
def test_equals_plain(spark, odd, odd_rows, sizes):
    items = items_of(random.Random(2))
    df = spark.createDataFrame([(*i, "a", 1, 2, "g") for i in items], ITEMS)
    got = search.rank(odd, df, **sizes)
    assert sorted(map(tuple, got.collect()), key=repr) == plain([(r[0], r[1]) for r in odd_rows], items, sizes.get("top", 50))


def test_empty(spark, odd, none):
    items = spark.createDataFrame([(1, "the river")], "item_id long, text string")
    assert search.rank(none, items).collect() == []
    assert search.rank(odd, items.where("item_id > 1")).collect() == []
    assert search.rank(odd, spark.createDataFrame([(1, " ?!")], "item_id long, text string")).collect() == []


def test_tree_shares_paths_and_bounds_hold():
    rng = np.random.default_rng(1)
    p = np.linspace(0.9, 0.02, 30)
    tf = (rng.random((700, 30)) < p).astype(np.int32) * rng.integers(1, 6, (700, 30)).astype(np.int32)
    tf[100:400] = tf[100]  # a large group of copies
    m, ids = rng.integers(51, 400, 700), np.arange(700)
    order, tree = search.grow(tf, m, ids, 8)
    assert sorted(order.tolist()) == list(range(700))
    t, norms = tf[order], m[order]
    for k in range(len(tree.lo)):
        own = slice(tree.lo[k], tree.hi[k])
        assert (tree.tf[k] == t[own].max(axis=0)).all() and tree.m[k] == norms[own].min() and tree.first[k] == ids[order][own].min()
        if tree.children[k]:
            parts = [(tree.lo[c], tree.hi[c]) for c in range(tree.child[k], tree.child[k] + tree.children[k])]
            assert parts[0][0] == tree.lo[k] and parts[-1][1] == tree.hi[k] and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    cols, w = np.array([3, 17, 25, 29]), np.array([200, 900, 1500, 3000])
    best = []
    scored = search.search(tree, t, norms, ids[order], cols, w, best, 10)
    all_ = search.gains(t[:, cols].astype(np.int64), norms, w)
    assert sorted(best, reverse=True) == sorted(((int(s), -int(i)) for s, i in zip(all_, ids[order], strict=True)), reverse=True)[:10]
    assert scored < 500  # whole branches were left out


def test_sql(spark, smoke_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{smoke_dir}/{t}.parquet'")
    want = con.sql(search.SQL)
    assert sorted(map(tuple, search.query(spark, smoke_dir).select(want.columns).collect())) == sorted(want.fetchall())
