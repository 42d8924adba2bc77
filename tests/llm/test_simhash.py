"""Groups against all pairs, with groups split and not."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidebar.llm import simhash


def plain_fp(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(fps):
    low = list(range(len(fps)))
    far = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None]) <= 3
    while True:
        new = [min(low[j] for j in np.flatnonzero(far[i])) for i in range(len(fps))]
        if new == low:
            return low
        low = new


def test_groups(spark, odd, odd_rows, none):
    rows = sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [plain_fp(t) for _, t, *_ in rows]
    low = closure(fps)
    want = sorted((str(r[0]), f"{fp:016x}", rows[g][0]) for r, fp, g in zip(rows, fps, low))
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.groups(odd).collect())
    assert got == want
    assert simhash.groups(none).count() == 0
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(rows[g][0]) for g in low})


def near(n, seed):
    """Numbers in chains of single-bit steps, and random ones."""
    rng = np.random.default_rng(seed)
    out = set(rng.integers(0, 1 << 63, n, dtype=np.uint64).tolist())
    for start in list(out)[:20]:
        x = start
        for _ in range(30):
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            out.add(x)
    return sorted(out)


def test_gray_index_is_all_pairs():
    for seed in range(5):
        fps = np.array(near(300, seed), np.uint64)
        np.random.default_rng(seed).shuffle(fps)
        got = simhash.gray_links(fps, chunk=64)
        groups = closure([int(x) for x in fps])
        smallest = {}
        for i, g in enumerate(groups):
            smallest[g] = min(smallest.get(g, i), i, key=lambda j: int(fps[j]))
        assert [int(x) for x in got] == [smallest[g] for g in groups]


@pytest.mark.parametrize("most", [3, 4096])
def test_links_connect_the_same(spark, most):
    fps = near(200, 9)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, most=most)).collect()}
    low = closure(fps)
    smallest = {}
    for x, g in zip(signed, low):
        smallest[g] = min(smallest.get(g, x), x)
    assert all(roots.get(x, x) == smallest[g] for x, g in zip(signed, low))


def test_gray_neighbours_differ_in_one_bit():
    order = np.argsort(simhash.gray_rank(np.arange(256, dtype=np.uint64)))
    assert set(np.bitwise_count(order[1:] ^ order[:-1])) == {1}


def test_long_chain(spark):
    df = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in simhash.components(df).collect()} == {0}
