"""Recall against brute force, ties, and vectors that take no part."""

import numpy as np

from tidebar.llm import ann

SCHEMA = "vec_id long, embedding array<float>, v string, list int, part string"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "v", 1, "p") for i, x in rows], SCHEMA).repartition(3)


def brute(rows, query, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    d = np.sqrt(((x - x[ids == query][0]) ** 2).sum(1))
    d[ids == query] = np.inf
    return [int(ids[j]) for j in np.lexsort((ids, d))[:k]]


def test_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 3
    rows = [(i, (centres[i % 20] + rng.normal(size=16)).tolist()) for i in range(3000)]
    df = frame(spark, rows)
    got = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0"), part=100).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = sum(len(set(v) & set(brute(rows, q, 10))) for q, v in got.items())
    assert len(got) == 30 and hits >= 0.9 * 300


def test_recall_with_rows_twelve_times(spark):
    """Repeated rows crowd nobody out: ten different neighbours for each query, in lists cut into many parts too."""
    rng = np.random.default_rng(1)
    once = [(i, rng.normal(size=8).tolist()) for i in range(500)]
    df = frame(spark, once * 12)
    for part in (40, 20_000):
        got = {}
        for r in ann.search(df, df.where("vec_id % 100 = 0"), part=part).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert [len(set(v)) for v in got.values()] == [10] * 5
        assert sum(len(set(v) & set(brute(once, q, 10))) for q, v in got.items()) >= 45


def test_rows_of_one_id_are_dealt_out(spark):
    """One id with many vectors, in parts of its own list, is one candidate."""
    rng = np.random.default_rng(2)
    rows = [(7, rng.normal(size=4).tolist()) for _ in range(600)] + [(i, rng.normal(size=4).tolist()) for i in range(100, 130)]
    df = frame(spark, rows)
    got = [(r["vec_id"], r["score"]) for r in ann.search(df, df.where("vec_id = 100"), part=50, recall=1.0).orderBy("rank").collect()]
    q = np.array(dict(rows)[100], np.float32).astype(float)
    best = {}
    for i, v in rows:
        if i != 100:
            best[i] = min(best.get(i, np.inf), float(np.sqrt(((np.array(v, np.float32).astype(float) - q) ** 2).sum())))
    assert len(got) == 10 and len({i for i, _ in got}) == 10
    assert got[0] == (min(best, key=best.get), min(best.values()))


def test_walk_meets_the_nearest_centroids():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 6))
    index = ann.fit(x, 200, 10, 0.97)
    far = ann.walk(index, x[:200], 1.2)
    d = np.sqrt(ann._squared(x[:200], index.centroids))
    assert (far.argmin(1) == d.argmin(1)).mean() > 0.97 and np.allclose(far[np.isfinite(far)], d[np.isfinite(far)])


def test_ties_and_odd_vectors(spark):
    same = [(i, [1.0, 2.0]) for i in range(400)]
    odd = [(1000, None), (1001, [0.0, 0.0]), (1002, [float("nan"), 1.0]), (1003, [float("inf"), 1.0]), (1004, [1.0, None]), (1005, [1.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])]
    df = frame(spark, same + odd)
    out = ann.search(df, df.where("vec_id in (0, 300, 1000, 1001)"), part=64).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out] == [(0, k, k, 0.0) for k in range(1, 11)] + [(300, k + 1, k, 0.0) for k in range(10)]


def test_few_and_none(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert [(r["vec_id"], r["score"]) for r in ann.search(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(2, 1.0), (1, 2**0.5)]
    none = df.limit(0)
    assert ann.search(none, none).count() == 0
    one = frame(spark, [(0, [1.0, 0.0])])
    assert ann.search(one, one).count() == 0


def test_repeated_ids_leave_room_for_others(spark):
    """Two other ids of twelve rows each are two neighbours, and rows that stand twice crowd nobody out."""
    rows = [(0, [1.0, 0.0]), *((1, [1.0 + j / 100, 0.1]) for j in range(12)), *((2, [2.0 + j / 100, 0.1]) for j in range(12))]
    df = frame(spark, rows)
    assert [r["vec_id"] for r in ann.search(df, df.where("vec_id = 0"), k=2).orderBy("rank").collect()] == [1, 2]
    twice = frame(spark, [(i, [1.0 + i, 1.0]) for i in range(12)] * 2)
    assert [r["vec_id"] for r in ann.search(twice, twice.where("vec_id = 0"), k=10).orderBy("rank").collect()] == list(range(1, 11))
