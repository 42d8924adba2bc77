"""Near copies against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tidebar.llm import likeness, simhash


def plain(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def wanted(rows):
    """The smallest id of each group by all pairs."""
    sets = [plain(t) for _, t in rows]
    low = list(range(len(rows)))
    near = [[j for j, y in enumerate(sets) if 5 * len(x & y) >= 4 * len(x | y)] for x in sets]
    while True:
        new = [min(low[j] for j in js) for js in near]
        if new == low:
            return sorted({rows[g][0] for g in low})
        low = new


def copies():
    """Texts edited at one to twelve places, in chains too, and others that share a passage of theirs."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}"
    texts = []
    shared = [word() for _ in range(60)]
    for _ in range(25):
        body = [word() for _ in range(rng.choice([6, 40, 150]))] + (shared if rng.random() < 0.5 else [])
        texts.append(" ".join(body))
        for _ in range(4):
            for _ in range(rng.randrange(1, 4)):
                body[rng.randrange(len(body))] = word()
            texts.append(" ".join(body))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("most", [0, 50_000])
def test_stage_is_all_pairs(spark, most):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = wanted(rows)
    assert len(want) < len(rows)
    assert sorted(r["doc_id"] for r in likeness.representatives(docs, most=most, part=8 if most else 2048).collect()) == want
    if most:
        assert sorted(r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, "").collect()) == want
    sets = [plain(t) for _, t in rows]
    fps = [simhash.fingerprint(t, 5) for _, t in rows]
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert any((fps[i] ^ fps[j]).bit_count() > 3 for i, j in alike)


def test_odd_rows(spark, odd, odd_rows, none):
    rows = sorted(((r[0], r[1]) for r in odd_rows), key=lambda r: (r[0] is None, r[0] or 0))
    kept = likeness.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, wanted([(str(i), t) for i, t in rows])))
    assert likeness.representatives(none).count() == 0


def test_the_bound_leaves_out_no_like_sets():
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(1, 800))
        a = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.8, 1.0)], rng.integers(0, 1 << 48, int(n * rng.uniform(0, 0.15))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 5 * both >= 4 * (len(a) + len(b) - both):
            assert likeness.may_be_alike(len(a), len(b), likeness.histogram(a), likeness.histogram(b))
    far = rng.integers(0, 1 << 48, (2, 300)).astype(np.uint64)
    assert not likeness.may_be_alike(300, 300, likeness.histogram(far[0]), likeness.histogram(far[1]))


def test_sets_are_read_by_their_places(tmp_path):
    store = likeness.Sets(str(tmp_path))
    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 48, 5 * i + 1).astype(np.uint64)) for i in range(9)]
    name, starts = store.write(sets)
    assert all((likeness.Sets(f"file://{tmp_path}").read(name, s, len(h)) == h).all() for s, h in zip(starts, sets))


def test_prefix_is_of_the_rarest():
    h = np.arange(10, dtype=np.uint64)
    assert likeness.prefix(h, np.array([0, 1], np.uint64), np.array([5, 3])).tolist() == [2, 3, 4]


@pytest.mark.parametrize("part", [8, 2048])
def test_a_large_group_gives_fewer_rows_than_members(spark, tmp_path, part):
    """Near copies that all meet in many shingles, and as many that share these but are unlike: rows grow with the sets, not with the pairs."""
    rng = np.random.default_rng(6)
    draw = lambda n: np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
    body, passage = draw(90), draw(20)
    sets = [np.unique(np.concatenate([body, draw(5)])) for _ in range(60)] + [np.unique(np.concatenate([passage, draw(80)])) for _ in range(60)]
    name, starts = likeness.Sets(str(tmp_path)).write(sets)
    rows = [(key, fp, fp, len(h), pos, bytearray(likeness.histogram(h).tobytes()), name, s) for fp, (h, s) in enumerate(zip(sets, starts, strict=True)) for pos, key in enumerate((1, 2, 3) if fp < 60 else (1, 4, 5))]
    members = spark.createDataFrame(rows, "key long, fp long, root long, n int, pos int, buckets binary, file string, start long")
    got = [(r["a"], r["b"]) for r in likeness._meeting(members, str(tmp_path), part).collect()]
    groups = {(k, i, j) for k in range(1, 6) for i in range(-(-120 // part)) for j in range(i + 1)} if part == 8 else range(5)
    assert len(got) < 59 * min(len(groups), 5)
    low = list(range(120))
    for _ in low:
        for a, b in got:
            low[a] = low[b] = min(low[a], low[b])
    assert low[:60] == [0] * 60 and low[60:] == list(range(60, 120))
