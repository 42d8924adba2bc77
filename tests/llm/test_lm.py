"""The model against one counted in plain Python."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidebar.llm import lm
from tidebar.llm.common import crc_bucket, stored, table


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def plain(train):
    pairs = Counter(p for t in train for p in zip(["<s>", *tokens(t)], tokens(t)))
    words = Counter(w for t in train for w in tokens(t))
    before = Counter(w for _, w in pairs)
    d2, d1 = lm._discounts([Counter(pairs.values())[k] for k in (1, 2, 3, 4)]), lm._discounts([Counter(before.values())[k] for k in (1, 2, 3, 4)])
    cut = lambda c, d: [0, *d][min(c, 3)]
    spare = sum(cut(c, d1) for c in before.values()) / max(1, len(pairs))
    low = lambda w: max(before[w] - cut(before[w], d1), 0) / max(1, len(pairs)) + (spare if pairs else 1.0) / (len(words) + 1)
    of = Counter(words)
    of["<s>"] = len(train)
    kept, left = {}, defaultdict(lambda: 1.0)
    for (h, w), c in pairs.items():
        if c > 1:
            kept[h, w] = (c - cut(c, d2)) / of[h]
            left[h] -= kept[h, w]
    return words, lambda h, w: kept.get((h, w), 0) + left[h] * low(w)


@pytest.mark.parametrize("hot", [512, 20])
def test_scores(spark, odd, odd_rows, monkeypatch, hot):
    monkeypatch.setattr(lm, "LEAST_HOT", hot)
    monkeypatch.setattr(lm, "HOT", 1)
    train = [t for i, t, *_ in odd_rows if i is not None and i % 3]
    model = lm.train(odd.where("doc_id % 3 <> 0"), singles=False, order=2)
    words, p = plain(train)
    n = sum(words.values())
    assert (model.tokens, model.words) == (n, len(words))
    got = {}
    for r in lm.score(odd, model).collect():
        got[r["doc_id"]] = r
    for i, t, *_ in odd_rows:
        if i is None:
            continue
        w, r = tokens(t), got[i]
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(words[x] > 0 for x in w))
        assert math.isclose(r["base_score"], sum(math.log10((words[x] + 0.1) / (n + 0.1 * (len(words) + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w)), rel_tol=1e-4, abs_tol=1e-4)
    total = sum(p("the", w) for w in words) + p("the", "never seen")
    assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_empty(spark, none, odd, odd_rows):
    model = lm.train(none)
    assert model.tokens == 0 and lm.score(none, model).count() == 0
    rows = lm.score(odd, model).collect()
    assert len(rows) == len(odd_rows) and all(np.isfinite(r["score"]) for r in rows)


def test_singles_have_their_own_probability(spark):
    """By hand: pairs seen once keep what their discount leaves; a count of kinds over one byte is whole."""
    words = [f"w{i}" for i in range(300)]
    train = ["a b c", "a b d", "a b", *(f"e {w}" for w in words)]
    docs = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string")
    pairs = Counter(p for t in train for p in zip(["<s>", *tokens(t)], tokens(t)))
    of = Counter(h for h, _ in pairs.elements())
    before = Counter(w for _, w in pairs)
    d2, d1 = lm._discounts([Counter(pairs.values())[k] for k in (1, 2, 3, 4)]), lm._discounts([Counter(before.values())[k] for k in (1, 2, 3, 4)])
    less = lambda c, d: [0, *d][min(c, 3)]
    spare = sum(less(c, d1) for c in before.values()) / len(pairs)
    low = lambda w: (before[w] - less(before[w], d1)) / len(pairs) + spare / (len(before) + 1)
    left = lambda h: sum(less(c, d2) for (x, _), c in pairs.items() if x == h) / of[h] if of[h] else 1.0
    p = lambda h, w: max(0, pairs[h, w] - less(pairs[h, w], d2)) / max(1, of[h]) + left(h) * low(w)
    asked = {0: "a b c", 1: "e w7", 2: "b w7", 3: "new a"}
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(list(asked.items()), "doc_id long, text string"), lm.train(docs, order=2)).collect()}
    for i, t in asked.items():
        assert math.isclose(got[i], sum(math.log10(p(a, b)) for a, b in zip(["<s>", *tokens(t)], tokens(t))), rel_tol=1e-4)
    assert math.isclose(sum(p("e", w) for w in before) + p("e", "never seen"), 1.0, rel_tol=1e-9)


def plain_triples(train, singles):
    """Order 3 in plain Python: the probability of a word after two others (None: nothing stands before the begin)."""
    triples, pairs = Counter(), Counter()
    for t in train:
        s = ["<s>", *tokens(t)]
        pairs.update(zip(s, s[1:]))
        triples.update(zip(s, s[1:], s[2:]))
    kinds = Counter((v, w) for _, v, w in triples)
    kinds.update({p: c for p, c in pairs.items() if p[0] == "<s>"})
    before = Counter(w for _, w in pairs)
    vocabulary = {w for t in train for w in tokens(t)}
    d3, d2, d1 = (list(lm._discounts([Counter(c.values())[k] for k in (1, 2, 3, 4)])) for c in (triples, kinds, before))
    if not singles:
        d3[0] = 1.0
    less = lambda c, d: [0, *d][min(c, 3)]
    spare = sum(less(c, d1) for c in before.values()) / max(1, len(pairs))
    total, left2, left3 = Counter(), Counter(), Counter()
    for (v, _), c in kinds.items():
        total[v] += c
        left2[v] += less(c, d2)
    for (u, v, _), c in triples.items():
        left3[u, v] += less(c, d3)
    low = lambda w: max(0, before[w] - less(before[w], d1)) / max(1, len(pairs)) + (spare if pairs else 1.0) / (len(vocabulary) + 1)
    two = lambda v, w: (max(0, kinds[v, w] - less(kinds[v, w], d2)) + left2[v] * low(w)) / total[v] if total[v] else low(w)

    def three(u, v, w):
        if v == "<s>" or not pairs[u, v]:
            return two(v, w)
        return (max(0, triples[u, v, w] - less(triples[u, v, w], d3)) + left3[u, v] * two(v, w)) / pairs[u, v]

    return vocabulary, three


@pytest.mark.parametrize(("hot", "singles", "chars"), [(1, True, 8_000_000), (60, True, 800), (60, False, 8_000_000)])
def test_order_three(spark, odd, odd_rows, monkeypatch, hot, singles, chars):
    """Against the plain model: without and with words that are dealt out by all three words, in few and in many ranges."""
    monkeypatch.setattr(lm, "LEAST_HOT", hot)
    monkeypatch.setattr(lm, "HOT", 0)
    monkeypatch.setattr(lm, "RANGE_CHARS", chars)
    train = [t for i, t, *_ in odd_rows if i is not None and i % 3]
    model = lm.train(odd.where("doc_id % 3 <> 0"), singles=singles)
    assert model.order == 3 and (len(model.hot) > 2) == (hot == 60) and (model.bits > 3) == (chars == 800)
    words, p = plain_triples(train, singles)
    got = {r["doc_id"]: r["score"] for r in lm.score(odd, model).collect()}
    for i, t, *_ in odd_rows:
        if i is not None:
            w = ["<s>", *tokens(t)]
            assert math.isclose(got[i], sum(math.log10(p(*x)) for x in zip([None, *w], w, w[1:])), rel_tol=1e-4, abs_tol=1e-4), t
    for u, v in [("the", "river"), (None, "<s>"), ("<s>", "the"), ("never", "seen"), ("never", "the")]:
        assert math.isclose(sum(p(u, v, w) for w in words) + p(u, v, "not in it"), 1.0, rel_tol=1e-9)


def test_many_ranges_under_few_handles(tmp_path):
    """4,096 ranges under a limit of 1,024 handles, each read twice."""
    import resource

    store = lm.Store(str(tmp_path))
    for r in range(4096):
        store.write(f"u{r}", [np.array([r], np.uint64), np.array([r + 1], np.int64)])
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (min(1024, hard), hard))
    try:
        for r in [*range(4096), *range(4096)]:
            key, value = store.read(f"u{r}", lm._U)
            assert (key[0], value[0]) == (r, r + 1)
        assert len(store.held) <= lm.MOST_MAPPED
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))


def test_other_orders_are_refused(none):
    with pytest.raises(ValueError):
        lm.train(none, order=4)


def test_query_has_the_whole_model(spark, smoke_dir):
    """The registered query scores by order 3 with every n-gram, as ``train`` gives it by default."""
    docs = table(spark, smoke_dir, "documents")
    model = lm.train(docs.where(crc_bucket(F.col("doc_id"), 10) != 0))
    assert model.order == 3
    want = {r["doc_id"]: round(r["score"], 6) for r in lm.score(docs, model).collect()}
    assert {r["doc_id"]: round(r["score"], 6) for r in lm.query(spark, smoke_dir).collect()} == want


@pytest.mark.parametrize("n", [0, 1, 7, 100_000])
def test_index(n):
    """Keys are found with their values, whatever bytes these need; others are not."""
    rng = np.random.default_rng(3)
    key = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    values = [rng.integers(1, 400, n), rng.integers(0, 1 << 40, n)]
    index = lm.Index(lm.Index.arrays(key, values))
    hit, at = index.find(np.concatenate([key, key + np.uint64(1)]))
    assert hit.tolist() == list(range(n))
    assert all((got == want).all() for got, want in zip(index.values(at), values, strict=True))


def test_arrays_are_small(spark):
    """Under 16 bytes of all arrays for each different trigram, and nothing but arrays left in the folder."""
    rng = np.random.default_rng(4)
    train = [" ".join(f"w{x}" for x in rng.integers(0, 500, 400)) for _ in range(100)]
    triples = {x for t in train for w in [["<s>", *tokens(t)]] for x in zip(w, w[1:], w[2:])}
    store = lm.Store(lm.train(spark.createDataFrame(list(enumerate(train)), "doc_id long, text string")).uri)
    found = store.fs.get_file_info(lm.pafs.FileSelector(store.root))
    assert all(f.type == lm.pafs.FileType.File for f in found)
    assert sum(f.size for f in found) < 16 * len(triples)


def test_trigrams_move_once(spark, monkeypatch):
    """What is merged and moves again is under two bytes for each different trigram."""
    sizes = []

    def measured(df, path=None):
        out = stored(df, path)
        if path and "/merged" in path:
            store = lm.Store(path)
            sizes.append(sum(f.size for f in store.fs.get_file_info(lm.pafs.FileSelector(store.root)) if f.path.endswith(".parquet")))
        return out

    monkeypatch.setattr(lm, "stored", measured)
    rng = np.random.default_rng(4)
    train = [" ".join(f"w{x}" for x in rng.integers(0, 1000, 400)) for _ in range(100)]
    triples = {x for t in train for w in [["<s>", *tokens(t)]] for x in zip(w, w[1:], w[2:])}
    lm.train(spark.createDataFrame(list(enumerate(train)), "doc_id long, text string").coalesce(1))
    assert sizes and sum(sizes) < 2 * len(triples)


def test_hashes():
    """Equal words have equal hashes and others have others, at every length, place and cut; each text has its end."""
    odd = ["a b", "", "  ", "abcdefgh abcdefghi ABCDEFGHI", "a\x1c\x85 x\x0by", "w" * 64 + " " + "w" * 65, "q" * 1000 + "R w", "日本 😀 É é", "a", " a", "b ", "x " * 300_000, "c"]
    for part in (pa.array(odd), pa.concat_arrays([pa.array(["zz  "]), pa.array(odd)]).slice(1), pa.array(odd, pa.large_string())):
        got, words = [], [w for t in odd for w in tokens(t)]
        for h, sizes in lm.hashes(part):
            assert len(h) == sizes.sum()
            got += h.tolist()
        assert len(got) == len(words)
        assert len(set(zip(got, words))) == len(set(got)) == len(set(words))
    assert not list(lm.hashes(pa.array([], pa.string())))


def test_order_of_keys_alike_in_their_upper_bits():
    """Keys that differ in the lowest bits alone still come in order."""
    key = np.random.default_rng(1).integers(0, 50, 1000).astype(np.uint64) + np.uint64(1 << 60)
    order, ordered = lm._ordered(key)
    assert ordered.tolist() == sorted(key.tolist()) == key[order].tolist()
    distinct, back = lm._distinct(key)
    assert distinct.tolist() == sorted(set(key.tolist())) and (distinct[back] == key).all()
    columns = [np.random.default_rng(k).integers(0, 9, 1000) for k in range(3)]
    for size in (9, 1 << 40):
        rows, n = lm._kinds(columns, size)
        want = Counter(zip(*(c.tolist() for c in columns)))
        assert dict(zip(zip(*(r.tolist() for r in rows)), n.tolist())) == want and list(zip(*rows)) == sorted(want)
