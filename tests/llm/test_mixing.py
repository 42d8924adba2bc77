"""Weights, budgets and whole passes."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidebar.llm import mixing

from .conftest import prose


@pytest.fixture(scope="module")
def docs(spark):
    import random

    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "big" if i % 3 else f"s{i % 5}") for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def shares(plan):
    return {r["source"]: r for r in plan.collect()}


def test_repetition_limit_and_cover(docs):
    steps = mixing.plan(docs, max_repeat=2.0, blocks=16)
    s = shares(steps)
    e = [r["epochs"] for r in s.values()]
    assert min(e) == pytest.approx(1.0) and max(e) == pytest.approx(2.0, abs=1e-4)
    assert sum(r["weight"] for r in s.values()) == pytest.approx(1.0)
    out = mixing.mix(docs, steps).select("row.doc_id", "source", "tokens", "copies", "pass").collect()
    assert {r["doc_id"] for r in out} == set(range(900))
    got = Counter()
    for r in out:
        got[r["source"]] += r["tokens"]
    for k, r in s.items():
        assert r["epochs"] * r["source_tokens"] - 60 <= got[k] <= r["epochs"] * r["source_tokens"] + 1e-6


def test_entropy(docs):
    want = 1.5
    s = shares(mixing.plan(docs, entropy=want, max_repeat=None))
    assert -sum(r["weight"] * math.log(r["weight"]) for r in s.values()) == pytest.approx(want, abs=1e-3)


def test_budget_below_a_pass(docs):
    steps = mixing.plan(docs, max_repeat=None, entropy=1.2, budget=3000.0, blocks=8)
    out = mixing.mix(docs, steps).collect()
    assert 3000 - 60 * 6 <= sum(r["tokens"] for r in out) <= 3000
    assert {r["pass"] for r in out} == {1}
    again = mixing.mix(docs.repartition(7), steps).collect()
    assert sorted(r["row"]["doc_id"] for r in out) == sorted(r["row"]["doc_id"] for r in again)


@pytest.mark.parametrize(("target", "limit"), [(0.5, 4.0), (0.9, 1.5), (None, 2.0)])
def test_plain_twin(docs, target, limit):
    """Exponent, weights, and the rows of each pass by plain Python over the same hashes."""
    blocks, seed = 8, 3
    rows = docs.select("doc_id", *mixing._rows(docs, "doc_id", "text", "source", seed)).withColumn("hb", mixing._block(F.lit(blocks), seed)).collect()
    tokens = Counter()
    for r in rows:
        tokens[r["source"]] += r["tokens"]
    total = sum(tokens.values())
    weights = lambda a: (lambda raw, z: {s: x / z for s, x in raw.items()})(raw := {s: n**a for s, n in tokens.items()}, sum(raw.values()))
    entropy = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    spread = lambda a: (lambda e: max(e) / min(e))([weights(a)[s] / n for s, n in tokens.items()])

    def bisect(good):
        """Where a condition that holds at one end of 0 to 1 changes."""
        low, high, first = 0.0, 1.0, good(0.0)
        if first == good(1.0):
            return 1.0 if first else 0.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) == first else (low, mid)
        return low

    goal = None if target is None else entropy(1) + target * (math.log(len(tokens)) - entropy(1))
    a = max(0.0 if goal is None else bisect(lambda x: entropy(x) >= goal), 0.0 if spread(0) <= limit else bisect(lambda x: spread(x) > limit))
    assert 0 < a < 1
    w = weights(a)
    spent = max(tokens[s] / w[s] for s in w)
    steps = mixing.plan(docs, entropy_between=target, max_repeat=limit, blocks=blocks, seed=seed)
    got = {r["source"]: r for r in steps.collect()}
    assert all(got[s]["weight"] == pytest.approx(w[s], abs=1e-6) and got[s]["epochs"] == pytest.approx(spent * w[s] / tokens[s], abs=1e-5) for s in w)
    want = Counter()
    for s in w:
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["hb"], r["hd"]))
        whole, left = got[s]["whole"], math.floor((got[s]["epochs"] - got[s]["whole"]) * tokens[s] + 1e-6)
        for r in own:
            want[r["doc_id"]] += whole
        for b in dict.fromkeys(r["hb"] for r in own):
            block = [r for r in own if r["hb"] == b]
            for r in block:
                if r["tokens"] > left:
                    break
                left -= r["tokens"]
                want[r["doc_id"]] += 1
            else:
                continue
            break
    assert Counter(r["row"]["doc_id"] for r in mixing.mix(docs, steps, seed=seed).collect()) == +want


def test_odd_tables(spark, odd, odd_rows, none):
    out = mixing.mix(odd, mixing.plan(odd))
    assert out.select("row.*").columns == odd.columns
    assert Counter(r["row"]["doc_id"] for r in out.where("pass = 1").collect()) == Counter(i for i, *_ in odd_rows)
    assert mixing.mix(none, mixing.plan(none)).count() == 0
