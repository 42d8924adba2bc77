"""Fingerprints against edited texts and true similarity."""

import hashlib
import re

from pyspark.sql import functions as F

from tidebar.llm import minhash


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_compare(odd, odd_rows):
    rows = sorted(((i, t or "") for i, t, *_ in odd_rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = {}
    for r in minhash.compare(odd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for k, (i, t) in enumerate(rows):
        if i in (None, 3):
            continue
        nxt = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        (r,) = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - jaccard(shingles(t), shingles(edited))) < 0.2
        assert abs(r["near_next"] - jaccard(shingles(t), shingles(nxt))) < 0.2


def test_equal_texts_and_buckets(spark):
    rows = [(7 * i, f"word {i // 2} is here with some others {i // 2}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fp = {r["doc_id"]: r["fingerprint"] for r in minhash.fingerprints(df).collect()}
    assert all(fp[7 * i] == fp[7 * i + 7] for i in range(0, 500, 2)) and len(set(fp.values())) == 250
    few = {r["doc_id"]: r["next_text"] for r in minhash.with_next(df, bucket_rows=9).collect()}
    assert few == {7 * i: rows[i - 1][1] for i in range(500)}


def test_lone_row_and_empty_table(spark, none):
    one = minhash.compare(spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    assert minhash.compare(none).count() == 0


def test_main_path_has_no_python(odd):
    plan = minhash.compare(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_likeness_of_texts_without_words(spark):
    df = spark.createDataFrame([("", " "), ("", "a b")], "a string, b string")
    near = df.select(minhash.likeness(minhash.fingerprint_codes(F.col("a")), minhash.fingerprint_codes(F.col("b"))))
    assert [r[0] for r in near.collect()] == [1.0, 0.0]
