"""Phrases against a plain search, and the expression parser."""

import re
import time

import pytest
from pyspark.sql import functions as F

from tidebar.llm import licenses


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = sorted((i, p) for p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({licenses.BASE[p] for _, p in at}))


CASES = ["CC BY 4.0, cc--by", "cc by cc by", "All rights\nreserved. GNU General Public License", "accc by", "ALL RIGHTS RESERVEDé", "cc byé", "", None, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nnext", "SPDX-License-Identifier: AND", "lesser general public license", "x " * 50_000 + "cc by"]


def test_scan(spark, odd, odd_rows, none):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(CASES):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[8]["labels"].split(",") == ["apache-2.0", "gpl-2.0-only with classpath-exception-2.0", "mit"] and got[8]["satisfied"] is False
    assert got[9]["expressions"] == [] and got[9]["satisfied"] is None
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"]) for r in licenses.scan(odd).collect()) == sorted((i is None, i or 0, plain(t)[0]) for i, t, *_ in odd_rows)
    assert licenses.scan(none).count() == 0


@pytest.mark.parametrize(("text", "postfix"), [("MIT", "MIT"), ("MIT OR BSD-3-Clause AND ISC", "MIT BSD-3-Clause ISC and or"), ("(MIT OR ISC) AND Zlib", "MIT ISC or Zlib and"), ("GPL-2.0 WITH X OR MIT", "GPL-2.0 X with MIT or"), ("MIT OR", "MIT"), ("MIT and text", "MIT text and")])
def test_shunting_yard(text, postfix):
    assert " ".join(licenses.parse_expression(text)) == postfix


@pytest.mark.parametrize("text", ["", "OR MIT", ")", "("])
def test_no_expression(text):
    assert licenses.parse_expression(text) is None


def test_long_texts_are_linear(spark):
    """A million phrases, and an expression of a hundred thousand names."""
    t = "cc by " * 1_000_000
    names = " OR ".join(f"a{i}" for i in range(100_000))
    df = spark.createDataFrame([(1, t), (2, f"SPDX-License-Identifier: {names}")], "doc_id long, text string").coalesce(1)
    began = time.time()
    got = {r["doc_id"]: r for r in licenses.scan(df).select("doc_id", "n_base", "first_word", "last_word", F.size(F.split("labels", ",")).alias("labels")).collect()}
    assert time.time() - began < 10
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[2]["labels"]) == (1_000_000, 0, 1_999_998, 100_000)


def test_evaluation():
    ok = frozenset(["mit"])
    assert licenses.evaluate(licenses.parse_expression("MIT OR GPL-2.0"), ok)[1] and not licenses.evaluate(licenses.parse_expression("MIT AND GPL-2.0"), ok)[1]
