"""The lexicon learns from training labels only, and sees through folding."""

import math
import random
import re
import zlib

import pytest

from tidebar.llm import toxicity

from .conftest import prose


def corpus(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = prose(rng, 40)
        if toxic:
            text = f"{text} idiot {prose(rng, 5)} you moron"
        elif i % 5 == 0:
            text += " village idiot festival"
        docs.append((i, text))
        labels.append((i, int(toxic) if zlib.crc32(str(i).encode()) % 4 != 2 else None))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_and_folds(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    assert any(k.startswith(("idiot", "^idio")) for k in model.weights) and any(k.startswith(("moron", "^moro")) for k in model.weights)
    assert ("village", next(k for k in model.weights if "idio" in k)) in model.exceptions
    probe = spark.createDataFrame([(1, "you m0r0n and 1di0t"), (2, "the quiet river"), (3, "village idiot festival"), (4, ""), (5, None), (6, "you mоrоn 1diot")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(probe, model).collect()}
    assert s[1] > 0.5 > s[2] and abs(s[3] - s[2]) < 1e-9 and s[4] == s[5] == s[2] and s[6] > 0.5
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    wrong = sum(out[i]["predicted"] != (i % 4 == 0) for i in range(600))
    assert wrong < 12
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(600))


def test_odd_tables(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == len(odd_rows)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(none, toxicity.train(none, labels.limit(0))).count() == 0


def test_repeated_documents_count_once(spark):
    """However often a labelled id stands in the table, the sample has one row of it."""
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, toxic int")
    got = toxicity.sample_labels(docs, labels, 100).collect()
    assert sorted((r["text"], r["toxic"]) for r in got) == [(min(f"text {j}" for j in range(i, 600, 3)), i % 2) for i in range(3) if zlib.crc32(str(i).encode()) % 4 != 2]


def plain_hits(text, weights):
    """By a search of each entry at each place."""
    flat, out = toxicity.fold(text), []
    for entry, w in weights.items():
        word = entry.removeprefix("^")
        for at in range(len(flat) - len(word) + 1):
            end = at + len(word)
            if flat[at:end] != word or (at and flat[at - 1].isalpha()) or (entry[0] != "^" and flat[end : end + 1].isalpha()):
                continue
            left = re.findall(r"[^\W\d_]+(?=[\W\d_]*$)", flat[max(0, at - 40) : at])
            right = re.match(r"[\W\d_]*([^\W\d_]+)", flat[end : end + 40])
            out.append((entry, w, left[-1] if left else "", right[1] if right else ""))
    return sorted(out)


def test_matches_and_scores_are_the_plain_ones():
    rng = random.Random(7)
    weights = {"idiot": 2.0, "^mor": 1.5, "scum": 1.0, "cum": 0.5}
    model = toxicity.Model(weights, frozenset([("village", "idiot"), ("scum", "bag")]), (-2.0, 1.0, 0.5))
    hits, features = toxicity._matcher(model), toxicity._features(model)
    parts = ["village", "idiot", "1d!0t", "idiot!", "!diot", "m0ron", "moral", "scum", "$cum", "scum bag", "document", "idiots", "river", ",", "!", "é", "іdіot"]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", "", "-", "! "]) for _ in range(rng.randrange(12)))
        want = plain_hits(text, weights)
        assert sorted(hits(text)) == want
        total = sum(w for e, w, a, b in want if (a, e) not in model.exceptions and (e, b) not in model.exceptions)
        assert features(text) == pytest.approx((math.log1p(total), math.log1p(100 * total / max(100, len(text) / 6))))
    assert toxicity.fold("you idiot! m0r0n!! k!ll b!tch!") == "you idiot! moron!! kill bitch!"


def test_folding_of_capitals_widths_and_invisible_marks():
    same = {"ass": ["Аss", "ａｓｓ", "ＡＳＳ", "a\u200bss", "\ufeffa\u00adss", "АЅЅ", "@$$"], "evil": ["Εvil", "ЕVІL", "ev\u2060il", "EVİL"], "idiot": ["id\u200biot", "ІDІОТ", "ΙDΙΟΤ", "𝐢𝐝𝐢𝐨𝐭"],
            "nix": ["ΝΙΧ", "Nіх"], "ärger": ["ÄRGER", "a\u0308rger", "Ärger"], "strasse": ["STRASSE", "Straße", "STRAẞE"], "": ["", "\u200b"]}
    for plain, forms in same.items():
        assert {toxicity.fold(f) for f in [plain, *forms]} == {plain}
    assert toxicity.fold("日本 élan") == "日本 élan"
    model = toxicity.Model({"idiot": 2.0}, frozenset(), (-2.0, 1.0, 0.5))
    f = toxicity._features(model)
    assert f("you ІDІОТ x") == f("you idiot x") != (0.0, 0.0)


def test_entries_do_not_overlap():
    kept = toxicity._apart([("^trash", 3.0), ("trash", 2.9), ("^tras", 2.8), ("trashy", 2.0), ("scum", 1.0)], 10)
    assert list(kept) == ["^trash", "scum"]
