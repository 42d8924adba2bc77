"""Toxicity: a weighted lexicon learned from labels, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_column, arrow_map, crc_bucket, table

# Look-alike letters and digit substitutions, each with the Latin letter that it stands for; capitals look like other letters than their small forms.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
              "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "ɑ": "a", "ɡ": "g", "ı": "i"}
CAPITALS = {"А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "У": "y", "Х": "x", "І": "i", "Ј": "j", "Ѕ": "s",
            "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Marks without a width: soft hyphen, joiners, directions, byte order, variation selectors; and the dot that a folded dotted capital I leaves.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
_DOT = 0x307

_SEEN = {**dict.fromkeys(INVISIBLE), **{ord(k): v for k, v in CAPITALS.items()}}
_FOLD = {_DOT: None, **{ord(k): v for k, v in {**HOMOGLYPHS, **SUBSTITUTES, **{chr(c): chr(c + 32) for c in range(65, 91)}}.items() if k != "!"}}
_CALL = re.compile(r"!+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")
#: Marks an entry of the lexicon that is the beginning of a word; lengths of such entries.
START, LENGTHS = "^", range(4, 9)


def fold(text: str) -> str:
    """Case folded, compatibility forms (full width and the like) as plain ones, invisible marks gone, look-alikes of both cases and digit substitutions as plain letters.

    Other letters keep their accents, so the length may change. An exclamation mark is a letter only before a letter, as else it ends a word.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).translate(_SEEN).casefold())
    flat = text.translate(_FOLD)
    return _CALL.sub(lambda m: SUBSTITUTES["!"] * len(m[0]), flat) if "!" in flat else flat


@dataclass(frozen=True)
class Model:
    """Word weights, phrases in which a word doesn't count, and the logistic fit over the two scores of a text."""

    weights: dict[str, float]
    exceptions: frozenset[tuple[str, str]]
    coef: tuple[float, float, float]


def _matcher(model: Model):
    """A function from a text to its matched weight, number of words' worth of letters, and hits."""
    find = ahocorasick.Automaton()
    for entry, w in model.weights.items():
        find.add_word(entry.removeprefix(START), (entry, w))
    find.make_automaton()
    some = bool(model.weights)
    before, after = re.compile(r"([^\W\d_]+)[\W\d_]*$"), re.compile(r"[\W\d_]*([^\W\d_]+)")

    def hits(text: str) -> list[tuple[str, float, str, str]]:
        """Matches of whole words, and of beginnings of words, with the words beside them."""
        found = []
        flat = fold(text)
        for end, (word, w) in find.iter(flat) if some else ():
            start = end + 1 - len(word.removeprefix(START))
            if (start and flat[start - 1].isalpha()) or (word[0] != START and end + 1 < len(flat) and flat[end + 1].isalpha()):
                continue
            left, right = before.search(flat[max(0, start - 40) : start]), after.match(flat[end + 1 : end + 41])
            found.append((word, w, left[1] if left else "", right[1] if right else ""))
        return found

    return hits


def _features(model: Model):
    hits, exceptions = _matcher(model), model.exceptions

    def run(text: str) -> tuple[float, float]:
        """Total weight, and weight a hundred words (texts under 100 words count as such), both damped by a logarithm."""
        total = sum(w for word, w, left, right in hits(text) if (left, word) not in exceptions and (word, right) not in exceptions)
        return float(np.log1p(total)), float(np.log1p(100 * total / max(100.0, len(text) / 6)))

    return run


def sample_labels(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """Text and label of about ``bound`` labelled training ids, taken evenly by a hash of the id (all, if fewer); one row an id.

    Training rows are those whose crc32(doc_id as text) mod 4 is not 2. Of several labels of an id the larger holds, of
    several texts the least.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), 4) != 2)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(bound / n * 1_000_003))
    # at most about ``bound`` pairs of numbers, so that side may be broadcast whatever the input
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _counted(rows: DataFrame, make, schema: str, keys: list[str]) -> DataFrame:
    return arrow_map(rows, make, schema).groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _count(batch: pa.RecordBatch, each, names: list[str]) -> pa.RecordBatch:
    """Per distinct key of the batch the number of toxic and other texts that have it."""
    pos: Counter = Counter()
    neg: Counter = Counter()
    for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
        (pos if toxic else neg).update(each(text))
    keys = list(pos | neg)
    return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(len(names))), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], [*names, "pos", "neg"])


def _entries(text: str) -> set[tuple[str]]:
    """The words of a text that may enter the lexicon, whole and by their beginnings."""
    words = {w for w in _WORD.findall(fold(text)) if len(w) < 40}
    return {(w,) for w in words} | {(START + w[:k],) for w in words for k in LENGTHS if len(w) > k}


def _apart(found: list[tuple[str, float]], most: int) -> dict[str, float]:
    """The first ``most`` entries of which none is the beginning of another, so that no place counts twice."""
    kept: dict[str, float] = {}
    taken: set[str] = set()
    for entry, w in found:
        plain = entry.removeprefix(START)
        if len(kept) < most and plain not in taken and not any(START + plain[:k] in kept for k in LENGTHS):
            kept[entry] = w
            taken.update(plain[:k] for k in (*LENGTHS, len(plain)))
    return kept


def train(docs: DataFrame, labels: DataFrame, bound: int = 20_000, lexicon_size: int = 2_000, min_texts: int = 3, z: float = 4.0) -> Model:
    """A model from at most about ``bound`` labelled training texts.

    An entry is a word or the beginning of one; its weight is its smoothed log odds between toxic and other texts; those whose odds are ``z`` standard errors
    above nothing and that at least ``min_texts`` toxic texts hold enter, the surest ``lexicon_size``. A word with its
    neighbour is an exception if the pair is found at least ``min_texts`` times in other texts and no likelier in toxic ones.
    Without labels of both kinds the model has no words and gives every text the share of toxic labels (0.5 if none).
    """
    rows = sample_labels(docs, labels, bound).persist()
    try:
        classes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        n_pos, n_neg = sum(v for k, v in classes.items() if k), sum(v for k, v in classes.items() if not k)
        share = (n_pos + 0.5) / (n_pos + n_neg + 1)
        flat = Model({}, frozenset(), (float(np.log(share / (1 - share))), 0.0, 0.0))
        if not n_pos or not n_neg:
            return flat
        words = _counted(rows, lambda: lambda b: _count(b, _entries, ["word"]), "word string, pos long, neg long", ["word"])
        odds = F.log((F.col("pos") + 0.5) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
        error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
        best = words.where(F.col("pos") >= min_texts).select("word", odds.alias("w"), (odds / error).alias("z")).where(F.col("z") > z).orderBy(F.desc("z"), "word").limit(8 * lexicon_size)
        weights = _apart([(r["word"], r["w"]) for r in best.collect()], lexicon_size)  # at most 8 * lexicon_size rows
        if not weights:
            return flat
        plain = Model(weights, frozenset(), flat.coef)

        def pairs():
            hits = _matcher(plain)
            return lambda b: _count(b, lambda t: {p for word, _, left, right in hits(t) for p in ((left, word), (word, right)) if all(p)}, ["a", "b"])

        clean = _counted(rows, pairs, "a string, b string, pos long, neg long", ["a", "b"]).where((F.col("neg") >= min_texts) & (F.col("pos") / n_pos <= F.col("neg") / n_neg))
        exceptions = frozenset((r["a"], r["b"]) for r in clean.orderBy(F.desc("neg"), "a", "b").limit(lexicon_size).collect())
        marked = Model(weights, exceptions, flat.coef)

        def points():
            f = _features(marked)

            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = [f(t) for t in batch.column("text").to_pylist()]
                return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64()), batch.column("toxic").cast(pa.int32())], ["x", "r", "toxic"])

            return run

        data = arrow_map(rows, points, "x double, r double, toxic int").toPandas()  # about bound rows of three numbers
        return Model(weights, exceptions, _logistic(data[["x", "r"]].to_numpy(), (data["toxic"] > 0).to_numpy(float)))
    finally:
        rows.unpersist()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    keep = np.diag([1e-6, ridge, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + keep, a.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def score_column(text: Column, model: Model) -> Column:
    """The probability of label 1 for each text: 0 to 1, null read as empty; an empty text gets that of a text without matches."""

    def make():
        f, coef = _features(model), np.array(model.coef)

        def run(whole: list[str]) -> list[float]:
            x = np.array([(1.0, *f(t)) for t in whole], dtype=float).reshape(-1, 3)
            return (1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))).tolist()

        return run

    return arrow_column(text, make, "double", pa.float64())


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. One row out for each row in, repeated rows alike; an empty table stays empty.

    A null id counts as empty text for ``held_out``. Only id and text are read, so other columns may have any name.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(F.col("text"), model).alias("score"))
    return rows.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
