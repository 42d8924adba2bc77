"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Each five-word shingle is hashed once; the upper bits of the hash are its bin, and a bin keeps its least hash. An empty bin
takes the value of another by optimal densification: a fixed sequence of random bins is tried until one is filled. The low
eight bits of each bin's value are the fingerprint; likeness is the share of equal bins, corrected for chance agreement.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, texts

SHINGLE, BIN_BITS, CODE_BITS, ATTEMPTS = 5, 8, 8, 24
BINS = 1 << BIN_BITS
#: Rows of a bucket of neighbouring ids, and the most buckets; a row of two numbers each is what reaches the driver.
BUCKET_ROWS, MOST_BUCKETS = 512, 1 << 16
_STEP = 64


def _longs(values: list[int]) -> Column:
    """A constant array; as one text, which the optimizer folds, it costs one call however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once, however often it is used and within whatever lambda."""
    return F.transform(F.array(value), use).getItem(0)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the word shingles of a text: with fewer words the whole sequence, with none no hash."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")

    def hashed(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
        few = F.array(F.xxhash64(F.array_join(w, " "), F.lit(size)))
        return F.when(n >= size, many).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))

    return _let(words, hashed)


def codes(hashes: Column) -> Column:
    """The low bits of each bin's least hash, empty bins densified; null for a text without shingles.

    Among the hashes is sorted one stand-in for each bin, above all hashes of that bin: the first of each bin then are the
    least hashes and, where a bin is empty, its stand-in.
    """
    rng = random.Random(11)
    tables = [_longs([rng.randrange(BINS) for _ in range(BINS)]).cast("array<int>") for _ in range(ATTEMPTS)]
    shift = 64 - BIN_BITS
    top = (1 << shift) - 1
    stand_ins = _longs([(j << shift) | top for j in range(-BINS // 2, BINS // 2)])

    def least(s: Column) -> Column:
        return F.filter(s, lambda x, i: F.coalesce(F.shiftright(x.bitwiseXOR(F.get(s, i - 1)), shift) != 0, F.lit(True)))

    def densified(d: Column) -> Column:
        known = lambda: F.filter(F.transform(d, lambda x, b: F.struct(x.alias("x"), b.alias("b"))), lambda e: e["x"].isNotNull())
        nearest = lambda j: F.array_min(F.transform(known(), lambda e: F.struct(F.xxhash64(j, e["b"]).alias("r"), e["x"].alias("x"))))["x"]  # noqa: E731  where all attempts failed: any filled bin, by the least hash of the two bins
        code = lambda x: x.bitwiseAND(F.lit((1 << CODE_BITS) - 1)).cast("smallint")
        return F.transform(d, lambda x, j: code(F.coalesce(x, *(F.get(d, F.get(t, j)) for t in tables), nearest(j))))

    bins = _let(F.sort_array(F.concat(hashes, stand_ins)), least)
    return F.when(F.size(hashes) > 0, _let(F.transform(bins, lambda x: F.nullif(x, x.bitwiseOR(F.lit(top)))), densified))


def fingerprint_codes(text: Column) -> Column:
    return _let(shingle_hashes(text), codes)


def packed(c: Column) -> Column:
    """Codes as hex digits, two a bin; the empty string for a text without shingles."""
    return F.coalesce(F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1: equal bins, less those equal by chance. Two texts without shingles are alike (1), one is not like any other (0)."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    chance = 2.0**-CODE_BITS
    fair = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(fair)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and fingerprint. Null texts are empty ones; repeated rows give repeated results."""
    return texts(docs, id_col, text_col).select("doc_id", packed(fingerprint_codes(F.col("text"))).alias("fingerprint"))


def bucket_of(bounds: list[int], key: Column) -> Column:
    """How many of the ascending bounds are at most the key, found in two steps; a null key has none."""
    if not bounds:
        return F.lit(0)
    upto = lambda found: F.size(F.filter(found, lambda b: b <= key))
    every = _longs(bounds)
    fine = lambda g: g * _STEP + upto(F.slice(every, g * _STEP + 1, F.lit(_STEP)))
    return F.coalesce(F.when(key >= bounds[0], _let(upto(_longs(bounds[::_STEP])) - 1, fine)), F.lit(0)).cast("int")


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id``, ``text``, ``codes`` and those of the next row in descending order of the id: ``next_text``, ``next_codes``.

    Rows are dealt into buckets of neighbouring ids, each ordered by itself; the first row of a bucket also comes as the
    last one of the bucket before it, that of all rows as the very last. Null ids are last; rows of one id go by text.
    """
    base = texts(docs)
    n = base.select("doc_id").count()
    k = max(1, min(MOST_BUCKETS, math.ceil(n / bucket_rows)))
    bounds: list[int] = []
    if k > 1:
        got = base.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], F.lit(max(10_000, 4 * k))).alias("b")).first()["b"]
        bounds = sorted(set(got or []))
    rows = base.withColumn("bucket", bucket_of(bounds, F.col("doc_id")))
    tops = sorted(rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect(), key=lambda r: r["bucket"])  # a row a bucket
    if not tops:
        tops = []
    sent = [(a["top"], b["bucket"]) for a, b in zip(tops, tops[1:], strict=False)] + ([(tops[-1]["top"], tops[0]["bucket"])] if tops else [])
    to = docs.sparkSession.createDataFrame(sent, "top long, to int")
    first = rows.select("doc_id", "text").join(F.broadcast(to), F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    both = rows.select("bucket", "doc_id", "text", F.lit(False).alias("copy")).union(first.select(F.col("to").alias("bucket"), "doc_id", "text", F.lit(True).alias("copy")))
    order = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    marked = both.withColumn("codes", fingerprint_codes(F.col("text")))
    return marked.select("doc_id", "text", "codes", "copy", F.lead("text").over(order).alias("next_text"), F.lead("codes").over(order).alias("next_codes")).where("NOT copy").drop("copy")


def compare(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and the next document.

    The edited text has the last third (floor of n_chars / 3 code points) replaced by the first as many, or all, of the
    next document. Null texts are empty ones. A lone row is its own next one; an empty table gives an empty result. Only
    ``doc_id`` and ``text`` are read.
    """
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - third), F.substr(F.col("next_text"), F.lit(1), third))
    rows = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), "codes", "next_codes", edited.alias("edited"))
    out = rows.select("doc_id", "n_chars", "codes", "next_codes", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(fingerprint_codes(F.col("edited")))).alias("edited_codes"))
    return out.select("doc_id", "n_chars", "edited_sha256", packed(F.col("codes")).alias("fingerprint"), packed(F.col("edited_codes")).alias("edited_fingerprint"),
                      likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"), likeness(F.col("codes"), F.col("next_codes")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
