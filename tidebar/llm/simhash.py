"""SimHash near-duplicates: a Gray-order hierarchical index over distinct fingerprints, and linked groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, table, texts

SHINGLE, SEED, MAX_DIFF = 3, 42, 3
#: The 64 bits in five blocks: with three differing bits at most, two blocks at least agree.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
FANOUT = 16


def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the word shingles in order; fewer words than a shingle count as one, no words give none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z, and white space as in the contract
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    flat = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[s : e - 1], seed) for s, e in zip([0, *ends], ends[size - 1 :], strict=False)), np.uint64, len(words) - size + 1)


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles; fewer words than a shingle count as one, no words give 0."""
    return of_hashes(shingle_hashes(text, size, seed))


def of_hashes(h: np.ndarray) -> int:
    """SimHash of shingle hashes: a bit is set if it is in over half of them."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):  # eight bytes a bit: in parts, for very long texts
        part = h[at : at + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) and ``th`` (a hash of the text) of each row."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), batch.column("th")], ["doc_id", "fp", "th"])

        return run

    return arrow_map(texts(docs, id_col, text_col).withColumn("th", F.xxhash64("text")), make, "doc_id long, fp long, th long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of each row."""
    return _marked(docs, id_col, text_col).select("doc_id", "fp")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each number in the Gray code, in which neighbours differ in one bit."""
    out = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n items under the links and the labels so far."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def gray_links(fps: np.ndarray, max_diff: int = MAX_DIFF, chunk: int = 128) -> np.ndarray:
    """For distinct numbers, the index of the smallest number that each is linked to by steps of ``max_diff`` bits or fewer.

    The numbers in Gray order are the leaves; every ``FANOUT`` neighbours share a node that keeps the bits common to all
    below it, without those that its own parent already keeps. A search goes down level by level, adds up the bits in
    which it differs from the kept ones, and leaves out a node with all below it once they are more than ``max_diff``.
    """
    n = len(fps)
    order = np.argsort(gray_rank(fps), kind="stable")
    leaves = fps[order]
    same, value = [np.full(n, ~np.uint64(0))], [leaves]
    while len(value[-1]) > 1:
        starts = np.arange(0, len(value[-1]), FANOUT)
        first = np.repeat(value[-1][starts], np.diff([*starts, len(value[-1])]))
        differ = np.bitwise_or.reduceat((value[-1] ^ first) | ~same[-1], starts)
        same.append(~differ)
        value.append(value[-1][starts])
    own = [s & ~np.repeat(same[k + 1], FANOUT)[: len(s)] if k + 1 < len(same) else s for k, s in enumerate(same)]
    label = np.arange(n)
    for at in range(0, n, chunk):
        q = np.arange(at, min(at + chunk, n))
        nodes, far = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for k in range(len(value) - 1, -1, -1):
            if k < len(value) - 1:
                wide = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q, far = np.repeat(q, FANOUT), np.repeat(far, FANOUT)
                ok = wide < len(value[k])
                nodes, q, far = wide[ok], q[ok], far[ok]
            far = far + np.bitwise_count((leaves[q] ^ value[k][nodes]) & own[k][nodes])
            ok = far <= max_diff
            if k == 0:
                ok &= nodes > q
            else:  # a node whose last leaf stands before the query was searched from there
                ok &= (nodes + 1) * FANOUT**k > q
            nodes, q, far = nodes[ok], q[ok], far[ok]
        if len(q):
            label = _roots(n, q, nodes, label)
    # as indexes into the given order, the smallest number of each group
    out = np.empty(n, np.int64)
    for_min = np.full(n, ~np.uint64(0))
    np.minimum.at(for_min, label, leaves)
    place = {int(v): int(i) for i, v in zip(order, leaves, strict=True)}
    out[order] = [place[int(for_min[r])] for r in label]
    return out


def _keyed(fps: DataFrame) -> DataFrame:
    """Each fingerprint under the ten masked patterns of two blocks: the upper nodes of the index, which Spark deals out."""
    masks = [sum(((1 << w) - 1) << at for at, w in pair) for pair in combinations(BLOCKS, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))).alias("u")).select("fp", "u.t", "u.key")


def _split_hot(keyed: DataFrame, most: int) -> DataFrame:
    """Groups of over ``most`` members as pairs of parts: each member goes to the pairs that its part is in, so no pair of members is lost."""
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    k = F.ceil(F.col("n") / F.lit(most)).cast("int")
    rows = keyed.join(sizes, ["t", "key"]).withColumn("k", k).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(j, F.col("part")).alias("i"), F.greatest(j, F.col("part")).alias("j")))
    return rows.select("fp", "t", "key", F.explode(others).alias("p")).select("fp", "t", "key", "p.i", "p.j")


def links(fps: DataFrame, max_diff: int = MAX_DIFF, most: int = 4096) -> DataFrame:
    """Links (a, b), a < b, of distinct fingerprints that differ in ``max_diff`` (3 at most) bits or fewer, thinned inside
    a group to a tree: what they connect is whole, and there are fewer links than members. ``most`` bounds a task's group."""
    if max_diff > MAX_DIFF:
        raise ValueError(f"the five blocks find {MAX_DIFF} differing bits at most")
    names = ["t", "key", "i", "j"]
    parts = _split_hot(_keyed(fps), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            new = np.ones(len(cols[0]), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols[1:]], axis=0)
            starts = np.flatnonzero(new)
            a, b = [], []
            for s, e in zip(starts, [*starts[1:], len(new)], strict=True):
                if e - s == 2:
                    if int(cols[0][s] ^ cols[0][s + 1]).bit_count() <= max_diff:
                        a.append(cols[0][s : s + 1])
                        b.append(cols[0][s + 1 : e])
                elif e - s > 2:
                    group = cols[0][s:e]
                    root = gray_links(group, max_diff)
                    moved = np.flatnonzero(root != np.arange(len(root)))
                    a.append(group[root[moved]])
                    b.append(group[moved])
            if not a:
                return None
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), *(batch.column(c).to_numpy(zero_copy_only=False) for c in names)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = np.flatnonzero(np.any([c != c[-1] for c in cols[1:]], axis=0))
            at = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            held = [c[at:] for c in cols]
            if at and (out := linked([c[:at] for c in cols])) is not None:
                yield out
        if held is not None and (out := linked(held)) is not None:
            yield out

    return parts.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Per node of the links (a, b) its component's smallest node: ``node``, ``root``.

    Large-star and small-star steps in turn; the links are kept in the shared folder after each round, and never reach the
    driver. Nothing moves any more once a round leaves the number of links and two 64-bit digests of them as they were.
    """

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first())

    now = cut(edges.where("a <> b").distinct())
    before = state(now)
    for _ in range(rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        now = cut(small)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components didn't settle")
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _named(classes: DataFrame, max_diff: int) -> DataFrame:
    """Each fingerprint class with the ``root`` of its component."""
    roots = components(links(classes.select("fp"), max_diff)).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_diff: int = MAX_DIFF) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links).

    Null and empty texts have fingerprint zero and are linked like any other; so do texts of white space. Repeated rows
    give repeated results. A row without id takes part, and its component's id is null only if no member has one. An empty
    table gives an empty result. Only id and text are read, so other columns may have any name.
    """
    marked = cut(fingerprints(docs, id_col, text_col))  # 16 bytes a row; the texts are read once
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    named = _named(classes, max_diff)
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return marked.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_diff: int = MAX_DIFF) -> DataFrame:
    """The rows of docs, all columns, of which one of each linked group stays: the one with the smallest id (null ids last, then by a hash of the text).

    Of repeated rows one stays as well. An empty table stays empty.
    """
    key = [F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")]
    rows = docs.select(*key, F.struct("*").alias("row"))
    marked = cut(_marked(docs, id_col, text_col))
    named = _named(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), max_diff)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "th"))
    by_class = marked.groupBy("fp").agg(first.alias("k"))  # one row a fingerprint before it is dealt out again, however many copies there are
    kept = by_class.join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min("k").alias("k")).select("k.id", "k.th")
    held = rows.alias("r").join(kept.alias("k"), F.col("r.id").eqNullSafe(F.col("k.id")) & (F.col("r.th") == F.col("k.th")), "left_semi")
    return held.dropDuplicates(["id", "th"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
