"""Ranked lexical search by a document FP-tree and branch and bound.

Documents are reduced to the terms that items ask for, the most frequent term first. In blocks of documents these restricted
vectors stand in a tree whose paths are shared by documents that begin alike; a node knows, over all documents below it, the
greatest frequency of each term, the least length norm and the least id. As a term's share of a score grows with its frequency
and falls with the norm, these bound every score below the node, so an item walks the tree depth first, best child first, and
leaves out what can't reach its list; lists are carried on from block to block of a task.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, small_batches, table, texts

TOP = 50
#: Documents of a tree and of a leaf; cells of a block (documents x terms) and terms of a block of items; terms that one pass over the documents looks for.
BLOCK, LEAF, CELLS, BLOCK_TERMS, PASS_TERMS = 8192, 16, 1 << 24, 4096, 1_000_000
#: Lists of an item are first merged in so many groups of tasks.
GROUPS = 64
# Bytes that are in a term are letters, digits and all from 0x80 on; only A-Z become lower case.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norm(n: int, n_docs: int, total: int) -> int:
    return 100 - 50 + (50 * n * n_docs) // total


def gains(tf: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores of rows of frequencies (rows x terms); zero frequencies give nothing."""
    return (w * (1_000_000_000 * tf // (1000 * tf + 20 * m[:, None]))).sum(axis=1)


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the children of one in a row: documents from ``lo`` to ``hi``, first child and how many (0: a leaf),
    and over the documents below a node: greatest frequencies (nodes x terms), least norm and least id."""

    lo: list[int]
    hi: list[int]
    child: list[int]
    children: list[int]
    tf: np.ndarray
    m: np.ndarray
    first: np.ndarray


def grow(tf: np.ndarray, m: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """The order of documents in which those that share a path stand together, and their tree.

    ``tf``: documents x terms, the most frequent term first. Where all documents of a node hold the same terms up to a place,
    that path is one node; small neighbours below one node share a leaf.
    """
    n = len(tf)
    bits = np.packbits(tf > 0, axis=1)
    keys = [(~b).tobytes() for b in bits]
    order = np.array(sorted(range(n), key=keys.__getitem__), np.int64)
    tf, m, ids, bits = tf[order], m[order], ids[order], bits[order]
    held = tf > 0
    depth = np.concatenate([np.zeros((n, 1), np.int32), np.cumsum(held, axis=1, dtype=np.int32)], axis=1)
    differs = held[1:] != held[:-1]
    place = np.where(differs.any(axis=1), differs.argmax(axis=1), held.shape[1])
    shared = np.concatenate([[0], depth[np.arange(1, n), place]])  # how many terms a document shares with the one before from the start on
    same = np.concatenate([[False], place == held.shape[1]])
    lo, hi, child, children = [0], [n], [0], [0]
    at = 0
    while at < len(lo):
        a, b = lo[at], hi[at]
        if b - a > leaf and not same[a + 1 : b].all():
            least = shared[a + 1 : b][~same[a + 1 : b]].min()
            cuts = (np.flatnonzero((shared[a + 1 : b] == least) & ~same[a + 1 : b]) + a + 1).tolist()
            parts, begin = [], a
            for cut, following in zip(cuts, [*cuts[1:], b], strict=True):
                if cut - begin and following - begin > leaf:
                    parts.append((begin, cut))
                    begin = cut
            parts.append((begin, b))
            if len(parts) > 1:
                child[at], children[at] = len(lo), len(parts)
                for x, y in parts:
                    lo.append(x)
                    hi.append(y)
                    child.append(0)
                    children.append(0)
        at += 1
    most, least_m, first = np.zeros((len(lo), tf.shape[1]), tf.dtype), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
    for k in range(len(lo) - 1, -1, -1):  # children have greater numbers
        own = slice(child[k], child[k] + children[k]) if children[k] else slice(lo[k], hi[k])
        of = (most, least_m, first) if children[k] else (tf, m, ids)
        most[k], least_m[k], first[k] = of[0][own].max(axis=0), of[1][own].min(), of[2][own].min()
    return order, Tree(lo, hi, child, children, most, least_m, first)


Hit = tuple[int, int]  # score, id negated: greater is better


def search(tree: Tree, tf: np.ndarray, m: np.ndarray, ids: np.ndarray, cols: np.ndarray, w: np.ndarray, best: list[Hit], top: int = TOP) -> int:
    """Documents (in the tree's order) into ``best``, an item's heap; how many documents were scored."""
    stack, scored = [0], 0
    limits: dict[int, int] = {0: int(gains(tree.tf[:1][:, cols].astype(np.int64), tree.m[:1], w)[0])}
    while stack:
        k = stack.pop()
        limit = limits.pop(k)
        if limit <= 0 or (len(best) == top and (limit, -int(tree.first[k])) <= best[0]):
            continue
        if tree.children[k]:
            own = np.arange(tree.child[k], tree.child[k] + tree.children[k])
            bounds = gains(tree.tf[own][:, cols].astype(np.int64), tree.m[own], w)
            for j in np.argsort(bounds, kind="stable").tolist():  # the greatest comes last, and so first from the stack
                stack.append(int(own[j]))
                limits[int(own[j])] = int(bounds[j])
            continue
        a, b = tree.lo[k], tree.hi[k]
        got = gains(tf[a:b][:, cols].astype(np.int64), m[a:b], w)
        scored += b - a
        worth = np.flatnonzero(got >= (best[0][0] if len(best) == top else 1))
        for j in worth.tolist():
            hit = (int(got[j]), -int(ids[a + j]))
            if len(best) < top:
                heapq.heappush(best, hit)
            elif hit > best[0]:
                heapq.heapreplace(best, hit)
    return scored


@dataclass(frozen=True)
class Items:
    """Items of a pass: all their terms (with numbers), and blocks of items that have few different terms together."""

    numbers: dict[bytes, int]
    own: list[tuple[int | None, list[int]]]

    @staticmethod
    def of(rows: list[tuple[int | None, list[bytes]]]) -> Items:
        numbers: dict[bytes, int] = {}
        return Items(numbers, [(i, [numbers.setdefault(t, len(numbers)) for t in own]) for i, own in rows])

    def blocks(self, most: int) -> Iterator[list[int]]:
        held: set[int] = set()
        block: list[int] = []
        for k, (_, own) in enumerate(self.own):
            if block and len(held.union(own)) > most:
                yield block
                held, block = set(), []
            held.update(own)
            block.append(k)
        if block:
            yield block


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id and its different terms; rows of one id are one item."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sorted(set(terms(t))) for t in batch.column("text").to_pylist()], pa.list_(pa.binary()))], ["item_id", "terms"])

        return run

    own = arrow_map(texts(items, id_col, text_col), make, "item_id long, terms array<binary>")
    return own.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def corpus_totals(base: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms stand in all of them."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [len(terms(t)) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array([sum(map(bool, n))], pa.int64()), pa.array([sum(n)], pa.int64())], ["n", "l"])

        return run

    r = arrow_map(base, make, "n long, l long", rows=2048).agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return r["n"] or 0, r["l"] or 0


def _statistics(base: DataFrame, numbers: dict[bytes, int]) -> tuple[int, int, list[int]]:
    """As ``corpus_totals``, and the number of documents that hold each term asked for."""
    shared = base.sparkSession.sparkContext.broadcast(numbers)

    def make():
        known = shared.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            df: Counter = Counter()
            n = total = 0
            for t in batch.column("text").to_pylist():
                own = terms(t)
                n, total = n + bool(own), total + len(own)
                df.update(set(map(known.get, set(own))))
            df.pop(None, None)
            return pa.RecordBatch.from_arrays([pa.array([*df, -1, -2], pa.int32()), pa.array([*df.values(), n, total], pa.int64())], ["term", "n"])

        return run

    got = {r["term"]: r["n"] for r in arrow_map(base, make, "term int, n long", rows=2048).groupBy("term").agg(F.sum("n").alias("n")).collect()}  # as many as terms asked for, two more
    return got.get(-1, 0), got.get(-2, 0), [got.get(k, 0) for k in range(len(numbers))]


def _pass(base: DataFrame, items: Items, top: int, block: int, leaf: int, block_terms: int) -> DataFrame:
    """The lists of some items over all documents, one for each task."""
    n_docs, total, df = _statistics(base, items.numbers)
    shared = base.sparkSession.sparkContext.broadcast((items.numbers, items.own, df, list(items.blocks(block_terms))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked, df, groups = shared.value
        pid = TaskContext.get().partitionId()
        frequent = sorted(range(len(df)), key=lambda t: (-df[t], t))
        plans = []
        for group in groups:
            mine = {t for k in group for t in asked[k][1]}
            col = np.full(len(df), -1, np.int64)
            col[[t for t in frequent if t in mine]] = np.arange(len(mine))
            plans.append((group, col, len(mine)))
        widest = max((p[2] for p in plans), default=1)
        size = max(64, min(block, CELLS // max(1, widest)))
        best: list[list[Hit]] = [[] for _ in asked]
        none = 1 << 63  # stands for a null id, behind all others
        held: list[tuple[int, int, dict[int, int]]] = []

        def work() -> None:
            at = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
            term = np.fromiter((t for h in held for t in h[2]), np.int64, len(at))
            count = np.fromiter((c for h in held for c in h[2].values()), np.int64, len(at))
            m_all, ids_all = np.array([norm(h[1], n_docs, total) for h in held], np.int64), [h[0] for h in held]
            for group, col, width in plans:
                tf = np.zeros((len(held), width), np.int32)
                own = col[term] >= 0
                tf[at[own], col[term[own]]] = count[own]
                some = np.flatnonzero(tf.any(axis=1))
                if not len(some):
                    continue
                place = np.argsort(np.array([i if i is not None else none - 1 for i in ids_all], np.int64)[some], kind="stable")  # the least id first among equals
                some = some[place]
                ids = np.array([ids_all[i] if ids_all[i] is not None else none - 1 for i in some], np.int64)
                order, tree = grow(tf[some], m_all[some], ids, leaf)
                t, m, ids = tf[some][order], m_all[some][order], ids[order]
                for k in group:
                    of = asked[k][1]
                    if of:
                        search(tree, t, m, ids, col[of], np.array([weight(n_docs, df[x]) for x in of], np.int64), best[k], top)
            held.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = terms(text.as_py())
                count = Counter(map(known.get, own))
                count.pop(None, None)
                if count:
                    held.append((doc_id, len(own), count))
                if len(held) == size:
                    work()
        if held:
            work()
        rows = [(k, None if -i == none - 1 else -i, s) for k, hits in enumerate(best) for s, i in hits]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([asked[k][0] for k, _, _ in rows], pa.int64()), pa.array([i for _, i, _ in rows], pa.int64()), pa.array([s for _, _, s in rows], pa.int64()), pa.array([pid % GROUPS] * len(rows), pa.int32())], ["item_id", "doc_id", "score", "_group"])

    return base.mapInArrow(run, "item_id long, doc_id long, score long, _group int")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK, leaf: int = LEAF, block_terms: int = BLOCK_TERMS, pass_terms: int = PASS_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: of all documents the ``top`` of greatest score above 0 for each item, equal scores by id (null ids last).

    Null and empty texts have no term; items without a term have no row; rows of one item id are one item; repeated documents are
    documents of their own. Empty tables give none. Columns besides ids and texts are not read. Items are taken in passes of at
    most ``pass_terms`` terms (each item wholly in one), so what is broadcast is bounded; each pass reads all documents twice.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = texts(docs)
    found, held, size = None, [], 0

    def flush() -> None:
        nonlocal found, held, size
        got = _pass(base, Items.of(held), top, block, leaf, block_terms)
        found, held, size = got if found is None else found.union(got), [], 0

    for r in item_terms(items).where(F.size("terms") > 0).orderBy("item_id").toLocalIterator():
        if held and size + len(r["terms"]) > pass_terms:
            flush()
        held.append((r["item_id"], [bytes(t) for t in r["terms"]]))
        size += len(r["terms"])
    if held:
        flush()
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_id", "_group"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents),
tf AS (SELECT r, doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
c AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM len),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), c),
s AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // l))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN len USING (r), c GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
