"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a balanced k-means on a bounded sample and stay in memory as a neighbour graph. Every vector of the
table is put into the list of its nearest centroid, and if it lies near a boundary into others too. A query walks the graph
and takes the lists whose centroids are at most ``ratio`` times as far as the nearest one; the ratio is fitted on the
sample to a target recall. Long lists are cut by hash into parts that are searched by tasks of their own: a task holds one
part and lets the queries that come to it stream past.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

#: Lists grow with the square root of the rows up to so many; rows of the sample for each list, and at least.
MOST_LISTS, SAMPLE_A_LIST, LEAST_SAMPLE = 4096, 8, 20_000


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class Index:
    """Centroids, the neighbours of each (those of centroid i from ``starts[i]`` to ``starts[i + 1]``), up to what ratio a list is taken, how many are at least, and how vectors were put into lists."""

    centroids: np.ndarray
    starts: np.ndarray
    neighbours: np.ndarray
    ratio: float
    least: int
    near: float
    copies: int


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def balanced_means(x: np.ndarray, k: int, steps: int = 12, seed: int = 0, chunk: int = 2048) -> np.ndarray:
    """k-means in which a cluster over its even share looks farther away, so that shares stay alike."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    weight = np.zeros(k)
    for _ in range(steps):
        own, least = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), chunk):
            d = np.sqrt(_squared(x[at : at + chunk], c))
            own[at : at + chunk], least[at : at + chunk] = (d + weight).argmin(1), d.min(1)
        size = np.bincount(own, minlength=k)
        weight = np.maximum(0, weight + 0.1 * least.mean() * (size / (len(x) / k) - 1))
        total = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def centroid_graph(c: np.ndarray, degree: int = 24, seed: int = 0, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each centroid: the nearest ones and a few far ones, both ways, so that every centroid can be reached."""
    k = len(c)
    if k == 1:
        return np.zeros(2, np.int64), np.zeros(0, np.int64)
    own, near = np.arange(k), min(degree, k - 1)
    closest = np.concatenate([np.argpartition(_squared(c[at : at + chunk], c), near, axis=1)[:, : near + 1] for at in range(0, k, chunk)])
    a = np.concatenate([np.repeat(own, near + 1), own, own])
    b = np.concatenate([closest.ravel(), np.random.default_rng(seed).permutation(k), (own + 1) % k])
    pairs = np.unique(np.concatenate([a * k + b, b * k + a])[np.tile(a != b, 2)])
    return np.searchsorted(pairs // k, np.arange(k + 1)), pairs % k


def walk(index: Index, x: np.ndarray, ratio: float, beam: int = 8) -> np.ndarray:
    """Distances to the centroids that a best-first walk from centroid 0 meets, infinite for the others.

    It goes on from a centroid if that is one of the ``beam`` nearest so far, or at most ``ratio`` times as far as the nearest.
    """
    n, k = len(x), len(index.centroids)
    far = np.full((n, k), np.inf)
    done = np.zeros((n, k), bool)
    far[:, 0] = np.linalg.norm(x - index.centroids[0], axis=1)
    while True:
        nearest = np.partition(far, min(beam, k) - 1, axis=1)[:, min(beam, k) - 1]
        go = np.isfinite(far) & ~done & ((far <= nearest[:, None]) | (far <= ratio * far.min(1)[:, None]))
        rows, cols = np.nonzero(go)
        if not len(rows):
            return far
        done |= go
        times = index.starts[cols + 1] - index.starts[cols]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(index.starts[cols], times)
        met = np.unique(np.repeat(rows, times) * k + index.neighbours[at])
        met = met[~np.isfinite(far.ravel()[met])]
        for part in np.array_split(met, max(1, -(-len(met) // (1 << 16)))):
            r, c = part // k, part % k
            far[r, c] = np.linalg.norm(x[r] - index.centroids[c], axis=1)


def assign(index: Index, x: np.ndarray) -> list[np.ndarray]:
    """The lists of each vector: the nearest, and others at most ``near`` times as far, unless such a list lies closer to one already taken than to the vector."""
    far = walk(index, x, index.near)
    order = np.argsort(far, 1)[:, : 4 * index.copies]
    out = []
    for i in range(len(x)):
        taken = [order[i, 0]]
        for j in order[i, 1:]:
            if len(taken) == index.copies or not far[i, j] <= index.near * far[i, taken[0]]:
                break
            if (np.linalg.norm(index.centroids[taken] - index.centroids[j], axis=1) * 1.2 >= far[i, j]).all():
                taken.append(j)
        out.append(np.array(taken))
    return out


def fit(sample: np.ndarray, lists: int, k: int, recall: float, near: float = 1.15, copies: int = 4) -> Index:
    """Centroids, graph and ratio from a bounded sample: the ratio at which the sample's own neighbours are found at ``recall``.

    A vector close to its centroid has few lists within the ratio; so many are taken at least that half of the misses are found too.
    """
    lists = max(1, min(lists, len(sample)))
    c = balanced_means(sample, lists)
    index = Index(c, *centroid_graph(c), 1.0, 1, near, copies)
    asked = sample[np.random.default_rng(1).choice(len(sample), min(500, len(sample)), replace=False)]
    d = _squared(asked, sample)
    near_ids = np.argsort(d, 1)[:, 1 : k + 1]
    if not near_ids.size:
        return index
    needed, rank = [], []
    to = np.sqrt(_squared(asked, c))
    own = dict(zip(u := np.unique(near_ids), assign(index, sample[u]), strict=True))
    for i, ids in enumerate(near_ids):
        first = [to[i, own[j]].min() for j in ids]
        needed += [x / max(to[i].min(), 1e-300) for x in first]
        rank += [(to[i] < x).sum() for x in first]
    ratio = float(np.quantile(needed, recall)) + 1e-9
    missed = np.array(rank)[np.array(needed) > ratio]
    return Index(c, index.starts, index.neighbours, ratio, int(np.median(missed)) + 1 if len(missed) else 1, near, copies)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def nearest(ids: np.ndarray, v: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k nearest different ids other than its own among rows that stand in order of their ids: query, id, distance."""
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    d = _squared(q, v)
    d[q_ids[:, None] == ids[None]] = np.inf
    least = np.minimum.reduceat(d, starts, axis=1)  # of each id
    most = min(k, len(starts)) - 1
    limit = np.partition(least, most, axis=1)[:, most]
    slack = 1e-9 * (1 + (q * q).sum(1) + (v * v).sum(1).max())  # rounding of the fast form; the exact one decides
    asked, found, far = [], [], []
    for i in range(len(q)):
        c = np.flatnonzero((d[i] <= limit[i] + slack[i]) & np.isfinite(d[i]))
        exact = np.sqrt(((v[c] - q[i]) ** 2).sum(1))
        best = np.lexsort((ids[c], exact))
        best = best[np.sort(np.unique(ids[c][best], return_index=True)[1])][:k]  # the nearest row of each id
        asked.append(np.full(len(best), q_ids[i]))
        found.append(ids[c][best])
        far.append(exact[best])
    return np.concatenate(asked), np.concatenate(found), np.concatenate(far)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, *, sample: int = LEAST_SAMPLE, recall: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", part: int = 20_000) -> DataFrame:
    """For each query row its k nearest other ids found: query_id, rank (from 1), vec_id, score (Euclidean distance in double precision).

    ``queries`` has the same two columns. Vectors that are null, zero, hold null or non-finite components, or have not the
    table's commonest number of components take no part, nor do rows without id; so an empty table gives an empty result.
    Rows with the same id count as one candidate, by the nearest; as a query by the least vector. Ties go to the smaller id.
    ``sample`` bounds what the driver fits on; every vector is indexed. A query takes more lists than the ratio says until
    they hold k others at least, so fewer than k come back only if there are fewer.
    """
    spark = vectors.sparkSession
    column = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), column.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = good.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dims, n = sizes[0]["size"], sizes[0]["count"]
    good = good.where(F.size("v") == dims)
    good = good.dropDuplicates(["vec_id", "v"])
    lists = max(1, min(MOST_LISTS, round(n**0.5)))
    sample = max(sample, SAMPLE_A_LIST * lists)
    share = good if n <= sample else good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < int(sample / n * 1_000_003))
    fitted = share.select("v").limit(2 * sample).toPandas()["v"]  # about ``sample`` vectors
    index = fit(np.array(fitted.tolist(), dtype=np.float64).reshape(-1, dims), lists=lists, k=k, recall=recall)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                lists = assign(index, _vectors(b.column("v"), dims))
                times = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int32)), b.column("vec_id").take(times), b.column("v").take(times)], ["list", "vec_id", "v"])

    posted = cut(good.mapInArrow(post, "list int, vec_id long, v array<double>"))
    by_list = posted.groupBy("list", "vec_id").agg(F.count("*").alias("n")).withColumn("share", 1 / F.count("*").over(Window.partitionBy("vec_id")))
    held = {r["list"]: r for r in by_list.groupBy("list").agg(F.sum("n").alias("n"), F.count("*").alias("ids"), F.sum("share").alias("share")).collect()}  # a row a list, MOST_LISTS at most
    count, ids_in, share_in = (np.array([held[i][name] if i in held else 0 for i in range(len(index.centroids))]) for name in ("n", "ids", "share"))
    parts = np.maximum(1, -(-count // part))
    n_parts = F.split(F.lit(",".join(map(str, parts.tolist()))), ",").cast("array<int>")
    posts = posted.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.element_at(n_parts, F.col("list") + 1)).cast("int"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                far = walk(index, _vectors(b.column("v"), dims), index.ratio, max(8, index.least))
                which, row = [], []
                for i in range(b.num_rows):
                    order = np.argsort(far[i], kind="stable")
                    take = max(index.least, int((far[i] <= index.ratio * far[i].min()).sum()))
                    # an id adds one at most to the sum of its shares over its lists: so many different ids at least
                    enough = (np.cumsum(ids_in[order]) // index.copies > k) & (np.cumsum(share_in[order]) > k + 1e-6)
                    order = order[: max(take, int(enough.argmax()) + 1 if enough.any() else len(order))]
                    for li in order:
                        which += [(li, p) for p in range(parts[li])]
                    row += [i] * int(parts[order].sum())
                times = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in which], pa.int32()), pa.array([x[1] for x in which], pa.int32()), b.column("vec_id").take(times), b.column("v").take(times)], ["list", "part", "query_id", "q"])

    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), column.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")) & (F.size(vector_col) == dims)).groupBy("vec_id").agg(F.min("v").alias("v"))
    routed = asked.mapInArrow(route, "list int, part int, query_id long, q array<double>")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by list and part, vectors before queries."""
        key, held, own = None, [], None
        for batch in batches:
            which, is_query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "is_query"))
            part, ids, v = batch.column("part").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False), _vectors(batch.column("v"), dims)
            starts = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (part[1:] != part[:-1]) | (is_query[1:] != is_query[:-1])]))
            for s, e in zip(starts, [*starts[1:], len(ids)], strict=True):
                if (which[s], part[s]) != key:
                    key, held, own = (which[s], part[s]), [], None
                if not is_query[s]:
                    held.append((ids[s:e], v[s:e]))
                elif held:
                    if own is None:
                        own_ids, own_v = (np.concatenate(x) for x in zip(*held, strict=True))
                        order = np.argsort(own_ids, kind="stable")
                        own = own_ids[order], own_v[order]
                    for at in range(s, e, 256):
                        found = nearest(*own, ids[at : min(e, at + 256)], v[at : min(e, at + 256)], k)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    both = posts.select("list", "part", F.lit(0).alias("is_query"), F.col("vec_id").alias("id"), "v").union(routed.select("list", "part", F.lit(1), "query_id", "q"))
    found = both.repartition("list", "part").sortWithinPartitions("list", "part", "is_query").mapInArrow(searched, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.pmod("vec_id", F.lit(100)) == 0))
