"""Near copies by the Jaccard likeness of five-word shingles: every pair at or over the limit is found, and checked exactly.

Candidates come from SimHash first: fingerprints of the five-word shingles that the Gray-order index links. That finds few
of the pairs, as at this likeness fingerprints differ in up to a dozen of 64 bits; so it is completed by prefixes. Two sets
of likeness 0.8 or more share one of the first ``n - ceil(0.8 n) + 1`` shingles of each, whatever order all sets follow. The
order puts shingles that are common in a bounded sample last, so few sets meet in a shingle. Of the sets that meet, a bound
from two small histograms leaves out most that can't be alike; the others' sets are read from the shared folder and compared
in the task in which they meet, which gives only links that connect. Rows so grow with the sets and not with their pairs.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, bitmap, cut, in_bitmap, shared_dir, stored, texts
from .simhash import components, links, of_hashes, shingle_hashes

#: Words of a shingle, and the likeness from which two texts are copies, as a fraction.
SHINGLE, LEAST, OF = 5, 4, 5
#: Hashes that a task writes to one file, buckets of a histogram, members of a shingle that one task compares with each other, hashes of sets that a task keeps at hand, pairs that it knows to be unlike.
FILE, BUCKETS, MOST, HELD, KNOWN = 1_000_000, 64, 2048, 4_000_000, 200_000


def shingles(text: str) -> tuple[np.ndarray, int]:
    """The upper 48 bits of the distinct shingle hashes in order, and the SimHash; texts without words have one hash of their own."""
    h = shingle_hashes(text, SHINGLE)
    own = np.unique(h >> np.uint64(16))
    return (own if len(own) else np.zeros(1, np.uint64)), of_hashes(h)


def prefix(h: np.ndarray, known: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The shingles of which two like sets share one: the rarest in the sample first, then by hash."""
    most = len(h) - -(-LEAST * len(h) // OF) + 1
    if not len(known):
        return h[:most]
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return h[np.argsort(np.where(known[at] == h, times[at], 0), kind="stable")[:most]]


def histogram(h: np.ndarray) -> np.ndarray:
    """How many hashes fall into each bucket, 255 at most."""
    return np.minimum(np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)


def may_be_alike(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of n and m hashes with these histograms can reach the limit: like sets differ in (n + m) / 9 hashes at most, and histograms differ in no more."""
    differ = np.abs(a.astype(np.int16) - b).sum(axis=-1, dtype=np.int64)
    return (differ * (OF + LEAST) <= (n + m) * (OF - LEAST)) & (np.minimum(n, m) * OF >= np.maximum(n, m) * LEAST)


def _common(rows: DataFrame, bound: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts among about ``bound``, at most ``most``, and how many hold each. The order only saves work."""
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < int(bound / n * 1_000_003))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            key, times = np.unique(np.concatenate([shingles(t.as_py())[0] for t in batch.column("text")]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(times.astype(np.int64))], ["key", "n"])

        return run

    got = arrow_map(rows, make, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(most).collect()
    key, times = np.array([r["key"] for r in got], np.int64).view(np.uint64), np.array([r["n"] for r in got], np.int64)
    order = np.argsort(key)
    return key[order], times[order]


class Sets:
    """Shingle sets in files of the shared folder, each read by its place."""

    def __init__(self, uri: str):
        self.fs, self.root = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.sets: OrderedDict[tuple[str, int], np.ndarray] = OrderedDict()
        self.size = 0

    def write(self, sets: list[np.ndarray]) -> tuple[str, list[int]]:
        """A new file's name and where each set starts. A task that runs twice leaves a file that no row names."""
        name, starts, at = uuid.uuid4().hex, [], 0
        with self.fs.open_output_stream(f"{self.root}/{name}") as out:
            for h in sets:
                starts.append(at)
                at += out.write((h & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (h >> np.uint64(32)).astype(np.uint16).tobytes())
        return name, starts

    def read(self, name: str, start: int, n: int) -> np.ndarray:
        key = name, start
        if key in self.sets:
            self.sets.move_to_end(key)
            return self.sets[key]
        if name not in self.files:
            self.files[name] = self.fs.open_input_file(f"{self.root}/{name}")
            if len(self.files) > 64:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(name)
        got = self.files[name].read_at(6 * n, start)
        h = np.frombuffer(got, np.uint32, n).astype(np.uint64) | np.frombuffer(got, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)
        self.sets[key] = h
        self.size += n
        while self.size > HELD and len(self.sets) > 2:
            self.size -= len(self.sets.popitem(last=False)[1])
        return h


def _buckets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BUCKETS)


def _alike(pairs: DataFrame, sets: DataFrame, uri: str) -> DataFrame:
    """Those of the pairs (a, b) whose sets' likeness reaches the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Sets(uri)
        for batch in batches:
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "m"))
            batch = batch.filter(pa.array(may_be_alike(n, m, _buckets(batch.column("x")), _buckets(batch.column("y")))))
            keep = []
            for p, s, n, q, t, m in zip(*(batch.column(c).to_pylist() for c in ("p", "s", "n", "q", "t", "m")), strict=True):
                both = len(np.intersect1d(store.read(p, s, n), store.read(q, t, m), assume_unique=True))
                keep.append(OF * both >= LEAST * (n + m - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("fp").alias("a"), F.col("file").alias("p"), F.col("start").alias("s"), "n", F.col("buckets").alias("x"))
    b = sets.select(F.col("fp").alias("b"), F.col("file").alias("q"), F.col("start").alias("t"), F.col("n").alias("m"), F.col("buckets").alias("y"))
    return cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(a, "a").join(b, "b").mapInArrow(run, "a long, b long"))


def _by_simhash(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that SimHash proposes: those of one fingerprint with its first set, and the first sets of linked fingerprints."""
    first = cut(sets.groupBy("sim").agg(F.min("fp").alias("set")))
    same = sets.join(first, "sim").select(F.col("fp").alias("a"), F.col("set").alias("b"))
    linked = links(first.select(F.col("sim").alias("fp")))
    left, right = first.select(F.col("sim").alias("a"), F.col("set").alias("sa")), first.select(F.col("sim").alias("b"), F.col("set").alias("sb"))
    return same.union(linked.join(left, "a").join(right, "b").select("sa", "sb"))


def _meeting(members: DataFrame, uri: str, most: int) -> DataFrame:
    """Links (a, b) between members (key, fp, root, n, pos, buckets, file, start) of a key that have different roots and are alike: those that connect what a task has not connected yet.

    ``pos`` is the place of the key among a set's shingles in the common order. Where two sets of likeness 0.8 meet first, what
    stands from there on must hold all that they share, so a pair for which that is too little is left to another key. A key of
    over ``most`` members is cut into parts, and each pair of parts is one group. The sets are compared where they meet: a group
    gives fewer rows than it has members, however many pairs it has.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("k"))
    rows = members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    of = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(j, F.col("part")).alias("i"), F.greatest(j, F.col("part")).alias("j")))
    dealt = rows.withColumn("p", F.explode(of)).select("key", "p.i", "p.j", "part", "fp", "root", "n", "pos", "buckets", "file", "start")
    names = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, unlike, moved = Sets(uri), set(), {}

        def now(r: int) -> int:
            while r in moved:
                r = moved[r]
            return r

        def linked(t: pa.Table) -> pa.RecordBatch:
            """Of whole groups: each row with the next of its group, the one after it, and so on, for all groups at once."""
            fp, n, part, pos, start, *cols = (t.column(c).to_numpy() for c in ("fp", "n", "part", "pos", "start", *names))
            root = np.array([now(r) for r in t.column("root").to_pylist()], np.int64)
            file, buckets, across, rest = t.column("file").to_pylist(), _buckets(t.column("buckets").combine_chunks()), cols[1] != cols[2], n - pos
            starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
            ends = np.repeat([*starts[1:], len(fp)], np.diff([*starts, len(fp)]))
            i, step, out = np.arange(len(fp)), 1, []
            while len(i := i[i + step < ends[i]]):
                i = i[LEAST * n[i + step] <= OF * n[i]]  # a group's sets stand in order of their size
                x, y = i, i + step
                ok = (root[x] != root[y]) & ~(across[x] & (part[x] == part[y])) & ((OF + LEAST) * np.minimum(rest[x], rest[y]) >= LEAST * (n[x] + n[y]))
                x, y = x[ok], y[ok]
                ok = may_be_alike(n[x], n[y], buckets[x], buckets[y])
                for a, b in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                    pair = int(min(fp[a], fp[b])), int(max(fp[a], fp[b]))
                    if root[a] == root[b] or pair in unlike:
                        continue
                    both = len(np.intersect1d(store.read(file[a], int(start[a]), int(n[a])), store.read(file[b], int(start[b]), int(n[b])), assume_unique=True))
                    if OF * both >= LEAST * (n[a] + n[b] - both):
                        out.append(pair)
                        moved[int(root[a])] = int(root[b])
                        root[root == root[a]] = root[b]
                    else:
                        if len(unlike) >= KNOWN:
                            unlike.clear()
                        unlike.add(pair)
                step += 1
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 4 * most:  # the last group may go on in the next batch
                t = pa.Table.from_batches(held).combine_chunks()
                cols = [t.column(c).to_numpy() for c in names]
                last = np.flatnonzero(np.any([c != c[-1] for c in cols], axis=0))
                at = int(last[-1]) + 1 if len(last) else 0
                if at:
                    yield linked(t.slice(0, at))
                held = t.slice(at).to_batches()
                size = t.num_rows - at
        if size:
            yield linked(pa.Table.from_batches(held))

    return dealt.repartition(*names).sortWithinPartitions(*names, "n").mapInArrow(run, "a long, b long")


def _fits(n: Column, m: Column) -> Column:
    return F.least(n, m) * OF >= F.greatest(n, m) * LEAST


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2_000, most: int = 50_000, part: int = MOST) -> DataFrame:
    """The rows of docs, all columns, of which one of each group of near copies stays: the one with the smallest id (null ids last, then by a hash of the text).

    A group is what pairs of likeness 0.8 or more connect. Texts of fewer than five words are one shingle; null and empty
    texts and those of white space are alike. Of repeated rows one stays as well. An empty table stays empty. ``sample``
    bounds the texts whose shingles order all others, and ``most`` these shingles; neither changes the result.
    """
    base = texts(docs, id_col, text_col)
    known, times = _common(base, sample, most)
    uri = f"{shared_dir(docs.sparkSession).rstrip('/')}/sets-{uuid.uuid4().hex}"
    folder = Sets(uri)
    folder.fs.create_dir(folder.root)
    of_set = [("file", pa.string()), ("start", pa.int64()), ("n", pa.int32()), ("sim", pa.int64()), ("buckets", pa.binary()), ("keys", pa.list_(pa.int64()))]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Sets(uri)

        def done(ids: list, ths: list, fps: list[int], held: dict[int, tuple[np.ndarray, int]]) -> pa.RecordBatch:
            """A set's own columns stand in the first row that has it."""
            name, starts = store.write([h for h, _ in held.values()])
            own = {fp: {"file": name, "start": s, "n": len(h), "sim": np.uint64(sim).astype(np.int64).item(), "buckets": histogram(h).tobytes(), "keys": prefix(h, known, times).view(np.int64)} for s, (fp, (h, sim)) in zip(starts, held.items(), strict=True)}
            rows = [own.pop(fp, {}) for fp in fps]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(fps, pa.uint64()).view(pa.int64()), *(pa.array([r.get(c) for r in rows], t) for c, t in of_set)], ["doc_id", "th", "fp", *(c for c, _ in of_set)])

        ids, ths, fps, held, size = [], [], [], {}, 0
        for batch in batches:
            for doc_id, t, th in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("th").to_pylist(), strict=True):
                h, sim = shingles(t.as_py())
                fp = xxhash.xxh64_intdigest(h.tobytes())
                ids.append(doc_id)
                ths.append(th)
                fps.append(fp)
                if fp not in held:
                    held[fp] = h, sim
                    size += len(h)
                if size >= FILE or len(ids) >= 10_000:
                    yield done(ids, ths, fps, held)
                    ids, ths, fps, held, size = [], [], [], {}, 0
        if ids:
            yield done(ids, ths, fps, held)

    marked = stored(base.withColumn("th", F.xxhash64("text")).mapInArrow(mark, "doc_id long, th long, fp long, file string, start long, n int, sim long, buckets binary, keys array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "th"))
    classes = marked.groupBy("fp").agg(first.alias("k"))  # one row a set, however many copies there are
    whole = marked.where("file is not null")
    sets = cut(whole.groupBy("fp").agg(*(F.first(c).alias(c) for c in ("sim", "n", "buckets")), F.min(F.struct("file", "start")).alias("at")).select("fp", "sim", "n", "buckets", "at.file", "at.start"))

    # members of shingles that several sets hold
    w = Window.partitionBy("key")
    held = whole.select("fp", "n", F.posexplode("keys").alias("pos", "key")).withColumn("low", F.min("fp").over(w)).withColumn("high", F.max("fp").over(w))
    shared = stored(held.where("low <> high").select("key", "fp", "n", "pos").distinct())

    # what SimHash proposes, and each set against two of those that it meets: what is alike in a large group is soon one component
    ends = [F.min(F.struct(F.xxhash64("fp", F.lit(seed)).alias("h"), "fp", "n")).over(w) for seed in (1, 2)]
    first_met = [F.min(F.when(_fits(F.col("n"), F.col(c)["n"]), F.col(c))).alias(c) for c in ("c0", "c1")]
    stars = shared.select("fp", "n", *(e.alias(f"c{i}") for i, e in enumerate(ends))).groupBy("fp").agg(*first_met).select("fp", F.explode(F.array("c0", "c1")).alias("c"))
    near = _alike(_by_simhash(sets).union(stars.select(F.col("fp").alias("a"), F.col("c.fp").alias("b"))), sets, uri)

    # then all pairs of a shingle that aren't connected yet; shingles that the same sets hold are one
    roots = cut(components(near).distinct()).withColumnRenamed("node", "fp")
    rooted = shared.join(roots, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"), "pos")
    holders = F.xxhash64(F.count("*").over(w), *(F.bit_xor(F.xxhash64("fp", F.lit(seed))).over(w) for seed in (3, 4)))
    apart = rooted.withColumn("low", F.min("root").over(w)).withColumn("high", F.max("root").over(w)).withColumn("key", holders).where("low <> high").groupBy("key", "fp", "root").agg(F.min("pos").alias("pos"))
    more = cut(_meeting(apart.join(sets.select("fp", "n", "buckets", "file", "start"), "fp"), uri, part))

    folder.fs.delete_dir(folder.root)  # both kinds of links stand in the shared folder now
    trees = roots.select(F.col("root").alias("a"), F.col("fp").alias("b"))  # what is connected already, as trees of depth one
    named = classes.join(components(trees.union(more)).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    place = lambda of: [F.coalesce(of, F.lit(0).cast("long")).alias("id0"), F.col(of).isNull().alias("no_id"), F.col("th")]
    names = ["id0", "no_id", "th"]
    kept = cut(named.groupBy("root").agg(F.min("k").alias("k")).select("k.id", "k.th").select(*place("id"), F.lit(True).alias("stays")))

    # rows whose key neither goes nor repeats stay where they are; only the others are dealt out by their key
    times = marked.select(*place("doc_id")).groupBy(*names).agg(F.count("*").alias("times"))
    doubtful = times.join(kept, names, "left").where("stays is null or times > 1").select(F.xxhash64(*names).alias("h"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th"), F.struct("*").alias("row")).select(*place("id"), "row")
    rows = rows.withColumn("doubt", in_bitmap(docs.sparkSession, bitmap(doubtful), F.xxhash64(*names)))
    checked = rows.where("doubt").join(kept, names, "left_semi").dropDuplicates(names)
    return rows.where("NOT doubt").select("row.*").union(checked.select("row.*"))
