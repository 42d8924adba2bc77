"""Conversation structure repair: the cheapest edits that turn the roles of a conversation into ``(s?(ua)+)?``.

Rows of a conversation are kept, get another role, are deleted, or empty ones are inserted before them; which edits are
cheapest is a shortest path over four states (nothing yet, after the system turn, after a user turn, after an assistant
turn), and of all cheapest ones the edits whose initials are ASCII-least are emitted.

A conversation may be of any length. Rows are range-partitioned in order, so a long conversation lies in many segments of
at most ``SEGMENT`` rows. A segment as a whole is a 4 x 4 table of least costs; the tables of a conversation are folded
from its end, so each segment gets the backward costs behind it. Inside a segment backward cost vectors are stored only at
every square-root-th row; a block between two of them is recomputed while the walk goes forward through it. Where segments
follow each other, each is walked from all four states first, and the states at which they begin are chained.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, stored, table

#: Rows of a segment, at most.
SEGMENT = 65_536
#: States by what stands before: nothing, the system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Classes of a row by its role's first letter, and what a row suffers from.
CLASSES, FINE, TRUNCATED, BLANK, DUPLICATE = "sua", 0, 1, 2, 3
DELETE, INSERT, REROLE, BROKEN = 3, 2, 2, 1
_NEVER = 1 << 40
#: State that an inserted or re-roled turn leads to, that turn's role, and where a kept row of each class leads to (-1: nowhere).
NEXT = (USER, USER, ASSISTANT, USER)
NAMED = ("user", "user", "assistant", "user")
KEEP = ((SYSTEM, USER, -1, -1), (-1, USER, -1, -1), (-1, -1, ASSISTANT, -1), (-1, USER, -1, -1))
#: Costs behind the last row: 0 where the conversation may end, else what insertions cost that end it.
END = (0, 4, 2, 0)

Vector = tuple[int, int, int, int]


_STEPS: dict[tuple[Vector, int], tuple[Vector, int, tuple[tuple[str, int], ...]]] = {}


def _step(after: Vector, code: int) -> tuple[Vector, int, tuple[tuple[str, int], ...]]:
    """``_made`` for vectors and codes met before is looked up: there are few different ones."""
    got = _STEPS.get((after, code))
    if got is None:
        got = _STEPS[after, code] = _made(after, code)
    return got


def _made(after: Vector, code: int) -> tuple[Vector, int, tuple[tuple[str, int], ...]]:
    """Of a row (class + 4 * fault) and the costs behind it: costs before it less the least one, that one, and from each
    state the ASCII-least edits up to the row's own one and the state they lead to."""
    kind, fault = code % 4, code // 4
    broken = BROKEN if fault == TRUNCATED else 0
    own = []
    for s in range(4):
        cost = [("D", DELETE + after[s], s)]
        if fault < BLANK:
            if KEEP[s][kind] >= 0:
                cost.append(("K", broken + after[KEEP[s][kind]], KEEP[s][kind]))
            cost.append(("R", REROLE + broken + after[NEXT[s]], NEXT[s]))
        own.append(cost)
    bare = [min(c for _, c, _ in own[s]) for s in range(4)]
    before = [min(bare[s], INSERT + bare[NEXT[s]], 2 * INSERT + bare[NEXT[NEXT[s]]]) for s in range(4)]
    walks = []
    for s in range(4):
        edits = ""
        while own[s][0][1] != before[s] and INSERT + before[NEXT[s]] == before[s]:
            edits += "I"
            s = NEXT[s]
        edit, _, to = next(x for x in own[s] if x[1] == before[s])
        walks.append((edits + edit, to))
    low = min(before)
    return tuple(min(c - low, _NEVER) for c in before), low, tuple(walks)  # type: ignore[return-value]


def _back(codes: bytes, after: Vector) -> tuple[Vector, int]:
    """Costs before the first of some rows (less the least one), and that one."""
    total = 0
    for code in reversed(codes):
        after, low, _ = _step(after, code)
        total += low
    return after, total


def walk(codes: bytes, state: int, behind: Vector) -> tuple[list[str], int]:
    """The ASCII-least cheapest edits of each row and the state after the last, given the costs behind it.

    Cost vectors are kept at every square-root-th row only; each block is recomputed when the walk comes to it.
    """
    n = len(codes)
    size = isqrt(n) + 1
    marks = {n: behind}
    after = behind
    for at in range((n - 1) // size * size, 0, -size):
        after = marks[at] = _back(codes[at : at + size], after)[0]
    edits = []
    for at in range(0, n, size):
        block = codes[at : at + size]
        after, steps = marks[min(at + size, n)], []
        for code in reversed(block):
            after, _, walks = _step(after, code)
            steps.append(walks)
        for walks in reversed(steps):
            own, state = walks[state]
            edits.append(own)
    return edits, state


def costs(codes: bytes) -> list[int]:
    """The least cost of some rows from each state to each, row by row; what is inserted after the last row is not theirs."""
    units = [tuple(0 if s == e else _NEVER for s in range(4)) for e in range(4)]
    made = [_back(codes, u) for u in units]  # type: ignore[arg-type]
    return [min(made[e][0][s] + made[e][1], _NEVER) for s in range(4) for e in range(4)]


def _in_front(matrix: list[int], behind: Vector) -> Vector:
    before = [min(matrix[4 * s + e] + behind[e] for e in range(4)) for s in range(4)]
    return tuple(c - min(before) for c in before)  # type: ignore[return-value]


def damage(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, ``n`` of rows damaged by the checksum of their place (nulls in role and text read as a blank):
    a twentieth each is lost (``n`` is 0), emptied, without ends of sentences, doubled (``n`` is 2) or said by the user."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), blank), F.coalesce(F.col("text"), blank)
    return convs.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with a key of role and text, their class and the fault that their own text shows; lost rows only tell of their conversation."""
    gone = F.col("n") == 0
    rows = rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").otherwise(F.col("role")).alias("role"), F.when(gone, "").otherwise(F.col("text")).alias("text"), "n")
    said = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    fault = F.when(said == "", BLANK).when(F.substring(said, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    return rows.withColumns({"key": F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))), "kind": kind, "fault": fault})


def segments(rows: DataFrame) -> DataFrame:
    """One row for each stretch of at most ``SEGMENT`` rows of a conversation, stored: its place ``part``, the rows' turns, roles, keys,
    numbers and codes, and what is counted in it. ``rows`` as ``_marked`` gives them; rows that are alike are one row with their number."""
    at = ["conv_id", "turn", "role", "key"]
    alike = rows.groupBy(*at, "kind", "fault").agg(F.sum("n").alias("n"))
    seen = alike.where("n > 0").groupBy("conv_id", "key").agg(F.count("*").alias("_turns"), F.min(F.struct("turn")).alias("_first")).where("_turns > 1")
    seen = seen.select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), "_first")
    told = alike.join(seen, alike["conv_id"].eqNullSafe(seen["_conv"]) & (alike["key"] == seen["_key"]), "left")
    again = F.col("_first").isNotNull() & ~F.col("_first.turn").eqNullSafe(F.col("turn")) & (F.col("fault") != BLANK)
    told = told.select(*at, "n", (F.col("kind") + 4 * F.when(again, DUPLICATE).otherwise(F.col("fault"))).cast("int").alias("code"))
    ordered = told.repartitionByRange(*at).sortWithinPartitions(*at)
    schema = "conv_id long, part long, turn array<long>, key array<binary>, n array<long>, codes binary, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def summed(conv_id: int | None, part: int, rows: list[tuple]) -> tuple:
        rows = [r for r in rows if r[3]]
        codes, n, known = np.array([r[4] for r in rows], np.uint8), np.array([r[3] for r in rows], np.int64), [r[1] for r in rows if r[1] is not None]
        kind, fault = codes % 4, codes // 4
        more = int((n - 1)[fault != BLANK].sum())
        pair = kind[:-1] * 4 + kind[1:]
        return (conv_id, part, [r[1] for r in rows], [r[2] for r in rows], n.tolist(), codes.tobytes(), int(n[fault == BLANK].sum()), int((fault == DUPLICATE).sum()) + more, int((fault == TRUNCATED).sum()),
                int((~np.isin(pair, [1, 6, 9])).sum() + (n - 1).sum()), known[0] if known else None, known[-1] if known else None, len(set(known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held, last = TaskContext.get().partitionId() << 32, 0, [], None
        packed = lambda done: pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=arrow)
        for batch in batches:
            done = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "key", "n", "code")), strict=True):
                if held and (row[0] != last or len(held) == SEGMENT):
                    done.append(summed(last, base + made, held))
                    made, held = made + 1, []
                last = row[0]
                held.append(row)
            if done:
                yield packed(done)
        if held:
            yield packed([summed(last, base + made, held)])

    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    arrow = pa.schema([(x.split(" ")[0], kinds[x.split(" ")[1]]) for x in schema.split(", ")])
    return stored(ordered.select("conv_id", "turn", "key", "n", "code").mapInArrow(run, schema))


def _folded(df: DataFrame, make, value: str, kind: pa.DataType, schema: str) -> DataFrame:
    """Of each conversation the segments' ``value`` in order, folded to one value each: as many at once as a conversation has segments."""
    lists = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", value))).alias("of"))

    def fold():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [[{"part": x["part"], "got": g} for x, g in zip(of, make([x[value] for x in of]), strict=True)] for of in batch.column("of").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(out, pa.list_(pa.struct([("part", pa.int64()), ("got", kind)])))], ["conv_id", "of"])

        return run

    got = arrow_map(lists, fold, f"conv_id long, of array<struct<part:long,got:{schema}>>")
    return got.select(F.explode("of").alias("x")).select("x.part", "x.got")


def _behind(matrices: list[list[int]]) -> list[list[int]]:
    out, behind = [], END
    for m in reversed(matrices):
        out.append(list(behind))
        behind = _in_front(m, behind)
    return out[::-1]


def _begins(leads: list[list[int]]) -> list[int]:
    out, state = [], START
    for to in leads:
        out.append(state)
        state = to[state]
    return out


def edits(segs: DataFrame) -> DataFrame:
    """conv_id, part, at, turn, key, and the edits of each different row: ``state`` before it, its ``edits``, how many ``more`` like it are deleted, the ``tail`` after it."""
    counted = segs.join(segs.groupBy("conv_id").agg(F.max("part").alias("_last"), F.count("*").alias("_of")).withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    lone, split = counted.where("_of = 1"), counted.where("_of > 1")

    def per(df: DataFrame, f, name: str) -> DataFrame:
        def make():
            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                rows = [f(*x) for x in zip(*(batch.column(c).to_pylist() for c in range(2, batch.num_columns)), strict=True)]
                return pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(rows, pa.list_(pa.int64()))], ["conv_id", "part", name])

            return run

        return arrow_map(df, make, f"conv_id long, part long, {name} array<long>")

    behind = _folded(per(split.select("conv_id", "part", "codes"), costs, "matrix"), _behind, "matrix", pa.list_(pa.int64()), "array<long>")
    ends = split.join(behind.withColumnRenamed("got", "behind"), "part")
    leads = per(ends.select("conv_id", "part", "codes", "behind"), lambda codes, b: [walk(codes, s, tuple(b))[1] for s in range(4)], "leads")
    ends = ends.join(_folded(leads, _begins, "leads", pa.int64(), "long").withColumnRenamed("got", "begin"), "part")
    cols = ["conv_id", "part", "turn", "key", "n", "codes", "behind", "begin", "end"]
    lone = lone.withColumns({"behind": F.array(*map(F.lit, END)).cast("array<long>"), "begin": F.lit(START).cast("long"), "end": F.lit(True)})
    every = lone.select(cols).unionByName(ends.withColumn("end", F.col("part") == F.col("_last")).select(cols))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for conv_id, part, turn, key, n, codes, after, state, end in zip(*(batch.column(c).to_pylist() for c in cols), strict=True):
                done, _ = walk(codes, state, tuple(after))
                for i, own in enumerate(done):
                    out.append((conv_id, part, i, turn[i], key[i], state, own, n[i] - 1, ""))
                    state = _moved(state, own, codes[i] % 4)
                if end and out and done:
                    tail = ""
                    while END[state]:
                        tail, state = tail + "I", NEXT[state]
                    out[-1] = (*out[-1][:-1], tail)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["conv_id", "part", "at", "turn", "key", "state", "edits", "more", "tail"])

        return run

    return arrow_map(every, make, "conv_id long, part long, at long, turn long, key binary, state long, edits string, more long, tail string", rows=64)


def _moved(state: int, own: str, kind: int) -> int:
    for e in own:
        state = state if e == "D" else KEEP[state][kind] if e == "K" else NEXT[state]
    return state


def repair(rows: DataFrame, segs: DataFrame | None = None) -> DataFrame:
    """Repaired conversations, row by row: conv_id, their place (``part``, ``at``, ``k``), ``edit`` (Delete, Insert, Keep, Rerole), ``times``,
    ``cost``, ``role`` and ``text`` (both empty where the edit is a deletion; rows alike are deleted ``times`` times).

    ``rows``: conv_id, turn, role, text and ``n`` (how often the row stands; 0: not at all). Rows go by turn, nulls first, equal turns by
    role and a digest of role and text; a null role or text is a blank; rows of a null conv_id are one conversation; other columns are not read.
    A row without visible text, or with a role and text that stood before, is deleted; one that ends without a stop costs one more unless
    deleted. A role whose first letter is none of s, u and a can't be kept. Without rows there is nothing to repair.
    """
    marked = _marked(rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "n"))
    told = edits(segs if segs is not None else segments(marked)).withColumnsRenamed({"conv_id": "_conv", "turn": "_turn", "key": "_key"})
    full = marked.where("n > 0").groupBy("conv_id", "turn", "key").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.first("fault").alias("fault"))
    both = full.join(told, F.col("key").eqNullSafe(F.col("_key")) & F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))).drop("_conv", "_turn", "_key", "turn", "key")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for conv_id, role, text, fault, part, at, state, own, more, tail in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
                k = 0
                broken = BROKEN if fault == TRUNCATED else 0
                for e in own:
                    said = "" if e == "D" else role if e == "K" else NAMED[state]
                    out.append((conv_id, part, at, k, e, 1, DELETE if e == "D" else INSERT if e == "I" else broken + REROLE * (e == "R"), said, text if e in "KR" else ""))
                    state, k = _moved(state, e, CLASSES.find(role[:1]) if role[:1] else 3), k + 1
                if more:
                    out.append((conv_id, part, at, k, "D", more, DELETE, "", ""))
                for e in tail:
                    k += 1
                    out.append((conv_id, part, at, k, e, 1, INSERT, NAMED[state], ""))
                    state = NEXT[state]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["conv_id", "part", "at", "k", "edit", "times", "cost", "role", "text"])

        return run

    return arrow_map(both, make, "conv_id long, part long, at long, k long, edit string, times long, cost long, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, ``cost``, ``audit`` and ``repaired_sha256`` of each conversation: one pass over its rows in order, holding only the edits' initials.

    A digest over a whole conversation can only be made in its rows' order, so one task reads all rows of a conversation here.
    """
    place = ["conv_id", "part", "at", "k"]
    ordered = repaired.repartition("conv_id").sortWithinPartitions(*place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun, sha, audit, cost = None, False, hashlib.sha256(), [], 0
        some = False
        for batch in batches:
            done = []
            for conv_id, edit, times, price, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "times", "cost", "role", "text")), strict=True):
                if begun and conv_id != last:
                    done.append((last, cost, "".join(audit), sha.hexdigest()))
                    sha, audit, cost, some = hashlib.sha256(), [], 0, False
                last, begun = conv_id, True
                audit.append(edit * times)
                cost += price * times
                if edit != "D":
                    sha.update(f"\n{role}:{text}".encode() if some else f"{role}:{text}".encode())
                    some = True
            if done:
                yield _packed(done)
        if begun:
            yield _packed([(last, cost, "".join(audit), sha.hexdigest())])

    return ordered.mapInArrow(run, "conv_id long, cost long, audit string, repaired_sha256 string")


def _packed(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["conv_id", "cost", "audit", "repaired_sha256"])


def faults(segs: DataFrame) -> DataFrame:
    """conv_id, ``gaps``, ``blank``, ``duplicate``, ``truncated`` and ``illegal`` of each conversation, from its segments' counts."""
    ends = segs.select("conv_id", "part", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", F.substring("codes", 1, 1).alias("a"), F.substring("codes", -1, 1).alias("z"))
    of = F.array_sort(F.filter(F.collect_list(F.struct("part", "low", "high", "a", "z")), lambda x: F.length(x["a"]) > 0)).alias("of")
    g = ends.groupBy("conv_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), *(F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal")), of)
    meets = F.when(F.size("of") > 1, F.transform(F.sequence(F.lit(1), F.size("of") - 1), lambda i: F.struct(F.get("of", i - 1).alias("p"), F.get("of", i).alias("q")))).otherwise(F.array())
    count = lambda test: F.size(F.filter(meets, test))
    kind = lambda b: F.conv(F.hex(b), 16, 10).cast("int") % 4
    twice = count(lambda m: m["p"]["high"] == m["q"]["low"])
    bad = count(lambda m: ~(kind(m["p"]["z"]) * 4 + kind(m["q"]["a"])).isin(1, 6, 9))
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - (F.col("turns") - twice))
    return g.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + bad).alias("illegal"))


def audit(convs: DataFrame) -> DataFrame:
    """Per conversation of the damaged rows: faults, the edits and their cost, and a digest of the repaired one. Repeated rows count as rows; an empty table gives an empty one."""
    rows = damage(convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    segs = segments(_marked(rows))
    done = digests(repair(rows, segs)).withColumnRenamed("conv_id", "_conv")
    out = faults(segs).join(done, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.coalesce("cost", F.lit(0).cast("long")).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::INT])), 4294967295) % 20 AS kind
  FROM conversations, crc),
copies AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM base),
told AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, left(role, 1) AS c, lag(left(role, 1)) OVER w AS p
  FROM copies WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
rows AS (
  SELECT *, CASE WHEN said = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(said, 1) IN ('.', '!', '?') THEN 'f' ELSE 't' END AS fault FROM told),
sized AS (SELECT conv_id, count(*) AS n FROM rows GROUP BY conv_id),
back AS (
  SELECT conv_id, n AS i, 0::BIGINT AS b0, 4::BIGINT AS b1, 2::BIGINT AS b2, 0::BIGINT AS b3 FROM sized
  UNION ALL
  SELECT conv_id, i - 1, least(n0, 2 + n2, 4 + n3), least(n1, 2 + n2, 4 + n3), least(n2, 2 + n3), least(n3, 2 + n2) FROM (
    SELECT b.conv_id, b.i,
      least(3 + b0, CASE WHEN fault IN ('f', 't') THEN least(CASE c WHEN 's' THEN b1 WHEN 'u' THEN b2 ELSE 999 END, 2 + b2) + (fault = 't')::INT ELSE 999 END) AS n0,
      least(3 + b1, CASE WHEN fault IN ('f', 't') THEN least(CASE c WHEN 'u' THEN b2 ELSE 999 END, 2 + b2) + (fault = 't')::INT ELSE 999 END) AS n1,
      least(3 + b2, CASE WHEN fault IN ('f', 't') THEN least(CASE c WHEN 'a' THEN b3 ELSE 999 END, 2 + b3) + (fault = 't')::INT ELSE 999 END) AS n2,
      least(3 + b3, CASE WHEN fault IN ('f', 't') THEN least(CASE c WHEN 'u' THEN b2 ELSE 999 END, 2 + b2) + (fault = 't')::INT ELSE 999 END) AS n3
    FROM back b JOIN rows r ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = b.i)),
costs AS (SELECT conv_id, i, [b0, b1, b2, b3] AS b FROM back),
path AS (
  SELECT conv_id, 0::BIGINT AS i, 1 AS s, '' AS audit, []::VARCHAR[] AS said, 0::BIGINT AS cost, false AS over FROM sized
  UNION ALL
  SELECT conv_id, CASE WHEN e IN ('D', 'K', 'R') THEN i + 1 ELSE i END,
    CASE e WHEN 'D' THEN s WHEN 'K' THEN keep WHEN '' THEN s ELSE nxt END, audit || e,
    CASE WHEN e IN ('D', '') THEN said WHEN e = 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, CASE nxt WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE e WHEN 'R' THEN text ELSE '' END) END,
    cost + CASE e WHEN 'D' THEN 3 WHEN 'I' THEN 2 WHEN 'K' THEN (fault = 't')::INT WHEN 'R' THEN 2 + (fault = 't')::INT ELSE 0 END, e = ''
  FROM (
    SELECT q.*, r.role, r.text, r.fault, CASE q.s WHEN 3 THEN 4 ELSE 3 END AS nxt,
      CASE WHEN q.s = 1 AND r.c = 's' THEN 2 WHEN q.s IN (1, 2, 4) AND r.c = 'u' THEN 3 WHEN q.s = 3 AND r.c = 'a' THEN 4 ELSE 0 END AS keep,
      CASE WHEN r.i IS NULL AND a.b[q.s] = 0 THEN ''
        WHEN r.i IS NOT NULL AND 3 + z.b[q.s] = a.b[q.s] THEN 'D'
        WHEN 2 + a.b[CASE q.s WHEN 3 THEN 4 ELSE 3 END] = a.b[q.s] THEN 'I'
        WHEN r.fault IN ('f', 't') AND CASE WHEN q.s = 1 AND r.c = 's' THEN z.b[2] WHEN q.s IN (1, 2, 4) AND r.c = 'u' THEN z.b[3] WHEN q.s = 3 AND r.c = 'a' THEN z.b[4] ELSE 999 END + (r.fault = 't')::INT = a.b[q.s] THEN 'K'
        ELSE 'R' END AS e
    FROM path q JOIN costs a ON q.conv_id IS NOT DISTINCT FROM a.conv_id AND q.i = a.i
    LEFT JOIN costs z ON q.conv_id IS NOT DISTINCT FROM z.conv_id AND z.i = q.i + 1
    LEFT JOIN rows r ON q.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = q.i + 1
    WHERE NOT q.over)),
done AS (SELECT conv_id, cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256 FROM path WHERE over),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND p || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON o.conv_id IS NOT DISTINCT FROM d.conv_id
"""
