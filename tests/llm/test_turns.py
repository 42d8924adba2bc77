import hashlib
import random
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from tidebar.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, part string, n string, key int, at int"
STATES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NEW = {"": "user", "s": "user", "u": "assistant", "a": "user"}
SPACES = " \t\n\x0b\f\r"


def cheapest(rows):
    """(cost, edits, turns) by all suffixes, from the last row back; edits compare as strings."""
    best = {s: (2 * k, "I" * k, [f"{r}:" for r in add]) for s, k, add in (("", 0, []), ("s", 2, ["user", "assistant"]), ("u", 1, ["assistant"]), ("a", 0, []))}
    for role, text, fault in reversed(rows):
        bare = {}
        for s in STATES:
            options = [(best[s][0] + 3, "D" + best[s][1], best[s][2])]
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                to = STATES[s].get(role[:1])
                if to:
                    c, e, t = best[to]
                    options.append((c + extra, "K" + e, [f"{role}:{text}", *t]))
                c, e, t = best[NEW[s][0]]
                options.append((c + 2 + extra, "R" + e, [f"{NEW[s]}:{text}", *t]))
            bare[s] = min(options, key=lambda o: o[:2])
        for _ in range(3):
            for s in STATES:
                c, e, t = bare[NEW[s][0]]
                bare[s] = min(bare[s], (c + 2, "I" + e, [f"{NEW[s]}:", *t]), key=lambda o: o[:2])
        best = bare
    return best[""]


def plain(rows):
    """The contract in plain Python, one conversation after another."""
    out, by = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        known = [t for t, _, _ in own if t is not None]
        seen, told = set(), []
        for _, role, text in own:
            said = text.rstrip(SPACES)
            told.append((role, text, "blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        cost, edits, said = cheapest(told)
        n = lambda f: sum(x[2] == f for x in told)  # noqa: E731, B023
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, n("blank"), n("duplicate"), n("truncated"), illegal, cost, edits, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def rows_of(rng, convs):
    rows = []
    for c in range(convs):
        for t in range(rng.choice([1, 2, 5, 9, 30])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No", "And then?", "  \t", "", None, f"It is {t}.", f"{t} is", "Ja.\n", "日本。"])
            rows.append((c, rng.choice([t, t, t, t * 3, None]), role, text))
    return rows + [(None, 0, "user", "Lost."), (None, None, None, None), rows[0], rows[0], (70, 1, "user", "Hm.")] + [(71, t, "user", "Same.") for t in range(90)] + [(72, 4, "user", "Hm.")] * 50


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(7)


@pytest.mark.parametrize("size", [65_536, 1, 3])
def test_equals_all_suffixes(spark, monkeypatch, size):
    monkeypatch.setattr(turns, "SEGMENT", size)
    rows = rows_of(random.Random(size), 40)
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in turns.audit(frame(spark, rows)).collect()}
    assert got == plain(rows)


def test_long_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(turns, "SEGMENT", 100)
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["Go.", f"{t}.", "hm", ""])) for t in range(3000)] + [(2, 1, "user", "Hi.")]
    got = {r["conv_id"]: (r["cost"], r["audit"], r["repaired_sha256"], r["illegal"]) for r in turns.audit(frame(spark, rows)).collect()}
    assert got == {k: (v[5], v[6], v[7], v[4]) for k, v in plain(rows).items()}


def test_checkpoints_and_blocks_agree():
    rng = random.Random(1)
    for n in (0, 1, 2, 50, 1000):
        codes = bytes(rng.randrange(16) for _ in range(n))
        whole, end = turns.walk(codes, 0, turns.END)
        half = n // 3
        behind = turns._back(codes[half:], turns.END)[0]
        first, mid = turns.walk(codes[:half], 0, behind)
        second, last = turns.walk(codes[half:], mid, turns.END)
        assert (whole, end) == (first + second, last)
        matrix = turns.costs(codes[:half])
        assert turns._in_front(matrix, behind) == turns._back(codes, turns.END)[0]


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Still there?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", " ")]
    df = frame(spark, rows).withColumn("n", F.lit(1).cast("long"))
    got = [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in turns.repair(df).orderBy("conv_id", "part", "at", "k").collect()]
    assert got == [(1, "K", "user", "Hello."), (1, "I", "assistant", ""), (1, "K", "user", "Still there?"), (1, "K", "assistant", "Yes."), (2, "D", "", "")]


def test_empty_table(spark):
    assert turns.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql(spark, smoke_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{smoke_dir}/conversations.parquet'")
    want = con.sql(turns.SQL)
    got = turns.query(spark, smoke_dir).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
