"""License scan: Aho-Corasick over tags and notice phrases, shunting-yard over licence expressions."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table, texts

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notice phrases of common licences (words joined by one space), their labels and how sure they make us.
NOTICES = {
    "apache license": ("apache", 0.9),
    "mit license": ("mit", 0.9),
    "bsd license": ("bsd", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "creative commons attribution": ("cc-by", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "public domain": ("public-domain", 0.7),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
}
BASE_SURE = {"cc-by": 0.8, "gpl": 0.9, "reserved": 0.6}
TAG = "spdx license identifier"
RANK = {"or": 1, "and": 2, "with": 3}

# A-Z to lower case, ASCII that is no letter or digit to a space; bytes of other characters stay, so words are cut as in the contract.
_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+-]+")
_AFTER_TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n\"'<>*]*)", re.IGNORECASE)


def parse_expression(text: str) -> list[str] | None:
    """A licence expression as postfix tokens (shunting-yard), the longest well-formed start of it; None if there is none."""
    out: list[str] = []
    ops: list[str] = []
    best: tuple[int, list[str]] | None = None  # how many postfix tokens are out by then, and the operators that follow
    operand, depth = True, 0
    for m in _TOKEN.finditer(text):
        token = m[0]
        low = token.lower()
        if operand:
            if token == "(":
                ops.append(token)
                depth += 1
            elif token == ")" or low in RANK:
                break
            else:
                out.append(token)
                operand = False
        elif token == ")":
            if not depth:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        elif low in RANK:
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        else:
            break
        if not operand and not depth:
            best = len(out), ops[::-1]
    return None if best is None else out[: best[0]] + best[1]


def evaluate(postfix: list[str], allowed: frozenset[str] | None = None) -> tuple[frozenset[str], bool]:
    """The identifiers that a postfix expression names (exceptions after WITH join theirs), and whether the allowed ones satisfy it."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in RANK:
            (b, ok_b), (a, ok_a) = stack.pop(), stack.pop()
            if token == "with":
                stack.append(({f"{x} with {y}" for x in a for y in b}, ok_a))
            else:
                more, less = (a, b) if len(a) >= len(b) else (b, a)
                more |= less  # the smaller set into the larger one, so that long expressions stay cheap
                stack.append((more, (ok_a and ok_b) if token == "and" else (ok_a or ok_b)))
        else:
            name = token.lower()
            stack.append(({name}, allowed is None or name in allowed))
    return frozenset(stack[0][0]), stack[0][1]


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


#: Identifiers that the score's expression may rely on; a parameter of ``scan``.
OPEN = frozenset(["mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "unlicense"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: frozenset[str] = OPEN) -> DataFrame:
    """Licence marks of each whole text; one row out for each row in.

    Null and empty texts have no words: counts 0, no first or last word, empty labels, score 0. Repeated rows give repeated
    results, and an empty table an empty result. Columns besides the id and the text are not read. ``expressions`` has the
    tagged licence expressions in postfix form, ``satisfied`` whether the ``allowed`` identifiers meet all of them (null
    without any). The score is how sure the surest mark makes us that the text bears a licence: 1 for an expression.
    """

    def make():
        find = _automaton().iter

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [[] for _ in range(10)]
            for text in batch.column("text"):
                whole = text.as_py()
                words = whole.encode("utf-8", "surrogatepass").translate(_FOLD).split()
                flat = f" {b' '.join(words).decode('latin-1')} "
                starts, base, marks, expressions, satisfied, sure = [], set(), set(), [], None, 0.0
                tagged, word, seen = False, 0, 0  # blanks before ``seen``: matches come by their ends, so each stretch is counted about once
                for end, phrase in find(flat):
                    if phrase in BASE:
                        at = end - len(phrase) - 1
                        word += flat.count(" ", seen, at) if at >= seen else -flat.count(" ", at, seen)
                        seen = at
                        starts.append(word)
                        base.add(BASE[phrase])
                        sure = max(sure, BASE_SURE[BASE[phrase]])
                    if phrase in NOTICES:
                        marks.add(NOTICES[phrase][0])
                        sure = max(sure, NOTICES[phrase][1])
                    tagged |= phrase == TAG
                if tagged:
                    for m in _AFTER_TAG.finditer(whole):
                        if (postfix := parse_expression(m[1])) is not None:
                            names, ok = evaluate(postfix, allowed)
                            marks |= names
                            expressions.append(" ".join(postfix))
                            satisfied, sure = ok and satisfied is not False, 1.0
                for column, value in zip(rows, (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | marks)), sure, expressions, satisfied), strict=False):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.bool_()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "satisfied"]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=False))], ["doc_id", *names])

        return run

    return arrow_map(texts(docs, id_col, text_col), make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, satisfied boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
