"""Personal data: exact base patterns, and a skip-chain conditional random field that adds spans.

Nodes of the field are the words with a digit or an at sign; all other words are surely no entity, so they cut the chain.
Neighbouring nodes share a chain potential, occurrences of the same or a similar word anywhere in a document a skip
potential (each occurrence with the one before it and the first, so edges stay linear and ways short). Loopy sum-product
passes messages for all documents of a batch at once until they settle; a word whose marginal favours a kind, outside base
spans, becomes a span.

The field learns what the patterns can't see: from texts as they are, labelled by the patterns and by names before secrets
(``token = ...``), and from copies in which each span of a pattern is written so that the pattern misses it, beside numbers
that are no personal data. Node weights and both potentials are fitted together by pseudo-likelihood.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_column, arrow_map, table, texts

#: Kinds of the base patterns, and all kinds; the last is found by the field alone.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
N_LABELS, N_FEATURES, WIDTH = len(KINDS) + 1, 1 << 14, 8
#: Parts of a shape, at most: a longer one would name a single word.
LONG_SHAPE = 24
#: Logarithmic odds for no entity before any evidence, so that words unlike all seen ones are none.
PRIOR = 3.0

# The base patterns. The look-behind only spares the search hopeless starts inside a run of digits.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|[(\[]at[)\]]")
# Names before a secret, and the fewest characters of one.
_SECRET = re.compile(r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key)[\x20\t]*[=:][\x20\t]*[\"']?([A-Za-z0-9+/_-]{16,})")
_NAMED = re.compile(r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key)[\x20\t]*[=:][\x20\t]*$")
# Hashes, identifiers and times, which are secrets only by a name.
_COMMON = re.compile(r"[0-9a-fA-F]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}[T_][0-9:.+Z-]+|[0-9.,:/_-]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_EDGE = "\"'`,;:!?.()[]{}<>|="

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base patterns, by start and then kind; a failing match is dropped and not tried again."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _MARK.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def silver_spans(text: str) -> list[Span]:
    """What labels are learned from: the base spans, and secrets by the name before them, wherever they stand in the text."""
    named = {m[1] for m in _SECRET.finditer(text) if _MARK.search(m[1])}
    again = [(m.start(), 4, m.end()) for m in re.finditer("|".join(map(re.escape, sorted(named, key=len, reverse=True))), text)] if named else []
    return sorted(base_spans(text) + again)


def _rewritten(kind: int, s: str, rng: random.Random) -> str:
    """A span of a base pattern in another way of writing, which its pattern doesn't see. What makes it one stays: check digits hold, parts are in range."""
    digits = "".join(c for c in s if "0" <= c <= "9")
    if kind == 0:
        return s.replace("@", rng.choice(["(at)", "[at]"]))
    if kind == 1:
        return rng.choice(["[.]", "(.)", "[dot]"]).join(s.split("."))
    if kind == 2:
        return rng.choice([".", "/", "_"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    groups = [g for g in re.split("[^0-9]+", s) if g]
    if len(groups) < 3:
        groups = [digits[:-10] or digits[:1], digits[-10:-7], digits[-7:-4], digits[-4:]]
    first, *rest = groups
    return rng.choice([f"00{first} " + " ".join(rest), f"{first} ({rest[0]}) " + "-".join(rest[1:]), f"{first}-" + "-".join(rest), f"00{first}-" + "-".join(rest)])


def _decoy(rng: random.Random) -> str:
    """A number, hash, version or time that is no personal data."""
    n = rng.randrange
    hexes = lambda k: f"{n(16**k):0{k}x}"
    day = lambda: f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}"
    odd = lambda k: next(x for x in iter(lambda: str(n(10 ** (k - 1), 10**k)), None) if not _luhn(x))
    kinds = (
        lambda: str(n(10)), lambda: str(n(1900, 2100)), day, lambda: f"{n(24):02}:{n(60):02}", lambda: f"{n(1, 10)}.{n(10)}.{n(20)}", lambda: f"{n(1, 1000)}.{n(100):02}", lambda: f"{n(1, 100)}%", lambda: f"v{n(1, 20)}.{n(10)}", lambda: f"{n(1, 32)}/{n(1, 13)}/{n(1900, 2100)}",
        lambda: str(n(10_000, 10_000_000)), lambda: str(n(10**9, 2 * 10**9)), lambda: str(n(10**12, 2 * 10**12)), lambda: odd(n(8, 12)), lambda: odd(12), lambda: odd(n(13, 20)), lambda: "978" + odd(10), lambda: f"978-{n(10)}-{n(100, 1000)}-{n(10_000, 100_000)}-{n(10)}",
        lambda: f"{n(1, 1000)},{n(1000):03}", lambda: f"{n(1, 1000)},{n(1000):03},{n(1000):03}", lambda: f"{n(1, 1000)},{n(1000):03},{n(1000):03},{n(1000):03}", lambda: f"{n(1, 20)}.{n(20)}.{n(256, 100_000)}.{n(1, 10_000)}", lambda: f"v{n(1, 9)}.{n(20)}.{n(20)}.{n(300, 999)}",
        lambda: f"{day()}T{n(24):02}:{n(60):02}:{n(60):02}" + rng.choice(["Z", "", "+00:00", f".{n(1000):03}Z"]), lambda: f"{day()} {n(24):02}:{n(60):02}:{n(60):02}", lambda: hexes(40), lambda: hexes(rng.choice([8, 12, 32, 64])), lambda: f"{hexes(8)}-{hexes(4)}-4{hexes(3)}-a{hexes(3)}-{hexes(12)}",
        lambda: f"{n(1000)}.{n(10**6):06}", lambda: f"{n(100, 1000)}-{n(10, 100)}-{n(1000, 10_000)}", lambda: f"#{n(10**5)}", lambda: f"{n(100)}x{n(1000)}",
    )
    return rng.choice(kinds)()


def rewritten_copy(text: str, spans: list[Span], seed: int) -> tuple[str, list[Span], list[Span]]:
    """The text with each base span rewritten and a number that is none beside every second one; every second span also stands
    once more at the end, and as many more numbers among words. The new places of all spans, and those rewritten."""
    rng = random.Random(crc32(text[:64].encode("utf-8", "replace")) + seed)
    parts, out, new, again, at, size = [], [], [], [], 0, 0
    for s, k, e in spans:
        if s < at:
            continue
        parts.append(text[at:s])
        size += s - at
        if rng.random() < 0.5:
            parts.append(_decoy(rng) + " ")
            size += len(parts[-1])
        word = _rewritten(k, text[s:e], rng) if k < len(BASE) else text[s:e]
        parts.append(word)
        out.append((size, k, size + len(word)))
        if k < len(BASE):
            new.append(out[-1])
        size += len(word)
        at = e
        if rng.random() < 0.5:
            again.append((k, word))
    parts.append(text[at:])
    size += len(parts[-1])
    words = [w for w in text[:512].split() if not _MARK.search(w)] or ["and"]
    more = again + [(-1, _decoy(rng)) for _ in range(3 + len(spans))]
    rng.shuffle(more)
    for k, word in more:  # all in the same surroundings: only what stands elsewhere tells a span that comes again
        parts.append(f" {rng.choice(words)} ")
        size += len(parts[-1])
        if k >= 0:
            out.append((size, k, size + len(word)))
            new += out[-1:] if k < len(BASE) else []
        parts.append(f"{word}{rng.choice(['', '', '.', ','])} {rng.choice(words)}")
        size += len(parts[-1])
    return "".join(parts), out, new


def _shape(word: str) -> str:
    """Digits and letters by kind and length, other characters as they are: ``+9:1``, ``a:3@a:4.a:3``; of hashes, which would each have a shape of their own, only that they are mixed."""
    out, last, n = [], "", 0
    for c in word[:48]:
        kind = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if kind == last:
            n += 1
            continue
        if last in ("9", "a"):
            out.append(f":{n}" if last == "9" else "")
        out.append(kind)
        last, n = kind, 1
    if last == "9":
        out.append(f":{n}")
    return "".join(out) if len(out) <= LONG_SHAPE else "mixed"


def _check(word: str) -> str:
    """What arithmetic says of a word: whether its digits pass Luhn, or the parts of a dotted quad are in range."""
    digits = "".join(c for c in word if "0" <= c <= "9")
    if _IP.fullmatch(word):
        return f"quad{all(int(p.lstrip('0')[:4] or 0) <= 255 for p in word.split('.'))}"
    return f"luhn{_luhn(digits)}" if 12 <= len(digits) <= 19 else str(min(len(digits), 20))


def _class(word: str) -> str:
    """What characters a word is of, and about how long it is."""
    some = ((any("0" <= c <= "9" for c in word), "9"), (any(c.isalpha() for c in word), "a"), ("@" in word, "@"), ("." in word, "."), ("-" in word, "-"), ("(" in word or "[" in word, "("))
    return "".join(c for has, c in some if has) + str(min(len(word), 48) // 4)


@dataclass(frozen=True)
class Nodes:
    """Candidate words of one text: place of the bare word, features, whether it directly follows the node before, and its skip keys."""

    start: list[int]
    end: list[int]
    features: list[tuple[int, ...]]
    follows: list[bool]
    keys: list[tuple[str, str]]


def nodes(text: str) -> Nodes:
    out = Nodes([], [], [], [], [])
    shapes: list[tuple[str, str, str, str]] = []
    at, size = 0, len(text)
    while m := _MARK.search(text, at):
        s = m.start()
        while s > at and not _SPACE.match(text[s - 1]):
            s -= 1
        gap = _SPACE.search(text, m.end())
        e = gap.start() if gap else size
        word = text[s:e]
        bare = word.strip(_EDGE)
        a = s + (word.find(bare) if bare else 0)
        before, after = text[max(0, s - 32) : s].split()[-1:], text[e : e + 32].split()[:1]
        out.start.append(a)
        out.end.append(a + len(bare))
        out.follows.append(bool(out.start) and len(out.start) > 1 and not text[out.end[-2] : s].strip(" \t" + _EDGE))
        named = bool(_NAMED.search(text, max(0, s - 32), a) or _SECRET.match(word.lstrip(_EDGE)))
        shapes.append((_shape(bare), "\0named" if named else before[0] if before else "", after[0] if after else "", _check(bare), _class(bare)))
        plain = "".join(c for c in bare if c.isalnum()).lower()
        out.keys.append((plain[:64], f"{_shape(bare)}/{plain[:6]}"))
        at = e
    for shape, left, right, check, kind in shapes:
        kept = left.lower()[-12:] if _MARK.search(left) is None else ""
        names = ("b", f"c{check}", f"s{shape}", f"k{kind}", f"d{check}/{kind}", f"l{_class(left) if _MARK.search(left) else ''}", f"r{_class(right) if _MARK.search(right) else ''}", f"w{kept}")
        out.features.append(tuple(crc32(x.encode("utf-8", "replace")) % N_FEATURES for x in names))
    return out


def _silver(found: Nodes, spans: list[Span]) -> list[int]:
    """Label of each node: 1 + kind of the first span (spans come by their starts) that overlaps it, else 0."""
    out, first, ends = [], 0, list(accumulate((e for _, _, e in spans), max))
    for a, b in zip(found.start, found.end, strict=True):
        while first < len(spans) and ends[first] <= a:
            first += 1
        i, label = first, 0
        while i < len(spans) and spans[i][0] < b and not label:
            label = spans[i][1] + 1 if spans[i][2] > a else 0
            i += 1
        out.append(label)
    return out


@dataclass(frozen=True)
class Model:
    """Node weights (features x labels), and the logarithmic chain and skip potentials (labels x labels)."""

    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _edges(found: Nodes) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    chain = [(i - 1, i) for i, near in enumerate(found.follows) if near]
    skip, last, first = [], {}, {}
    for i, keys in enumerate(found.keys):
        for key in dict.fromkeys(keys):
            if key in last and not (last[key] == i - 1 and found.follows[i]):
                skip.append((last[key], i))
            if key in first and first[key] < i - 1:
                skip.append((first[key], i))
            last[key] = i
            first.setdefault(key, i)
    return chain, list(dict.fromkeys(skip))


def marginals(unary: np.ndarray, edges: np.ndarray, tables: np.ndarray, kind: np.ndarray, owner: np.ndarray | None = None, rounds: int = 200, damp: float = 0.3, tolerance: float = 1e-3) -> np.ndarray:
    """Loopy sum-product over nodes (n x labels) and edges (m x 2), in logarithms; an edge has the labels x labels table of its ``kind``.

    ``owner`` is the text of each edge (edges of different texts share no node). A text is done when none of its messages changes
    by more than the tolerance, and isn't touched after that, so its result doesn't depend on which texts stand beside it;
    ``rounds`` only ends what never settles. Memory: a few rows of labels for each edge.
    """
    m = len(edges)
    belief = unary.copy()
    if m:
        owner = np.zeros(m, np.int64) if owner is None else owner
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        which, own = np.concatenate([kind, kind + len(tables)]), np.concatenate([owner, owner])
        factor = np.exp(np.concatenate([tables, tables.transpose(0, 2, 1)]))
        order = np.argsort(which, kind="stable")
        place = np.empty(2 * m, np.int64)
        place[order] = np.arange(2 * m)
        back = place[np.concatenate([np.arange(m, 2 * m), np.arange(m)])[order]]
        src, dst, which, own = src[order], dst[order], which[order], own[order]
        groups = [(int(k), *np.searchsorted(which, [k, k + 1])) for k in np.unique(which)]
        message = np.zeros((2 * m, unary.shape[1]))
        done = np.zeros(int(owner.max()) + 1, bool)
        for _ in range(rounds):
            new = belief[src]
            new -= message[back]
            new -= new.max(axis=1, keepdims=True)
            np.exp(new, out=new)
            for k, a, b in groups:
                new[a:b] = new[a:b] @ factor[k]
            np.log(new, out=new)
            new -= new.max(axis=1, keepdims=True)
            new *= 1 - damp
            new += damp * message
            held = done[own]
            if held.any():
                new[held] = message[held]
            moved = np.abs(new - message).max(axis=1)
            message = new
            belief = unary + np.stack([np.bincount(dst, message[:, k], len(unary)) for k in range(unary.shape[1])], axis=1)
            most = np.zeros(len(done))
            np.maximum.at(most, own, moved)
            done = most < tolerance
            if done.all():
                break
    belief -= belief.max(axis=1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(axis=1, keepdims=True)


def _sound(kind: int, s: str, named: set[str]) -> bool:
    """Whether a span is what its kind must be: an address with four parts in range, a card that passes its check, a phone in groups,
    a secret that has a name somewhere in its text or looks like no hash, identifier or time."""
    groups = re.findall("[0-9]+", s)
    digits = "".join(groups)
    if kind == 0:
        return len(s) >= 5
    if kind == 1:
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if kind == 2:
        return 12 <= len(digits) <= 19 and _luhn(digits)
    if kind == 3:
        return 9 <= len(digits) <= 17 and len(groups) >= 3
    return len(s) >= 16 and (s in named or not _COMMON.fullmatch(s))


def find(batch: list[str], model: Model, sure: float = 0.5) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and spans that the field adds, for each text."""
    base = [base_spans(t) for t in batch]
    held = [nodes(t) if _MARK.search(t) else None for t in batch]
    features, edges, kinds, owner, first = [], [], [], [], []
    for text, h in enumerate(held):
        first.append(len(features))
        if h:
            at = len(features)
            features += h.features
            for kind, pairs in enumerate(_edges(h)):
                edges += [(a + at, b + at) for a, b in pairs]
                kinds += [kind] * len(pairs)
                owner += [text] * len(pairs)
    if not features:
        return [(b, []) for b in base]
    unary = model.weights[np.array(features)].sum(axis=1)
    unary[:, 0] += PRIOR
    p = marginals(unary, np.array(edges, dtype=np.int64).reshape(-1, 2), np.stack([model.chain, model.skip]), np.array(kinds, np.int64), np.array(owner, np.int64))
    best, top = p.argmax(axis=1), p.max(axis=1)
    out = []
    for t, b, h, at in zip(batch, base, held, first, strict=True):
        added: list[Span] = []
        last = -2
        starts, ends = [s for s, _, _ in b], list(accumulate((e for _, _, e in b), max))
        for i in range(len(h.start)) if h else ():
            k = int(best[at + i]) - 1
            s, e = h.start[i], h.end[i]
            if k == 3 and s and t[s - 1] == "(" and ")" in t[s:e]:
                s -= 1
            before = bisect_left(starts, e)
            if k < 0 or top[at + i] <= sure or s >= e or (before and ends[before - 1] > s):
                continue
            if added and last == i - 1 and h.follows[i] and added[-1][1] == k and k in (2, 3):
                added[-1] = (added[-1][0], k, e)
            else:
                added.append((s, k, e))
            last = i
        named = {m[1] for m in _SECRET.finditer(t)} if any(k == 4 for _, k, _ in added) else set()
        out.append((b, [x for x in added if _sound(x[1], t[x[0] : x[2]], named)]))
    return out


def _training_rows(text: str) -> Iterator[tuple[int, ...]]:
    """Features, label, labels of the neighbours in the chain (-1: none) and how many skip neighbours have each label (three at most), for each node of a text and of its rewritten copy."""
    spans = silver_spans(text)
    copy, moved, _ = rewritten_copy(text, spans, 1)
    for t, own in ((text, spans), (copy, moved)) if spans else ((text, spans),):
        found = nodes(t)
        label = _silver(found, own)
        chain, skip = _edges(found)
        left, right, far = [-1] * len(label), [-1] * len(label), [[0] * N_LABELS for _ in label]
        for a, b in chain:
            left[b], right[a] = label[a], label[b]
        for a, b in skip:
            far[a][label[b]] = min(3, far[a][label[b]] + 1)
            far[b][label[a]] = min(3, far[b][label[a]] + 1)
        for i, y in enumerate(label):
            yield (*found.features[i], y, left[i], right[i], *far[i])


def train(docs: DataFrame, bound: int = 20_000, max_rows: int = 60_000, steps: int = 150) -> Model:
    """A field fitted to texts and their rewritten copies, on about ``bound`` documents taken evenly by a hash of the id and
    at most ``max_rows`` different rows of their words (by a hash, each with how often it stands); the fit is a bounded
    sample, while ``scan`` covers every document.

    Pseudo-likelihood: each label given those of its neighbours, for node weights and both potentials at once, with a ridge.
    Without any word with a digit or an at
    sign the model finds nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < int(bound / n * 1_000_003))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: Counter = Counter()
            for t in batch.column("text").to_pylist():
                if _MARK.search(t):
                    counts.update(_training_rows(t))
            return pa.RecordBatch.from_arrays([pa.array(list(map(list, counts)), pa.list_(pa.int32())), pa.array(counts.values(), pa.int64())], ["value", "n"])

        return run

    counted = arrow_map(rows, make, "value array<int>, n long").groupBy("value").agg(F.sum("n").alias("n"))
    got = counted.orderBy(F.xxhash64("value"), "value").limit(max_rows).collect()
    weights, pair = np.zeros((N_FEATURES, N_LABELS)), np.zeros((2, N_LABELS, N_LABELS))
    if not got:
        weights[:, 0] = 10.0
        return Model(weights, pair[0], pair[1])
    value, w = np.array([r["value"] for r in got]), np.log1p(np.array([r["n"] for r in got], float))
    x, y, left, right, far = value[:, :WIDTH], value[:, WIDTH], value[:, WIDTH + 1], value[:, WIDTH + 2], value[:, WIDTH + 3 :].astype(float)
    w /= w.sum()
    has_left, has_right, truth = left >= 0, right >= 0, np.eye(N_LABELS)[y]
    square, square_pair = np.full_like(weights, 1e-8), np.full_like(pair, 1e-8)
    for _ in range(steps):  # AdaGrad
        z = weights[x].sum(axis=1) + far @ pair[1]
        z[:, 0] += PRIOR
        z[has_left] += pair[0][left[has_left]]
        z[has_right] += pair[0][:, right[has_right]].T
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p = (p - truth) * w[:, None]
        g = np.column_stack([np.bincount(x.ravel(), np.repeat(p[:, k], WIDTH), N_FEATURES) for k in range(N_LABELS)]) + 1e-6 * weights
        g_pair = 1e-4 * pair
        np.add.at(g_pair[0], left[has_left], p[has_left])
        np.add.at(g_pair[0].T, right[has_right], p[has_right])
        g_pair[1] += far.T @ p
        g_pair[1] = (g_pair[1] + g_pair[1].T) / 2  # a skip edge has no direction
        square += g * g
        square_pair += g_pair * g_pair
        weights -= 0.5 * g / np.sqrt(square)
        pair = np.clip(pair - 0.2 * g_pair / np.sqrt(square_pair), -4, 4)
    return Model(weights, pair[0], pair[1])


def measure(docs: DataFrame, model: Model, seed: int = 2) -> dict[str, float]:
    """How well the field finds rewritten spans, by copies of all given documents that have base spans (give ones held out from training).

    ``recall``: rewritten spans of which an added span of their kind covers a part. ``precision``: added spans that overlap a
    span of the copy, base, secret or rewritten; the copy's numbers that are none count against it. ``spans``: rewritten spans.
    """

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [0, 0, 0, 0]
            for t in batch.column("text").to_pylist():
                spans = silver_spans(t)
                if not spans:
                    continue
                copy, moved, new = rewritten_copy(t, spans, seed)
                added = find([copy], model)[0][1]
                seen = set(base_spans(copy))
                for s, k, e in new:
                    if not any(a < e and s < b for a, _, b in seen):
                        n[0] += 1
                        n[1] += any(k == j and a < e and s < b for a, j, b in added)
                n[2] += len(added)
                n[3] += sum(any(a < e and s < b for s, _, e in moved) for a, _, b in added)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in n], ["spans", "hits", "added", "right"])

        return run

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    r = arrow_map(rows, make, "spans long, hits long, added long, right long").agg(*(F.sum(c).alias(c) for c in ("spans", "hits", "added", "right"))).first()
    share = lambda a, b: (r[a] or 0) / r[b] if r[b] else 1.0
    return {"spans": r["spans"] or 0, "recall": share("hits", "spans"), "precision": share("right", "added")}


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256, spans, n_added. One row out for each row in, repeated rows alike.

    Null and empty texts have no spans (base_sha256 is that of an empty string); an empty table stays empty. Columns besides
    id and text are not read. ``spans`` has base spans and added ones as kind:start:end, by start and kind, in code points.
    """

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = find(batch.column("text").to_pylist(), model)
            n = [[sum(x[1] == k for x in base) for base, _ in found] for k in range(len(BASE))]
            digest = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in n), pa.array(digest, pa.string()), pa.array([_joined(b + a) for b, a in found], pa.string()), pa.array([len(a) for _, a in found], pa.int64())],
                                              ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"])

        return run

    return arrow_map(texts(docs, id_col, text_col), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact_column(text: Column, model: Model) -> Column:
    """Each text with every span replaced by its kind in brackets; overlapping spans are replaced as one, by the first one's kind."""

    def run(whole: list[str]) -> list[str]:
        out = []
        for t, (base, added) in zip(whole, find(whole, model), strict=True):
            parts, at = [], 0
            for s, k, e in sorted(base + added):
                if s >= at:
                    parts += [t[at:s], f"[{KINDS[k]}]"]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]) if at else t)
        return out

    return arrow_column(text, lambda: run, "string", pa.string())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
