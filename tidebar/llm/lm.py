"""Interpolated modified Kneser-Ney model of order 3 (or 2): counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

Words are 64-bit hashes. Each task counts what it reads and sends one block of sorted counts to each hash range, so that a
range is merged with array operations. A range's arrays are written once to the shared folder; workers map them, a few hundred at
once, or copy and map them where the folder is not a mounted one. N-grams of the highest order are stored, each with its count,
where they are merged, and do not move again. With order 2 how many kinds of each count follow a context is dealt out by the context, one
row a range and context, and bigrams by the last word, by both if it is hot. With order 3 trigrams are dealt out by the middle word: the context
before it and the bigram behind it are both whole there, so that only how many words stand before a word has to move again. Trigrams around a
hot word are dealt out by the first two words, by all three if the first is hot too; what that cuts up is summed up in parts. In their shuffle the most
frequent words have names of two bytes, columns are pressed, and half of the ranges moves at a time. Arrays of order 3 are indexes: sorted keys
shortened to 32 bits in buckets, counts as codes into a table of those that occur; shuffle files and merged blocks are dropped once they are used.
``train`` can leave the weight of those seen once to the lower order (``singles=False``); probabilities after each context sum to one either way.
Ranges grow in number with the characters of the table, and each is a partition of its own, so what a task merges doesn't grow until there are
``MOST_RANGES``.
"""

from __future__ import annotations

import math
import mmap
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, cut, shared_dir, shuffles_dropped, stored, table, texts

#: Tokens that a task counts or scores at once, characters (and as many a document) that a hash range is made for, and shares of all tokens: a word with more than one in HOT a range, and LEAST_HOT in all, is hot.
BLOCK, RANGE_CHARS, DOC_CHARS, MOST_RANGES, HOT, LEAST_HOT = 1_000_000, 8_000_000, 6, 1 << 16, 4, 512
#: Words that have names of two bytes in the shuffle of trigrams.
SHORT = 0xFFFF
#: Rounds in which trigrams are moved and merged, each a part of the ranges: as much less of them lies in shuffle files at once.
ROUNDS = 2
#: Files that a task maps at once: those longest mapped give way.
MOST_MAPPED = 256
BEGIN, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SALT = np.uint64(0xD6E8FEB86659FD93)
#: In a model of order 3 words are the upper 48 bits of their hashes.
UPPER = np.uint64(0xFFFFFFFFFFFF0000)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Of eight bytes the first so many.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of text that are hashed at once, if a text isn't longer; bytes from which on a word is hashed on its own.
AT_ONCE, LONG_WORD = 1 << 19, 64


def _stirred(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (h ^ w) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``hashes`` of texts as bytes, of which each begins at an offset."""
    word = _IN_WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # where one text meets the next
    first[inner], last[inner - 1] = word[inner], word[inner - 1]
    start, size = np.flatnonzero(first), np.flatnonzero(last) + 1
    size -= start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data]
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = _stirred(size.astype(np.uint64) * _SALT, eight[start] & _FIRST[np.minimum(size, 8)])
    at, k = np.flatnonzero(size > 8), 8
    while len(at) and k < LONG_WORD:
        h[at] = _stirred(h[at], eight[start[at] + k] & _FIRST[np.minimum(size[at] - k, 8)])
        k += 8
        at = at[size[at] > k]
    for i in at.tolist():
        h[i] = xxhash.xxh64_intdigest(padded[start[i] : start[i] + size[i]].tobytes())
    sizes = np.diff(np.searchsorted(start, offsets)) + 1
    out = np.empty(len(h) + len(sizes), np.uint64)
    end = np.cumsum(sizes) - 1
    inside = np.ones(len(out), bool)
    inside[end] = False
    out[inside], out[end] = _stirred(h, _SALT), END
    return out, sizes


def hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash of each token of texts in turn, and how many each text has, some texts at once: the words between white space, A-Z lower-cased, and one end."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    s = 0
    while s < len(texts):
        e = max(s + 1, int(np.searchsorted(offsets, offsets[s] + AT_ONCE, "right")) - 1)
        yield _hashes(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s])
        s = e


def mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One hash of a pair; of h the upper 48 bits count."""
    x = ((h >> np.uint64(16)) * _SALT) ^ w
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def _ranges(n_chars: int) -> int:
    """Bits of the hash that name a range."""
    return max(3, math.ceil(math.log2(max(1, min(MOST_RANGES, n_chars / RANGE_CHARS)))))


def _in(w: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of w are among numbers that stand in order."""
    if not len(of):
        return np.zeros(len(w), bool)
    return of[np.minimum(np.searchsorted(of, w), len(of) - 1)] == w


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of n over each."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.add.reduceat(n, at)


class Store:
    """Arrays by name in a folder that driver and executors share."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.root = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
        self.held: dict[str, list[np.ndarray]] = {}

    def write(self, name: str, arrays: list[np.ndarray]) -> None:
        """Arrays of one length."""
        self._write(name, [np.array([len(arrays[0])], np.int64), *arrays])

    def write_all(self, name: str, arrays: list[np.ndarray]) -> None:
        """Arrays of any types and lengths."""
        head = np.array([len(arrays), *chain.from_iterable((_TYPES.index(a.dtype), len(a)) for a in arrays)], np.int64)
        self._write(name, [head, *arrays])

    def _write(self, name: str, parts: list[np.ndarray]) -> None:
        """Under a name of its own first: a task that runs twice leaves one whole file."""
        own = f"{self.root}/{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(own) as out:
            for a in parts:
                out.write(a.tobytes())
        try:
            self.fs.move(own, f"{self.root}/{name}")
        except OSError:  # where a store doesn't replace files, the same arrays written by another run of the task hold
            if self.fs.get_file_info(f"{self.root}/{name}").type != pafs.FileType.File:
                raise
            self.fs.delete_file(own)

    def read(self, name: str, dtypes: list[type]) -> list[np.ndarray]:
        """What ``write`` wrote, mapped, not loaded; a range without a file is empty."""

        def cut_up(whole: mmap.mmap | None) -> list[np.ndarray]:
            if whole is None:
                return [np.empty(0, t) for t in dtypes]
            n, at, out = int(np.frombuffer(whole, np.int64, 1)[0]), 8, []
            for t in dtypes:
                out.append(np.frombuffer(whole, t, n, at))
                at += n * np.dtype(t).itemsize
            return out

        return self._held(name, cut_up)

    def read_all(self, name: str) -> list[np.ndarray]:
        """What ``write_all`` wrote, mapped; nothing where there is no file."""

        def cut_up(whole: mmap.mmap | None) -> list[np.ndarray]:
            if whole is None:
                return []
            k = int(np.frombuffer(whole, np.int64, 1)[0])
            at, out = 8 * (1 + 2 * k), []
            for of, n in np.frombuffer(whole, np.int64, 2 * k, 8).reshape(k, 2).tolist():
                out.append(np.frombuffer(whole, _TYPES[of], n, at))
                at += n * _TYPES[of].itemsize
            return out

        return self._held(name, cut_up)

    def _held(self, name: str, cut_up: Callable[[mmap.mmap | None], list[np.ndarray]]) -> list[np.ndarray]:
        if name not in self.held:
            while len(self.held) >= MOST_MAPPED:
                self.held.pop(next(iter(self.held)))  # unmapped once no array of it is in use
            self.held[name] = cut_up(self._mapped(name))
        return self.held[name]

    def _mapped(self, name: str) -> mmap.mmap | None:
        if self.fs.get_file_info(f"{self.root}/{name}").type == pafs.FileType.NotFound:
            return None
        if isinstance(self.fs, pafs.LocalFileSystem):
            f = open(f"{self.root}/{name}", "rb")  # noqa: SIM115  the map outlives the file object
        else:
            f = tempfile.TemporaryFile()  # without a name: gone with the worker
            with self.fs.open_input_stream(f"{self.root}/{name}") as source:
                while part := source.read(1 << 22):
                    f.write(part)
            f.flush()
        whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        f.close()
        return whole


_TYPES = [np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.uint64)]


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _coded(values: list[np.ndarray]) -> list[np.ndarray]:
    """Which of the different rows each row is, in as few bytes as these need, and a table of them for each column of values."""
    bits = 16 // len(values)
    small = np.ones(len(values[0]), bool)
    for v in values:
        small &= v < 1 << bits
    packed = sum(v.astype(np.int64) << bits * k for k, v in enumerate(values))
    kinds = np.flatnonzero(np.bincount(packed[small], minlength=1))
    place = np.zeros(1 << 16, np.int64)
    place[kinds] = np.arange(len(kinds))
    code = np.where(small, place[packed & 0xFFFF], 0)
    if not small.any():
        kinds = kinds[:0]
    tables = [kinds >> bits * k & (1 << bits) - 1 for k in range(len(values))]
    large = np.flatnonzero(~small)
    if len(large):
        of = [v[large] for v in values]
        order = np.lexsort(of)
        at = _starts(*(v[order] for v in of))
        code[large[order]] = len(kinds) + np.repeat(np.arange(len(at)), np.diff([*at, len(order)]))
        tables = [np.concatenate([t, v[order][at]]) for t, v in zip(tables, of, strict=True)]
    return [_narrow(code), *map(_narrow, tables)]


class Index:
    """Values by 64-bit keys: sorted keys without the bits that name their bucket (4 to 8 keys), of the rest 32 bits; values as codes.

    Where a bucket starts is kept in two bytes, as what it is off the place at which it would start if all had as many keys. A key that isn't there is taken for one that is about once in 2 ** 29 times.
    """

    def __init__(self, arrays: list[np.ndarray]):
        self.starts, self.low, self.code, *self.tables = arrays

    @staticmethod
    def arrays(key: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        key = key * _SALT
        order, key = _ordered(key)
        return Index.of_spread(key, [v[order] for v in values])

    @staticmethod
    def of_spread(key: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        """The same from keys times ``_SALT``, in order."""
        bits = min(16, max(1, len(key).bit_length() - 3))
        starts = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        off = starts - Index._even(np.arange((1 << bits) + 1), len(key), bits) + (1 << 15)
        return [off.astype(np.uint16) if off.min() >= 0 and off.max() < 1 << 16 else starts.astype(np.uint32), ((key << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32), *_coded(values)]

    @staticmethod
    def _even(bucket: np.ndarray, n: int, bits: int) -> np.ndarray:
        return bucket * n >> bits

    def _start(self, bucket: np.ndarray, bits: int) -> np.ndarray:
        start = self.starts[bucket].astype(np.int64)
        return start if self.starts.dtype == np.uint32 else start + self._even(bucket, len(self.low), bits) - (1 << 15)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the places of those."""
        key = key * _SALT
        bits = (len(self.starts) - 1).bit_length() - 1
        bucket, low = (key >> np.uint64(64 - bits)).astype(np.int64), ((key << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        at, end = self._start(bucket, bits), self._start(bucket + 1, bits)
        if not len(self.low) or not len(key):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        step = 1 << int((end - at).max()).bit_length()
        while step := step >> 1:  # all at once: a step where all keys that it passes are less
            to = at + step
            at = np.where((to <= end) & (self.low[np.minimum(to, len(self.low)) - 1] < low), to, at)
        hit = np.flatnonzero((at < end) & (self.low[np.minimum(at, len(self.low) - 1)] == low))
        return hit, at[hit]

    def values(self, at: np.ndarray) -> list[np.ndarray]:
        code = self.code[at]
        return [t[code] for t in self.tables]


def _store(uri: str) -> Store:
    return Store(uri)


_U, _C, _B, _G = [np.uint64, np.int64], [np.uint64, np.int64], [np.uint64, np.uint32], [np.uint64, np.float32]


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that hold for all: hash bits of a range, training tokens, distinct words, bigram kinds, discounts of words and bigrams, training documents, the hot words, and the discounts of trigrams if there are any."""

    uri: str
    bits: int
    tokens: int
    words: int
    kinds: int
    discounts: tuple[float, float, float]
    spare: float
    of_pairs: tuple[float, float, float]
    n_docs: int
    hot: np.ndarray
    of_triples: tuple[float, float, float] | None = None

    @property
    def order(self) -> int:
        return 2 if self.of_triples is None else 3


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Token hashes of whole documents, each with its begin, about ``BLOCK`` at once."""
    held, size = [], 0
    for batch in batches:
        for h, sizes in hashes(batch.column("text")):
            held.append(np.insert(h, np.cumsum(sizes) - sizes, BEGIN))
            size += len(held[-1])
            if size >= BLOCK:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _tiles(n: np.ndarray) -> np.ndarray:
    """Into how many rows of bytes each count goes, one at least."""
    return np.maximum(1, -(-n // 255))


def _packed(of_kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of three kinds (rows) in bytes: how often each column stands, the first kind, and the other two as one number."""
    times = _tiles(of_kind.max(axis=0))
    left = np.repeat(of_kind, times, axis=1) - 255 * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
    small = np.clip(left, 0, 255).astype(np.uint8)
    return times, small[0], small[1].astype(np.uint16) << np.uint16(8) | small[2]


def _six(x: np.ndarray) -> list[np.ndarray]:
    """Numbers of 48 bits as columns of four and two bytes."""
    return [(x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint16)]


def _of_six(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


@dataclass(frozen=True)
class Names:
    """Words in order of frequency, the most frequent first: their places are their names. The same words in order, and the name of each."""

    words: np.ndarray
    in_order: np.ndarray
    names: np.ndarray

    @staticmethod
    def of(words: np.ndarray) -> Names:
        names = np.argsort(words)
        return Names(words, words[names], names.astype(np.uint16))

    def named(self, x: np.ndarray) -> np.ndarray:
        """The name of each word; ``SHORT`` for those without."""
        if not len(self.words):
            return np.full(len(x), SHORT, np.uint16)
        at = np.minimum(np.searchsorted(self.in_order, x), len(self.words) - 1)
        return np.where(self.in_order[at] == x, self.names[at], SHORT).astype(np.uint16)

    def back(self, names: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Words by their names, those without one from the rest, in turn."""
        out = np.zeros(len(names), np.uint64)
        known = names < SHORT
        out[known], out[~known] = self.words[names[known]], rest
        return out


def _pressed(columns: list[np.ndarray]) -> bytes:
    """Columns of any lengths and unsigned types, pressed: the first bytes of all numbers stand together, then the second ones."""
    head = np.array([len(columns), *chain.from_iterable((_TYPES.index(c.dtype), len(c)) for c in columns)], np.int64).tobytes()
    raw = b"".join([head, *(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns)])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpressed(row: bytes) -> list[np.ndarray]:
    raw = pa.decompress(memoryview(row)[8:], decompressed_size=int(np.frombuffer(row, np.int64, 1)[0]), codec="zstd", asbytes=True)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 * (1 + 2 * k), []
    for of, n in np.frombuffer(raw, np.int64, 2 * k, 8).reshape(k, 2).tolist():
        size = _TYPES[of].itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(_TYPES[of]).ravel())
        at += n * size
    return out


def _deltas(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[1:] -= x[:-1]
    return out


def _sent(of: np.ndarray, columns: list[np.ndarray], kind: str, some: tuple[tuple[np.ndarray, np.ndarray], ...] = ()) -> pa.RecordBatch:
    """One row for each range (these stand in order), with its part of each column, of the first column differences; of ``some`` columns only what is marked."""
    at = _starts(of)
    rows = [_pressed([_deltas(columns[0][s:e]), *(c[s:e] for c in columns[1:]), *(c[s:e][m[s:e]] for c, m in some)]) for s, e in zip(at, [*at[1:], len(of)][: len(at)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array(of[at].astype(np.int32)), pa.array(rows, pa.binary())], ["kind", "r", "a"])


_SENT = "kind string, r int, a binary"


def _received(t: pa.Table, kind: str, types: list[type]) -> list[np.ndarray]:
    """The columns of all rows of a kind that ``_sent`` made."""
    rows = [_unpressed(a) for k, a in zip(t.column("kind").to_pylist(), t.column("a").to_pylist(), strict=True) if k == kind]
    if not rows:
        return [np.empty(0, x) for x in types]
    return [np.concatenate([np.cumsum(c, dtype=np.uint64) if not k else c for c in column]).astype(x) for k, (column, x) in enumerate(zip(zip(*rows, strict=True), types, strict=True))]


def _order_of(ranges: np.ndarray) -> np.ndarray:
    """In order of ranges, of which there are ``MOST_RANGES`` at most."""
    return np.argsort(ranges.astype(np.uint16), kind="stable")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in columns that stand in order."""
    n = len(columns[0])
    new = np.zeros(max(0, n - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate([[True], new])) if n else np.empty(0, np.int64)


def _by_kind(at: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For stretches that begin at ``at`` how many counts are one, two, and more."""
    kind = np.minimum(c, 3)
    return np.stack([np.add.reduceat((kind == k).astype(np.int64), at) for k in (1, 2, 3)]) if len(at) else np.zeros((3, 0), np.int64)


def _range(h: np.ndarray, w: np.ndarray, hot: np.ndarray, shift: np.uint64) -> np.ndarray:
    """The range of each bigram: of h the upper 48 bits count."""
    r = w >> shift
    wide = _in(w, hot)
    r[wide] = mix(h[wide], w[wide]) >> shift
    return r


def _dealt(of: np.ndarray, columns: list[np.ndarray], kind: str = "", sort: bool = True) -> pa.RecordBatch:
    """One row for each range, with its part of each column as bytes."""
    if sort:
        order = np.argsort(of, kind="stable")
        of, columns = of[order], [c[order] for c in columns]
    at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    ends = [*at[1:], len(of)] if len(at) else []
    parts = [pa.array([c[s:e].tobytes() for s, e in zip(at, ends, strict=True)], pa.binary()) for c in columns]
    parts += [pa.nulls(len(at), pa.binary())] * (4 - len(parts))
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array(of[at].astype(np.int32)), *parts], ["kind", "r", *"abcd"])


_DEALT = "kind string, r int, a binary, b binary, c binary, d binary"


def _column(t: pa.Table, name: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), dtype)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many kinds were seen one to four times; 0.5, 1 and 1.5 where those say nothing."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.01), k - 0.01) for k, x in enumerate(d, 1))


def _less(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def _of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist()


def _of_ranges(counts: DataFrame, words: int) -> list[int]:
    """How many words have one to four before them, from each range's counts of those and of all that it has."""
    more = counts.select(*(F.col("n")[i].alias(f"n{i}") for i in range(5))).agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(5))).first()
    n = [more[f"n{i}"] or 0 for i in range(5)]
    return [n[0] + words - n[4], *n[1:4]]  # words that no array has follow one word only


def _before(merged: DataFrame, uri: str, n_ranges: int, words: int) -> list[int]:
    """Writes how many words stand before each word that more than one or a hot range's do, and gives how many words have one to four."""

    def merge_before(t: pa.Table) -> pa.Table:
        word, n = _sums(_column(t, "a", np.uint64), _column(t, "b", np.int64))
        _store(uri).write(f"c{t.column('r')[0].as_py()}", [word, n])
        return pa.table({"n": pa.array([[*_of_counts(n), len(n)]], pa.list_(pa.int64()))})

    return _of_ranges(merged.where("kind = 'before'").repartitionById(n_ranges, "r").groupBy("r").applyInArrow(merge_before, "n array<long>"), words)


def _spare(d: tuple[float, float, float], of_words: list[int], words: int, kinds: int) -> float:
    return (d[0] * of_words[0] + d[1] * of_words[1] + d[2] * max(0, words - of_words[0] - of_words[1])) / max(1, kinds)


def _numbers(merged: DataFrame, kind: str, n: int) -> np.ndarray:
    """The sum of a few numbers a range."""
    out = np.zeros(n, np.int64)
    for r in merged.where(F.col("kind") == kind).select("a").toLocalIterator():
        out += np.frombuffer(r["a"], np.int64)
    return out


def _kinds(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of three columns of numbers under size, in order, and how often each stands."""
    bits = np.int64(max(1, size - 1).bit_length())
    if 3 * bits < 64:
        key = np.sort((columns[0] << 2 * bits) | (columns[1] << bits) | columns[2])
        at, mask = _starts(key), (np.int64(1) << bits) - 1
        return [key[at] >> 2 * bits, key[at] >> bits & mask, key[at] & mask], np.diff([*at, len(key)])
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    at = _starts(*columns)
    return [c[at] for c in columns], np.diff([*at, len(order)])


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of 64-bit keys, and the keys in it: their upper bits are sorted with places below, which is right but where keys differ further down alone."""
    below = (np.uint64(1) << np.uint64(len(key).bit_length())) - np.uint64(1)
    order = (np.sort((key & ~below) | np.arange(len(key), dtype=np.uint64)) & below).astype(np.int64)
    ordered = key[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    return order, ordered


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys, and where each different key begins in it."""
    order, key = _ordered(key)
    return order, _starts(key)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and which of them each key is."""
    order, key = _ordered(key)
    at, back = _starts(key), np.empty(len(key), np.int64)
    back[order] = np.repeat(np.arange(len(at)), np.diff([*at, len(key)]))
    return key[at], back


def _train_triples(base: DataFrame, model: Model, singles: bool, named: np.ndarray) -> Model:
    """Order 3 on top of the words: raw counts of trigrams, kinds of words before a bigram (raw counts after a begin), kinds of words before a word.

    A trigram is dealt out by its middle word, by its first two if the middle one is hot, by all three if both are. So its context and, unless the
    middle word is hot, the bigram it ends in are whole where it is merged. Of bigrams that begin with a hot word and of contexts of two hot words
    parts are merged in a range of their own. A begin is hot; before it stands another one. ``named`` are the words with names, the most frequent first.
    """
    named = base.sparkSession.sparkContext.broadcast(named)
    uri, hot, shift, n_ranges = model.uri, model.hot, np.uint64(64 - model.bits), 1 << model.bits
    begin = BEGIN & UPPER

    def count(batches, part):
        names = Names.of(named.value)
        for block in _blocks(batches):
            words, at = _distinct(block & UPPER)
            first = int(np.searchsorted(words, begin))
            w, v = at[1:], at[:-1]
            u = np.where(v == first, first, np.concatenate([v[:1], v[:-1]]))
            (v, u, w), n = _kinds([x[w != first] for x in (v, u, w)], len(words))
            r = _range_of_three(*(words[x] for x in (u, v, w)), *(_in(words, hot)[x] for x in (u, v)), shift)
            mine = np.flatnonzero(r % np.uint64(ROUNDS) == part)
            order = mine[_order_of(r[mine])]
            v, u, w = v[order], u[order], w[order]
            short = names.named(words)
            yield _sent(r[order] // np.uint64(ROUNDS), [words[v], short[u], short[w], n[order].astype(np.uint32)], "triple", tuple((words[x], short[x] == SHORT) for x in (u, w)))

    def numbers(kind: str, x: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([0], pa.int32()), pa.array([np.array(x, np.int64).tobytes()], pa.binary())], ["kind", "r", "a"])

    def of_pairs(own: str, v: np.ndarray, w: np.ndarray, spread: np.ndarray, kinds: np.ndarray) -> tuple[list[pa.RecordBatch], list[np.ndarray]]:
        """Writes whole bigrams, and tells what they mean for the second words and, by kinds, for the first ones."""
        _store(uri).write_all(own, Index.of_spread(spread, [kinds]))
        order, at = _groups(w)
        word, before = w[order][at], np.diff([*at, len(w)][: len(at) + 1])
        out = [numbers("pairs", [*_of_counts(kinds), len(kinds)]), _sent(word >> shift, [word, before.astype(np.uint32)], "before")]
        order, at = _groups(v)
        kinds = kinds[order]
        return out, [v[order][at], np.add.reduceat(kinds, at) if len(at) else kinds, *_by_kind(at, kinds)]

    def merge(t: pa.Table, part: int) -> pa.Table:
        own, names, rows = t.column("r")[0].as_py() * ROUNDS + part, Names.of(named.value), [_unpressed(x) for x in t.column("a").to_pylist()]
        v = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in rows])
        u, w = (np.concatenate([names.back(x[k], x[k + 3]) for x in rows]) for k in (1, 2))
        n = np.concatenate([x[3] for x in rows]).astype(np.int64)
        del rows
        spread = mix(u, mix(v, w)) * _SALT
        order, at = _groups(spread)
        n, order = np.add.reduceat(n[order], at), order[at]
        u, v, w, spread = u[order], v[order], w[order], spread[order]
        real, wide = v != begin, _in(v, hot)
        stored_ones = real & (n > (0 if singles else 1))
        _store(uri).write_all(f"t{own}", Index.of_spread(spread[stored_ones], [n[stored_ones]]))
        out = [numbers("triples", _of_counts(n[real]))]

        key = mix(v, w)
        order, at = _groups(key * _SALT)
        kinds = np.where(v[order[at]] == begin, np.add.reduceat(n[order], at), np.diff([*at, len(order)]))
        order = order[at]
        whole = ~wide[order]
        ones = order[whole]
        more, one = of_pairs(f"p{own}", v[ones], w[ones], key[ones] * _SALT, kinds[whole])
        _store(uri).write_all(f"g{own}", Index.arrays(one[0], one[1:]))
        part, kinds = order[~whole], kinds[~whole]
        order = np.argsort(w[part])
        order = order[_order_of(key[part[order]] >> shift)]
        part, kinds = part[order], kinds[order]
        out += [*more, _sent(key[part] >> shift, [w[part], np.searchsorted(hot, v[part]).astype(np.uint32), kinds.astype(np.uint32)], "part")]

        u, v, n = u[real], v[real], n[real]
        key = mix(u, v)
        order, at = _groups(key * _SALT)
        of_context = [np.add.reduceat(n[order], at) if len(at) else n, *_by_kind(at, n[order])]
        order = order[at]
        part = wide[real][order] & _in(u[order], hot)
        _store(uri).write_all(f"x{own}", Index.of_spread(key[order[~part]] * _SALT, [x[~part] for x in of_context]))
        key, of_context = key[order[part]], [x[part] for x in of_context]
        order = np.argsort(key)
        out.append(_sent(key[order] >> shift, [key[order], *(x[order].astype(np.uint64) for x in of_context)], "two"))
        return pa.Table.from_batches(out)

    def merge_parts(t: pa.Table) -> pa.Table:
        own = t.column("r")[0].as_py()
        w, v, kinds = _received(t, "part", [np.uint64, np.int64, np.int64])
        v = hot[v]
        spread = mix(v, w) * _SALT
        order, at = _groups(spread)
        kinds = np.add.reduceat(kinds[order], at) if len(at) else kinds
        order = order[at]
        out, one = of_pairs(f"w{own}", v[order], w[order], spread[order], kinds)
        out.append(_sent(one[0] >> shift, [one[0], *(x.astype(np.uint64) for x in one[1:])], "one"))
        key, *of_context = _received(t, "two", [np.uint64, *[np.int64] * 4])
        if len(key):
            _store(uri).write_all(f"y{own}", Index.arrays(*_all_sums(key, of_context)))
        return pa.Table.from_batches(out)

    def merge_words(t: pa.Table) -> pa.Table:
        own = t.column("r")[0].as_py()
        word, n = _sums(*_received(t, "before", [np.uint64, np.int64]))
        _store(uri).write(f"c{own}", [word[n > 1], n[n > 1]])
        key, *of_one = _received(t, "one", [np.uint64, *[np.int64] * 4])
        if len(key):
            _store(uri).write_all(f"z{own}", Index.arrays(*_all_sums(key, of_one)))
        return pa.table({"n": pa.array([[*_of_counts(n), len(n)]], pa.list_(pa.int64()))})

    groups = lambda df: df.repartitionById(n_ranges, "r").groupBy("r")
    of_part = lambda k: lambda t: merge(t, k)
    for k in range(ROUNDS):
        of_round = base.mapInArrow(partial(count, part=k), _SENT).repartitionById(n_ranges // ROUNDS, "r").groupBy("r")
        merged = stored(of_round.applyInArrow(of_part(k), _SENT), f"{uri}/merged/{k}")
    merged = base.sparkSession.read.schema(merged.schema).parquet(*(f"{uri}/merged/{k}" for k in range(ROUNDS)))
    parts = stored(groups(merged.where("kind IN ('part', 'two')")).applyInArrow(merge_parts, _SENT), f"{uri}/parts")
    both = merged.unionByName(parts)
    stat = _numbers(both, "pairs", 5)
    of_words = _of_ranges(groups(both.where("kind IN ('before', 'one')")).applyInArrow(merge_words, "n array<long>"), model.words)
    d_word, d_pair, d_triple = _discounts(of_words), _discounts(stat[:4].tolist()), _discounts(_numbers(merged, "triples", 4).tolist())
    if not singles:
        d_triple = 1.0, *d_triple[1:]
    store = _store(uri)
    for name in ("merged", "parts"):  # all of it is in the arrays now
        store.fs.delete_dir(f"{store.root}/{name}")
    kinds = int(stat[4])
    return replace(model, kinds=kinds, discounts=d_word, spare=_spare(d_word, of_words, model.words, kinds), of_pairs=d_pair, of_triples=d_triple)


def _all_sums(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order, at = _groups(key)
    return key[order][at], [np.add.reduceat(x[order], at) if len(at) else x for x in values]


def _range_of_three(u: np.ndarray, v: np.ndarray, w: np.ndarray, hot_u: np.ndarray, hot_v: np.ndarray, shift: np.uint64) -> np.ndarray:
    """The range of each trigram."""
    r = v >> shift
    one, both = hot_v & ~hot_u, hot_v & hot_u
    r[one] = mix(u[one], v[one]) >> shift
    r[both] = mix(u[both], mix(v[both], w[both])) >> shift
    return r


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", singles: bool = True, order: int = 3) -> Model:
    """A model of all given documents, null texts read as empty, repeated rows counted as often as they stand.

    With ``singles`` n-grams of the highest order that were seen once have their own probability; else they count towards all
    statistics and score like unseen ones. ``order`` is 2 or 3.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    base = texts(docs, id_col, text_col).select("text")
    size = base.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    n_docs = size["n"]
    bits = _ranges((size["chars"] or 0) + DOC_CHARS * n_docs)
    shift, n_ranges = np.uint64(64 - bits), 1 << bits
    shares = max(LEAST_HOT, HOT * n_ranges)
    uri = f"{shared_dir(spark).rstrip('/')}/lm-{uuid.uuid4().hex}"
    store = Store(uri)
    store.fs.create_dir(store.root)

    def count_words(batches):
        for block in _blocks(batches):
            key, n = np.unique(block[block != BEGIN], return_counts=True)
            yield _dealt(key >> shift, [key, n.astype(np.uint32)], sort=False)

    def merge_words(t: pa.Table) -> pa.Table:
        key, n = _sums(_column(t, "a", np.uint64), _column(t, "b", np.uint32).astype(np.int64))
        _store(uri).write(f"u{t.column('r')[0].as_py()}", [key, n])
        hot = n > n.sum() / shares
        top = np.argsort(n, kind="stable")[-max(1, SHORT // n_ranges) :]
        return pa.table({"top": pa.array([key[top].view(np.int64).tolist()], pa.list_(pa.int64())), "top_n": pa.array([n[top].tolist()], pa.list_(pa.int64())), "words": [len(key)], "tokens": [int(n.sum())], "hot": pa.array([key[hot].view(np.int64).tolist()], pa.list_(pa.int64())), "n": pa.array([n[hot].tolist()], pa.list_(pa.int64()))})

    with shuffles_dropped(spark):
        found = stored(base.mapInArrow(count_words, _DEALT).repartitionById(n_ranges, "r").groupBy("r").applyInArrow(merge_words, "top array<long>, top_n array<long>, words long, tokens long, hot array<long>, n array<long>"))
    total = found.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first()
    words, tokens = total["words"] or 0, total["tokens"] or 0
    hot_rows = found.select(F.explode(F.arrays_zip("hot", "n")).alias("x")).where(F.col("x.n") > tokens / shares).select("x.hot").collect()  # fewer than shares, as counts add up to all tokens
    hot = np.sort(np.array([r["hot"] for r in hot_rows], np.int64).view(np.uint64))

    if order == 3:
        top = found.select(F.explode(F.arrays_zip("top", "top_n")).alias("x")).select("x.*").collect()  # as many words of each range, SHORT and one a range at most
        word, n = (np.array([r[k] for r in top], np.int64) for k in ("top", "top_n"))
        word, first = np.unique(word.view(np.uint64) & UPPER, return_index=True)
        named = word[np.argsort(-n[first], kind="stable")][:SHORT]
        hot = np.unique(np.append(hot & UPPER, BEGIN & UPPER))
        with shuffles_dropped(spark):
            return _train_triples(base, Model(uri, bits, tokens, words, 0, (), 0.0, (), n_docs, hot), singles, named)

    def count_pairs(batches):
        for block in _blocks(batches):
            w = block[1:]
            ok = w != BEGIN
            h, w = block[:-1][ok], w[ok]
            order = np.lexsort((h, w))
            h, w = h[order] >> np.uint64(16), w[order]
            at = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])]))
            n = np.diff([*at, len(w)]).astype(np.uint32)
            h, w = h[at], w[at]
            r = _range(h << np.uint64(16), w, hot, shift)
            order = np.argsort(r, kind="stable")
            r, h, w, n = r[order], h[order], w[order], n[order]
            first = np.concatenate([[True], r[1:] != r[:-1]])
            delta = np.where(first, w, w - np.concatenate([[np.uint64(0)], w[:-1]]))  # words stand in order: mostly zeros, which shuffles press
            yield _dealt(r, [delta, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint16), n], sort=False)

    def merge_pairs(t: pa.Table) -> pa.Table:
        w = np.concatenate([np.cumsum(np.frombuffer(x, np.uint64), dtype=np.uint64) for x in t.column("a").to_pylist()])
        h = _column(t, "b", np.uint32).astype(np.uint64) | (_column(t, "c", np.uint16).astype(np.uint64) << np.uint64(32))
        n = _column(t, "d", np.uint32).astype(np.int64)
        order = np.lexsort((h, w))
        h, w, n = h[order], w[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])]))
        h, w, n = h[at], w[at], np.add.reduceat(n, at)
        stats = _dealt(np.zeros(1, np.uint64), [np.array([*_of_counts(n), len(n)], np.int64)[None, :]], "stat")
        start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        word, before = w[start], np.diff([*start, len(w)])
        more = (before > 1) | _in(word, hot)
        pair = mix(h << np.uint64(16), w)
        stored = np.flatnonzero(n > (0 if singles else 1))
        stored = stored[np.argsort(pair[stored])]
        _store(uri).write(f"b{t.column('r')[0].as_py()}", [pair[stored], n[stored].astype(np.uint32)])
        order = np.argsort(h, kind="stable")
        context, kind = h[order], np.minimum(n[order], 3)
        at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        context, of_kind = context[at], np.stack([np.add.reduceat((kind == c).astype(np.int64), at) for c in (1, 2, 3)])
        times, once, packed = _packed(of_kind)
        context = np.repeat(context, times)
        dealt = _dealt((context << np.uint64(16)) >> shift, [*_six(context), once, packed], "context", sort=False)
        out = [stats, _dealt(word[more] >> shift, [word[more], before[more].astype(np.int64)], "before"), dealt]
        return pa.Table.from_batches(out)

    merged = cut(base.mapInArrow(count_pairs, _DEALT).repartitionById(n_ranges, "r").groupBy("r").applyInArrow(merge_pairs, _DEALT))
    stat = np.zeros(5, np.int64)
    for r in merged.where("kind = 'stat'").select("a").toLocalIterator():  # five numbers a range
        stat += np.frombuffer(r["a"], np.int64)

    of_words = _before(merged, uri, n_ranges, words)
    d_pair, d_word = _discounts(stat[:4].tolist()), _discounts(of_words)
    kinds = int(stat[4])
    spare = _spare(d_word, of_words, words, kinds)

    if not singles:
        d_pair = 1.0, *d_pair[1:]

    def merge_contexts(t: pa.Table) -> pa.Table:
        r, own = t.column("r")[0].as_py(), _store(uri)
        h = _column(t, "a", np.uint32).astype(np.uint64) | (_column(t, "b", np.uint16).astype(np.uint64) << np.uint64(32))
        once, packed = _column(t, "c", np.uint8), _column(t, "d", np.uint16)
        context, taken = _sums(h, once * d_pair[0] + (packed >> np.uint16(8)) * d_pair[1] + (packed & np.uint16(255)) * d_pair[2])
        key, count = own.read(f"u{r}", _U)
        at = np.minimum(np.searchsorted(key >> np.uint64(16), context), max(0, len(key) - 1))
        of = np.where(context == np.uint64(int(BEGIN) >> 16), n_docs, count[at] if len(key) else 1)
        own.write(f"g{r}", [context, (taken / of).astype(np.float32)])
        return pa.table({"n": [len(context)]})

    merged.where("kind = 'context'").repartitionById(n_ranges, "r").groupBy("r").applyInArrow(merge_contexts, "n long").agg(F.sum("n")).first()
    return Model(uri, bits, tokens, words, kinds, d_word, spare, d_pair, n_docs, hot)


class Scorer:
    """Looks up a model's mapped arrays."""

    def __init__(self, model: Model):
        self.model, self.store, self.shift = model, Store(model.uri), np.uint64(64 - model.bits)

    def _find(self, prefix: str, dtypes: list[type], ranges: np.ndarray, keys: np.ndarray, default: float, shifted: bool = False) -> np.ndarray:
        """Values of keys that stand in order of their ranges."""
        out = np.full(len(keys), default)
        at = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(ranges) else []
        for s, e in zip(at, [*at[1:], len(ranges)], strict=True):
            known, value = self.store.read(f"{prefix}{int(ranges[s])}", dtypes)
            if len(known):
                i = np.minimum(np.searchsorted(known, keys[s:e]), len(known) - 1)
                hit = known[i] == keys[s:e]
                out[s:e][hit] = value[i[hit]]
        return out

    def _look(self, prefix: str, ranges: np.ndarray, keys: np.ndarray, out: list[np.ndarray], to: np.ndarray) -> None:
        """Puts the values of keys in any order, as many as are stored with a key, into as many arrays at the given places, where there are any."""
        order = _order_of(ranges)
        ranges, keys, to = ranges[order], keys[order], to[order]
        at = _starts(ranges)
        for s, e in zip(at, [*at[1:], len(ranges)][: len(at)], strict=True):
            arrays = self.store.read_all(f"{prefix}{int(ranges[s])}")
            if arrays:
                index = Index(arrays)
                hit, i = index.find(keys[s:e])
                for o, value in zip(out, index.values(i), strict=True):
                    o[to[s:e][hit]] = value

    def _of_three(self, words: np.ndarray, back: np.ndarray, starts: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The probability of each token by the two before it, from those of words alone; tokens are places of words."""
        m, begin = self.model, len(words)
        words = np.append(words, BEGIN) & UPPER
        hot = _in(words, m.hot)
        total, left = np.ones(len(words)), np.ones(len(words))
        of = [np.zeros(len(words)) for _ in range(4)]
        for prefix, own in (("g", ~hot), ("z", hot)):
            at = np.flatnonzero(own)
            self._look(prefix, words[at] >> self.shift, words[at], of, at)
        known = of[0] > 0
        total[known] = of[0][known]
        left[known] = (sum(k * d for k, d in zip(of[1:], m.of_pairs, strict=True)) / total)[known]

        before = np.concatenate([[begin], back[:-1]])
        before[starts] = begin
        v, w, hot_v = words[before], words[back], hot[before]
        pair, kinds = mix(v, w), np.zeros(len(w))
        for prefix, at in (("p", np.flatnonzero(~hot_v)), ("w", np.flatnonzero(hot_v))):
            self._look(prefix, (v if prefix == "p" else pair)[at] >> self.shift, pair[at], [kinds], at)
        p = np.maximum(kinds - _less(kinds.astype(np.int64), m.of_pairs), 0) / total[before] + left[before] * low

        inner = np.ones(len(w), bool)
        inner[starts] = False
        i = np.flatnonzero(inner)
        u, v, w, hot_u, hot_v, context, low = v[i - 1], v[i], w[i], hot_v[i - 1], hot_v[i], pair[i - 1], p[i]
        key, n, of = mix(u, pair[i]), np.zeros(len(i)), [np.zeros(len(i)) for _ in range(4)]
        ranges, both = np.where(hot_v, context, v) >> self.shift, hot_u & hot_v
        for prefix, at in (("x", np.flatnonzero(~both)), ("y", np.flatnonzero(both))):
            self._look(prefix, ranges[at], context[at], of, at)
        seen = np.flatnonzero(of[0])  # no trigram of another context is there
        ranges[both] = key[both] >> self.shift
        self._look("t", ranges[seen], key[seen], [n], seen)
        left = sum(k[seen] * d for k, d in zip(of[1:], m.of_triples, strict=True))
        p[i[seen]] = (np.maximum(n[seen] - _less(n[seen].astype(np.int64), m.of_triples), 0) + left * low[seen]) / of[0][seen]
        return p

    def score(self, block: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of each document of a block of token hashes; a document's tokens start at starts."""
        m = self.model
        words, back = _distinct(block)
        count = self._find("u", _U, words >> self.shift, words, 0.0)
        before = self._find("c", _C, words >> self.shift, words if m.order == 2 else words & UPPER, 1.0)
        before[count == 0] = 0
        base = np.log10((count + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
        low = np.maximum(before - _less(before.astype(np.int64), m.discounts), 0) / max(1, m.kinds) + (m.spare if m.kinds else 1.0) / (m.words + 1)
        total = lambda x: np.add.reduceat(x, starts)
        known, based = total((count > 0)[back].astype(np.int64)), total(base[back])
        if m.order == 3:
            return known, based, total(np.log10(self._of_three(words, back, starts, low[back])))
        h = np.concatenate([[BEGIN], block[:-1]])
        h[starts] = BEGIN
        contexts, back_h = np.unique(h, return_inverse=True)
        left = self._find("g", _G, contexts >> self.shift, contexts >> np.uint64(16), 1.0)[back_h]
        of = self._find("u", _U, contexts >> self.shift, contexts, 1.0)
        of[contexts == BEGIN] = max(1, m.n_docs)
        ranges = _range(h, block, m.hot, self.shift)
        order = np.argsort(ranges, kind="stable")
        n = np.empty(len(block))
        n[order] = self._find("b", _B, ranges[order], mix(h, block)[order], 0.0)
        value = (n - _less(n.astype(np.int64), m.of_pairs)) / of[back_h]
        return known, based, total(np.log10(value + left * low[back]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score, score (log10 of the text's probability), perplexity. One row out for each row in.

    A null or empty text is its end alone. Repeated rows score alike; an empty table stays empty. An untrained model (no
    documents) spreads its probability evenly over the one unknown word. Columns besides id and text are not read.
    """
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)

        def done(ids: list[pa.Array], held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            block, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            known, base, p = scorer.score(block, np.cumsum(sizes) - sizes)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *map(pa.array, (sizes.astype(np.int64), known, base, p, 10 ** np.minimum(-p / sizes, 300)))], names)

        ids, held, size = [], [], 0
        for batch in batches:
            at = 0
            for h, sizes in hashes(batch.column("text")):
                ids.append(batch.column("doc_id").slice(at, len(sizes)))
                held.append((h, sizes))
                at, size = at + len(sizes), size + len(h)
                if size >= BLOCK:
                    yield done(ids, held)
                    ids, held, size = [], [], 0
        if held:
            yield done(ids, held)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(doc_id as text) mod 10 is not 0, and scores all, by the whole model: order 3, with every n-gram."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 10) == 0
    model = train(docs.where(~held_out))
    return score(docs, model).withColumn("held_out", held_out).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
