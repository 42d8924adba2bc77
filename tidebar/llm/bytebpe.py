"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is a product of its parts: each part is encoded alone, and two neighbours are joined by encoding anew only what the
place between them can change. Halves are encoded recursively down to leaves; long documents are cut into fragments that
are encoded in tasks of their own and joined up the same tree. Two proofs tell where a join may stop:

* Pattern matches. A match depends only on the text from its start to one character behind its end (a contraction: to its
  third character). So matches that end three characters before the end of the left part stand. From the first other one
  matching goes on into the right part, through a window that grows, until a match ends where one of the right part's own
  matches ends: from there both go on alike.
* Tokens of one long match. A sequence of tokens is the encoding of its bytes exactly if every two neighbours among them are
  what their own bytes encode to. So tokens outside a window stand as soon as the new tokens agree with both neighbours; until
  then the window grows.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, kept, table, texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters of a leaf, bytes of a leaf inside one match, and characters of a fragment that a task encodes.
LEAF, PIECE_LEAF, FRAGMENT = 2048, 1024, 1 << 16
#: Different matches that a task's memo holds, and the longest match that goes into it.
MEMO_WORDS, MEMO_CHARS = 250_000, 64
#: Matches whose end lies so close to the end of a text may change when it goes on.
_MARGIN = 3


@dataclass(frozen=True)
class Node:
    """A text encoded alone: the ends of its matches in characters, how many tokens there are up to each, and the tokens."""

    text: str
    ends: np.ndarray
    upto: np.ndarray
    ids: np.ndarray


class Coder:
    """Encodes and decodes by a file of ranks; ``pattern`` must match all of any text and look behind nothing."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF, piece_leaf: int = PIECE_LEAF):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pattern = regex.compile(pattern)
        self.leaf, self.piece_leaf = leaf, piece_leaf
        self.memo: dict[str, list[int]] = {}

    def _agree(self, a: int, b: int) -> bool:
        return self.core(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two neighbouring parts of one match as those of the whole."""
        k = 1
        while True:
            head, tail = left[: max(0, len(left) - k)], right[k:]
            middle = self.core(b"".join([self.bytes_of[i] for i in left[len(head) :] + right[:k]]))
            if not middle or ((not head or self._agree(head[-1], middle[0])) and (not tail or self._agree(middle[-1], tail[0]))):
                return head + middle + tail
            k *= 2

    def piece(self, raw: bytes) -> list[int]:
        """Tokens of one match: halves recursively, then joined."""
        if len(raw) <= self.piece_leaf:
            return self.core(raw)
        half = len(raw) // 2
        return self.join_tokens(self.piece(raw[:half]), self.piece(raw[half:]))

    def pieces(self, matches: list[str]) -> list[list[int]]:
        new = set(matches).difference(self.memo)
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = set(matches)
        far = {}
        for m in new:
            (self.memo if len(m) <= MEMO_CHARS else far)[m] = self.piece(m.encode())
        return [self.memo[m] if m in self.memo else far[m] for m in matches] if far else list(map(self.memo.__getitem__, matches))

    def node(self, text: str) -> Node:
        """A text encoded: leaves at once, longer ones by halves."""
        if len(text) > self.leaf:
            half = len(text) // 2
            return self.join(self.node(text[:half]), self.node(text[half:]))
        matches = self.pattern.findall(text)
        own = self.pieces(matches)
        n = len(matches)
        return Node(text, np.fromiter(accumulate(map(len, matches)), np.int64, n), np.fromiter(accumulate(map(len, own)), np.int64, n), np.fromiter(chain.from_iterable(own), np.uint32))

    def join(self, a: Node, b: Node) -> Node:
        """The node of both texts in a row."""
        if not a.text or not b.text:
            return a if a.text else b
        kept_ = int(np.searchsorted(a.ends, len(a.text) - _MARGIN, "right"))
        start, before = (int(a.ends[kept_ - 1]), int(a.upto[kept_ - 1])) if kept_ else (0, 0)
        gap = len(a.text) - start
        width, skip, ends = 64, -1, []
        while skip < 0:
            window, ends = a.text[start:] + b.text[:width], []
            for m in self.pattern.finditer(window):
                if width < len(b.text) and m.end() > len(window) - _MARGIN:
                    break
                ends.append(m.end())
                at = m.end() - gap
                own_end = int(np.searchsorted(b.ends, at)) if at > 0 else -1
                if at == 0 or (at > 0 and b.ends[own_end] == at):  # the window's last match ends where the right part does, at the latest
                    skip = own_end + 1
                    break
            width *= 2
        used = int(b.upto[skip - 1]) if skip else 0
        if len(ends) == 1 and len(a.ends) - kept_ == 1 and skip == 1:  # one match of either side is one match now
            own = [self.join_tokens(a.ids[before:].tolist(), b.ids[:used].tolist())]
        else:
            own = self.pieces([window[s:e] for s, e in zip([0, *ends], ends, strict=False)])
        made = np.array(list(accumulate(map(len, own))), np.int64) + before
        shift = int(made[-1]) - used
        return Node(
            a.text + b.text,
            np.concatenate([a.ends[:kept_], np.array(ends, np.int64) + start, b.ends[skip:] + len(a.text)]),
            np.concatenate([a.upto[:kept_], made, b.upto[skip:] + shift]),
            np.concatenate([a.ids[:before], np.fromiter(chain.from_iterable(own), np.uint32), b.ids[used:]]),
        )

    def joined(self, nodes: list[Node]) -> Node:
        """Nodes in a row joined in pairs up a tree."""
        while len(nodes) > 1:
            nodes = [self.join(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of tokens; halves are decoded alone and put together."""
        if len(ids) > 4096:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.bytes_of.__getitem__, ids))


_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def _finished(coder: Coder, doc_ids: pa.Array, ids: list[np.ndarray], keep_ids: bool, extra: tuple[pa.Array, ...] = ()) -> pa.RecordBatch:
    raw = [i.astype("<u4").tobytes() for i in ids]
    cols = [doc_ids, pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()), pa.array([hashlib.sha256(coder.decode(i.tolist())).hexdigest() for i in ids], pa.string()), pa.array(raw if keep_ids else [None] * len(raw), pa.binary())]
    return pa.RecordBatch.from_arrays([*cols, *extra], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", *["n"][: len(extra)]])


def encode(docs: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, fragment: int = FRAGMENT) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the ids (little-endian, 32 bits each).

    Null and empty texts have no tokens. One row out for each row in, repeated rows alike, an empty table gives an empty one,
    a null id stays. Columns besides id and text are not read. Texts over ``fragment`` characters are encoded in fragments that
    are dealt out; a document's fragments meet in one task only to be joined, as its ids are one row.
    """
    base = texts(docs, id_col, text_col)
    coder_of = lambda: kept(("byte coder", path), lambda: Coder(path))

    def whole():
        coder = coder_of()
        return lambda batch: _finished(coder, batch.column("doc_id"), [coder.node(t).ids for t in batch.column("text").to_pylist()], keep_ids)

    def cut_up():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc_id, key, n, of, at, text = [], [], [], [], [], []
            for d, t, k in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "n")), strict=True):
                digest, parts = hashlib.md5(t.encode()).digest(), range(0, len(t), fragment)
                doc_id += [d] * len(parts)
                key += [digest] * len(parts)
                n += [k] * len(parts)
                at += parts
                text += [t[i : i + fragment] for i in parts]
            return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(at, pa.int64()), pa.array(text, pa.string())], ["doc_id", "key", "n", "at", "text"])

        return run

    def parts():
        coder = coder_of()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [coder.node(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([getattr(m, c).tobytes() for m in made], pa.binary()) for c in ("ends", "upto", "ids"))], [*batch.schema.names, "ends", "upto", "ids"])

        return run

    def assemble():
        coder = coder_of()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = []
            for of in batch.column("of").to_pylist():
                ids.append(coder.joined([Node(x["text"], np.frombuffer(x["ends"], np.int64), np.frombuffer(x["upto"], np.int64), np.frombuffer(x["ids"], np.uint32)) for x in sorted(of, key=lambda x: x["at"])]).ids)
            return _finished(coder, batch.column("doc_id"), ids, keep_ids, (batch.column("n"),))

        return run

    size = F.length("text")
    short = arrow_map(base.where(size <= fragment), whole, _SCHEMA)
    alike = base.where(size > fragment).groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    fragments = arrow_map(alike, cut_up, "doc_id long, key binary, n long, at long, text string", rows=8).repartition("doc_id", "key", "at")
    nodes = arrow_map(fragments, parts, "doc_id long, key binary, n long, at long, text string, ends binary, upto binary, ids binary", rows=8)
    met = nodes.groupBy("doc_id", "key", "n").agg(F.collect_list(F.struct("at", "text", "ends", "upto", "ids")).alias("of")).select("doc_id", "n", "of")
    long = arrow_map(met, assemble, f"{_SCHEMA}, n long", rows=1)
    return short.union(long.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n", "_k"))


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id and the decoded ``bytes`` of each row of ``encode(keep_ids=True)``; a row without ids has none."""

    def make():
        coder = kept(("byte coder", path), lambda: Coder(path))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [coder.decode(np.frombuffer(i or b"", "<u4").tolist()) for i in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

        return run

    return arrow_map(encoded.select("doc_id", "ids"), make, "doc_id long, bytes binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
