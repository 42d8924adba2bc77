"""BPE encoding and decoding with content-defined chunk reuse across documents.

A rolling hash over the characters cuts each text into chunks; equal passages give equal chunks wherever they stand. Spark
counts chunk hashes over all documents; a chunk that several documents have is encoded once, and its ids are joined to
every place where it stands. A chunk's ids hold inside it, but not where two chunks meet: a join is repaired by encoding
the text around it anew, wider and wider, until the new ids agree exactly with those of both chunks at an edge. So of an
encoded stretch only the ids between its outermost edges and the few characters outside them are needed further on: these move,
and no document's text does.

Which chunks may be shared is told to the scan by a bitmap of 16 bits for each shared chunk, 32 MB at most, in which each sets
four. Where all four of another chunk are set (one in 400), it is only treated as shared without need.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, kept, stored, table, texts

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Characters that the rolling hash sees, and the mean, least and most length of a chunk.
WINDOW, MEAN, LEAST, MOST = 16, 1024, 256, 8192
#: Least and most bits of the shared-chunk bitmap, words that a task's memo holds, and chunks that a task knows it has sent.
BITMAP_BITS, MEMO_WORDS, SENT = (1 << 20, 1 << 28), 250_000, 250_000
#: A chunk with over one in HOT of all places, and LEAST_HOT places at least, is hot: there are fewer than HOT such chunks.
HOT, LEAST_HOT = 1000, 10_000
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)
#: Words that normalising leaves alone but for lower case: Latin letters without marks to compose.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch

# Places where no token and no normalising reaches across. Blanks and line ends; each digit is a unit; letters and
# marks are units apart, but for apostrophes (contractions) and the marks that added tokens are made of.
_MARKS = r"""!"#$%&()*+,\-./:;=?@\[\]\\^_`{}~"""
_PLACES = rf"(?=[ \n])|(?<=[ \n])|(?<=[A-Za-z0-9{_MARKS}])(?=[0-9])|(?<=[0-9])(?=[A-Za-z{_MARKS}])|(?<=[{_MARKS}])(?=[A-Za-z])|(?<=[A-Za-z])(?=[{_MARKS}])|(?<=[\u4e00-\u9fff])(?=[，。、！？；：])|(?<=[，。、！？；：])(?=[\u4e00-\u9fff])"
_EDGE, _EDGE_BACK = regex.compile(_PLACES), regex.compile(_PLACES, regex.REVERSE)


def chunk_ends(text: str) -> list[int]:
    """Ends of a text's chunks. An end depends on the characters just before it and the end before, never on the place in the text."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16) if text.isascii() or max(text) <= "￿" else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) & 0xFFFF
    gear = _GEAR[codes]
    rolled = gear.copy()
    width = 1
    while width < WINDOW:  # sum of the last WINDOW values, each shifted by its distance, in log2(WINDOW) steps
        rolled[width:] += rolled[:-width] << np.uint32(width)
        width *= 2
    marks = np.flatnonzero(rolled < np.uint32((1 << 32) // (MEAN - LEAST))) + 1
    ends, at = [], 0
    for m in marks.tolist():
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST:
            ends.append(m)
            at = m
    while n - at > MOST:
        at += MOST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def _digest(chunk: str) -> bytes:
    return xxhash.xxh3_128_digest(chunk.encode("utf-8", "surrogatepass"))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Encoder:
    """Encodes by words, with a bounded memo. Blanks and line ends stand in no token and join with nothing, so words are exact units.

    Words of Latin letters alone need no normalising but lower case, and one following full stop or comma is a unit of its
    own: these go to the merges directly. All other words take the library's whole way.
    """

    def __init__(self, path: str, memo: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.memo: dict[str, tuple[int, ...]] = {}
        self.most = memo
        self.chars = 0
        self.marks = {m: tuple(self.tokenizer.encode(m, add_special_tokens=False).ids) for m in ".,"}
        self.dtype = np.uint16 if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) <= 0xFFFF else np.uint32

    def _learn(self, words: set[str]) -> None:
        memo, rest = self.memo, []
        for w in words:
            mark = w[-1:] if w[-1:] in self.marks else ""
            bare = w[: len(w) - len(mark)]
            if not _PLAIN(bare):
                rest.append(w)
                continue
            low = bare.lower()
            ids = memo.get(low)
            if ids is None:
                ids = tuple([t.id for t in self.merges(low if low.isascii() else "".join([self.letters[b] for b in low.encode()]))])
            memo[w] = ids + self.marks[mark] if mark else ids
        memo.update((w, tuple(e.ids)) for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        self.chars += sum(map(len, words))

    def ids(self, text: str) -> list[int]:
        """The ids of a text, as the library gives for it."""
        words = text.replace("\n", " ").split(" ")
        new = set(words).difference(self.memo)
        if new:
            if len(self.memo) + len(new) > self.most or self.chars > 64 * self.most:
                self.memo.clear()
                self.chars = 0
                new = set(words)
            self._learn(new)
        return list(chain.from_iterable(map(self.memo.__getitem__, words)))


def _first_edge(text: str, encoder: Encoder, ids: list[int]) -> tuple[int, int] | None:
    """The first edge of a text at which its ids agree with those of its head alone, and how many these are; None without one."""
    m = _EDGE.search(text)
    while m:
        head = encoder.ids(text[: m.start()])
        if ids[: len(head)] == head:
            return m.start(), len(head)
        m = _EDGE.search(text, 2 * m.start() + 1)
    return None


def _last_edge(text: str, encoder: Encoder, ids: list[int]) -> tuple[int, int] | None:
    """The last edge at which the ids agree with those of the tail alone, and how many ids stand before it."""
    m = _EDGE_BACK.search(text)
    while m:
        tail = encoder.ids(text[m.start() :])
        if ids[len(ids) - len(tail) :] == tail:
            return m.start(), len(ids) - len(tail)
        m = _EDGE_BACK.search(text, 0, max(0, len(text) - 2 * (len(text) - m.start())))
    return None


class Piece(NamedTuple):
    """An encoded stretch of text: the ids between its first edge and its last, and what stands outside; without an edge all of it is head, and there are no ids."""

    head: str
    ids: bytes | None
    tail: str


def piece(encoder: Encoder, text: str, ids: list[int]) -> Piece:
    first = _first_edge(text, encoder, ids)
    last = _last_edge(text, encoder, ids) if first else None
    if first is None or last is None or last[0] < first[0]:
        return Piece(text, None, "")
    return Piece(text[: first[0]], np.array(ids[first[1] : last[1]], encoder.dtype).tobytes(), text[last[0] :])


def join_pieces(encoder: Encoder, pieces: list[Piece]) -> list[int]:
    """The ids of all pieces in a row.

    A piece's ids hold from its first edge to its last. What lies between the last edge of one piece and the first of the next
    is encoded anew, once; at both edges the new ids must agree with the given ones, or the stretch grows to farther edges. A
    piece without an edge belongs to such a stretch as a whole, so the work is linear even in texts that are one long word.
    """
    settled: list[int] = []
    open_: list[str] = []
    for head, ids, tail in pieces:
        open_.append(head)
        if ids is not None:
            settled += encoder.ids("".join(open_))
            settled += np.frombuffer(ids, encoder.dtype).tolist()
            open_ = [tail]
    return settled + encoder.ids("".join(open_))


def join_all(encoder: Encoder, parts: list[tuple[str, list[int]]]) -> list[int]:
    """The ids of all parts in a row, each text of a part with its own ids."""
    return join_pieces(encoder, [piece(encoder, *p) for p in parts])


def _picked(of: list[str], ids: list[int]) -> str:
    return " ".join(itemgetter(*ids)(of)) if len(ids) > 1 else of[ids[0]] if ids else ""


class Decoder:
    """Decodes as the library does for a vocabulary without a decoder: tokens joined by one blank; unknown ids are left out."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        if t.decoder is not None:
            raise ValueError("this decoder is for vocabularies whose tokens are joined by blanks")
        size = max(t.get_vocab(with_added_tokens=True).values()) + 1
        self.tokens = [t.id_to_token(i) for i in range(size)]
        self.whole = None not in self.tokens
        self.numbers = list(map(str, range(size)))

    def text(self, ids: list[int]) -> str:
        if not self.whole or (ids and not 0 <= min(ids) <= max(ids) < len(self.tokens)):
            ids = [i for i in ids if 0 <= i < len(self.tokens) and self.tokens[i] is not None]
        return _picked(self.tokens, ids)

    def decimal(self, ids: list[int]) -> str:
        """The ids in decimals, joined by one blank."""
        return _picked(self.numbers, ids)


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits of ``_slots`` for each shared hash: or-ed in Spark into words of 64 bits, at most ``bits`` / 64 rows."""
    slots = F.array(*(F.pmod(F.conv(F.hex(F.substring("h", k, 4)), 16, 10).cast("long"), F.lit(bits)) for k in (1, 5, 9, 13)))
    words = hashes.select(F.explode(slots).alias("at")).select(F.expr("shiftright(at, 6)").alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
    out = np.zeros(bits // 64, np.uint64)
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _slots(digest: bytes, bits: int) -> list[int]:
    return [int.from_bytes(digest[k : k + 4], "big") % bits for k in (0, 4, 8, 12)]


def _marked(digest: bytes, bitmap: np.ndarray) -> bool:
    return all(int(bitmap[s >> 6]) >> (s & 63) & 1 for s in _slots(digest, 64 * len(bitmap)))


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, np.uint32).tobytes() if ids and max(ids) > 0xFFFF else np.array(ids, np.uint16).tobytes()


_PIECE = pa.struct([("at", pa.int32()), ("head", pa.string()), ("ids", pa.binary()), ("tail", pa.string())])


def encode(docs: DataFrame, path: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the ids themselves.

    Null and empty texts have no ids. One row out for each row in; repeated rows give repeated results and an empty table an
    empty one. A row without id is encoded like any other. Columns besides id and text are not read.
    """
    base = texts(docs, id_col, text_col)

    def sketch():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: dict[bytes, int] = {}
            for t in batch.column("text"):
                text, at = t.as_py(), 0
                for d in {_digest(text[at : (at := end)]) for end in chunk_ends(text)}:
                    seen[d] = seen.get(d, 0) + 1
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["h", "n"])

        return run

    shared = cut(arrow_map(base, sketch, "h binary, n long", rows=2048).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    totals = shared.agg(F.count("*").alias("chunks"), F.sum("n").alias("places")).first()
    n_bits = min(BITMAP_BITS[1], max(BITMAP_BITS[0], 1 << (16 * totals["chunks"]).bit_length()))
    bitmap = base.sparkSession.sparkContext.broadcast(_bitmap(shared.select("h"), n_bits))
    share = max(LEAST_HOT, (totals["places"] or 0) / HOT)
    hot = base.sparkSession.createDataFrame(shared.where(F.col("n") > share).select("h", F.ceil(F.col("n") / F.lit(share)).cast("int").alias("k")).collect(), "h binary, k int")  # fewer than HOT rows
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    done_schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"

    def finish(decoder: Decoder, rows: list[tuple[int | None, list[int]]]) -> list[pa.Array]:
        ids = [decoder.decimal(i) for _, i in rows]
        return [pa.array([d for d, _ in rows], pa.int64()), pa.array([len(i) for _, i in rows], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in ids], pa.string()),
                pa.array([hashlib.sha256(decoder.text(i).encode("utf-8", "surrogatepass")).hexdigest() for _, i in rows], pa.string()), pa.array([_pack(i) if keep_ids else None for _, i in rows], pa.binary())]

    def scan():
        encoder, decoder, bits = kept(("encoder", path), lambda: Encoder(path)), kept(("decoder", path), lambda: Decoder(path)), bitmap.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            """Documents without a chunk that may be shared are done here; the others go on as such chunks, and the pieces between them encoded."""
            alone, met = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at, own, refs, chunks, pieces = 0, 0, [], [], []
                for end in chunk_ends(text):
                    d = _digest(text[at:end])
                    if _marked(d, bits):
                        if own < at:
                            pieces.append({"at": own, **piece(encoder, text[own:at], encoder.ids(text[own:at]))._asdict()})
                        refs.append({"h": d, "at": at})
                        chunks.append(text[at:end])
                        own = end
                    at = end
                if not refs:
                    alone.append((doc_id, encoder.ids(text)))
                    continue
                if own < at:
                    pieces.append({"at": own, **piece(encoder, text[own:], encoder.ids(text[own:]))._asdict()})
                met.append((doc_id, xxhash.xxh3_128_digest(f"{doc_id} {text}".encode("utf-8", "surrogatepass")), pieces, refs, chunks))
            none = [None] * len(met)
            first = [pa.concat_arrays([a, pa.array(m, a.type)]) for a, m in zip(finish(decoder, alone), ([x[0] for x in met], none, none, none, none), strict=True)]
            pad = [None] * len(alone)
            rest = [pa.array(pad + [x[k] for x in met], t) for k, t in ((1, pa.binary()), (2, pa.list_(_PIECE)), (3, pa.list_(pa.struct([("h", pa.binary()), ("at", pa.int32())]))), (4, pa.list_(pa.string())))]
            return pa.RecordBatch.from_arrays([*first, *rest], [*names, "key", "pieces", "refs", "chunks"])

        return run

    piece_schema = "at:int,head:string,ids:binary,tail:string"
    scanned = stored(arrow_map(base, scan, f"{done_schema}, key binary, pieces array<struct<{piece_schema}>>, refs array<struct<h:binary,at:int>>, chunks array<string>"))
    met = scanned.where("key is not null")

    def chunks():
        sent: set[bytes] = set()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            own: dict[bytes, str] = {}
            for refs, texts_ in zip(batch.column("refs").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
                own.update((r["h"], t) for r, t in zip(refs, texts_, strict=True) if r["h"] not in sent)
            if len(sent) > SENT:
                sent.clear()
            sent.update(own)
            return pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.string())], ["h", "chunk"])

        return run

    def encode_chunks():
        encoder = kept(("encoder", path), lambda: Encoder(path))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [piece(encoder, t, encoder.ids(t)) for t in batch.column("chunk").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("h"), *(pa.array([getattr(p, c) for p in made], t) for c, t in (("head", pa.string()), ("ids", pa.binary()), ("tail", pa.string())))], ["h", "head", "ids", "tail"])

        return run

    once = arrow_map(arrow_map(met.select("refs", "chunks"), chunks, "h binary, chunk string").groupBy("h").agg(F.first("chunk").alias("chunk")), encode_chunks, "h binary, head string, ids binary, tail string")
    places = met.dropDuplicates(["key"]).select("key", F.explode("refs").alias("r")).select("key", F.col("r.h").alias("h"), F.col("r.at").alias("at"))
    # a hot chunk's ids are copied, and its places dealt out over the copies
    places = places.join(F.broadcast(hot), "h", "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64("key", "at"), F.col("k")).cast("int"), F.lit(0))).drop("k")
    once = once.join(F.broadcast(hot), "h", "left").select("h", "head", "ids", "tail", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("k") - 1, F.lit(0)))).alias("copy"))
    given = places.join(once, ["h", "copy"]).groupBy("key").agg(F.collect_list(F.struct("at", "head", "ids", "tail")).alias("given"))

    def assemble():
        encoder, decoder = kept(("encoder", path), lambda: Encoder(path)), kept(("decoder", path), lambda: Decoder(path))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, pieces, given_ in zip(batch.column("doc_id").to_pylist(), batch.column("pieces").to_pylist(), batch.column("given").to_pylist(), strict=True):
                rows.append((doc_id, join_pieces(encoder, [Piece(p["head"], p["ids"], p["tail"]) for p in sorted(pieces + given_, key=itemgetter("at"))])))
            return pa.RecordBatch.from_arrays(finish(decoder, rows), names)

        return run

    rest = arrow_map(met.select("doc_id", "key", "pieces").join(given, "key").select("doc_id", "pieces", "given"), assemble, done_schema)
    return scanned.where("key is null").select(*names).union(rest)


def unpack(ids: bytes, n: int) -> list[int]:
    """The ids of a row of ``encode``."""
    return np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32).tolist()


def decode(encoded: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id and the decoded text of each row of ``encode(keep_ids=True)``; a row without ids is the empty text."""

    def make():
        decoder = kept(("decoder", path), lambda: Decoder(path))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [decoder.text(unpack(i or b"", n)) for i, n in zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

        return run

    return arrow_map(encoded.select("doc_id", "n_tokens", "ids"), make, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
