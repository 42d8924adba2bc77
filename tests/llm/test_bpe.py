"""Exact agreement with the tokenizers library, whatever is shared between documents."""

import hashlib
import random
import time
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidebar.llm import bpe

LIB = Tokenizer.from_file(bpe.TOKENIZER)
ENC = bpe.Encoder(bpe.TOKENIZER, memo=50)


def expected(text):
    ids = LIB.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(LIB.decode(ids, skip_special_tokens=False))


def test_documents(odd, odd_rows):
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(odd).collect())
    assert got == Counter((i, *expected(t)) for i, t, *_ in odd_rows)


def test_round_trip(odd, odd_rows):
    got = Counter((r["doc_id"], r["text"]) for r in bpe.decode(bpe.encode(odd)).collect())
    assert got == Counter((i, LIB.decode(LIB.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t, *_ in odd_rows)


def test_empty_table(none):
    assert bpe.encode(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="abcé .,'\n1ß日，<|>Σ\u0301=", max_size=12), st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "'ll", "don't", "\u1100", "\u1161", "か", "\u3099"])), max_size=8))
def test_joins(parts):
    parts = [p for p in parts if p]
    pieces = [(p, LIB.encode(p, add_special_tokens=False).ids) for p in parts]
    assert bpe.join_all(ENC, pieces) == LIB.encode("".join(parts), add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["日月火水木金土山川田", "abcdefghij", "0123456789abcdefghijklmnopqrstuvwxyz", "AZaz09+/="])
def test_a_million_letters_without_blanks(letters):
    """Linear: under five seconds, and as the library has it."""
    rng = random.Random(1)
    text = "".join(rng.choice(letters) for _ in range(1_000_000))
    ends = bpe.chunk_ends(text)
    chunks = [text[a:b] for a, b in zip([0, *ends], ends)]
    pieces = [(c, e.ids) for c, e in zip(chunks, LIB.encode_batch(chunks, add_special_tokens=False))]
    began = time.process_time()
    got = bpe.join_all(bpe.Encoder(bpe.TOKENIZER), pieces)
    assert time.process_time() - began < 5
    assert got == LIB.encode(text, add_special_tokens=False).ids


def test_hot_chunks(spark, monkeypatch):
    """A passage in every document, dealt out over copies of its ids."""
    monkeypatch.setattr(bpe, "LEAST_HOT", 10)
    rng = random.Random(4)
    passage = " ".join(f"w{rng.randrange(500)}" for _ in range(2000))
    rows = [(i, f"{i} {i * i} {passage} {i}") for i in range(120)]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: expected(t) for i, t in rows}


def test_chunks_are_found_again(odd_rows):
    long = next(t for _, t, *_ in odd_rows if t and len(t) > 100_000)
    a, b = bpe.chunk_ends(long), bpe.chunk_ends("shifted " + long)
    assert a[-1] == len(long) and all(0 < y - x <= bpe.MOST for x, y in zip([0, *a], a))
    chunks = lambda t, ends: {t[x:y] for x, y in zip([0, *ends], ends)}
    assert len(chunks(long, a) & chunks("shifted " + long, b)) > 0.9 * len(a)


def test_other_vocabularies_are_refused():
    with pytest.raises(Exception):
        bpe.Decoder("/nowhere.json")


def test_few_chunks_are_shared_without_need(spark):
    """Of chunks that no other document has, under one in a hundred is taken for a shared one, at 16 bits for each shared chunk."""
    digests = [bpe._digest(f"chunk {i}") for i in range(1 << 16)]
    bitmap = bpe._bitmap(spark.createDataFrame([(bytearray(d),) for d in digests], "h binary"), 1 << 20)
    assert all(bpe._marked(d, bitmap) for d in digests)
    assert sum(bpe._marked(bpe._digest(f"other {i}"), bitmap) for i in range(10_000)) < 100


def test_texts_do_not_move(spark):
    """Documents that share a passage are kept as the chunks they share and ids: not half of their characters."""
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = words(1000)
    rows = [(i, f"{words(2000)} {passage} {words(2000)}") for i in range(12)]
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("stored-*"))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: expected(t) for i, t in rows}
    letters = lambda x: len(x) if isinstance(x, str) else sum(map(letters, x)) if isinstance(x, (tuple, list)) else 0
    held = sum(letters(r) for p in set(folder.glob("stored-*")) - before for r in spark.read.parquet(str(p)).collect())
    assert held < 0.5 * sum(len(t) for _, t in rows)
