import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebar.llm import bytebpe


@pytest.fixture(scope="module")
def library():
    with open(bytebpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def small():
    """Leaves of a few characters, so that nearly every place is joined."""
    return bytebpe.Coder(leaf=5, piece_leaf=4)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 'slrevdt\n\t  09.,-日本語éß😀\x1c​", max_size=120))
def test_any_text(text):
    held = test_any_text.__dict__.setdefault("held", [bytebpe.Coder(leaf=5, piece_leaf=4), bytebpe.Coder()])
    with_leaves, plain = held
    node = with_leaves.node(text)
    assert node.ends.tolist() == np.cumsum([len(m) for m in plain.pattern.findall(text)]).tolist()
    assert node.ids.tolist() == [i for m in plain.pattern.findall(text) for i in plain.core(m.encode())]
    assert with_leaves.decode(node.ids.tolist()) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000, " " * 3000 + "x", "x" + "\n" * 2000 + " y", "the" * 2000, "日本" * 1500, "1" * 999, "'" * 400 + "s" * 400, "'ll" * 300, "😀" * 700, ".-" * 800, "won't've  I'll", "　" * 50 + "a", "ab\x85\xa0c" * 50])
def test_long_matches(library, small, text):
    assert small.node(text).ids.tolist() == library.encode_ordinary(text)


def test_every_cut(library):
    rng = random.Random(4)
    coder = bytebpe.Coder()
    for _ in range(60):
        text = "".join(rng.choice(["the ", "harbour", "'ll", "'", " ", "  ", "\n", "12", "日本", "é", "...", "x"]) for _ in range(rng.randrange(1, 30)))
        want = library.encode_ordinary(text)
        for cut in range(len(text) + 1):
            assert coder.join(coder.node(text[:cut]), coder.node(text[cut:])).ids.tolist() == want
        thirds = [text[i : i + 3] for i in range(0, len(text), 3)]
        assert coder.joined([coder.node(t) for t in thirds]).ids.tolist() == want


def test_tokens_encode_to_themselves():
    """What the second proof asks of the vocabulary: every token is what its own bytes merge to, step by step."""
    coder = bytebpe.Coder()
    ranks = {t: i for i, t in enumerate(coder.bytes_of) if t}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            assert best[0] < 1 << 30, rank
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert parts == [token]


def test_rows(spark, library, odd, odd_rows, none):
    want = sorted((repr(r[0]), len(ids := library.encode_ordinary(r[1] or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in odd_rows)
    for fragment in (bytebpe.FRAGMENT, 300):  # 300: most texts go by fragments, repeated rows too
        got = bytebpe.encode(odd, fragment=fragment)
        rows = got.collect()
        assert sorted((repr(r[0]), r[1], r[2], r[3]) for r in rows) == want
        back = sorted((repr(r[0]), bytes(r[1])) for r in bytebpe.decode(got).collect())
        assert back == sorted((repr(r[0]), (r[1] or "").encode()) for r in odd_rows)
    assert bytebpe.encode(none).collect() == []


def test_registered(spark, smoke_dir, library):
    from tidebar.llm.queries import QUERIES

    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op13_byte_bpe"](spark, smoke_dir).collect()}
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == {d: (len(ids := library.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in docs}
