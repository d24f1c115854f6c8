import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from lodestone.llm.bpe import Codec, RankQueue, encode_documents, load_ranks, merge_piece

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = load_ranks(VOCABULARY)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = Codec(RANKS, P.PATTERN)
QUEUE = RankQueue(len(RANKS))
TEXTS = ["", " ", "a", "it's  we'll\n\n x ", "aaaa" * 50, "\x1c\x1d a\x85b c  d", "naïve 12345 ßü 漢字 🙂!!", "a \n b\t\tc   ", "x" * 3000 + "  " + "é" * 500, " " * 300 + "a"]


@pytest.mark.parametrize("text", TEXTS)
def test_like_the_library(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab e's\n\té漢 1.!"), max_size=60) | st.text(max_size=40).filter(lambda t: t.isprintable()))
def test_random_texts(text):
    assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


def test_long_pieces():
    for piece in (b"ab" * 20000, b"the" * 9000 + b"zq" * 500):
        assert merge_piece(piece, RANKS, QUEUE) == LIBRARY.encode_ordinary(piece.decode())


def test_generations(monkeypatch):
    from lodestone.llm import bpe

    monkeypatch.setattr(bpe, "PIECES", 3)
    monkeypatch.setattr(bpe, "CHUNKS", 2)
    codec = Codec(RANKS, P.PATTERN)
    for text in TEXTS + TEXTS[::-1] + ["zqxj wvut zqxj kjhg wvut mnbv zqxj"] * 3:
        assert codec.encode(text) == LIBRARY.encode_ordinary(text)
    assert len(codec.pieces) <= 3 and len(codec.old_pieces) <= 3 and len(codec.chunks) <= 2


def by_scanning(piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in RANKS]
        if not found:
            return [RANKS[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeth", min_size=2, max_size=60))
def test_queue_against_scanning_all_pairs(text):
    """The queue for pre-tokens of any length."""
    from lodestone.llm import bpe

    assert bpe.merge_scanned(text.encode(), RANKS) == by_scanning(text.encode())
    kept, bpe.SHORT = bpe.SHORT, 0
    try:
        check_queue(text)
    finally:
        bpe.SHORT = kept


def check_queue(text):
    assert merge_piece(text.encode(), RANKS, QUEUE) == by_scanning(text.encode()) and not any(QUEUE.low) and not any(QUEUE.mid) and not any(QUEUE.buckets)


def test_invalid_bytes(spark):
    raw = b"ab \xff\xfe c\xc3 d"
    df = spark.createDataFrame([(1, raw)], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    row = encode_documents(df, VOCABULARY, P.PATTERN, keep=["doc_id"]).first()
    assert row.decoded_sha256 == hashlib.sha256(raw).hexdigest() and row.n_tokens > 4


def test_documents(spark):
    df = spark.createDataFrame([(1, "one two", 9), (1, "one two", 9), (None, None, 8), (3, "", 7)], "doc_id long, text string, n_tokens int")
    rows = sorted(encode_documents(df, VOCABULARY, P.PATTERN, with_ids=True).collect(), key=str)
    assert len(rows) == 4 and rows[0].asDict().keys() == {"doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    for r in rows:
        ids = LIBRARY.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids == ",".join(map(str, ids))
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert encode_documents(df.limit(0), VOCABULARY, P.PATTERN).count() == 0


def test_what_is_remembered_is_bounded():
    """A codec that remembers little gives the same ids and holds no more than it may."""
    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    text = " ".join(f"word{k % 37},{k}. x{k * k}" for k in range(500))
    small, large = (Codec(ranks, P.PATTERN, n) for n in (8, 1 << 12))
    assert small.encode(text) == large.encode(text) and small.decode(small.encode(text)) == text.encode()
    assert max(len(c) for c in (small.pieces, small.old_pieces, small.chunks, small.old_chunks)) == 8 < len(large.chunks)
