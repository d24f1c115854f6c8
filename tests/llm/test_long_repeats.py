import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import long_repeats as L


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, kept sha256) of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            w = r[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(rng.randrange(length // 2, 4 * length)) for _ in range(6)]
    texts = [None, "", "a" * (length + 1), "a" * (3 * length), "ab" * length, word(length - 1), "x" + "é" * (2 * length)]
    for _ in range(60):
        parts = [word(rng.randrange(3 * length)) for _ in range(rng.randrange(4))]
        for s in rng.sample(shared, rng.randrange(3)):
            lo = rng.randrange(max(1, len(s) // 3))
            parts.insert(rng.randrange(len(parts) + 1), s[lo : len(s) - rng.randrange(max(1, len(s) // 3))])
        texts.append("".join(parts))
    return texts + texts[10:14] + ["".join(shared) * 2]


@pytest.mark.parametrize("seed, length, piece, shard, wide", [(1, 200, 1 << 19, 4 << 20, 8 << 20), (2, 20, 1 << 19, 100, 8 << 20), (3, 31, 50, 1, 0), (4, 200, 333, 4 << 20, 0), (5, 3, 7, 1 << 20, 1 << 20)])
def test_like_plain_python(spark, monkeypatch, seed, length, piece, shard, wide):
    """Names are indexed many together, each alone, and (wide 0) the largest of them by their windows."""
    monkeypatch.setattr(L, "PIECE", piece)
    monkeypatch.setattr(L, "AT_ONCE", 300)
    monkeypatch.setattr(L, "SHARD", shard)
    monkeypatch.setattr(L, "WIDE", wide)
    texts = corpus(seed, length)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_spans int").repartition(3)
    rows = sorted(L.remove_repeats(df, length=length).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == plain(texts, length)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    assert L.remove_repeats(df.limit(0), length=length).count() == 0


def test_run_index():
    """The transform, its runs and its samples against suffixes that are sorted as a whole; matches against a dictionary."""
    rng = random.Random(6)
    for case in range(60):
        base = bytes(rng.choices(b"ab\0", k=rng.randrange(1, 40)))
        texts = [base[rng.randrange(len(base)) :] * rng.randrange(1, 4) + bytes(rng.choices(b"abc", k=rng.randrange(6))) for _ in range(rng.randrange(1, 8))]
        index = L.RunIndex(texts)
        # (suffix, text): a text's end is less than any byte, and of equal suffixes that of the earlier text comes first
        every = sorted(((t[i:], k, i) for k, t in enumerate(texts) for i in range(len(t) + 1)), key=lambda x: x[:2])
        symbols = [texts[k][i - 1] + 1 if i else 0 for _, k, i in every]
        runs = [j for j in range(len(every)) if not j or symbols[j] != symbols[j - 1] or not symbols[j]]
        assert index.symbols.tolist() == [symbols[j] for j in runs]
        assert index.heads.tolist() == [index.starts[every[j][1]] + every[j][2] for j in runs]
        for length in (1, 3, 9):
            seen = {}
            for k, t in enumerate(texts):
                for i in range(len(t) - length + 1):
                    seen.setdefault(t[i : i + length], []).append((k, i))
            want = sorted(p for held in seen.values() if len(held) > 1 for p in held)
            text, first, n = L.repeated_spans(texts, length)
            assert sorted((int(k), int(a) + j) for k, a, m in zip(text, first, n, strict=True) for j in range(m)) == want, case


def test_long_texts_and_nulls(spark):
    rng = random.Random(8)
    word = lambda n: bytes(rng.choices(b"abcdefgh ", k=n)).decode()
    shared = word(5000)
    texts = [None, "", word(1_500_000) + shared + word(10), shared[3:] + "z", shared[:-2] * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(L.remove_repeats(df).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == plain(texts, 200)


def test_blocks_and_batches_are_bounded(monkeypatch):
    """What a task decides leaves it in blocks, and what is found in batches, of at most FOUND rows."""
    monkeypatch.setattr(L, "FOUND", 100)
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 6000, np.uint8).tobytes()
    names = np.arange(2, dtype=np.int64)
    out = L._Out(names, 2)
    held = [p for rid, raw in enumerate((text, text, text[:3000] + b"-" + text[3001:])) for p in L.pieces(rid, raw, 20)]
    rows = [*out.add(L.runs(held, L.Hasher(), 20, 13)), *out.done()]
    done = [L.unpack(block, *L._DECISION) for _, major, kind, block in rows if kind == L._DONE]
    assert sum(len(d[0]) for d in done) > 1 and max(len(d[0]) for d in done) <= 100
    many = L.pack(*(np.zeros(950, k) for k in L._DECISION))
    batch = next(iter(L.batched(iter([(0, -1, L._DONE, many)]))))
    found = list(L._settled(20)(iter([batch])))
    assert [b.num_rows for b in found] == [100] * 9 + [50]
