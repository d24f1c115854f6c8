import random

import numpy as np
import pytest

from lodestone.llm import near_copies as N
from lodestone.llm.simhash_golay import fingerprint


def plain(rows, size=5, similarity=0.8):
    """Ids that stay, by comparing every two texts."""

    def cut(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()

    sets = {i: cut(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if i < j and (a == b or (a | b and len(a & b) / len(a | b) >= similarity)):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sorted(i for i in root if root[i] == i)


def texts(seed, docs=25, n=150):
    rng = random.Random(seed)
    out = []
    for _ in range(docs):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 7, 40, n]))]
        out.append(words)
        for _ in range(rng.randrange(4)):
            words = list(words)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
            out.append(words)
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("size,similarity", [(5, 0.8), (2, 0.6)])
def test_like_plain_python(spark, size, similarity):
    rows = [*texts(size), (900, None), (901, " \n"), (902, "One two"), (903, "oNE  two")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, other int")
    got = N.deduplicate(df, size=size, similarity=similarity)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == plain(rows, size, similarity)


def test_pipeline_stage(spark):
    import corpus_pipeline

    rng = random.Random(1)
    base = [f"w{rng.randrange(9999)}" for _ in range(200)]
    near, far = list(base), list(base)
    for k in (20, 90, 160):
        near[k] = "x"  # 181 of 211 shingles in common: 0.858
    for k in range(10, 200, 30):
        far[k] = "y"  # 161 of 231: 0.697
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    bits = [fingerprint(t.encode()) for _, t in rows]
    assert (bits[0] ^ bits[1]).bit_count() > 4
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == plain(rows) == [1, 3]


def test_ids_and_empty(spark):
    rows = [(None, "a b"), (None, "a b"), (7, "a b"), (7, "a b"), (7, "c d"), (8, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in N.deduplicate(df).collect()), key=str)
    assert got == [(7, "a b"), (7, "c d"), (None, "a b"), (None, "a b")]
    assert N.deduplicate(df.limit(0)).count() == 0


def test_forest_compares_all():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 11, 22, 500, 511, 60)]
    assert sorted(tuple(sorted(x)) for x in N.forest(sets)) == [(0, 1), (1, 2), (3, 4)]


def test_candidates_from_fingerprints_and_bands(spark):
    """Fingerprints within 4 bits connect nodes without a common band, through Golay keys; common bands connect those whose fingerprints are apart."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(5)]
    near = [fps[0], fps[0] ^ 0b1 ^ 1 << 21 ^ 1 << 42 ^ 1 << 63, fps[1], fps[1], fps[2], fps[2] ^ 0b11111, fps[3], fps[4], None]
    bands = [[k] for k in range(6)] + [[77], [77], []]
    rows = [(k, None if f is None else f - (1 << 64 if f >> 63 else 0), b) for k, (f, b) in enumerate(zip(near, bands, strict=True))]
    got = {r.node: r.root for r in N.candidates(spark.createDataFrame(rows, "node long, fp long, bands array<bigint>")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 6: 6, 7: 6}


def test_fingerprint_of_a_set():
    own = N.shingles(b"a b c d e f g a b c d e f g h")
    want = sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in own) > len(own))
    assert N.fingerprint_of(own) % (1 << 64) == want and len(own) < 11
    assert N.fingerprint_of(own[:0]) is None
