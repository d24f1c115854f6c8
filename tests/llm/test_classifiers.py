import random
import zlib

import numpy as np
import pytest

from lodestone.llm import toxicity_ftrl, zstd_quality
from lodestone.llm.training import labelled_sample

WORDS = ["river", "stone", "walks", "green", "table", "under", "seven", "light", "house", "paper", "cloud", "winter"]


def corpus(kind, n=240, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, y = rng.choices(WORDS, k=60), i % 3 == 0
        if kind == "toxic" and y:
            for _ in range(3):
                text.insert(rng.randrange(60), rng.choice(["villain", "wretch"]))
        if kind == "quality" and not y:
            text = [w.upper() + "%%|" for w in text]
        docs.append((i, " ".join(text), 0.5, "x"))
        labels.append((i, int(y)))
    return docs, labels


@pytest.mark.parametrize("module, kind, folds, out", [(toxicity_ftrl, "toxic", 3, 1), (zstd_quality, "quality", 4, 2)])
def test_held_out(spark, module, kind, folds, out):
    docs, labels = corpus(kind)
    truth = dict(labels)
    more = [(None, "river stone", 0.0, "x"), (9000, "", 0.0, "x"), (9001, None, 0.0, "x"), docs[0]]
    df = spark.createDataFrame([*docs, *more], "doc_id long, text string, score double, held_out string")
    lab = spark.createDataFrame([*labels, (None, 1), (9000, None), labels[0], (77777, 1)], f"doc_id long, {kind} int")
    rows = module.judged(df, lab).collect()
    assert len(rows) == len(docs) + len(more) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == out) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.95
    assert [c for c in module.judged(df.limit(0), lab).collect()] == []
    assert {r.score for r in module.judged(df, lab.limit(0)).collect()} == {0.5}


def test_held_out_labels_are_not_seen(spark):
    docs, labels = corpus("toxic")
    df = spark.createDataFrame([r[:2] for r in docs], "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (toxicity_ftrl.train(df, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert a == b
    few = labelled_sample(df, spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text", "toxic", 3, 1, 7, 1 << 20).collect()
    assert len(few) == 14 and sum(r.label for r in few) == 7


def test_filter_keeps_columns(spark):
    docs, labels = corpus("quality")
    df = spark.createDataFrame(docs, "doc_id long, text string, score double, held_out string")
    kept = zstd_quality.filter_quality(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, y in labels if y}


def in_order(spark, rows, labels, folds, out):
    """The labelled rows outside the fold, as the sample orders them when it takes all."""
    keys = {r.i: (r.h, r.i) for r in spark.createDataFrame([(i,) for i, _ in rows], "i long").selectExpr("i", "xxhash64(i, 'order') as h").collect()}
    truth = dict(labels)
    return [(t.encode(), truth[i]) for i, t in sorted(rows, key=lambda r: keys[r[0]]) if i in truth and zlib.crc32(str(i).encode()) % folds != out]


def plain_ftrl(rows):
    """FTRL-proximal, a coordinate at a time."""
    m = toxicity_ftrl
    z, n = {}, {}

    def weight(i):
        l1 = 0 if i < 0 else m.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1 if z.get(i, 0.0) > 0 else -1
        return (sign * l1 - z.get(i, 0.0)) / ((m.BETA + n.get(i, 0.0) ** 0.5) / m.ALPHA + m.L2)

    data = [([-1, *m.features(t).tolist()], y) for t, y in rows]
    for epoch in range(m.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(data)):
            x, y = data[k]
            w = {i: weight(i) for i in x}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in x:
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - old**0.5) / m.ALPHA * w[i]
    return lambda t: 1 / (1 + np.exp(-(weight(-1) + sum(weight(i) for i in m.features(t).tolist()))))


def plain_zstd(rows):
    """Two dictionaries from every other row, each block compressed with either, a logistic curve by plain gradient descent."""
    import zstandard

    m, of = zstd_quality, {k: [t for t, y in rows if y == k] for k in (0, 1)}
    blocks = lambda t: [t[i : i + 1024] for i in range(0, len(t), 1024)]
    made = {k: zstandard.ZstdCompressionDict(m.make_dictionary(of[k][::2])) for k in (0, 1)}
    size = lambda t, k: sum(len(zstandard.ZstdCompressor(dict_data=made[k], level=m.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b)) for b in blocks(t))
    value = lambda t: (size(t, 0) - size(t, 1)) / len(t) if t else 0.0
    rest = [(value(t), k) for k in (0, 1) for t in of[k][1::2]]
    x, y = (np.array(v, float) for v in zip(*rest, strict=True))
    scale, a, b = x.std(), 0.0, 0.0
    for _ in range(200_000):
        p = 1 / (1 + np.exp(-(a * x / scale + b)))
        a, b = a - 0.02 * ((p - y) @ x / scale + 0.05 * a), b - 0.02 * ((p - y).sum() + 0.05 * b)
    return lambda t: 1 / (1 + np.exp(-(a * value(t) / scale + b)))


@pytest.mark.parametrize("module, kind, folds, out, plain, close", [(toxicity_ftrl, "toxic", 3, 1, plain_ftrl, 1e-9), (zstd_quality, "quality", 4, 2, plain_zstd, 1e-4)])
def test_like_plain_python(spark, module, kind, folds, out, plain, close):
    docs, labels = corpus(kind, 150)
    rows = [(i, t) for i, t, *_ in docs] + [(5000, "river Villain " * 3000), (5001, "")]
    of = plain(in_order(spark, rows, labels, folds, out))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in module.judged(df, spark.createDataFrame(labels, f"doc_id long, {kind} int")).collect()}
    assert all(abs(got[i] - of(t.encode())) < close for i, t in rows)


def test_sample_is_bounded(spark):
    """Rows that repeat an id, and bytes."""
    df = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(3, "y" * 900), (4, "z" * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    take = lambda n, size: labelled_sample(df, labels, "doc_id", "text", "toxic", 7, 99, n, size).collect()
    assert len(take(5, 1 << 20)) == 7 and len(take(1000, 1 << 20)) == 502
    few = take(1000, 64 * 2000)
    assert {r.text[0] for r in few} == {"t", "y"} and len(take(1000, 64 * 20)) < 200
