import random

import numpy as np
import xxhash

from lodestone.llm import simhash_golay as S


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def plain_components(fps):
    """fps: {id: fingerprint}."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint():
    for text in ("", "  \n", "One", "One two THREE", "a b c d", "É A b\tC d\ne f g a b c d " * 9):
        assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def test_golay_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)
    parity, errors = S._golay_tables()
    code = words ^ errors[parity[words >> 11] ^ (words & 0x7FF)]
    assert len(np.unique(code)) == 4096 and int(np.bitwise_count(words ^ code).max()) == 3


def test_keys_meet_within_four_bits():
    rng = random.Random(1)
    for _ in range(4000):
        u = rng.getrandbits(64)
        v = u
        for b in rng.sample(range(64), rng.randint(0, 4)):
            v ^= 1 << b
        row, key = S.keys_of(np.array([u, v], np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])


def test_classes(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        t = rng.choices(words, k=rng.choice([0, 3, 40, 400]))
        rows.append((i * 3, " ".join(t)))
        for k in range(rng.randint(0, 3)):
            u = list(t)
            if u:
                u[rng.randrange(len(u))] = "changed"
            rows.append((i * 3 + 500 + k, " ".join(u)))
    rows = list(dict(rows).items()) + [(900001, None), (900002, "\n")]
    want = plain_components({i: plain_fingerprint(t or "") for i, t in rows})
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").withColumn("fp", S.F.lit("clash"))
    got = S.classes(df).collect()
    assert len(got) == len(rows) + 1 and {r.doc_id: r.component_id for r in got} == want
    assert sorted(r.doc_id for r in S.deduplicate(df).collect()) == sorted(set(want.values()))
    assert S.classes(df.limit(0)).count() == 0


def test_hot_keys_are_linked_through_neighbours(spark, monkeypatch):
    rng = random.Random(3)
    fps = {i: x for i, x in enumerate({(1 << rng.randrange(12)) | (1 << rng.randrange(12, 63)) for _ in range(150)} | {rng.getrandbits(63) for _ in range(50)})}
    monkeypatch.setattr(S, "HOT", 0)
    table = spark.createDataFrame([(x,) for x in fps.values()], "fp long")
    import pyarrow as pa
    key = np.zeros(len(fps), np.int64)
    got = list(S._links(iter([pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.array(list(fps.values()), np.int64))], names=["key", "fp"])])))
    assert sum(b.num_rows for b in got if b.column(2)[0].as_py()) == len(fps)
    shared = table.mapInArrow(S._neighbours, "w bigint, fp bigint")
    least = shared.groupBy("w").agg(S.F.min("fp").alias("a"))
    pairs = shared.join(least, "w").where("a < fp").select("a", S.F.col("fp").alias("b"))
    root = {r.node: r.root for r in S.components(pairs).collect()}
    want = plain_components({x: x for x in fps.values()})
    assert {x: root.get(x, x) for x in fps.values()} == want


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (300, 100)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 150: 100, 300: 100}


def test_links_with_hot_keys(spark, monkeypatch):
    """All keys are hot: the whole of links() goes through shared neighbours. Executors see HOT as it is when the function is pickled."""
    rng = random.Random(7)
    fps = sorted({(1 << rng.randrange(10)) | (1 << rng.randrange(10, 63)) for _ in range(30)} | {rng.getrandbits(62) for _ in range(10)})

    def hot_links(batches):
        S.HOT = 0
        return links_of(batches)

    links_of = S._links
    monkeypatch.setattr(S, "_links", hot_links)
    found = S.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    root = {r.node: r.root for r in S.components(found).collect()}
    assert {x: root.get(x, x) for x in fps} == plain_components({x: x for x in fps})


def test_string_ids_and_rows_with_one_id(spark):
    df = spark.createDataFrame([("b", "one text of many words"), ("a", "one text of many words"), ("a", "another text altogether, unlike it"), (None, "one text of many words"), (None, None)], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in S.classes(df).collect()} == {("b", "a"), ("a", "a"), (None, "a"), (None, None)}
    assert sorted(map(str, (tuple(r) for r in S.deduplicate(df).collect()))) == sorted(map(str, [("a", "one text of many words"), ("a", "another text altogether, unlike it"), (None, None)]))
