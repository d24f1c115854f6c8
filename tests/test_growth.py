"""Steps of the engine that must not move or hold more than their results need."""

import contextlib
import io
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestone.functions.porter import term
from lodestone.operators import lexical, ranking, vector
from lodestone.sources.files import with_text
from lodestone.storage import BATCH_BYTES, small_files

TEXTS = ["The fox jumps; foxes jumped, it_was it was.", "it was the fox it was", "", "was it a FOX? no, it was", "a-b " * 300, "it", "éléments Éléments it. was"]


def plan(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


@pytest.fixture
def cut(spark):
    return spark.createDataFrame([(f"c{i}", t, f"/p/{i}.txt") for i, t in enumerate(TEXTS)], "chunk_id string, text string, path string").repartition(3)


def plain(text, stemmed=False):
    found = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return [term(t) for t in found] if stemmed else found


@pytest.mark.parametrize("stemmed", [False, True])
def test_postings_where_chunks_are(cut, stemmed, monkeypatch):
    monkeypatch.setattr(lexical, "ROWS", 2)
    df = lexical.postings(cut, ("text",), stemmed)
    assert "Exchange" not in plan(df).split("MapInArrow")[0]
    want = defaultdict(list)
    for i, text in enumerate(TEXTS):
        for place, t in enumerate(plain(text, stemmed)):
            want[t, f"c{i}"].append(place)
    got = {(r.term, r.chunk_id): r.places for r in df.collect()}
    assert got == want and all(r.tf == len(r.places) and r.dl == len(plain(TEXTS[int(r.chunk_id[1])])) for r in df.collect())


def test_term_counts(cut):
    want = defaultdict(lambda: [0, 0])
    for text in TEXTS:
        for t in plain(text):
            want[t][1] += 1
        for t in set(plain(text)):
            want[t][0] += 1
    assert {r.term: [r.n, r.occurrences] for r in lexical.term_counts(cut).collect()} == want


def test_matches_where_chunks_are(cut, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 8)  # a chunk or two at a time
    df = lexical.matches(cut, lexical.phrase_rows([(0, "it_was"), (1, "it was"), (2, "fox fox"), (3, "zzz"), (4, "it it_was_the")]))
    assert "Exchange" not in plan(df).split("MapInArrow")[0]
    rows = df.collect()
    got = {(r.query_id, r.chunk_id): r.f for r in rows if r.query_id is not None and r.chunk_id}
    want = {}
    for i, text in enumerate(TEXTS):
        t = plain(text)
        pairs, three = sum(x == ("it", "was") for x in zip(t, t[1:])), sum(x == ("it", "was", "the") for x in zip(t, t[1:], t[2:]))
        for q, f in enumerate([[pairs], [t.count("it"), t.count("was")], [t.count("fox")] * 2, [0], [t.count("it"), three]]):
            if all(f):
                want[q, f"c{i}"] = f
    assert got == want
    assert sum(r.f[0] for r in rows if r.query_id is None) == len(TEXTS) and sum(r.dl for r in rows if r.query_id is None) == sum(len(plain(t)) for t in TEXTS)
    assert sum(r.f[0] for r in rows if r.query_id == 2 and not r.chunk_id) == sum("fox" in plain(t) for t in TEXTS)


def test_candidates_go_to_the_chunks(spark, cut):
    found = spark.createDataFrame([(0, "c1", 2.0), (0, "c3", 1.0)], "query_id long, chunk_id string, score double")
    queries = spark.createDataFrame([(0, "it was")], "query_id long, query string")
    df = ranking.fused(found, found.limit(1), cut.withColumn("file_id", F.col("path")), queries)
    assert {r.chunk_id for r in df.collect()} == {"c1", "c3"} and "SortMergeJoin [chunk_id" not in plan(df)


def test_groups_of_queries(spark, monkeypatch):
    """Equal vectors tie by id, whatever meets them first; a task sends k rows for each query of its group at most."""
    for name, n in (("BLOCK", 2), ("GROUP", 3), ("ROWS", 7), ("LEAST_PARTS", 2)):
        monkeypatch.setattr(vector, name, n)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 4))
    held = [(f"v{i:03}", base[i % 6].tolist()) for i in rng.permutation(120)]
    asked = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(8, 4)))]
    df = vector.nearest(spark.createDataFrame(held, "chunk_id string, embedding array<double>").repartition(5), asked, 25)
    assert "Union" not in plan(df)
    got = defaultdict(list)
    for r in df.collect():
        got[r.query_id].append((r.chunk_id, r.score))
    for i, v in asked:
        want = sorted(((c, round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6)) for c, w in held), key=lambda x: (-x[1], x[0]))[:25]
        assert sorted(got[i], key=lambda x: (-x[1], x[0])) == want


def test_batches_of_long_pages_are_bounded(spark):
    pages = spark.range(24).repartition(1).select(F.concat(F.lit("/p/"), F.col("id"), F.lit(".md")).alias("path"), F.lit(1).cast("long").alias("mtime"), F.lit(1 << 20).cast("long").alias("size"), F.encode(F.repeat(F.lit("x"), 1 << 20), "UTF-8").alias("content"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert with_text(pages).where("length(text) > 0").count() == 24
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES
    held = F.pandas_udf(lambda s: s.map(lambda _: len(s)), "long")
    assert pages.select(held("content").alias("n")).agg(F.max("n")).first()[0] <= BATCH_BYTES >> 20


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i}.txt").write_text("x")
    df = spark.read.format("binaryFile").load(str(tmp_path))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with small_files(spark):
        assert df.select("path").repartition(1).count() == 60 and spark.read.format("binaryFile").load(str(tmp_path)).rdd.getNumPartitions() <= 5
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_cascade_joins_ids_only(spark):
    df = __spark_entry__.queries()["delete_cascade"](spark, "/root/testdata/sf0.001")
    assert "split(" not in plan(df)
