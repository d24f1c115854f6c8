import random

import duckdb
import pandas as pd
import pytest

from lodestone.llm import line_dedup as L


def plain(rows, size):
    """rows: (id, text) in row order; (id, text, n_lines, n_removed, n_runs) each."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    lines = {k: [(x, i) for i, x in enumerate((rows[k][1] or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")] for k in order}
    seen, gone = set(), {k: set() for k in order}
    for k in order:
        for o in range(len(lines[k]) - size + 1):
            run = tuple(x for x, _ in lines[k][o : o + size])
            if run in seen:
                gone[k].update(range(o, o + size))
            seen.add(run)
    out = []
    for k, (i, text) in enumerate(rows):
        at = {lines[k][o][1] for o in gone[k]}
        kept = None if text is None else "" if gone[k] and len(gone[k]) == len(lines[k]) else "\n".join(x for j, x in enumerate(text.split("\n")) if j not in at)
        out.append((i, kept, len(lines[k]), len(gone[k]), sum(o - 1 not in gone[k] for o in gone[k])))
    return out


def rows_for(seed):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["a", "b", "cc", "", " ", "d e", f"u{rng.randrange(99)}"]) for _ in range(rng.randrange(9)))) for i in range(40)]
    return rows + [(100, None), (101, ""), (102, "a\nb\ncc"), (103, "same\nsame\nsame\nsame"), (104, "x\r\ny")]


@pytest.mark.parametrize("size, heavy", [(1, 4096), (2, 20), (3, 1), (5, 4096)])
def test_like_plain_python(spark, monkeypatch, size, heavy):
    rows = rows_for(size) + [(None, "a\nb\ncc"), (7, "q\nr"), (7, "q\nr")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, N_Lines int").coalesce(1)
    monkeypatch.setattr(L, "HEAVY", heavy)
    out = L.deduplicate(df, size=size)
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed, r.n_runs) for r in out.collect()]
    assert sorted(got, key=str) == sorted(plain(rows, size), key=str)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_sql_and_empty(spark):
    from lodestone.llm.queries import op8_line_runs  # noqa: F401

    rows = rows_for(9)
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.deduplicate(df).selectExpr("doc_id", "n_lines", "n_removed", "n_runs", "sha2(coalesce(text, ''), 256)").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(L.SQL).fetchall())
    assert L.deduplicate(df.limit(0)).count() == 0


def every_run(rows, least):
    """(id, text) without the later copies of runs of two or more lines, of any length, and of single lines of least or more words."""
    lines = [[(x, i) for i, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")] for _, t in rows]
    seen, gone = set(), [set() for _ in rows]
    for k, own in enumerate(lines):
        for o in range(len(own)):
            for n in range(1, len(own) - o + 1):
                run = tuple(x for x, _ in own[o : o + n])
                if n == 1 and len(run[0].split()) < least:
                    continue
                if run in seen:
                    gone[k].update(range(o, o + n))
                seen.add(run)
    out = []
    for k, (i, text) in enumerate(rows):
        at = {lines[k][o][1] for o in gone[k]}
        out.append((i, "" if at and len(at) == len(lines[k]) else "\n".join(x for j, x in enumerate(text.split("\n")) if j not in at), len(at)))
    return out


def test_long_single_lines_and_maximal_runs(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a", "b c", "", "d e f", "d e  f", "g h i j", f"u{rng.randrange(99)}"]) for _ in range(rng.randrange(12)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (3, 99):
        got = L.deduplicate(df, long=least).select("doc_id", "text", "n_removed").collect()
        assert sorted(map(tuple, got)) == every_run(rows, least)


def test_pipeline_deletes_long_lines(spark):
    import corpus_pipeline

    long, short = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 50), ("v", 49)))
    rows = [(1, f"a\n{long}\nb\n{short}", 0), (2, f"c\n{long}\nd\n{short}", 0)]
    got = corpus_pipeline.lines(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), "").collect()
    assert {r.doc_id: r.text for r in got} == {1: rows[0][1], 2: f"c\nd\n{short}"}
    assert all(r.n_chars == len(r.text) for r in got)


def test_ranks_are_a_suffix_array(spark):
    """Ranks of the deepest interval that a position is in keep the order of the sequences of line numbers, and equal ranks are equal runs."""
    from pyspark.sql import functions as F

    rows = rows_for(6)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("__rid", F.monotonically_increasing_id())
    positions = L._positions(df.select("__rid", F.struct("doc_id").alias("__order"), L._numbered(F.col("text")).alias("__lines")), None)
    one, n = L._ranked(positions)
    two, _ = L._ranked(one.select("__at", F.col("rank").alias("k1"), F.first("rank").over(L.Window.partitionBy("__at.__rid").orderBy("__at.i").rangeBetween(1, 1)).alias("k2"), "long").where("k2 is not null"))
    number = {(r["__at"]["__rid"], r["__at"]["i"]): r["rank"] for r in one.collect()}
    assert n == len(number)
    pairs = {(r["__at"]["__rid"], r["__at"]["i"]): r["rank"] for r in two.collect()}
    of = {p: (number[p], number[p[0], p[1] + 1]) for p in pairs}
    assert len(pairs) > 20 and all((pairs[p] < pairs[q]) == (of[p] < of[q]) for p in pairs for q in pairs)


def test_long_text_and_clashes(spark):
    lines = [f"line {i % 5000} of many" for i in range(20000)]
    rows = [(1, "\n".join(lines), "mine"), (2, "\n".join(lines[:7] + ["own"]), "too")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = {r.doc_id: r for r in L.deduplicate(df).collect()}
    assert (got[1].n_lines, got[1].n_removed, got[1].n_runs) == (20000, 15000, 1) and got[2].text == "own"
    kept = L.deduplicate(df, counts=False)
    assert kept.columns == df.columns and {r.n_lines for r in kept.collect()} == {"mine", "too"}
