import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.ids import chunk_id, file_id
from lodestone.functions.porter import term
from lodestone.operators import lexical
from lodestone.operators.chunking import chunks

TEXTS = ["", " ", "word", "Artificial intelligence is here, and artificial intelligence stays.", "créer des Éléments nouveaux\x1cici", "x" * 300, "aa bb " * 60, "the end: intelligence", "a 🙂 intelligence 🙂 b " * 9]
QUERIES = ["intelligence", "artificial intelligence", "stays artificial", "éléments", "zzz", "bb aa x"]


def words(t):
    return t.split()


def plain_match(t, q):
    low, ask = t.lower(), q.lower()
    if ask in low:
        return low.index(ask)
    return min((low.index(w) for w in words(ask) if w in low), default=-1)


def plain_snippet(t, q, r):
    at = plain_match(t, q)
    if not t or not q.strip() or at < 0:
        return t[: 2 * r], 0, min(2 * r, len(t))
    lo, hi = max(0, at - r), min(len(t), at + len(q) + r)
    return ("..." if lo else "") + t[lo:hi] + ("..." if hi < len(t) else ""), lo, hi


def plain_exact(t, q):
    ask, low = q.lower().strip(), t.lower()
    if ask in low:
        return 1.0
    own = set(words(ask))
    share = len(own & set(words(low))) / len(own) if own else 0.0
    return share if share >= 0.7 else 0.0


def plain_position(t, q):
    at = t.lower().find(q.lower().strip())
    return 1 - at / max(1, len(t)) if at >= 0 and at / max(1, len(t)) <= 0.3 else 0.0


def plain_truncated(t, n=200):
    if len(t) <= n:
        return t
    cut = t[:n]
    at = cut.rfind(" ")
    return (cut[:at] if at > n * 0.8 else cut) + "..."


@pytest.mark.parametrize("q", QUERIES)
def test_matches_and_snippets(spark, q):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    t = F.col("t")
    made = df.select("i", "t", X.make_snippet(t, F.lit(q), 20).alias("s"), X.exact_match(F.lit(q), t).alias("e"), X.position_bonus(F.lit(q), t).alias("p"), X.truncate_snippet(X.squeezed(t)).alias("c"), X.highlight(t, q).alias("h"))
    for r in made.collect():
        assert (r.s.snippet, r.s.start, r.s.end) == plain_snippet(r.t, q, 20)
        assert r.e == pytest.approx(plain_exact(r.t, q)) and r.p == pytest.approx(plain_position(r.t, q))
        assert r.c == plain_truncated(" ".join(r.t.split()))
        assert r.h == re.sub(rf"(?i)\b({'|'.join(map(re.escape, q.split()))})\b", r"**\1**", r.t)


def test_clean_query(spark):
    said = ["  Foo_bar, (baz)! ", "", "?!", "É É"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in said], "q string").select(X.clean_query(F.col("q"))).collect()]
    assert got == [X.clean_query_text(x) for x in said] == ["foo_bar baz", "", "", "é é"]


def test_upper_like_sql(spark):
    import duckdb
    import pyarrow as pa

    every = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["Straße ßß ﬁn", "ß", "aßb", "", "ŉ\nǰ", *every]
    held = pa.table({"t": texts})  # noqa: F841  DuckDB reads it by its name
    want = duckdb.sql("select t, upper(t) as u from held").fetchall()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert sorted((r.t, r.u) for r in df.select("t", X.upper(F.col("t")).alias("u")).collect()) == sorted(want)


@pytest.mark.parametrize("n", [0, 1, 159, 160, 200, 201, 361])
def test_chunks(spark, n):
    w = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([("f", "/p", 1, "  " + " \n".join(w))], "file_id string, path string, mtime long, text string")
    got = sorted((r.idx, r.token_start, r.token_end, r.text) for r in chunks(df, 200, 40).collect())
    assert got == [(k, s, min(s + 200, n), " ".join(w[s : s + 200])) for k, s in enumerate(range(0, n, 160))]
    with pytest.raises(ValueError, match="overlap"):
        chunks(df, 40, 40)


def test_ids(spark):
    import hashlib
    import uuid

    r = spark.range(1).select(file_id(F.lit("/test/file.txt"), F.lit(1234567890), F.lit(1024)).alias("f"), chunk_id(F.lit("abc"), F.lit(3)).alias("c")).first()
    assert r.f == hashlib.sha1(b"/test/file.txt|1234567890|1024").hexdigest() and r.c == str(uuid.uuid5(uuid.NAMESPACE_DNS, "abc_3"))


SAID = ["caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll learning learned créer naïve"]


def test_stems_like_sqlite():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter')")
    db.execute("create virtual table v using fts5vocab(t, row)")
    for w in SAID[0].split():
        db.execute("delete from t")
        db.execute("insert into t values (?)", (w,))
        assert [term(w)] == [r[0] for r in db.execute("select term from v")], w


def test_bm25_like_sqlite(spark):
    rng = random.Random(3)
    pool = ["learning", "learned", "créer", "alpha", "beta", "running", "foo_bar", "bar_foo", "txt", "x1", "Ponies", "of"]
    rows = [(f"c{i}-a{i % 3}", " ".join(rng.choices(pool, k=rng.randrange(1, 20))), f"/p/{i}.{rng.choice(['txt', 'md'])}") for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(chunk_id, text, path, tokenize='porter')")
    db.executemany("insert into t values (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "chunk_id string, text string, path string")
    asked = ["learn", "alpha beta", "alpha alpha", "foo_bar", "txt running", "creer", "zzz", "of", "?!"]
    got = lexical.search(df, list(enumerate(asked)), columns=("chunk_id", "text", "path"), stemmed=True).collect()
    for i, q in enumerate(asked):
        said = X.clean_query_text(q)
        want = {c: -s for c, s in db.execute("select chunk_id, bm25(t) from t where t match ?", (said,))} if said else {}
        own = {r.chunk_id: r.score for r in got if r.query_id == i}
        assert own.keys() == want.keys() and all(abs(own[c] - want[c]) < 2e-6 for c in own), q
