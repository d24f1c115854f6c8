import random
import re

import duckdb
import pandas as pd

from lodestone.llm import decontamination as D


def plain(docs, items):
    def shingles(text, least=5):
        w = re.findall(r"[^\W_]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        n = min(least, len(w))
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    out = []
    for i, t in docs:
        for j, u in items:
            s = shingles(u)
            own = set().union(*(shingles(t, n) for n in {x.count(" ") + 1 for x in s}))
            if s and 100 * len(s & own) >= 80 * len(s):
                out.append((i, j, len(s), len(s & own)))
    return sorted(out, key=str)


def test_like_plain_python_and_sql(spark):
    rng = random.Random(4)
    words = [f"w{i}é" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 40)))) for i in range(30)] + [(60, "Short ITEM"), (61, "one"), (62, "a b c")] + [(50, None), (51, ""), (52, "a b c d"), (3, "Rep eated item of six words"), (None, "Rep eated item of six words")]
    docs = [(0, None), (1, ""), (2, "a b c d e"), (None, "x rep EATED, item of six words. y"), (3, "rep eated item of six"), (3, "rep eated item of six"), (4, "a short, item and One a b, c"), (5, "shorter item onerous a b")]
    for k in range(60):
        body = rng.choices(words, k=rng.randrange(300))
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = w
        docs.append((100 + k, " ".join(body).capitalize().replace("w3é ", "W3é,\n")))
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, __rid int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    out = D.contained(d, b)
    assert len(want) > 10 and sorted(map(tuple, out.collect()), key=str) == want
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    documents, benchmark = (pd.DataFrame(x, columns=c).astype({c[0]: "Int64"}) for x, c in ((docs, ["doc_id", "text"]), (items, ["item_id", "text"])))  # noqa: F841
    assert sorted(duckdb.sql(D.SQL).fetchall(), key=str) == want
    assert {(4, 60, 1, 1), (4, 61, 1, 1), (4, 62, 1, 1)} <= set(want)
    kept = D.decontaminate(d.drop("__rid"), b)
    bad = {r[0] for r in want}
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted(((i, t) for i, t in docs if i not in bad), key=str)
    assert D.contained(d.limit(0), b).count() == 0 and D.contained(d, b.limit(0)).count() == 0


def test_long_text_and_clashes(spark):
    """Items in a text of 200,000 words, and tables whose other columns have the names that are used inside."""
    body = [f"w{i % 9973}" for i in range(200_000)]
    body[150_000:150_000] = "this is the short item that hides in here".split()
    d = spark.createDataFrame([(1, " ".join(body), "x", 1), (2, None, "y", 2)], "doc_id long, text string, item_id string, h int")
    b = spark.createDataFrame([(7, "This is the short item that hides in here", 1), (8, "that hides", 1), (9, "hides that", 1), (None, None, 1)], "item_id long, text string, doc_id int")
    assert sorted(map(tuple, D.contained(d, b).collect())) == [(1, 7, 5, 5), (1, 8, 1, 1)]
    assert [tuple(r) for r in D.decontaminate(d, b).collect()] == [(2, None, "y", 2)]
