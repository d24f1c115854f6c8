import math
import random
from collections import Counter

import duckdb
import pandas as pd
import pytest

from lodestone.llm import backoff_lm as B


def plain(texts):
    words = [[w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").replace("\t", " ").split(" ") if w] for t in texts]

    def grams(w):
        full = ["", "", *w]
        out = Counter(tuple(full[i - n + 1 : i + 1]) for n in (1, 2, 3) for i in range(2, len(full)))
        if w:
            out.update([("",), ("", "")])
        return out

    every = [grams(w) for w in words]
    total = sum(every, Counter())
    n, out = sum(map(len, words)), []
    for w, own in zip(words, every, strict=True):
        c = lambda *g, own=own: total[g] - own[g]
        full, logs, backed = ["", "", *w], [], 0
        for i in range(2, len(full)):
            x, y, z = full[i - 2 : i + 1]
            backed += c(x, y, z) == 0
            if c(x, y, z):
                logs.append(math.log(c(x, y, z) / c(x, y)))
            elif c(y, z):
                logs.append(math.log(0.4 * c(y, z) / c(y)))
            else:
                logs.append(math.log(0.4 * 0.4 * max(c(z), 1) / max(n - len(w), 1)))
        out.append((len(w), backed, sum(logs) / len(w) if w else None))
    return out


def same(got, want):
    for (n, b, s), (n2, b2, s2) in zip(got, want, strict=True):
        assert (n, b) == (n2, b2) and (s is s2 if s2 is None else abs(s - s2) < 2e-6)


@pytest.mark.parametrize("ranges, at_once", [(512, 1_200_000), (7, 40), (1, 5)])
def test_like_plain_python_and_sql(spark, monkeypatch, ranges, at_once):
    monkeypatch.setattr(B, "RANGES", ranges)
    monkeypatch.setattr(B, "AT_ONCE", at_once)
    rng = random.Random(ranges)
    texts = [None, "", " \n", "One", "one ONE One", "é É x"] + [" ".join(rng.choices(["a", "the", "B", "c", f"u{i}", "d\ne"], k=rng.randrange(30))) for i in range(60)]
    texts += texts[8:10]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, LM_score string").repartition(3)
    got = sorted(tuple(r) for r in B.scored(df).select("doc_id", "n_words", "n_backoff", "lm_score").collect())
    same([r[1:] for r in got], plain(texts))
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    sql = sorted(duckdb.sql(B.SQL).fetchall())
    assert [r[0] for r in sql] == [r[0] for r in got]
    same([r[1:] for r in got], [r[1:] for r in sql])
    assert B.scored(df.limit(0)).count() == 0


def test_lone_text_and_null_id(spark):
    df = spark.createDataFrame([(None, "a b a")], "doc_id long, text string")
    same([tuple(r)[2:] for r in B.scored(df).collect()], plain(["a b a"]))


def test_more_distinct_words_than_21_bits(spark):
    """Words w0 w1 w2 ... in one text of 2.2 million; another text has a part of it, and pairs that never occur aren't found."""
    n = (1 << 21) + 100_000
    long = " ".join(f"w{i}" for i in range(n))
    other = " ".join(f"w{i}" for i in range(n - 50, n)) + f" w0 w{n - 1}"
    df = spark.createDataFrame([(1, long), (2, other)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_backoff, r.lm_score) for r in B.scored(df).collect()}
    # 48 triples of the long text are in the other one, too
    assert got[1][:2] == (n, n - 48) and got[2][:2] == (52, 4)
    want = (48 * math.log(1.0) + math.log(0.4 * 1.0) + (math.log(0.16 / n) + math.log(0.16 / n) + math.log(0.16 / n))) / 52
    assert abs(got[2][2] - want) < 1e-5
