import re

import duckdb
import pandas as pd

from lodestone.llm import quality_rules as Q

TEXTS = [None, "", " \n\t", "one two three four five six seven eight nine ten eleven", "a b c d e f a b c d e f g", "x " * 40, "line of words here\n\nline of words here\n other\nother",
         "LOUD WORDS ONLY HERE AND NO OTHERS AT ALL IN THIS TEXT", "é%% ü|| ñ$$ ## a b c d e f g h", "\x1fa\x0bb c\x85d e f g h i j k l", "the same five words stay the same five words stay here the same five words end", "1 2 3 4 5 6 7 8 9 10 11 12", "one 2 3 4 5 é 7 8 9 10 11 12 13 14", "so it goes...\nand on\u2026\nand ends here with some more words to be ten",
         " ".join(f"{a} {b}" for a in "abcdefgh" for b in "ijklmnop" for _ in range(3)), "long " + "word and other " * 5 + " ".join(f"w{i}" for i in range(60_000))]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, symbols, dup = len(words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    base = n < 10 or 100 * len(covered) > 20 * n
    chars = sum(map(len, words))
    capitals, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    letters_in = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7F]", w)) for w in words)
    open_lines = sum(x.endswith(("...", "\u2026")) for x in text.split("\n"))
    more = 2 * letters_in < n or 20 * len(set(words)) < n or 10 * open_lines > 3 * (text.count("\n") + 1)
    kept = not base and not more and not (chars < 2 * n or chars > 20 * n or 10 * symbols > 3 * n or 10 * dup > 3 * (text.count("\n") + 1) or 2 * capitals > letters)
    return (n, chars, symbols, dup, len(covered), base, kept)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_like_plain_python_and_sql(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3])]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, Kept int")
    out = Q.judged(df)
    got = sorted((r.doc_id, *[r[c] for c in COLUMNS]) for r in out.collect())
    assert got == sorted((i, *plain(t)) for i, t in rows)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    assert sorted(duckdb.sql(Q.SQL).fetchall()) == got
    assert Q.judged(df.limit(0)).count() == 0


def test_order_changes_nothing(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    kept = [sorted(map(str, Q.judged(df, order=list(o)).select("text", "kept").collect())) for o in (Q.RULES, reversed(Q.RULES))]
    assert kept[0] == kept[1]
    found = Q.measure(df)
    assert {n for n, _, _ in found} == set(Q.RULES) and all(c > 0 for _, _, c in found)


def test_conditional_order():
    """b rejects most, but nothing that a hasn't rejected already."""
    seen = [(50, set()), (30, {"a", "b"}), (5, {"a"}), (2, {"c"}), (1, {"b", "d"})]
    got = Q.in_order(seen, {"a": 1.0, "b": 1.1, "c": 1.0, "d": 1.0})
    assert [(n, round(r, 4)) for n, r, _ in got] == [("a", round(35 / 88, 4)), ("c", round(2 / 53, 4)), ("d", round(1 / 51, 4)), ("b", 0.0)]
