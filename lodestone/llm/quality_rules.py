"""Quality rules as a short-circuit cascade of column expressions.

Each rule rejects a text. On a sample, each rule's cost (seconds a row, those of an empty pass taken off) and what it rejects are measured; rules are then
tried in the order of rejections per cost, the rejections of each counted among the texts that all rules before it pass, and a rule is evaluated
only where all before it passed. The order changes the cost and which rule is named as the first that failed, never which texts are kept.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, let, staged, without, words_of

WINDOW = 5
#: Rows of the sample that costs and rejection rates are measured on.
SAMPLE = 2000
#: How often the sample is gone through for a rule's cost, so that the rows outweigh the start of a job.
TIMES = 8


def repeated_words(words: Column) -> Column:
    """Words that lie in a WINDOW-word window which occurs twice or more in the text, first occurrences included."""

    def covered(keys: Column) -> Column:
        pairs = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(p, i)["k"] == F.get(p, j)["k"], F.lit(False))
            return F.array_sort(F.transform(F.filter(p, lambda _, i: same(i, i - 1) | same(i, i + 1)), lambda x: x["i"]))

        def span(s: Column) -> Column:
            gaps = F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda n, x: n + x)

        return let(pairs, lambda p: let(starts(p), span))

    def of(w: Column) -> Column:
        # a window's key: the hash of its words, each word hashed once
        def keyed(h: Column) -> Column:
            keys = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
            return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k)))

        return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), keyed))

    return let(words, of).cast("long")


def counts(text: Column, words: Column) -> dict[str, Column]:
    """The base counts; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


#: Rules of the cascade by name, as SQL over the base counts and text: true rejects. Integers only, so that every engine agrees.
RULES = {
    "words_too_short": "word_chars < 2 * n_words",
    "words_too_long": "word_chars > 20 * n_words",
    "too_many_symbols": "10 * n_symbols > 3 * n_words",
    "too_many_dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "mostly_capitals": "2 * n_capitals > n_letters",
    "few_words_with_letters": "2 * n_letter_words < n_words",
    "few_distinct_words": "20 * n_distinct_words < n_words",
    "too_many_open_lines": "10 * n_open_lines > 3 * n_lines",
}
#: What only the rules need; evaluated where a rule asks for it.
PARTS = {
    "n_lines": lambda t: F.regexp_count(t, F.lit("\n")) + 1,
    "n_capitals": lambda t: F.length(F.regexp_replace(t, "[^A-Z]", "")),
    "n_letters": lambda t: F.length(F.regexp_replace(t, "[^A-Za-z]", "")),
    "n_letter_words": lambda t: F.size(F.filter(words_of(t), lambda w: w.rlike(r"[A-Za-z]|[^\x00-\x7F]"))),
    "n_distinct_words": lambda t: F.size(F.array_distinct(words_of(t))),
    "n_open_lines": lambda t: F.size(F.filter(F.split(t, "\n"), lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("\u2026")))),
}


def _rule(name: str, text: Column) -> Column:
    """The rule as a column: parts that it names become expressions over text."""
    left, sign, right = re.fullmatch(r"(.+) ([<>]) (.+)", RULES[name]).groups()

    def side(said: str) -> Column:
        m = re.fullmatch(r"(?:(\d+) \* )?(\w+)", said)
        value = PARTS[m[2]](F.coalesce(text, F.lit(""))) if m[2] in PARTS else F.col(m[2])
        return value * int(m[1]) if m[1] else value

    return side(left) < side(right) if sign == "<" else side(left) > side(right)


def measure(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(rule, share of the texts that it rejects among those that the rules before it pass, seconds a row), in the order to try, on a sample of about that many
    rows that pass the base rules."""
    small = docs.select(text_col)
    share = min(1.0, rows / max(1, small.count()))
    # written once, so that only the rules are timed
    part = staged(with_counts(small.sample(share, seed=11), text_col).where("not base_failed"), "rule-sample")
    rules = {name: F.coalesce(_rule(name, F.col(text_col)), F.lit(False)) for name in RULES}
    seen = [(r["count"], {n for n in RULES if r[n]}) for r in part.groupBy(*[c.alias(n) for n, c in rules.items()]).count().collect()]  # 2**rules groups at most
    many = part.withColumn("__time", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def seconds(rule) -> float:
        begun = time.perf_counter()
        many.agg(F.count_if(rule & F.col(text_col).isNotNull())).first()
        return time.perf_counter() - begun

    seconds(F.lit(True))
    empty, total = seconds(F.lit(True)), max(1, TIMES * sum(n for n, _ in seen))
    cost = {name: max((seconds(c) - empty) / total, 1e-9) for name, c in rules.items()}
    return in_order(seen, cost)


def in_order(seen: list[tuple[int, set[str]]], cost: dict[str, float]) -> list[tuple[str, float, float]]:
    """seen: (rows, the rules that reject them). The rule of most rejections per cost first, then that among the rows which are left, and so on; ties by cost and name."""
    left, out, names = list(seen), [], sorted(cost)
    while names:
        rows = max(1, sum(n for n, _ in left))
        rate = {name: sum(n for n, by in left if name in by) / rows for name in names}
        best = min(names, key=lambda x: (-rate[x] / cost[x], cost[x], x))
        out.append((best, rate[best], cost[best]))
        names.remove(best)
        left = [(n, by) for n, by in left if best not in by]
    return out


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base counts and base_failed; columns that clash with these are replaced."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "first_failed"]
    clean = without(docs, names).withColumn("__words", words_of(F.col(text_col)))
    out = clean.select("*", *[v.alias(k) for k, v in counts(F.col(text_col), F.col("__words")).items()]).drop("__words")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def judged(docs: DataFrame, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """docs with the base counts, base_failed, kept, and first_failed (the first failing rule in the order tried; null: kept).

    Null, empty and blank texts have no words and fail the base rules. Texts are read whole. Repeated rows are judged alike;
    an empty table gives an empty table; no row needs another row, so nothing is shuffled. order: names of RULES, else measured."""
    order = order or [name for name, _, _ in measure(docs, text_col)]
    based = with_counts(docs, text_col)
    failed = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        failed = failed.when(_rule(name, F.col(text_col)), F.lit(name))
    return based.withColumn("first_failed", failed).withColumn("kept", F.col("first_failed").isNull())


SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
        row_number() over () as rid from t),
g as (select rid, unnest(range(1, len(words) - 3)) as i, words from w where len(words) >= 5),
k as (select rid, i, array_to_string(words[i:i + 4], ' ') as gram from g),
d as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) as n from k) where n > 1),
c as (select rid, sum(least(5, coalesce(nxt - i, 5)))::bigint as covered from (select rid, i, lead(i) over (partition by rid order by i) as nxt from d) group by rid),
b as (select doc_id, text, words, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered, 0)::bigint as n_repeat_words
      from w left join c using (rid)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
        length(text) - length(replace(text, chr(10), '')) + 1 as n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_capitals,
        length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as n_letters,
        len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) as n_letter_words, len(list_distinct(words)) as n_distinct_words,
        len(list_filter(string_split(text, chr(10)), lambda x: suffix(x, '...') or suffix(x, '…'))) as n_open_lines from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (""" + " or ".join(f"({r})" for r in RULES.values()) + r""") as kept from f
"""
