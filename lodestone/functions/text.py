"""Words, matches and snippets, as column expressions. Positions count code points from 0 unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: What counts as white space (as Python's str.split has it), and as a word character.
SPACES = r"\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"
#: Letters that SQL's upper() turns into one letter or leaves, where Spark's upper() writes several or a capital of Unicode 16.
CAPITALS = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1} | {"ß": "ẞ"}
CAPITALS |= {c: c for c in ["ƛ", "ɤ", "\u1c8a", "\ua7cd", "\ua7db", *map(chr, range(0x10D70, 0x10D86))]}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def upper(text: Column) -> Column:
    """Capitals letter for letter, as SQL has them: no text gets longer."""
    held = "".join(CAPITALS)
    parts = F.split(text, f"(?<=[{held}])|(?=[{held}])")
    kept = F.create_map(*[F.lit(x) for pair in CAPITALS.items() for x in pair])
    return F.when(text.rlike(f"[{held}]"), F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(kept, p), F.upper(p))), "")).otherwise(F.upper(text))


def clean_query(query: Column) -> Column:
    """Lower case, everything but word characters and white space as a space, white space squeezed."""
    return squeezed(F.regexp_replace(F.lower(query), f"[^{WORD}{SPACES}]", " "))


def clean_query_text(query: str) -> str:
    """clean_query of a query that the driver holds."""
    return " ".join(re.sub(r"[^\w\s]", " ", query.lower()).split())


def exact_match(query: Column, text: Column) -> Column:
    """1 if the text has the query as it stands, else the share of the query's distinct words that it has, if 0.7 or more, else 0."""

    def of(q: Column) -> Column:
        asked = F.array_distinct(words_of(q))
        share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words_of(F.lower(text)))) / F.size(asked)).otherwise(F.lit(0.0))
        return F.when(F.contains(F.lower(text), q), F.lit(1.0)).otherwise(let(share, lambda s: F.when(s >= 0.7, s).otherwise(F.lit(0.0))))

    return let(F.lower(stripped(query)), of)


def position_bonus(query: Column, text: Column) -> Column:
    """1 less the relative position of the query's first place in the text, if that is 0.3 or less, else 0; absent: 0."""
    at = F.instr(F.lower(text), F.lower(stripped(query))) - 1
    ratio = at / F.greatest(F.length(text), F.lit(1))
    return F.when((at >= 0) & (ratio <= 0.3), 1 - ratio).otherwise(F.lit(0.0))


def best_match(text: Column, query: Column) -> Column:
    """Where the query is in the text, else where the earliest of its words is, else -1; letters of either case."""
    low = F.lower(text)
    single = F.array_min(F.filter(F.transform(words_of(F.lower(query)), lambda w: F.instr(low, w)), lambda p: p > 0))
    return F.when(F.instr(low, F.lower(query)) > 0, F.instr(low, F.lower(query))).otherwise(F.coalesce(single, F.lit(0))) - 1


def make_snippet(text: Column, query: Column, radius: int = 50) -> Column:
    """Struct of snippet, start and end: radius characters on either side of the match, with ... where the text goes on; without a match the start of the text."""
    n = F.length(text)

    def around(at: Column) -> Column:
        lo, hi = F.greatest(F.lit(0), at - radius), F.least(n, at + F.length(query) + radius)
        body = F.concat(F.when(lo > 0, "...").otherwise(""), F.substring(text, lo + 1, hi - lo), F.when(hi < n, "...").otherwise(""))
        return F.struct(body.alias("snippet"), lo.alias("start"), hi.alias("end"))

    begin = F.struct(F.substring(text, 1, 2 * radius).alias("snippet"), F.lit(0).alias("start"), F.least(F.lit(2 * radius), n).alias("end"))
    return let(best_match(text, query), lambda at: F.when((at < 0) | (F.length(stripped(query)) == 0) | (n == 0), begin).otherwise(around(at)))


def truncate_snippet(snippet: Column, length: int = 200) -> Column:
    """At most so many characters, cut at the last space if that lies in the last fifth, and then ... ."""
    cut = F.substring(snippet, 1, length)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    whole = F.when((F.instr(cut, " ") > 0) & (space > int(length * 0.8)), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(snippet) <= length, snippet).otherwise(F.concat(whole, F.lit("...")))


def highlight(snippet: Column, query: str) -> Column:
    """The query's words, as whole words, between double asterisks."""
    asked = "|".join(rf"\Q{w}\E" for w in query.split())
    return F.regexp_replace(snippet, rf"(?iU)\b({asked})\b", "**$1**") if asked else snippet


def file_type(path: Column) -> Column:
    """From the suffix, as it is written."""
    kinds = {"markdown": ("md", "markdown"), "pdf": ("pdf",), "text": ("txt", "text"), "html": ("htm", "html"), "document": ("doc", "docx")}
    out = None
    for kind, ends in kinds.items():
        has = F.regexp_extract(path, r"\.([^./]*)$", 1).isin(*ends)
        out = F.when(has, kind) if out is None else out.when(has, kind)
    return out.otherwise("unknown")


def extension(path: Column) -> Column:
    """The lower-cased suffix with its dot, or nothing."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def sanitize_path(path: Column) -> Column:
    return F.btrim(F.regexp_replace(path, r'[<>:"|?*]', "_"), F.lit(" ."))
