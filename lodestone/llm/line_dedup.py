"""Repeated runs of lines, by a suffix array over line numbers: later copies are deleted.

A text is the sequence of its lines that aren't blank, each line under a 128-bit name (two hashes). Distributed prefix doubling sorts
all suffixes of all these sequences by ever longer prefixes: a position's rank among the prefixes of twice as many lines comes from the pair of its own rank and
that of the position so many lines later in its text. Ranks are numbers of the sorted distinct pairs, so they keep the suffixes' order. Positions of one rank are an interval of the suffix array whose
longest common prefix has at least that many lines; intervals of one position are left out, and so is what follows from them, until none is
left. In each interval of LINES or more lines the first position, by document id, stays; the runs of all others are later copies. Their union in
each text, with runs that meet or overlap as one, is deleted, so every maximal repeated run is, however long.

A shorter repeated run stays, unless a least length is given for single lines: then a line of so many words is a run of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import HEAVY, SPACE, let, looked_up, stable, staged, without, words_of

LINES = 2
#: Words from which the pipeline takes a single line for a run.
LONG = 50


def _numbered(text: Column) -> Column:
    """(x: line, at: its place among all lines) of the lines that aren't blank."""
    every = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("at")))
    return F.filter(every, lambda s: s["x"].rlike(f"[^{SPACE}]"))


def _positions(docs: DataFrame, long: int | None) -> DataFrame:
    """docs: __rid, __order, __lines. __at (order, row, ordinal of the line), the line's name and whether it is long."""
    is_long = F.lit(False) if long is None else (F.length("x") >= 2 * long - 1) & (F.size(words_of(F.col("x"))) >= long)
    every = docs.select("__rid", "__order", F.posexplode(F.transform("__lines", lambda s: s["x"])).alias("i", "x"))
    return every.select(F.struct("__order", "__rid", "i").alias("__at"), F.xxhash64(F.lit("a"), "x").alias("k1"), F.xxhash64(F.lit("b"), "x").alias("k2"), is_long.alias("long"))


def _ranked(positions: DataFrame) -> tuple[DataFrame, int]:
    """positions: __at, k1, k2, long. Those whose pair of keys occurs twice or more, with its rank and whether a position before has it, too; and how many."""
    intervals = positions.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("__at").alias("first")).where("n > 1")
    intervals = intervals.repartitionByRange("k1", "k2").sortWithinPartitions("k1", "k2").withColumn("rank", F.monotonically_increasing_id())
    intervals = staged(intervals, "line-intervals")
    total = intervals.agg(F.sum("n")).first()[0] or 0
    if not total:
        return positions.limit(0), 0
    both = looked_up(positions, intervals, ["k1", "k2"], ["rank", "first"], "n", total, HEAVY).where("found is not null")
    return staged(both.select("__at", "long", F.col("found.rank").alias("rank"), (F.col("__at") > F.col("found.first")).alias("later")), "line-ranks"), total


def later_copies(positions: DataFrame, size: int, single: bool) -> DataFrame:
    """(__rid, i, span): runs of span lines from line i that occur before. positions as from _positions; single: also long lines by themselves."""
    active, n = _ranked(positions)
    runs, have = [], 1
    if n and (size == 1 or single):
        runs.append(active.where("later" if size == 1 else "later and long").select("__at", F.lit(1).alias("span")))
    while n:
        step = have if have >= size else min(have, size - have)  # the last step to size overlaps where size is no power of two
        after = Window.partitionBy("__at.__rid").orderBy("__at.i").rangeBetween(step, step)
        pairs = active.select("__at", F.col("rank").alias("k1"), F.first("rank").over(after).alias("k2"), "long").where("k2 is not null")
        active, n = _ranked(pairs)
        have += step
        if n and have >= size:
            runs.append(active.where("later").select("__at", F.lit(have).alias("span")))
    every = positions.select("__at", F.lit(1).alias("span")).limit(0)
    for r in runs:
        every = every.union(r)
    return every.select("__at.__rid", "__at.i", "span")


def merged(runs: DataFrame) -> DataFrame:
    """(__rid, __runs: sorted array of (lo, hi)) of runs (__rid, i, span), those of a row that meet or overlap as one."""
    w = Window.partitionBy("__rid").orderBy("i", "span")
    ends = runs.withColumn("end", F.col("i") + F.col("span")).withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    parts = ends.withColumn("part", F.sum(F.when(F.col("i") <= F.col("before"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = parts.groupBy("__rid", "part").agg(F.min("i").alias("lo"), F.max("end").alias("hi"))
    return one.groupBy("__rid").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("__runs"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = LINES, long: int | None = None, counts: bool = True) -> DataFrame:
    """docs with the later copies of repeated runs of size or more lines, and of single lines of long or more words, deleted from the texts; if counts, with
    n_lines (lines that aren't blank), n_removed and n_runs (maximal deleted runs), which replace columns that clash with them.

    Lines are equal if all their characters are. "Later" is by id (null ids last), then by row, then by place, so copies within one
    text count, too, and of repeated rows the first keeps its lines. Blank lines stay where they are; a text that
    loses all its other lines becomes empty; a null text stays null and has no lines; texts are read whole. An empty table gives an empty table."""
    clean = stable(without(docs, ["n_lines", "n_removed", "n_runs"] if counts else []))
    own = [f"`{c}`" for c in clean.columns]
    rows = clean.select(F.struct(*own).alias("__row"), F.col(f"`{text_col}`").cast("string").alias("__text"), F.col(f"`{id_col}`").alias("__id"), F.monotonically_increasing_id().alias("__rid"))
    order = F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"))
    positions = _positions(rows.select("__rid", order.alias("__order"), _numbered(F.col("__text")).alias("__lines")), long)
    gone = merged(later_copies(positions, size, long is not None))
    joined = rows.join(gone.withColumnRenamed("__rid", "__gone_rid"), F.col("__rid") == F.col("__gone_rid"), "left").withColumn("__lines", _numbered(F.col("__text")))
    ordinals = F.flatten(F.transform("__runs", lambda r: F.sequence(r["lo"], r["hi"] - 1)))
    n, removed = F.size("__lines"), F.aggregate("__runs", F.lit(0), lambda k, r: k + r["hi"] - r["lo"])
    every = F.split("__text", "\n")
    left = F.array_except(F.transform(every, lambda x, i: i), F.transform(ordinals, lambda o: F.get(F.col("__lines"), o)["at"]))
    text = F.when(F.col("__runs").isNull(), F.col("__text")).when(removed == n, F.lit("")).otherwise(let(every, lambda a: F.array_join(F.transform(left, lambda i: F.get(a, i)), "\n")))
    made = [n.cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.when(F.col("__runs").isNotNull(), F.size("__runs")), F.lit(0)).cast("long").alias("n_runs")]
    return joined.select(*[text.alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in clean.columns], *(made if counts else []))


SQL = r"""
with t as (select row_number() over (order by doc_id) as rid, doc_id, coalesce(text, '') as text from documents),
a as (select rid, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from t),
l as (select rid, pos, line, row_number() over (partition by rid order by pos) as o from a where regexp_matches(line, '[^\x20\x09-\x0D]')),
r as (select rid, o, line, lead(line) over (partition by rid order by o) as next from l),
x as (select rid, o, row_number() over (partition by line, next order by rid, o) as k from r where next is not null),
g as (select distinct rid, o + d as o from x, (values (0), (1)) as v(d) where k > 1),
m as (select a.rid, a.pos, a.line, l.o, g.o as gone from a left join l using (rid, pos) left join g on g.rid = l.rid and g.o = l.o),
s as (select rid, pos, line, o, gone, gone is not null and coalesce(lag(gone) over (partition by rid order by o nulls last), -9) <> gone - 1 as opens from m),
c as (select rid, count(o) as n_lines, count(gone) as n_removed, count(*) filter (opens) as n_runs,
  case when count(o) = count(gone) and count(o) > 0 then '' else coalesce(string_agg(line, chr(10) order by pos) filter (gone is null), '') end as kept from s group by rid)
select doc_id, n_lines, n_removed, n_runs, sha256(kept) as kept_sha256 from t join c using (rid)
"""
