"""URL filter: fixed host-and-path rules first, then association rules mined by FP-growth from labelled pages.

A URL is a set of tokens (host labels, path segments, extension, query keys; digits become #). Spark's FP-growth finds the frequent token
combinations of the pages with the bad label; how many labelled pages have each combination at all is then counted, over whole token sets. Where pages have too
many tokens for it, they are projected on single tokens first, and FP-growth goes over what is left of each projection. Combinations that imply
the bad label with enough confidence and support are rules, unless a shorter rule covers them. A rule stands in an inverted index under its rarest token: pages are exploded into their tokens,
joined to the index, and each rule that is met is verified by the page's tokens.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, stable, staged, without

#: (verdict, host and path): the host with its subdomains, and paths that start so; the longest that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SUPPORT, CONFIDENCE = 0.0005, 0.5
#: Bad pages that a rule needs at least, however few pages are labelled.
PAGES = 20
#: Tokens of one bad page up to which FP-growth goes over all their combinations, at most 2**ITEMS; pages with more are projected on each of their tokens first. No token is left out.
ITEMS = 16
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) as columns, null where none fits."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(said)) if verdict is None else verdict.when(fits, F.lit(said))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL; null or without "://": none."""

    def marked(parts: Column, mark: str) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "#")))

    path, query = path_of(url), F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])
    every = F.concat(marked(F.split(host_of(url), r"\."), "h:"), marked(F.split(path, "/"), "p:"), marked(F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), "x:"), marked(keys, "q:"))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def proposed(known: DataFrame, n: int, least: float, confidence: float = CONFIDENCE, items: int = ITEMS) -> DataFrame:
    """known: rid, tokens, bad. (rule: sorted array of tokens): at least all combinations that imply the bad label and of which no part does.

    A base is a combination, with the pages that have it and the tokens that may extend it; the first is empty. A token with which the base is a rule, or which all of its pages have,
    is in no longer rule with it: the rule would have a part that is one. FP-growth goes over the tokens that are left if no bad page has more than items of them; else each of
    them, the rarest first, makes a base with those after it."""
    rows = known.select(F.array().cast("array<string>").alias("base"), F.lit(n).cast("bigint").alias("n_base"), "rid", "bad", F.explode("tokens").alias("token"))
    found, baskets, empty = [], [], False
    while not empty:
        counts = rows.groupBy("base", "n_base", "token").agg(F.count("*").alias("n"), F.sum("bad").alias("hit")).where(F.col("hit") >= least)
        counts = staged(counts.withColumn("sure", F.col("hit") >= confidence * F.col("n")), "url-counts")
        found.append(counts.where("sure").select(F.concat("base", F.array("token")).alias("rule")))
        left = rows.join(counts.where("not sure and n < n_base").select("base", "token", "n"), ["base", "token"])
        left = staged(left.groupBy("base", "rid").agg(F.max("bad").alias("bad"), F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t")), "url-baskets")
        long = staged(left.where("bad = 1").groupBy("base").agg(F.max(F.size("t")).alias("most")).select(F.monotonically_increasing_id().alias("number"), "base", (F.col("most") > items).alias("long")), "url-bases")
        baskets.append((left.where("bad = 1").join(long.where("not long"), "base").select("number", "t"), long))
        first = left.join(long.where("long"), "base").select("base", "rid", "bad", "t", F.posexplode("t").alias("at", "first"))
        rows = first.select(F.concat("base", F.array("first.token")).alias("base"), F.col("first.n").alias("n_base"), "rid", "bad", F.explode(F.slice("t", F.col("at") + 2, F.size("t"))).alias("after")).select("base", "n_base", "rid", "bad", "after.token")
        empty = long.where("long").isEmpty()
    # one run for the bases of all rounds: an item is named by round, base and token, so that none of one base goes with those of another
    named = [(b.withColumn("of", of), long.select(of.alias("of"), "base")) for k, (b, long) in enumerate(baskets) for of in [F.concat(F.lit(f"{k},"), F.col("number").cast("string"))]]
    every = reduce(DataFrame.unionByName, [b for b, _ in named]).select(F.transform("t", lambda x: F.concat("of", F.lit(":"), x["token"])).alias("items"))
    every = staged(every, "url-tagged")
    grown = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, every.count()))).fit(every).freqItemsets.where(F.size("items") > 1)
    grown = grown.select(F.substring_index(F.col("items")[0], ":", 1).alias("of"), F.transform("items", lambda x: F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("more"))
    bases = reduce(DataFrame.unionByName, [base for _, base in named])
    found.append(grown.join(bases, "of").select(F.concat("base", "more").alias("rule")))
    return reduce(DataFrame.unionByName, found).select(F.array_sort("rule").alias("rule"))


def mine(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality", bad: int = 0, support: float = SUPPORT, confidence: float = CONFIDENCE, pages_at_least: int = PAGES, items: int = ITEMS) -> DataFrame:
    """(rule: sorted array of tokens, rarest: the token that fewest labelled pages have, confidence, support) of the token combinations that imply the bad label.

    Support is the share of labelled pages that have the combination and are bad. A combination of which a part is a rule isn't one. All combinations of all tokens
    of a page count, however many it has; items only decides where FP-growth begins. An id's label is bad if any of its rows has the bad one; rows with a null id, label or URL teach nothing."""
    marks = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).cast("bigint").alias("__id")).agg(F.max((F.col(label_col) == bad).cast("int")).alias("bad"))
    known = pages.select(F.col(id_col).cast("bigint").alias("__id"), tokens_of(F.col(url_col)).alias("tokens")).where(F.size("tokens") > 0).join(marks, "__id")
    known = staged(known.select(F.monotonically_increasing_id().alias("rid"), "tokens", "bad"), "url-labels")
    n = known.count()
    least = max(pages_at_least, support * n)
    counts = known.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).where(F.col("bad") >= least)
    of = proposed(known, n, least, confidence, items).select("rule", F.explode("rule").alias("token")).join(counts.select("token", "n"), "token").groupBy("rule").agg(F.min(F.struct("n", "token")).alias("r"))
    rules = staged(of.select(F.monotonically_increasing_id().alias("__rule"), "rule", F.col("r.token").alias("rarest")), "url-proposed")
    counted = met(known.select("tokens", "bad"), rules).groupBy("__rule").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    sure = counted.where((F.col("bad") >= least) & (F.col("bad") >= confidence * F.col("n"))).select("__rule", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / max(1, n)).alias("support"))
    sure = staged(rules.join(sure, "__rule"), "url-sure")
    covered = met(sure.select(F.col("rule").alias("tokens"), F.col("__rule").alias("longer")), sure.select("__rule", "rule", "rarest")).where("longer <> __rule").select(F.col("longer").alias("__rule")).distinct()
    return staged(sure.join(covered, "__rule", "left_anti").drop("__rule"), "url-rules")


def met(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows: tokens and more; rules: rule, rarest and more. Each row with each rule whose tokens it all has."""
    index = rules.withColumnRenamed("rarest", "__token")
    return rows.withColumn("__token", F.explode("tokens")).join(index, "__token").where(F.size(F.array_except("rule", "tokens")) == 0).drop("__token")


def matches(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens: rid, tokens. (rid, confidence of the surest rule that matches) for the rids that a rule matches."""
    return met(tokens, rules).groupBy("rid").agg(F.max("confidence").alias("bad_confidence"))


def judged(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict and bad_confidence (of the mined rule that blocks; null: none matches).

    A fixed rule's verdict comes first; else block if a mined rule matches, else allow. A null URL, or one without "://", has an empty host
    and path, no tokens, and is allowed. Repeated rows are judged alike; an empty table gives an empty table, and without labels
    nothing is mined. Columns that clash with the new ones are replaced."""
    clean = stable(without(pages, ["host", "path", "rule", "verdict", "bad_confidence", "rid"])).withColumn("rid", F.monotonically_increasing_id())
    found = matches(clean.select("rid", tokens_of(F.col(url_col)).alias("tokens")), mine(pages, labels, id_col, url_col))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    parts = clean.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}).join(found, "rid", "left")
    verdict = F.coalesce(said, F.when(F.col("bad_confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return parts.withColumns({"rule": rule, "verdict": verdict}).drop("rid")
