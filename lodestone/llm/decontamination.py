"""Benchmark decontamination: which documents contain a benchmark item, by size-partitioned MinHash sketches and exact shingles.

Words are runs of letters and digits, A-Z lower-cased; an item's shingles are its distinct five-word sequences, or its whole sequence if it has fewer
words. An item is contained in a document that has at least 80 % of its shingles.

Items are partitioned by size, a power of two of shingles each. An item's sketch is the least hashes of its shingles, one more than the number that may be
missing, so a document that contains the item has one of them at least, however long it is. The largest hash in a partition's sketches bounds
the documents' sketches for that partition: all their hashes up to it, so that a document's sketch grows with the document and a short item's is
found inside a long one (sketches of one size for both sides would have to tell Jaccard similarities of a thousandth). A document takes part only in the partitions whose
items are small enough for it. Sketches are joined on the hash, and each pair that meets is verified by the item's shingles as text.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, let, stable, staged, without

WORDS = 5
#: A document contains an item if it has so many hundredths of its shingles.
PERCENT = 80
_LEAST = -(1 << 63)


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _every(w: Column, size: int, make) -> Column:
    """make(i) for each place where size words of w begin."""
    return F.when(F.size(w) < size, F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - size), make))


def shingles(words: Column) -> Column:
    """An item's distinct shingles as text."""

    def of(w: Column) -> Column:
        long = F.array_distinct(_every(w, WORDS, lambda i: F.array_join(F.slice(w, i + 1, WORDS), " ")).cast("array<string>"))
        return F.when(F.size(w) >= WORDS, long).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return let(words, of)


def _grams(h: Column, n: int) -> Column:
    """A hash of each n words in sequence, from the words' hashes h."""
    return _every(h, n, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])).cast("array<bigint>")


def item_hashes(words: Column) -> Column:
    """A hash of each of an item's shingles, from the hashes of its words."""

    def of(h: Column) -> Column:
        out = F.when(F.size(h) >= WORDS, _grams(h, WORDS))
        for n in range(1, WORDS):
            out = out.when(F.size(h) == n, _grams(h, n))
        return out.otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda x: F.xxhash64(x)), of)


def sketch(words: Column, bounds: list[tuple[int, int, int]]) -> Column:
    """A document's hashes up to the bounds. bounds: (words in a shingle, shingles that a document needs, largest hash)."""

    def of(h: Column) -> Column:
        parts = []
        for n in sorted({b[0] for b in bounds}):
            most = F.lit(_LEAST)
            for _, needs, top in (b for b in bounds if b[0] == n):
                most = F.greatest(most, F.when(F.size(h) - (n - 1) >= needs, F.lit(top)).otherwise(F.lit(_LEAST)))
            parts.append(let(most, partial(upto, h, n)))
        return F.array_distinct(F.concat(*parts))

    def upto(h: Column, n: int, top: Column) -> Column:
        return F.filter(_grams(h, n), lambda x: x <= top)

    return let(F.transform(words, lambda x: F.xxhash64(x)), of)


def leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs: __rid and text_col. (__rid, __item_id, n_shingles, n_shared) for each document and item that it contains."""
    words = items.select(F.col(f"`{item_id}`").alias("__item_id"), words_of(F.col(f"`{item_text}`")).alias("__w")).where(F.size("__w") > 0)
    known = words.select("__item_id", F.least(F.size("__w"), F.lit(WORDS)).alias("__words"), shingles(F.col("__w")).alias("__shingles"), F.array_sort(F.array_distinct(item_hashes(F.col("__w")))).alias("__h"))
    known = staged(known.select(F.monotonically_increasing_id().alias("__item"), "*"), "items")
    size = F.size("__shingles")
    needs = F.ceil(size * PERCENT / 100).cast("int")
    sketches = known.select("__item", "__words", size.alias("size"), needs.alias("needs"), F.slice("__h", F.lit(1), size - needs + 1).alias("__sketch"))
    sketches = staged(sketches.select("__item", "__words", "size", "needs", F.explode("__sketch").alias("h")), "sketches")
    # partitions by size: 64 for five words, one for each smaller number of words
    bounds = sketches.groupBy("__words", F.floor(F.log2("size")).alias("part")).agg(F.min("needs").alias("needs"), F.max("h").alias("top")).collect()
    if not bounds:
        return known.limit(0).select(F.lit(0).cast("long").alias("__rid"), "__item_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_shared"))
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select("__rid", F.explode(sketch(words_of(text), [(b["__words"], b["needs"], b["top"]) for b in bounds])).alias("h"))
    # written once, so that its size is known: few pairs go to the texts, not texts to the pairs
    pairs = staged(own.join(sketches.select("h", "__item"), "h").select("__rid", "__item").distinct(), "leak-candidates")
    joined = docs.select("__rid", text.alias("__text")).join(pairs, "__rid").join(known.select("__item", "__item_id", "__shingles"), "__item")
    # word ends are spaces, so that a shingle is found as whole words only
    padded = joined.select("__rid", "__item_id", "__shingles", F.concat(F.lit(" "), F.array_join(words_of(F.col("__text")), " "), F.lit(" ")).alias("__t"))
    shared = let(F.col("__t"), lambda t: F.size(F.filter("__shingles", lambda s: F.contains(t, F.concat(F.lit(" "), s, F.lit(" "))))))
    counted = padded.select("__rid", "__item_id", F.size("__shingles").cast("long").alias("n_shingles"), shared.cast("long").alias("n_shared"))
    return staged(counted.where(100 * F.col("n_shared") >= PERCENT * F.col("n_shingles")), "leaks")


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_id, n_shingles, n_shared), one row for each row of docs and row of items that it contains.

    Texts are read whole. An item of fewer than five words is contained where its words stand in sequence; null, empty and wordless items are never contained; null and
    empty documents contain nothing. Repeated rows of either side each have their row; rows with null ids take part. An empty table on
    either side gives an empty table; other columns of either table play no part."""
    clean = stable(docs.select(F.col(f"`{id_col}`").alias("__doc"), F.col(f"`{text_col}`").alias("__of"))).withColumn("__rid", F.monotonically_increasing_id())
    found = leaks(clean.select("__rid", "__of"), items, "__of", item_id, item_text)
    return clean.select("__rid", "__doc").join(found, "__rid").select(F.col("__doc").alias(id_col), F.col("__item_id").alias(item_id), "n_shingles", "n_shared")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that contain no item, with their columns (but for one named __rid). Null and empty texts and repeated rows stay, or go, alike; without
    items all stay."""
    clean = stable(without(docs, ["__rid"])).withColumn("__rid", F.monotonically_increasing_id())
    return clean.join(leaks(clean, items, text_col, item_id, item_text).select("__rid").distinct(), "__rid", "left_anti").drop("__rid")


SQL = r"""
with d as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
b as (select row_number() over () as bid, item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
bs as (select distinct bid, item_id, array_to_string(w[i:i + k - 1], ' ') as s from (select bid, item_id, w, least(len(w), 5) as k, unnest(range(1, len(w) - least(len(w), 5) + 2)) as i from b where len(w) > 0)),
bn as (select bid, count(*) as n from bs group by bid),
ks as (select distinct least(len(w), 5) as k from b where len(w) > 0),
ds as (select distinct rid, doc_id, array_to_string(w[i:i + k - 1], ' ') as s from (select rid, doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k))
select doc_id, item_id, any_value(n)::bigint as n_shingles, count(*)::bigint as n_shared
from ds join bs using (s) join bn using (bid) group by rid, bid, doc_id, item_id having 100 * count(*) >= 80 * any_value(n)
"""
