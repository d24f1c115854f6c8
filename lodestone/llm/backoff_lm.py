"""Language-model scores of documents by stupid backoff over word triples, pairs and words, from counts over all other documents.

Words are as everywhere here, A-Z lower-cased; a text starts with two empty words. With c the counts in all other rows, a word w after
u v scores c(u v w) / c(u v) if that triple occurs there, else ALPHA c(v w) / c(v) if that pair does, else ALPHA**2 c(w) / N, where a word that
no other row has counts as seen once. A document's score is the mean logarithm over its words. Every count is exact, nothing is pruned.

The count tables of all three orders are partitioned by the range of the grams' 64-bit hashes. Documents are taken together in parts; each
part's distinct grams, with their counts, go to the tables, are joined and summed there, and what other parts have goes back to the part, where it meets
the documents (as word numbers), is put under every word and summed by document. A gram comes once from each
part, so that no gram is a hot key. Rows travel in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .blocks import RANGES, SCHEMA, Row, batched, dealt, edges_of, grouped, labels, mixed, n_ranges, own_bucket, pack, range_bucket, ranged, unpack
from .common import bounded_batches, stable, staged, without

ALPHA = 0.4
#: Words that a part takes together; a longer text is a part of its own.
AT_ONCE = 1_500_000
_U = np.uint64


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()  # of bytes: A-Z only; splits at space and U+0009 to U+000D


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def parts(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row ids, numbers of words, words as numbers, hashes of the numbered words) of consecutive texts. The same in each use of a table."""
    rids, sizes, ids, numbers, held = [], [], [], _Numbers(), 0

    def out():
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, held)
        return np.array(rids, np.int64), np.array(sizes, np.int64), flat, np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))

    for batch in batches:
        for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(text.as_py() or b"")
            if rids and (held + len(words) > at_once or len(rids) >= at_once):
                yield out()
                rids, sizes, ids, numbers, held = [], [], [], _Numbers(), 0
            rids.append(rid)
            sizes.append(len(words))
            ids.append(list(map(numbers.__getitem__, words)))
            held += len(words)
    if rids:
        yield out()


class Grams:
    """The grams of a part. Word 0 is the empty one, others are numbered from 1. one, two, three: number of the gram that ends at each
    place; places hold the two empty words of each text that has words, then its words."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray, hashes: np.ndarray) -> None:
        self.text = np.flatnonzero(sizes)
        size = sizes[self.text]
        self.of = np.repeat(np.arange(len(size)), size + 2)
        first = np.cumsum(size + 2) - (size + 2)
        self.is_word = np.ones(len(self.of), bool)
        self.is_word[first] = self.is_word[first + 1] = False
        self.one = np.zeros(len(self.of), np.int64)
        self.one[self.is_word] = flat.astype(np.int64) + 1
        self.counts_one = np.bincount(self.one, minlength=len(hashes) + 1)
        self.counts_one[0] = len(size)
        self.ends_two = np.ones(len(self.of), bool)
        self.ends_two[first] = False
        k = np.flatnonzero(self.ends_two)
        self.two = np.zeros(len(self.of), np.int64)
        two, self.two[k], self.counts_two = np.unique(self.one[k - 1] << 32 | self.one[k], return_inverse=True, return_counts=True)
        k = np.flatnonzero(self.is_word)
        self.three = np.zeros(len(self.of), np.int64)
        three, self.three[k], self.counts_three = np.unique(self.two[k - 1] << 32 | self.one[k], return_inverse=True, return_counts=True)
        low = (1 << 32) - 1
        w = mixed(np.concatenate((np.array([xxhash.xxh64_intdigest(b"")], np.uint64), hashes)))
        h2 = mixed(w[two >> 32] * _U(0x9E3779B97F4A7C15) + w[two & low])
        h3 = mixed(h2[three >> 32] * _U(0xD6E8FEB86659FD93) + w[three & low])
        self.hashes = np.concatenate((w, h2, h3))
        self.counts = np.concatenate((self.counts_one, self.counts_two, self.counts_three))
        self.order = np.argsort(self.hashes)


def _asked(names: np.ndarray, ranges: int, at_once: int):
    """Texts to the grams of each part, by range of the tables: (part, hashes as differences, counts)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        for rids, sizes, flat, hashes in parts(batches, at_once):
            if not len(flat):
                continue
            g = Grams(sizes, flat, hashes)
            h, n = g.hashes[g.order], g.counts[g.order].astype(np.uint32)
            at = ranged(h, ranges)
            edges = edges_of(at)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                r = int(at[lo])
                yield range_bucket(names, ranges, r), r, 0, pack(rids[:1], np.diff(h[lo:hi], prepend=_U(0)), n[lo:hi])

    return lambda batches: batched(made(batches))


def _answered(names: np.ndarray):
    """Rows by range to what each part lacks: the counts of its grams in all other parts, in the order that it asked in."""

    def answers(at: int, blocks: list[bytes]) -> Iterator[Row]:
        asked = [unpack(b, np.int64, np.uint64, np.uint32) for b in blocks]
        h = np.concatenate([np.cumsum(a[1]) for a in asked])
        n = np.concatenate([a[2] for a in asked]).astype(np.int64)
        order = np.argsort(h)
        new = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        total = np.empty(len(h), np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], new), np.diff(np.append(new, len(h))))
        others, end = total - n, 0
        for rid, own, _ in asked:
            part = others[end : end + len(own)]
            end += len(own)
            yield own_bucket(names, int(rid[0])), int(rid[0]), at, pack(part)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        for at, blocks in grouped(batches):
            yield from answers(at, [b for _, b in blocks])

    return lambda batches: batched(made(batches))


def _texts(names: np.ndarray, at_once: int):
    """Texts to parts as word numbers, for where their answers go; they come before these."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        for rids, sizes, flat, hashes in parts(batches, at_once):
            yield own_bucket(names, int(rids[0])), int(rids[0]), -1, pack(np.diff(rids, prepend=rids[:1]), sizes, flat, hashes)

    return lambda batches: batched(made(batches))


def _within(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often each place's gram occurs in its text."""
    _, at, n = np.unique(of << 32 | ids, return_inverse=True, return_counts=True)
    return n[at]


def _sums(first: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    rids, sizes, flat, hashes = unpack(rows[0][1], np.int64, np.int64, np.uint32, np.uint64)
    log, words, backed = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    if len(flat):
        g = Grams(sizes, flat, hashes)
        total = g.counts.astype(np.int64)
        total[g.order] += np.concatenate([unpack(raw, np.int64)[0] for _, raw in rows[1:]])
        one, two, three = np.split(total, np.cumsum((len(g.counts_one), len(g.counts_two))))
        k = np.flatnonzero(g.is_word)
        of = g.of[k]
        # counts in all other texts: those of all less those of this one
        c1 = one[g.one]
        c1[k] -= _within(g.one[k], of)
        c1[~g.is_word] -= 1
        c2, ends = two[g.two], np.flatnonzero(g.ends_two)
        c2[ends] -= _within(g.two[ends], g.of[ends])
        c3 = three[g.three[k]] - _within(g.three[k], of)
        after, pair, context = c2[k - 1], c2[k], c1[k - 1]
        value = np.where(c3 > 0, c3 / np.maximum(after, 1), np.where(pair > 0, ALPHA * pair / np.maximum(context, 1), ALPHA**2 * np.maximum(c1[k], 1)))
        n = len(g.text)
        log[g.text] = np.bincount(of, np.log(value), n)
        backed[g.text] = np.bincount(of, c3 == 0, n).astype(np.int64)
        words[g.text] = np.bincount(of, (c3 == 0) & (pair == 0), n).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.cumsum(rids) + first), pa.array(log), pa.array(sizes), pa.array(backed), pa.array(words)], names=["rid", "log", "n_words", "n_backoff", "n_single"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for first, rows in grouped(batches):
        yield _sums(first, rows)


def scored(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_backoff (words whose triple no other row has) and lm_score.

    Texts are read whole; counts are over all rows, so that of repeated rows each is among the others' texts. Null, empty and blank texts have no words
    and a null score; the words of a table's only text all count as seen once, of one word. Memory of a task grows with its longest text, about 200 bytes a word. An
    empty table gives an empty table; columns that clash with the new ones are replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    clean = stable(without(docs, ["n_words", "n_backoff", "lm_score", "__rid"])).withColumn("__rid", F.monotonically_increasing_id())
    texts = clean.select("__rid", F.col(f"`{text_col}`").cast("string").cast("binary").alias("t"))
    names = labels(spark)
    n, ranges = len(names), n_ranges(names, RANGES)
    answers = dealt(texts.mapInArrow(_asked(names, ranges, AT_ONCE), SCHEMA), n).mapInArrow(_answered(names), SCHEMA)
    both = dealt(answers.union(texts.mapInArrow(_texts(names, AT_ONCE), SCHEMA)), n)
    sums = staged(both.mapInArrow(_met, "rid bigint, log double, n_words bigint, n_backoff bigint, n_single bigint"), "lm-sums")
    total = sums.agg(F.sum("n_words")).first()[0] or 0
    rest = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1))
    mean = F.round((F.col("log") - F.col("n_single") * F.log(rest)) / F.col("n_words"), 6)
    named = clean.join(sums.withColumn("lm_score", F.when(F.col("n_words") > 0, mean)), F.col("__rid") == F.col("rid"))
    return named.select(*[F.col(f"`{c}`") for c in clean.columns if c != "__rid"], "n_words", "n_backoff", "lm_score")


SQL = r"""
with d as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
p as (select rid, unnest(list_concat(['', ''], w)[:-3]) as u, unnest(list_prepend('', w)[:-2]) as v, unnest(w) as w from d where len(w) > 0),
g as (select rid, w as x, null as y, null as z from p union all select rid, v, w, null from p union all select rid, u, v, w from p
  union all select rid, '', null, null from d where len(w) > 0 union all select rid, '', '', null from d where len(w) > 0),
own as (select rid, x, y, z, count(*) as n from g group by all),
c as (select rid, x, y, z, sum(n) over (partition by x, y, z) - n as n from own),
n as (select count(*) as n from p), size as (select rid, count(*) as n from p group by rid),
s as (select p.rid, case when c3.n > 0 then ln(c3.n::double / c2.n::double) when b2.n > 0 then ln(0.4::double * b2.n::double / b1.n::double) else ln(0.4::double * 0.4::double * greatest(c1.n, 1)::double / greatest(n.n - size.n, 1)::double) end as l, c3.n = 0 as backed
  from p, n join size on size.rid = p.rid
  join c c3 on c3.rid = p.rid and c3.x = u and c3.y = v and c3.z = w
  join c c2 on c2.rid = p.rid and c2.x = u and c2.y = v and c2.z is null
  join c b2 on b2.rid = p.rid and b2.x = v and b2.y = w and b2.z is null
  join c b1 on b1.rid = p.rid and b1.x = v and b1.y is null
  join c c1 on c1.rid = p.rid and c1.x = w and c1.y is null),
t as (select rid, sum(l) as l, count(*) filter (backed) as b, count(*) as n from s group by rid)
select doc_id, coalesce(n, 0)::bigint as n_words, coalesce(b, 0)::bigint as n_backoff, round(l / n, 6) as lm_score from d left join t using (rid)
"""
