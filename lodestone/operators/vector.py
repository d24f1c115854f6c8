"""Exact cosine search, and embedders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..storage import bounded_batches, give_back

#: Queries that are scored together, and that one task holds the best of; vectors that are taken together; the least number of tasks for a group of queries.
BLOCK, GROUP, ROWS, LEAST_PARTS = 256, 1024, 4096, 4


class Embedder(Protocol):
    dim: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashes of words, of length 1: a deterministic stand-in where no model is installed."""

    def __init__(self, dim: int = 384) -> None:
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embedded(chunks: DataFrame, embedder: Embedder, batch: int = 1024) -> DataFrame:
    """(chunk_id, embedding, path, file_id, idx): the embedder is called for batch texts at a time. Texts of a call that fails have no row, so that they are
    found by their words only."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(text: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(text), batch):
            part = list(text[at : at + batch])
            try:
                out += [list(map(float, v)) for v in embedder.embed(part)]
            except Exception:  # noqa: BLE001  a model may raise anything
                out += [None] * len(part)
        return pd.Series(out, dtype=object)

    return chunks.select("chunk_id", of("text").alias("embedding"), "path", "file_id", "idx").where("embedding is not null")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda n, x: n + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def nearest(vectors: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int = 300, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id_col, score): the k vectors of largest cosine with each query, exactly, ties by id. All queries are met in one pass over the vectors, as products
    of matrices BLOCK queries at a time; each task keeps only the best k of each query and sends them on once. More than GROUP queries are dealt in groups:
    each group meets every vector in a few tasks, whose rows are few beside those that any other partitioning of the vectors would send. Vectors of no length, or of
    another than the query's, score 0."""
    if not queries:
        return vectors.limit(0).select(F.lit(0).cast("long").alias("query_id"), id_col, F.lit(0.0).alias("score"))
    bounded_batches(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    groups, held = -(-len(queries) // GROUP), vectors.select(id_col, "embedding", F.lit(0).alias("g"))
    if groups > 1:
        parts = max(LEAST_PARTS, -(-vectors.sparkSession.sparkContext.defaultParallelism // groups))
        each = F.explode(F.array(*[F.lit(g) for g in range(groups)]))
        held = held.select(id_col, "embedding", each.alias("g")).repartitionById(groups * parts, (F.col("g") * parts + F.pmod(F.hash(id_col), F.lit(parts))).cast("int"))
    found = held.select(id_col, F.col("embedding").cast("array<double>"), "g").mapInArrow(_best(queries, k, id_col), f"query_id bigint, `{id_col}` {kind}, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return found.withColumn("score", F.round("score", 6)).withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


class _Top:
    """The best k of each of n queries among the vectors so far: scores, rounded, and numbers of ids, -1 for none."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.number = k, np.full((n, k), -np.inf), np.full((n, k), -1)

    def add(self, at: int, q: np.ndarray, score: np.ndarray, number: np.ndarray, rank: np.ndarray) -> None:
        """Scores of queries at + q. rank: places of the numbered ids among each other."""
        some = np.unique(q)
        held = self.number[at + some]
        old = held >= 0
        q = np.r_[q, np.repeat(some, old.sum(1))]
        score, number = np.r_[score, self.score[at + some][old]], np.r_[number, held[old]]
        order = np.lexsort((rank[number], -score, q))
        q, score, number = q[order], score[order], number[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.score[at + q[kept], place[kept]] = score[kept]
        self.number[at + q[kept], place[kept]] = number[kept]


def _best(queries: Sequence[tuple[int, Sequence[float]]], k: int, id_col: str):
    dim = max(len(v) for _, v in queries)
    asked = np.zeros((len(queries), dim))
    for row, (_, v) in zip(asked, queries, strict=True):
        row[: len(v)] = v
    norm = np.linalg.norm(asked, axis=1, keepdims=True)
    asked = asked / np.where(norm == 0, 1, norm)
    size = np.array([len(v) for _, v in queries])
    query_ids = np.array([i for i, _ in queries], np.int64)
    group, block, rows = GROUP, BLOCK, ROWS

    def units(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The vectors at length 1, and how many numbers each has."""
        sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        flat = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False))
        held = np.zeros((len(sizes), dim))
        fits = (sizes > 0) & (sizes <= dim)
        inside = np.repeat(fits, sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        held[row[inside], place[inside]] = flat[inside]
        norm = np.linalg.norm(held, axis=1, keepdims=True)
        return held / np.where(norm == 0, 1, norm), sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, _Top] = {}
        ids: dict[int, pa.Array] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                of = part.column(2).to_numpy(zero_copy_only=False)
                for g in np.unique(of).tolist():
                    mine = part.filter(pa.array(of == g))
                    lo, hi = g * group, min((g + 1) * group, len(size))
                    top = tops.setdefault(g, _Top(hi - lo, k))
                    first = len(ids.get(g, ()))
                    ids[g] = pa.concat_arrays([*([ids[g]] if g in ids else []), mine.column(0)])
                    rank = np.empty(len(ids[g]), np.int64)
                    rank[pc.sort_indices(ids[g]).to_numpy()] = np.arange(len(rank))
                    held, sizes = units(mine.column(1))
                    for at in range(lo, hi, block):
                        end = min(at + block, hi)
                        score = np.where(sizes[:, None] == size[at:end], held @ asked[at:end].T, 0.0)
                        # what rounding may make equal to the k-th stays, too
                        keep = score >= top.score[at - lo : end - lo, -1] - 2e-6
                        if len(score) > k:
                            keep &= score >= np.partition(score, len(score) - k, axis=0)[len(score) - k] - 2e-6
                        row, q = np.nonzero(keep)
                        if len(row):
                            s = score[row, q]
                            top.add(at - lo, q, np.sign(s) * np.floor(np.abs(s) * 1e6 + 0.5) / 1e6 + 0.0, first + row, rank)
        for g, top in tops.items():
            for at in range(0, len(top.score), block):
                q, n = np.nonzero(top.number[at : at + block] >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[g * group + at + q]), ids[g].take(pa.array(top.number[at + q, n])), pa.array(top.score[at + q, n])], names=["query_id", id_col, "score"])
        give_back()

    return run
