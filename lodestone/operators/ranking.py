"""Fusing the two candidate lists, one best chunk a file, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import SearchSettings
from ..functions.text import exact_match, position_bonus

#: So many candidates at most are broadcast.
CANDIDATES = 200_000
KEY = ["query_id", "chunk_id"]


def minmax(score: Column, by: str = "query_id") -> Column:
    """Scores of a query on 0 to 1; if all are the same they stay as they are."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, score).otherwise((score - low) / (high - low))


def fused(lexical: DataFrame, vector: DataFrame, chunks: DataFrame, queries: DataFrame, s: SearchSettings | None = None) -> DataFrame:
    """lexical, vector: (query_id, chunk_id, score), each at most a few hundred rows a query; queries: (query_id, query).
    The merged candidates with their chunk's columns, bm25, cosine, exact, position_bonus and score, the best merge_k of each query. The few candidates go to the chunks, so that no other chunk is moved."""
    s = s or SearchSettings()
    a = lexical.select(*KEY, minmax(F.col("score")).alias("bm25"))
    b = vector.select(*KEY, minmax(F.col("score")).alias("cosine"))
    merged = a.join(b, KEY, "full_outer").na.fill(0.0, ["bm25", "cosine"])
    if queries.count() * (s.lex_k + s.vec_k) <= CANDIDATES:
        merged = F.broadcast(merged)
    full = chunks.join(merged, "chunk_id").where(F.length("text") > 0).join(queries, "query_id")
    parts = full.withColumns({"exact": exact_match(F.col("query"), F.col("text")), "position_bonus": position_bonus(F.col("query"), F.col("text"))})
    total = s.bm25_weight * F.col("bm25") + s.cosine_weight * F.col("cosine") + s.exact_boost * F.col("exact") + s.early_pos_boost * F.col("position_bonus")
    return best(parts.withColumn("score", F.round(total, 6)), s.merge_k, ["query_id"])


def best(scored: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The n rows of largest score of each group, ties by chunk_id."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def best_by_file(scored: DataFrame, n: int = 1) -> DataFrame:
    return best(scored, n, ["query_id", "file_id"])


def paged(hits: DataFrame, page: int, per_page: int) -> DataFrame:
    """One page of ranked hits (query_id, chunk_id, score), with total_hits, total_pages, has_next and has_prev."""
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page must be positive")
    w = Window.partitionBy("query_id")
    placed = hits.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "chunk_id")).cast("long"), "total_hits": F.count("*").over(w)})
    pages = F.ceil(F.col("total_hits") / per_page).cast("long")
    return placed.where(F.col("rank").between((page - 1) * per_page + 1, page * per_page)).withColumns({"total_pages": pages, "has_next": F.lit(page) < pages, "has_prev": F.lit(page > 1)})
