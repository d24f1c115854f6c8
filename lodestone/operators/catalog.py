"""The catalog of files and chunks: views, change detection, upserts and deletes as whole-table rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def file_chunk_counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files with the number of their chunks, 0 for none. Chunks are counted before the join, so that it moves one row a file."""
    counted = chunks.groupBy("file_id").agg(F.count("chunk_id").alias("chunk_count"))
    return files.join(counted, "file_id", "left").select("file_id", "path", "size", "mtime", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "indexed_at")


def orphaned_fts(fts: DataFrame, chunks: DataFrame) -> DataFrame:
    return fts.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "path")


def missing_fts(chunks: DataFrame, files: DataFrame, fts: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "file_id").join(fts.select("chunk_id"), "chunk_id", "left_anti").join(files.select("file_id", "path"), "file_id").select("chunk_id", "path")


def db_stats(files: DataFrame, chunks: DataFrame, fts: DataFrame) -> DataFrame:
    """One row of totals."""
    one = files.agg(F.count("*").alias("total_files"), F.sum("size").alias("total_size_bytes"), F.max("indexed_at").alias("last_indexed")).withColumn("k", F.lit(1))
    two = chunks.agg(F.count("*").alias("total_chunks")).withColumn("k", F.lit(1))
    three = fts.agg(F.count("*").alias("total_fts_entries"), F.countDistinct("path").alias("unique_paths")).withColumn("k", F.lit(1))
    return one.join(two, "k").join(three, "k").select("total_files", "total_chunks", "total_fts_entries", "unique_paths", "total_size_bytes", "last_indexed")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of a new listing against the catalog: added, changed, unchanged or deleted. Files are compared by the hash of their bytes."""
    a = old.select("path", F.col("file_id").alias("old_id"), F.col("bytes_sha256").alias("old_hash"))
    b = new.select("path", F.col("file_id").alias("new_id"), F.col("bytes_sha256").alias("new_hash"))
    same = (F.col("old_id") == F.col("new_id")) & (F.col("old_hash") == F.col("new_hash"))
    status = F.when(F.col("new_id").isNull(), "deleted").when(F.col("old_id").isNull(), "added").when(same, "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row a path, the last indexed; of those the largest file_id."""
    w = Window.partitionBy("path").orderBy(F.desc("indexed_at"), F.desc("file_id"))
    return old.unionByName(new).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def replace_rows(old: DataFrame, new: DataFrame, gone: DataFrame, key: str = "file_id") -> DataFrame:
    """old without the rows of gone keys, and new."""
    return old.join(gone.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_files(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The tables (files, chunks, postings, lengths, vectors) without what belongs to the file_ids of gone."""
    ids = gone.select("file_id").distinct()
    lost = tables["chunks"].join(ids, "file_id", "left_semi").select("chunk_id")
    return {name: df.join(ids, "file_id", "left_anti") if "file_id" in df.columns else df.join(lost, "chunk_id", "left_anti") for name, df in tables.items()}


def recent(events: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """The n latest rows, with their time as text."""
    latest = events.orderBy(F.desc("timestamp"), *columns).limit(n)
    return latest.select(*columns, F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("timestamp_str"))


def bench_summary(runs: DataFrame) -> DataFrame:
    """By operation: runs, mean, least, largest and total seconds, cache hits."""
    return runs.groupBy("operation").agg(F.count("*").alias("runs"), F.avg("seconds").alias("mean_s"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"), F.sum("seconds").alias("total_s"), F.count_if("cache_hit").alias("cache_hits"))


def bench_compare(runs: DataFrame) -> DataFrame:
    """Each run's change in per cent against the run of the same operation before it; the first of an operation has none."""
    w = Window.partitionBy("operation").orderBy("timestamp", "run_id")
    before = F.lag("seconds").over(w)
    return runs.select("run_id", "operation", "seconds", before.alias("previous"), F.when(before > 0, (before - F.col("seconds")) / before * 100).alias("improvement"))
