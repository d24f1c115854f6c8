"""Timing an engine: index a folder, search it, keep the figures in a CSV history and compare a run with the one before."""

from __future__ import annotations

import argparse
import json
import shutil
import tempfile
import time
from collections.abc import Sequence
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import load_config
from .engine import Engine
from .operators.catalog import bench_compare
from .storage import Store

HISTORY = "timestamp long, operation string, files_indexed long, chunks_indexed long, t_index double, t_search_hybrid double, t_search_vec double, t_search_lex double, test_paths string, queries string"
QUERIES = ("city walls", "river trade", "stone bridges", "harbour lights")
#: A small corpus, so that the harness can run where there are no files to index.
SAMPLE = {
    "rivers.md": "# Rivers\n\nRiver trade grew with stone bridges.\nBarges carried salt, timber and grain between the towns.",
    "walls.txt": "City walls were raised in haste and mended for centuries.\nGates closed at dusk.",
    "harbour.html": "<html><body><h1>Harbour</h1><p>Harbour lights guided ships past the river mouth.</p></body></html>",
}


def sample_corpus(folder: str | None = None) -> str:
    """Writes the sample files into a folder, a new temporary one if none is given, and returns it."""
    root = Path(folder or tempfile.mkdtemp(prefix="bench-"))
    root.mkdir(parents=True, exist_ok=True)
    for name, text in SAMPLE.items():
        (root / name).write_text(text, encoding="utf-8")
    return str(root)


def timed(call) -> tuple[float, object]:
    begun = time.perf_counter()
    out = call()
    return time.perf_counter() - begun, out


def index_run(engine: Engine, roots: Sequence[str], max_items: int | None = None) -> dict:
    """A full pass over the roots, or with max_items an incremental one in slices."""
    took, found = timed(lambda: engine.index(roots) if max_items is None else [engine.index_incremental(r, max_items=max_items) for r in roots])
    there = bool(engine.store.versions())
    totals = engine.status() if there else {"total_files": 0, "total_chunks": 0, "total_errors": 0}
    return {"timestamp": int(time.time()), "operation": "indexing", "files_indexed": totals["total_files"], "chunks_indexed": totals["total_chunks"], "errors": totals["total_errors"], "outcomes": found, "t_index": took, "test_paths": ",".join(roots)}


def search_run(engine: Engine, queries: Sequence[str], k: int = 10) -> dict:
    """Each query once cold (nothing remembered), after one that warms the engine up; then once again from the cache."""
    engine.clear_cache()
    warm_up, _ = timed(lambda: engine.search(queries[0], k=k))
    engine.clear_cache()
    first = [timed(lambda q=q: engine.search(q, k=k)) for q in queries]
    again = [timed(lambda q=q: engine.search(q, k=k)) for q in queries]
    times = [t for t, _ in first]
    return {
        "timestamp": int(time.time()), "operation": "search_hybrid", "queries": list(queries), "search_times": times, "total_results": [r["total_hits"] for _, r in first], "cache_hits": sum(r["cache_hit"] for _, r in again),
        "t_warm_up": warm_up, "t_search_avg": sum(times) / len(times), "t_search_min": min(times), "t_search_max": max(times), "t_cached_avg": sum(t for t, _ in again) / len(again),
    }


def end_to_end(engine: Engine, roots: Sequence[str], queries: Sequence[str], max_items: int | None = None) -> dict:
    made, found = index_run(engine, roots, max_items), search_run(engine, queries)
    return made | {"t_search_hybrid": found["t_search_avg"], "search_queries": len(queries), "total_search_time": sum(found["search_times"]), "queries": list(queries), "search": found}


def save(spark: SparkSession, result: dict, history: str) -> None:
    """Appends a result to the CSV history, a folder."""
    named = {**result, "queries": ",".join(result.get("queries", [])), "t_search_hybrid": result.get("t_search_hybrid", result.get("t_search_avg", 0.0))}
    row = [named.get(c.split()[0], 0 if c.endswith("long") else 0.0 if c.endswith("double") else "") for c in HISTORY.split(", ")]
    spark.createDataFrame([row], HISTORY).coalesce(1).write.mode("append").option("header", True).csv(history)


def load(spark: SparkSession, history: str) -> DataFrame:
    """All results of the history; none: an empty table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(history)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(HISTORY).option("header", True).csv(history) if there else spark.createDataFrame([], HISTORY)


def compare(spark: SparkSession, history: str) -> DataFrame:
    """(operation, measure, timestamp, seconds, previous, improvement in per cent) of the last run of each operation that has one before it."""
    every = load(spark, history).select("operation", "timestamp", F.explode(F.create_map(F.lit("t_index"), F.col("t_index"), F.lit("t_search_hybrid"), F.col("t_search_hybrid"))).alias("measure", "seconds")).where("seconds > 0")
    runs = every.select(F.concat_ws("/", "operation", "measure").alias("operation"), "timestamp", "seconds", F.monotonically_increasing_id().alias("run_id"))
    made = bench_compare(runs).join(runs.select("run_id", "timestamp"), "run_id").where("previous is not null")
    last = made.groupBy("operation").agg(F.max_by(F.struct("timestamp", "seconds", "previous", "improvement"), F.struct("timestamp", "run_id")).alias("r"))
    return last.select(F.split("operation", "/")[0].alias("operation"), F.split("operation", "/")[1].alias("measure"), "r.*")


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    said = argparse.ArgumentParser(prog="lodestone.bench")
    said.add_argument("--paths", nargs="*", default=[])
    said.add_argument("--queries", nargs="*", default=list(QUERIES))
    said.add_argument("--max-items", type=int)
    said.add_argument("--create-test-env", action="store_true", help="write and index the sample files")
    said.add_argument("--cleanup", action="store_true", help="remove the sample files afterwards")
    said = said.parse_args(arguments)
    spark, settings = spark or SparkSession.builder.appName("lodestone-bench").getOrCreate(), load_config()
    sample = sample_corpus() if said.create_test_env or not said.paths else None
    if sample:
        settings = replace(settings, index=replace(settings.index, exclude_patterns=()))
    history = f"{Store(spark, settings.store).root}-runs/search_bench"
    try:
        out = end_to_end(Engine(spark, settings), [*said.paths, *([sample] if sample else [])], said.queries, said.max_items)
    finally:
        if sample and said.cleanup:
            shutil.rmtree(sample)
    save(spark, out, history)
    out["compared"] = [r.asDict() for r in compare(spark, history).collect()]
    print(json.dumps(out, default=str, ensure_ascii=False))
    return out


if __name__ == "__main__":
    main()
