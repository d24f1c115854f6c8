"""What the two classifiers share: the labelled sample and the folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_batches, stable, staged

#: A labelled text of over 1/SHARE of the sample's bytes isn't learnt from.
SHARE = 64


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids: null."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_out: int, per_class: int, most_bytes: int) -> DataFrame:
    """(at, text, label) of labelled rows outside the held-out fold, numbered in the order of a hash of the id: at most per_class rows of either label, and of
    these as many from the first as most_bytes of text hold.

    A label other than 0 or 1 doesn't count; an id with labels of both kinds counts as 1; rows with a null id, a blank text or one of over
    most_bytes / SHARE are left out; rows that repeat an id count one by one. Rows are chosen by numbers only; texts are fetched for those chosen."""
    rows = stable(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))).withColumn("__rid", F.monotonically_increasing_id())
    marks = labels.select(F.col(f"`{id_col}`").alias("__of"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1) and __of is not null")
    marks = marks.where(fold("__of", folds) != held_out).groupBy("__of").agg(F.max("label").alias("label"))
    sized = rows.where(F.length(F.trim("__text")) > 0).select("__rid", "__id", F.octet_length("__text").cast("long").alias("size"), F.xxhash64("__text").alias("content"))
    known = sized.where(F.col("size") * SHARE <= most_bytes).join(marks, F.col("__id") == F.col("__of"))
    order = [F.xxhash64("__id"), "__id", "content", "__rid"]
    parts = [known.where(F.col("label") == kind).orderBy(*order).limit(per_class) for kind in (0, 1)]
    chosen = staged(parts[0].union(parts[1]).select("__rid", "__id", "size", "content", "label"), "sample")
    # 2 * per_class rows of numbers at most
    by = Window.orderBy(F.xxhash64("__id", F.lit("order")), "__id", "content", "__rid")
    chosen = chosen.withColumns({"at": F.row_number().over(by), "sum": F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))}).where(F.col("sum") <= most_bytes)
    return rows.select("__rid", "__text").join(F.broadcast(chosen.select("__rid", "at", "label")), "__rid").select("at", F.col("__text").alias("text"), "label")


def train_once(sample: DataFrame, fit: Callable[[list[tuple[bytes, int]]], bytes]) -> bytes:
    """fit(rows) in one task over a labelled_sample, whose rows and bytes are bounded; returns the model, which is small."""
    bounded_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(text.as_py(), label.as_py()) for batch in batches for text, label in zip(batch.column(0), batch.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows)], pa.binary())], names=["model"])

    ordered = sample.repartition(1).sortWithinPartitions("at").select(F.col("text").cast("binary"), "label")
    found = ordered.mapInArrow(run, "model binary").first()  # an empty table may run no task at all
    return bytes(found.model) if found else fit([])
