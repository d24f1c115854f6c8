"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What separates words everywhere in this subpackage: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
#: Arrow batches are cut at so many bytes, so that a run of long texts can't fill a Python worker.
BATCH_BYTES = 8 << 20
#: A key with over 1/HEAVY of all rows, of which there are HEAVY at most, is met by broadcast.
HEAVY = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where all is one machine, a temporary one if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark, "_own_checkpoint_dir", None)
        if not found:
            found = tempfile.mkdtemp(prefix="checkpoints-")
            spark._own_checkpoint_dir = found
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, survives lost executors, and
    makes row ids and samples the same for every later use."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stable(df: DataFrame) -> DataFrame:
    """df if its rows come in the same order each time, since it only projects and filters files (so that row ids are the same in every use); else written once."""
    plan = df._jdf.queryExecution().optimizedPlan()

    def from_files(node) -> bool:
        kind = node.getClass().getSimpleName()
        if kind in ("Project", "Filter"):
            return from_files(node.child())
        return kind == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation"

    return df if plan.deterministic() and from_files(plan) else staged(df, "rows")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], fields: list[str], n: str, total: int, heavy: int = HEAVY) -> DataFrame:
    """rows with the column found, a struct of the table's fields, or null. table has one row for each combination of the keys, of which n rows have it;
    total: the sum of n. Keys with over 1/heavy of all rows, of which there are heavy at most, are broadcast, and their rows spread evenly; only others are met by a shuffle."""
    made = F.struct(*fields)
    often = F.col(n) * heavy > total
    hot = table.where(often).select(*[F.col(k).alias(f"__hot_{k}") for k in keys], made.alias("__hot"))
    cold = table.where(~often).select(*[F.col(k).alias(f"__cold_{k}") for k in keys], F.lit(False).alias("__never"), made.alias("__cold"))

    def met(side: str, mine: str):
        out = F.lit(True)
        for k in keys:
            out = out & (F.col(f"{mine}{k}") == F.col(f"__{side}_{k}"))
        return out

    kinds = dict(rows.dtypes)
    out = rows.join(F.broadcast(hot), met("hot", ""), "left").withColumn("__known", F.col("__hot").isNotNull())
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    out = out.withColumns({f"__key_{k}": F.when(F.col("__known"), spread.cast(kinds[k])).otherwise(F.col(k)) for k in keys})
    out = out.join(cold, met("cold", "__key_") & (F.col("__known") == F.col("__never")), "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("__hot", "__cold").alias("found"))


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def given_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which its task's freed memory goes back to the system: a Python worker waits for later stages, and would keep the most that it ever held."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return wrapped


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text, as an array: maximal runs of characters outside SPACE; null or blank text: empty."""
    core = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.filter(F.split(core, f"[{SPACE}]+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns of these names, in any case: computed columns replace columns that clash with them."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def per_text(docs: DataFrame, text_col: str, fields: list[tuple[str, str]], fn: Callable[[], Callable[[bytes], tuple]], keep: list[str] | None = None) -> DataFrame:
    """Add columns computed from each whole text in Python, over Arrow batches.

    fn() is called once per task and returns the function of one text's UTF-8 bytes (null: empty) that gives the values of
    fields, which are (name, "string" | "bigint" | "int" | "double"). keep: the input columns to carry, else all;
    columns that clash with fields are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    bounded_batches(spark)
    carried = without(docs, [n for n, _ in fields])
    if keep is not None:
        made = {n.lower() for n, _ in fields}
        carried = carried.select(*[F.col(f"`{c}`") for c in keep if c.lower() not in made])
    names = list(carried.columns)
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").cast("binary").alias("__text"))
    added = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields))
    out = StructType([*carried.schema.fields, *added.fields])
    kinds = [f.type for f in to_arrow_schema(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = fn()
        for batch in batches:
            rows = [one(x.as_py() or b"") for x in batch.column(len(names))]
            columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], names=[*names, *[n for n, _ in fields]])

    return source.mapInArrow(given_back(run), out)
