"""Where tables live: versioned folders of Parquet under a store, reached by Spark's file systems only."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TABLES = ("files", "chunks", "postings", "lengths", "vectors", "errors")
#: What a table is sorted by, so that a lookup reads the few row groups that may have the key.
SORTED = {"files": "path", "chunks": "chunk_id", "postings": "term", "lengths": "chunk_id", "vectors": "chunk_id"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; in local mode, where all is one machine, a temporary folder if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lodestone_dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark._lodestone_dir = tempfile.mkdtemp(prefix="lodestone-")
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes what staged has written for these frames, which aren't used any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: For many small files: a task takes many of them, and a few hundred paths are looked up by the driver rather than by a task each.
SMALL_FILES = {"spark.sql.files.openCostInBytes": str(64 << 10), "spark.sql.sources.parallelPartitionDiscovery.threshold": "1024", "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256"}


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Within, SMALL_FILES hold; a stream needs them for as long as it runs."""
    before = {k: spark.conf.get(k, None) for k in SMALL_FILES}
    for k, v in SMALL_FILES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Arrow batches for Python are cut at so many bytes, so that long texts can't fill a worker.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """A worker's freed memory goes back to the system: it waits for later tasks, and would keep the most that it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


class Store:
    """Tables by version: a new version is written whole beside the old one and becomes current once its marker is there, so readers never see half."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self._path(self.root)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.root}/{n}/_READY")))

    def read(self, table: str) -> DataFrame:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"{self.root} holds no index")
        return self.spark.read.parquet(f"{self.root}/v{found[-1]}/{table}")

    def write(self, tables: dict[str, DataFrame]) -> int:
        """All tables as the next version; the version before it stays, for its readers, and older ones go."""
        found = self.versions()
        now = (found or [0])[-1] + 1
        for name, df in tables.items():
            if name in SORTED:
                df = df.repartitionByRange(SORTED[name]).sortWithinPartitions(SORTED[name])
            df.write.mode("overwrite").parquet(f"{self.root}/v{now}/{name}")
        self._fs.create(self._path(f"{self.root}/v{now}/_READY")).close()
        for old in found[:-1]:
            self._fs.delete(self._path(f"{self.root}/v{old}"), True)
        return now

    def reset(self) -> None:
        self._fs.delete(self._path(self.root), True)
