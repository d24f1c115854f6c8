"""Rows packed into blocks: one Spark row (bucket, major, minor, block) holds many small rows that go to the same place.

A shuffle of hashes costs a tenth of what it costs as rows, and blocks are taken apart, sorted and merged by numpy. Buckets
are as many as shuffle partitions, and are labelled so that each falls into a partition of its own; there, rows come in the order
of major and minor, and a task holds those of one major value at a time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "bucket int, major bigint, minor int, block binary"
#: Hashes are cut into so many ranges at least, whatever the number of partitions.
RANGES = 512
Row = tuple[int, int, int, bytes]


_CODEC: list = []


def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    if not _CODEC:
        _CODEC.append((zstandard.ZstdCompressor(level=1, write_checksum=False), zstandard.ZstdDecompressor()))
    return _CODEC[0]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: the first bytes of all values, then the second, and so on, each of these strings compressed by itself if that makes
    it smaller: the high bytes of small integers and of differences nearly vanish."""
    small = _codec()[0].compress
    sizes = np.array([len(a) for a in arrays], np.uint32)
    head, out = [], []
    for a in arrays:
        for plane in np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T):
            raw = plane.tobytes()
            less = small(raw) if len(raw) > 32 else raw
            out.append(less if len(less) < len(raw) else raw)
            head.append(len(out[-1]))
    return b"".join([sizes.tobytes(), np.array(head, np.uint32).tobytes(), *out])


def unpack(raw: bytes, *kinds: type) -> list[np.ndarray]:
    large = _codec()[1].decompress
    sizes = np.frombuffer(raw, np.uint32, len(kinds)).tolist()
    widths = [np.dtype(k).itemsize for k in kinds]
    head = np.frombuffer(raw, np.uint32, sum(widths), 4 * len(kinds)).tolist()
    at, out, next_plane = 4 * (len(kinds) + len(head)), [], iter(head)
    for n, kind, width in zip(sizes, kinds, widths, strict=True):
        planes = np.empty((width, n), np.uint8)
        for k in range(width):
            size = next(next_plane)
            part = raw[at : at + size]
            planes[k] = np.frombuffer(part if size == n else large(part), np.uint8)
            at += size
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """uint64 to well-mixed uint64, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labels(spark: SparkSession) -> np.ndarray:
    """A label for each shuffle partition, whose hash leads to it."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.range(0, n * 32 + 256, 1, 4).select(F.col("id").cast("int").alias("x"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("x").alias("x")).collect()
    of = {r.p: r.x for r in found}
    return np.array([of.get(p, p) for p in range(n)], np.int64)


def n_ranges(names: np.ndarray, least: int = RANGES) -> int:
    """How many ranges of hashes: a multiple of the buckets."""
    return len(names) * -(-least // len(names))


def ranged(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash, in the hashes' order."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def range_bucket(names: np.ndarray, ranges: int, at: int) -> int:
    return int(names[at * len(names) // ranges])


def own_bucket(names: np.ndarray, key: int) -> int:
    return int(names[int(mixed(np.array([key], np.int64).view(np.uint64))[0] % np.uint64(len(names)))])


def edges_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))) if len(values) else np.zeros(1, np.int64)


def sent(names: np.ndarray, ranges: int, hashes: np.ndarray, minor: int, *arrays: np.ndarray, step: int | None = None) -> Iterator[Row]:
    """Rows of SCHEMA: the arrays cut by range of the hashes, each cut in the order given. step: the array to send as differences."""
    at = ranged(hashes, ranges)
    order = np.argsort(at, kind="stable")
    at, cut = at[order], [a[order] for a in arrays]
    edges = edges_of(at)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        parts = [a[lo:hi] for a in cut]
        if step is not None:
            parts[step] = np.diff(parts[step], prepend=parts[step].dtype.type(0))
        r = int(at[lo])
        yield range_bucket(names, ranges, r), r, minor, pack(*parts)


def batched(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in chain(rows, (None,)):
        if row is not None:
            held.append(row)
            size += len(row[3])
        if held and (row is None or len(held) >= 64 or size >= 4 << 20):
            columns = zip(zip(*held, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=["bucket", "major", "minor", "block"])
            held, size = [], 0


def dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "major", "minor")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(major, [(minor, block)]) of dealt rows."""
    now, held = None, []
    for batch in batches:
        for bucket, major, minor, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, major) != now:
                if held:
                    yield now[1], held
                now, held = (bucket, major), []
            held.append((minor, block))
    if held:
        yield now[1], held
