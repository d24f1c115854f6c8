"""Near-duplicate documents by SimHash fingerprints that are linked through Golay-code keys.

A fingerprint's 64 bits are cut into three segments of 21, 21 and 22 bits. Each segment, as a word of the perfect binary
Golay code [23, 12, 7], has the indices (12 bits) of all codewords that it or a word one bit away decodes to: one index, or about
six for words at distance 3 from their codeword. Two words at distance 2 or less have an index in common: a word
between them decodes to a codeword that both have.

Pigeonhole over the segments: of 4 differing bits at most, either one segment has none, and then one of the other two has at
most 2 (key: first segment exactly, Golay index of the second); or two segments have exactly one each, at least (key: Golay index
of the one, and a half of the other, of which one half is unchanged). So fingerprints within 4 bits always share a
key. Rows with the same key are compared, verified by the count of differing bits, and linked with no more links than
a spanning forest needs. Components come from alternating large-star and small-star steps over the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, looked_up, per_text, stable, staged, without

BITS = 4
#: Keys with more distinct fingerprints than this are not compared in one task but linked through shared neighbours.
HOT = 20_000
_SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprint(raw: bytes, size: int = 4) -> int:
    """SimHash over the XXH64 (seed 42) of shingles of ASCII-lower-cased words; no words: 0."""
    words = raw.lower().split()  # of bytes: A-Z only; splits at space and U+0009 to U+000D
    n = len(words)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= size:
        values = [h(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        values = [h(joined[a:b], 42) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 14):
        part = np.array(values[at : at + (1 << 14)], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, column: str = "fp") -> DataFrame:
    """docs with the signed 64-bit fingerprint of each whole text."""

    def start():
        return lambda raw: ((x := fingerprint(raw)) - (1 << 64 if x >> 63 else 0),)

    return per_text(docs, text_col, [(column, "bigint")], start, keep)


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Parity (11 bits) by message (12 bits), and the correctable error by syndrome."""
    poly = 0b101011100011
    message = np.arange(1 << 12, dtype=np.int64)
    rest = message << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ poly << (bit - 11), rest)
    parity = rest
    errors = np.zeros(1 << 11, np.int64)
    one = [1 << i for i in range(23)]
    for e in [*one, *(a | b for a in one for b in one if a < b), *(a | b | c for a in one for b in one if a < b for c in one if b < c)]:
        errors[parity[e >> 11] ^ e & 0x7FF] = e
    return parity, errors


_TABLES: list[np.ndarray] = []


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index of the codeword within 3 bits of each 23-bit word; the code is perfect, so there is exactly one."""
    if not _TABLES:
        _TABLES.extend(_golay_tables())
    parity, errors = _TABLES
    return (words ^ errors[parity[words >> 11] ^ (words & 0x7FF)]) >> 11


def _indices(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the distinct codeword indices of each word and of the words one bit away."""
    flips = np.concatenate(([0], 1 << np.arange(width, dtype=np.int64)))
    every = np.sort(golay_index(segment[:, None] ^ flips), axis=1)
    new = np.ones(every.shape, bool)
    new[:, 1:] = every[:, 1:] != every[:, :-1]
    return np.nonzero(new)[0], every[new]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for unsigned fingerprints."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in _SEGMENTS]
    golay = [_indices(p, width) for p, (_, width) in zip(parts, _SEGMENTS, strict=True)]
    rows, keys = [], []
    for a in range(3):
        for b in range(3):
            if a != b:
                row, index = golay[b]
                rows.append(row)
                keys.append(((a * 3 + b) << 40) | parts[a][row] << 12 | index)
            if a < b:
                row, index = golay[a]
                for half in (0, 1):
                    value = parts[b] & 0x7FF if half else parts[b] >> 11
                    rows.append(row)
                    keys.append(((9 + (a * 3 + b) * 2 + half) << 40) | value[row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            row, key = keys_of(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])


def forest(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one group of distinct fingerprints: every member once, no list of pairs."""
    a, b = [], []
    left = fps.copy()
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            u, front = front[0], front[1:]
            near = np.bitwise_count(left ^ u) <= bits
            if near.any():
                found = left[near]
                a.append(np.full(len(found), u))
                b.append(found)
                front, left = np.concatenate((front, found)), left[~near]
    none = np.empty(0, fps.dtype)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to links (a, b, hot false); members of keys with over HOT of them come out as (fp, key, hot true)."""

    def out(a, b, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])

    def closed(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups."""
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(edges)
        small = np.repeat(size <= 32, size)
        found_a, found_b = [], []
        for d in range(1, 32):
            i = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= BITS]
            found_a.append(fp[i])
            found_b.append(fp[i + d])
        for g in np.flatnonzero(size > 32):
            a, b = forest(fp[edges[g] : edges[g + 1]])
            found_a.append(a)
            found_b.append(b)
        a, b = np.concatenate([fp[:0], *found_a]), np.concatenate([fp[:0], *found_b])
        if len(a):
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
            yield out(pairs[:, 0].view(np.int64), pairs[:, 1].view(np.int64), False)

    key, fp, hot = np.empty(0, np.int64), np.empty(0, np.uint64), None
    for batch in batches:
        key = np.concatenate((key, batch.column(0).to_numpy()))
        fp = np.concatenate((fp, batch.column(1).to_numpy().view(np.uint64)))
        if hot is not None:
            n = int(np.searchsorted(key, hot, "right"))
            if n:
                yield out(fp[:n].view(np.int64), key[:n], True)
            key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            hot = None
        last = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
        if last >= 50_000:
            yield from closed(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
            last = 0
        if len(key) - last > HOT:
            if last:
                yield from closed(key[:last], fp[:last])
            hot = key[-1]
            yield out(fp[last:].view(np.int64), key[last:], True)
            key, fp = key[:0], fp[:0]
    if len(key):
        yield from closed(key, fp)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint with all words within 2 bits: two within 4 bits have one of these in common, and only those have."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    two = (one[:, None] | one)[np.triu_indices(64, 1)]
    masks = np.concatenate((np.zeros(1, np.uint64), one, two))
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fps), 64):
            part = fps[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks).ravel().view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], names=["w", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct column fp. Links (a, b) that connect what the links within 4 bits connect."""
    bounded_batches(fps.sparkSession)
    keyed = fps.mapInArrow(_key_rows, "key bigint, fp bigint").repartition("key").sortWithinPartitions("key")
    found = staged(keyed.mapInArrow(_links, "a bigint, b bigint, hot boolean"), "links")
    shared = found.where("hot").select(F.col("a").alias("fp")).distinct().mapInArrow(_neighbours, "w bigint, fp bigint")
    # a star in each word's group; first the least member of each word, then every member with it
    least = shared.groupBy("w").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a < most").select("w", "a")
    stars = shared.join(least, "w").where("a < fp").select("a", F.col("fp").alias("b"))
    return found.where("not hot").select("a", "b").union(stars).distinct()


def components(pairs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the links (a, b); root: the least node of its component. Alternates large-star
    and small-star steps, each written to the shared folder, until nothing changes."""
    edges = staged(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every node keeps a link to its own least neighbour, so that no component falls apart
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        edges = staged(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id) for each row: the least id that its fingerprint reaches by links of 4 or fewer bits. Ids of any type that has an order.

    Null and blank texts have fingerprint 0 and link like others; texts of any length are read whole; repeated rows stay
    and share a component; rows with a null id take part, and a component of only such rows has a null component_id; other columns play no part.
    An empty table gives an empty table. Links are made between distinct fingerprints only, so copies cost nothing."""
    marked = staged(with_fingerprints(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__of")), "__of", ["__id"]), "fingerprints")
    nodes = staged(marked.groupBy("fp").agg(F.min("__id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    n_nodes, total = nodes.agg(F.count("*"), F.sum("n")).first()
    of = looked_up(named, least, ["root"], ["component_id"], "members", n_nodes).select("fp", "n", F.col("found.component_id").alias("component_id"))
    # copies of a third of all rows have one fingerprint
    found = looked_up(marked, staged(of, "classes"), ["fp"], ["component_id"], "n", total or 0)
    return found.select(F.col("__id").alias(id_col), "fp", F.col("found.component_id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the least id, and of the first row where several have it; null ids count as the last."""
    rows = stable(without(docs, ["__rid"])).withColumn("__rid", F.monotonically_increasing_id())
    found = classes(rows, "__rid", text_col)
    ids = rows.select("__rid", F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), "__rid").alias("place")).join(found, "__rid")
    kept = ids.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.__rid").alias("__rid"))
    return rows.join(kept, "__rid", "left_semi").drop("__rid")
