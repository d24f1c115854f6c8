"""Near copies by the Jaccard similarity of word shingles: candidates from SimHash fingerprints linked through Golay keys, and from MinHash bands for the rest; each group verified exactly.

Texts with the same set of shingles are one node (64-bit name of the set). A node has a fingerprint of its shingles, and fingerprints within 4 bits are linked
through their Golay keys (simhash_golay.py). At a similarity of 0.8 fingerprints differ in some ten bits, which these keys don't reach; so a node also has BANDS keys, each made of ROWS minima of its
shingles' hashes; two nodes of similarity 0.8 miss all of these keys of each other with a chance of 5 in a million. Nodes that fingerprints or keys connect
are gathered in one task, where every two that no verified link connects yet are compared by their whole sets. What is linked is
therefore at least as similar as asked, and within a group nothing depends on the keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, given_back, stable, staged, without
from .simhash_golay import components, links

SIZE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6
_RANDOM = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_BY, _PLUS = _RANDOM[0] | np.uint64(1), _RANDOM[1]


def shingles(raw: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the shingles of ASCII-lower-cased words; a text of fewer words is one shingle, one of none has none."""
    words = raw.lower().split()  # of bytes: A-Z only; splits at space and U+0009 to U+000D
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= size:
        return np.array([h(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([h(joined[a:b], 42) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64))


def band_keys(own: np.ndarray) -> list[int]:
    """Signed keys of a set of shingles, one for each band; none for the empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 1024):
        made = np.multiply.outer(_BY, own[at : at + 1024])
        made += _PLUS[:, None]
        np.minimum(least, made.min(axis=1), out=least)
    return [xxhash.xxh3_64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]


def fingerprint_of(own: np.ndarray) -> int | None:
    """Signed SimHash fingerprint of a set of shingles, each counted once: a bit is 1 if it is in over half of them; none for the empty set."""
    if not len(own):
        return None
    total = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 14):
        total += np.unpackbits(own[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(own), bitorder="little").view(np.int64)[0])


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _marker(size: int):
    """Batches (__rid, __id, __text) to (__rid, __id, node, fp, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, bands, ends = [], [], [], [0]
            for x in batch.column(2):
                own = shingles(x.as_py() or b"", size)
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes(), 42))
                fps.append(fingerprint_of(own))
                bands.extend(band_keys(own))
                ends.append(len(bands))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(bands)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_signed(nodes)), pa.array(fps, pa.int64()), lists], names=["__rid", "__id", "node", "fp", "bands"])

    return given_back(run)


def forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets at least so similar, by their places; every two that aren't connected are compared."""
    n = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)[np.argsort(at, kind="stable")]
    opens = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(values)))))
    mine = np.split(at, np.cumsum(n)[:-1])
    alive, links = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        if not alive[first]:
            continue
        alive[first] = False
        front = [first]
        while front and alive.any():
            u = front.pop()
            a, long = opens[mine[u]], opens[mine[u] + 1] - opens[mine[u]]
            held = owner[np.repeat(a - np.concatenate(([0], np.cumsum(long)[:-1])), long) + np.arange(long.sum())]
            both = np.bincount(held, minlength=len(sets))
            found = np.flatnonzero(alive & (both / np.maximum(n + n[u] - both, 1) >= similarity))
            alive[found] = False
            links.extend((u, int(v)) for v in found)
            front.extend(found.tolist())
    return links


def _verifier(size: int, similarity: float):
    """Batches (root, node, __text), sorted by root, to verified links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, nodes, sets = None, [], []

        def closed() -> pa.RecordBatch:
            found = forest(sets, similarity) if len(sets) > 1 else []
            ends = ([nodes[u] for u, _ in found], [nodes[v] for _, v in found])
            return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], names=["a", "b"])

        for batch in batches:
            for r, node, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                if r.as_py() != root:
                    yield closed()
                    root, nodes, sets = r.as_py(), [], []
                nodes.append(node.as_py())
                sets.append(shingles(text.as_py() or b"", size))
        yield closed()

    return given_back(run)


def candidates(nodes: DataFrame) -> DataFrame:
    """nodes: node, fp, bands. (node, root) of the nodes that fingerprints within 4 bits or equal bands connect, in groups that are still to be verified."""
    known = nodes.where("fp is not null")
    # equal fingerprints are one more key
    keyed = nodes.select(F.explode("bands").alias("key"), "node").unionByName(known.select(F.xxhash64("fp").alias("key"), "node"))
    # a star in each key's group connects what the key connects
    least = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most").select("key", "a")
    stars = keyed.join(least, "key").where("a < node").select("a", F.col("node").alias("b"))
    one = staged(known.groupBy("fp").agg(F.min("node").alias("node")), "near-fingerprints")
    golay = links(one.select("fp")).join(one.select(F.col("fp").alias("a"), F.col("node").alias("u")), "a").join(one.select(F.col("fp").alias("b"), F.col("node").alias("v")), "b")
    return components(stars.unionByName(golay.select(F.col("u").alias("a"), F.col("v").alias("b"))).distinct())


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row, that of the least id, of each group that links of the given Jaccard similarity of size-word shingles connect.

    Texts without words are copies of each other; texts of any length are read whole; of rows that repeat an id and have near
    copies as texts one stays. Rows with a null id all stay and displace no others. An empty table gives an empty table."""
    bounded_batches(docs.sparkSession)
    rows = stable(docs)
    rows = without(rows, ["__rid"]).withColumn("__rid", F.monotonically_increasing_id())
    known = rows.where(F.col(id_col).isNotNull())
    text = F.col(text_col).cast("string").cast("binary").alias("__text")
    kind = docs.schema[id_col].dataType.simpleString()
    marked = known.select("__rid", F.col(id_col).alias("__id"), text).mapInArrow(_marker(size), f"__rid bigint, __id {kind}, node bigint, fp bigint, bands array<bigint>")
    marked = staged(marked, "near-marked")
    nodes = staged(marked.groupBy("node").agg(F.min(F.struct("__id", "__rid")).alias("first"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), "near-nodes")
    asked = nodes.join(candidates(nodes), "node").select(F.col("first.__rid").alias("__rid"), "node", "root")
    texts = known.select("__rid", text).join(asked, "__rid").select("root", "node", "__text").repartition("root").sortWithinPartitions("root")
    verified = staged(texts.mapInArrow(_verifier(size, similarity), "a bigint, b bigint"), "near-links")
    named = nodes.select("node", "first").join(components(verified), "node", "left")
    kept = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.__rid").alias("__rid"))
    left = rows.join(staged(kept, "near-kept"), "__rid", "left_semi").unionByName(rows.where(F.col(id_col).isNull()))
    return left.drop("__rid")
