"""Bytes of documents that lie in a string of 200 bytes which also starts elsewhere in the corpus, by run-length indexes.

The corpus is cut into shards by content, so that no shard needs another: every 200-byte window is named by the least of the hashes of the grams
of GRAM bytes in it, and equal windows have the same name. Neighbouring windows of a text that have their name from the same gram are a run of windows; a run is one row:
its name, a hash of all its text, and where it is. A name that occurs once holds no repeated window; runs that are equal as a whole are
repeated as a whole, and what a task has several times is settled there, so that a passage that a third of all documents share costs each task a few rows.

Where runs of one name differ, at the ends of repeated passages, their bytes go to the name's shard. A shard's texts get a run-length
index (RunIndex): the run-compressed Burrows-Wheeler transform with the text places and common prefixes of its runs' ends sampled. Matching statistics of the texts
are streamed from the samples alone, since they fall by one from a sample to the next, and matches of 200 bytes or more are marked.

A name with more bytes than a quarter of a task's share (there are at most four such for each task) isn't indexed in one place: its windows are named by the hash of
their whole text, dealt out by it and counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .blocks import RANGES, SCHEMA, Row, batched, dealt, edges_of, grouped, labels, mixed, n_ranges, own_bucket, pack, sent, unpack
from .common import bounded_batches, given_back, stable, staged, without

LENGTH = 200
GRAM = 136
#: Windows of a text that are hashed together, and runs that a task settles together.
PIECE = 1 << 19  # under 2**23
AT_ONCE = 1 << 20
#: Decisions of one block, and rows of one batch of what is found.
FOUND = 1 << 16
#: Bytes that are indexed together, if names allow it, and bytes up to which a name is always indexed in one place.
SHARD = 4 << 20
WIDE = 8 << 20
_U = np.uint64
_X = 0xD6E8FEB86659FD93
_FOUND = "rid bigint, lo int, n int, sure boolean, name bigint"
#: Kinds of rows: runs to be settled, decisions, bytes to be indexed.
_RUNS, _DONE, _BYTES = 0, 1, 2


class Hasher:
    """Hashes of all substrings of one length, from a polynomial modulo 2**64 over mixed bytes."""

    def __init__(self) -> None:
        self.of = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            more = n + n // 4
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(more, x, np.uint64)))) for x in (_X, pow(_X, -1, 1 << 64)))
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.of[data] * self.up[:n], out=out[1:])
        return out

    def at(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((prefix[hi] - prefix[lo]) * self.down[lo])

    def all(self, prefix: np.ndarray, length: int) -> np.ndarray:
        n = len(prefix) - length
        return mixed((prefix[length:] - prefix[:n]) * self.down[:n])


def pieces(rid: int, raw: bytes, length: int) -> Iterator[tuple[int, int, bytes]]:
    """(rid, offset, bytes): together they have each window of the text once."""
    for at in range(0, max(0, len(raw) - length + 1), PIECE):
        yield rid, at, raw[at : at + PIECE + length - 1]


def runs(held: list[tuple[int, int, bytes]], hasher: Hasher, length: int, gram: int) -> list[np.ndarray]:
    """name, content, rid, lo, n of the runs of windows in these pieces."""
    data = np.frombuffer(b"".join(p[2] for p in held), np.uint8)
    prefix = hasher.prefix(data)
    grams = hasher.all(prefix, gram)
    # the least hash of each window, and of equal ones the leftmost: hash bits above, place below
    least, have, width = grams >> _U(24) << _U(24) | np.arange(len(grams), dtype=np.uint64), 1, length - gram + 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    size = np.array([len(p[2]) for p in held])
    many = size - length + 1
    piece = np.repeat(np.arange(len(held)), many)
    at = np.arange(len(piece)) + np.repeat(np.cumsum(size) - size - (np.cumsum(many) - many), many)
    place = (least[at] & _U((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (piece[1:] != piece[:-1]))))
    n = np.diff(np.append(first, len(at)))
    lo, piece = at[first], piece[first]
    content = hasher.at(prefix, lo, lo + n - 1 + length)
    offset = np.array([p[1] for p in held]) - (np.cumsum(size) - size)
    return [grams[place[first]], content, np.array([p[0] for p in held], np.int64)[piece], (lo + offset[piece]).astype(np.int32), n.astype(np.int32)]


def settle(name: np.ndarray, content: np.ndarray, twice: np.ndarray, differs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Masks over rows: repeated as a whole; to be looked into; to be sent on; and whether the name has other contents.
    twice, differs: what is known already of a row's content and of its name."""
    order = np.lexsort((content, name))
    k, c = name[order], content[order]
    new_k = np.concatenate(([True], k[1:] != k[:-1]))
    new = new_k | np.concatenate(([True], c[1:] != c[:-1]))
    at, at_k = np.flatnonzero(new), np.flatnonzero(new_k)
    n, n_k = np.diff(np.append(at, len(k))), np.diff(np.append(at_k, len(k)))
    whole = np.repeat((n > 1) | np.logical_or.reduceat(twice[order], at), n)
    nth = np.cumsum(new) - np.repeat(np.cumsum(new)[at_k], n_k)  # which content of its name, from 0
    other = np.repeat((np.add.reduceat(new.astype(np.int64), at_k) > 1) | np.logical_or.reduceat(differs[order], at_k), n_k)
    out = [np.empty(len(k), bool) for _ in range(4)]
    for mask, value in zip(out, (whole, other & (~whole | new), new & (~other | (nth < 2)), other), strict=True):
        mask[order] = value
    return tuple(out)


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of a collection of texts, with samples at its runs' ends.

    symbols: the transform's runs (0: before a text's first byte, else byte + 1), one to each sample. heads, tails: the place in the joined texts of each run's
    first and last suffix. above, below: the common prefix, within the two texts, of the head with the suffix before it, and of the tail with the suffix after it."""

    def __init__(self, texts: list[bytes]) -> None:
        size = np.array([len(t) for t in texts])
        self.starts = np.cumsum(size + 1) - (size + 1)
        joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + 1
        ends = self.starts + size
        joined[ends] = 0
        n = len(joined)
        left = np.repeat(ends, size + 1) - np.arange(n)  # symbols up to the end of the text
        # suffixes by ever longer prefixes, of 7, 14, 28 ... symbols; equal texts stay in the order of their places
        key = np.zeros(n, np.int64)
        for k in range(7):
            key = key << 9 | np.where(left > k, np.concatenate((joined[k:], np.zeros(k, np.int64))), 0)
        ranks, depth = [np.unique(key, return_inverse=True)[1]], 7
        while depth <= int(size.max(initial=0)):
            last = ranks[-1]
            after = np.where(left > depth, np.concatenate((last[depth:], np.zeros(min(depth, n), np.int64)))[:n] + 1, 0)
            ranks.append(np.unique(last << 32 | after, return_inverse=True)[1])
            depth *= 2
        order = np.argsort(ranks[-1], kind="stable")
        before = np.where(order > 0, joined[order - 1], 0)
        edge = np.ones(n + 1, bool)
        edge[1:n] = (before[1:] != before[:-1]) | (before[1:] == 0)
        first, last = np.flatnonzero(edge[:-1]), np.flatnonzero(edge[1:])
        self.symbols, self.heads, self.tails = before[first], order[first], order[last]
        self.above = np.where(first > 0, self._common(ranks, joined, left, order[first], order[first - 1]), 0)
        self.below = np.where(last < n - 1, self._common(ranks, joined, left, order[last], order[(last + 1) % n]), 0)
        self.n = n

    @staticmethod
    def _common(ranks: list[np.ndarray], joined: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes, from the ranks of prefixes of each length; ends of texts end them."""
        most = np.minimum(left[a], left[b])
        have = np.zeros(len(a), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            i, j = np.minimum(a + have, len(joined) - 1), np.minimum(b + have, len(joined) - 1)
            have += np.where((have < most) & (ranks[k][i] == ranks[k][j]), 7 << k, 0)
        for _ in range(7):
            i, j = np.minimum(a + have, len(joined) - 1), np.minimum(b + have, len(joined) - 1)
            have += (have < most) & (joined[i] == joined[j])
        return np.minimum(have, most)

    def matching(self, length: int) -> np.ndarray:
        """Whether a string of that length that starts at a place of the joined texts also starts elsewhere in them. A match at place p that
        isn't at a run's end is the match at p - 1 without its first byte, so each sample gives those of the places after it."""
        marks = np.zeros(self.n + 1, np.int64)
        for place, long in ((self.heads, self.above), (self.tails, self.below)):
            yes = long >= length
            np.add.at(marks, place[yes], 1)
            np.add.at(marks, place[yes] + long[yes] - length + 1, -1)
        return np.cumsum(marks[:-1]) > 0


def repeated_spans(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, n) of the runs of windows that start elsewhere, too."""
    index = RunIndex(texts)
    found = index.matching(length)
    edge = np.flatnonzero(np.diff(found.astype(np.int8), prepend=0, append=0))
    first, end = edge[::2], edge[1::2]
    text = np.searchsorted(index.starts, first, "right") - 1
    return text, first - index.starts[text], end - first


def _joined(rid: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring or overlapping runs of a document as one."""
    order = np.lexsort((lo, rid))
    rid, lo, hi = rid[order], lo[order], (lo + n)[order]
    # a document's runs don't contain each other, so ends are in order, too, but for rows that repeat
    new = np.concatenate(([True], (rid[1:] != rid[:-1]) | (lo[1:] > hi[:-1])))[: len(rid)]
    at = np.flatnonzero(new)
    return rid[at], lo[at], (np.maximum.reduceat(hi, at) - lo[at]).astype(np.int32) if len(at) else n[:0]


_DECISION = (np.int64, np.int32, np.int32, np.uint8, np.uint64)
_ROW = (np.uint64, np.uint64, np.int64, np.int32, np.int32, np.uint8)


def _decided(rows: list[np.ndarray], twice: np.ndarray, differs: np.ndarray) -> tuple[list[np.ndarray], tuple]:
    """Arrays of _DECISION, and the masks of settle."""
    name, content, rid, lo, n = rows
    masks = settle(name, content, twice, differs)
    whole, look = masks[:2]
    a, b, c = _joined(rid[whole], lo[whole], n[whole])
    sure = np.repeat(np.array([1, 0], np.uint8), (len(a), int(look.sum())))
    return [np.concatenate((a, rid[look])), np.concatenate((b, lo[look])).astype(np.int32), np.concatenate((c, n[look])).astype(np.int32), sure, np.concatenate((np.zeros(len(a), np.uint64), name[look]))], masks


class _Out:
    """Rows of one task: what is known within it, as decisions, and what it can't know, for the shards."""

    def __init__(self, names: np.ndarray, ranges: int) -> None:
        self.names, self.ranges = names, ranges
        self.parts, self.held = [], 0

    def add(self, rows: list[np.ndarray]) -> Iterator[Row]:
        self.parts.append(rows)
        self.held += len(rows[0])
        if self.held >= AT_ONCE:
            yield from self.done()

    def done(self) -> Iterator[Row]:
        if not self.held:
            return
        parts, self.parts, self.held = self.parts, [], 0
        rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
        del parts
        none = np.zeros(len(rows[0]), bool)
        decision, (whole, _, on, other) = _decided(rows, none, none)
        # what is sent goes block by block, and nothing else is held meanwhile
        flags = (whole.astype(np.uint8) | other.astype(np.uint8) << 1)[on]
        rows = [x[on] for x in rows]
        del none, whole, on, other, _
        for at in range(0, len(decision[0]), FOUND):
            part = [x[at : at + FOUND] for x in decision]
            yield own_bucket(self.names, int(part[0][0])), -1, _DONE, pack(*part)
        del decision
        yield from sent(self.names, self.ranges, mixed(rows[0]), _RUNS, *rows, flags, step=2)


def _settled(length: int):
    """Dealt rows to _FOUND."""

    def found(*every) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(every[0]), FOUND):
            rid, lo, n, sure, name = (x[at : at + FOUND] for x in every)
            columns = [pa.array(rid.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(sure > 0), pa.array(name.astype(np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "lo", "n", "sure", "name"])

    def indexed(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        held = []
        for raw in blocks:
            name, rid, lo, size, data = unpack(raw, np.uint64, np.int64, np.int32, np.int32, np.uint8)
            data, end = data.tobytes(), np.cumsum(size)
            held += [(*x, data[b - c : b]) for *x, b, c in zip(name.tolist(), rid.tolist(), lo.tolist(), end.tolist(), size.tolist(), strict=True)]
        held.sort(key=lambda x: x[:3])
        at = 0
        while at < len(held):
            end, size = at, 0
            # whole names, as many as a shard takes
            while end < len(held) and (size < SHARD or held[end][0] == held[end - 1][0]):
                size += len(held[end][3])
                end += 1
            part = held[at:end]
            text, first, n = repeated_spans([x[3] for x in part], length)
            rid, lo = np.array([x[1] for x in part]), np.array([x[2] for x in part])
            yield from found(rid[text], lo[text] + first, n, np.ones(len(text)), np.zeros(len(text)))
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            of = {kind: [b for k, b in rows if k == kind] for kind in (_RUNS, _DONE, _BYTES)}
            for raw in of[_DONE]:
                yield from found(*unpack(raw, *_DECISION))
            if of[_RUNS]:
                parts = [unpack(b, *_ROW) for b in of[_RUNS]]
                for p in parts:
                    p[2] = np.cumsum(p[2])
                every = [np.concatenate(x) for x in zip(*parts, strict=True)]
                yield from found(*_decided(every[:5], every[5] & 1 > 0, every[5] & 2 > 0)[0])
            if of[_BYTES]:
                yield from indexed(of[_BYTES])

    return given_back(run)


def _document_runs(names: np.ndarray, ranges: int, length: int, gram: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        out, hasher, held, size = _Out(names, ranges), Hasher(), [], 0
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for p in pieces(rid, text.as_py() or b"", length):
                    held.append(p)
                    size += len(p[2])
                    if size >= PIECE:
                        yield from out.add(runs(held, hasher, length, gram))
                        held, size = [], 0
        if held:
            yield from out.add(runs(held, hasher, length, gram))
        yield from out.done()

    return given_back(lambda batches: batched(made(batches)))


def _looked_into(names: np.ndarray, ranges: int, length: int, wide: np.ndarray):
    """(rid, text, spans) to the bytes of the spans, for the shards of their names; spans of wide names to windows, named by their own hash."""

    def windows(rid: int, raw: np.ndarray, spans: list, hasher: Hasher) -> list[np.ndarray]:
        data = np.concatenate([raw[s["lo"] : s["lo"] + s["n"] - 1 + length] for s in spans])
        many = np.array([s["n"] for s in spans])
        start = np.cumsum(many + length - 1) - (many + length - 1)
        place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        h = hasher.at(hasher.prefix(data), k := place + np.repeat(start, many), k + length)
        lo = (place + np.repeat(np.array([s["lo"] for s in spans]), many)).astype(np.int32)
        return [h, h, np.full(len(h), rid, np.int64), lo, np.ones(len(h), np.int32)]

    def given(rows: list[tuple]) -> Iterator[Row]:
        name = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        at = np.argsort(mixed(name), kind="stable")
        for lo in range(0, len(at), 1 << 16):
            k = at[lo : lo + (1 << 16)]
            # sent cuts arrays by row; bytes are cut by the sizes
            for bucket, major, minor, block in sent(names, ranges, mixed(name[k]), _BYTES, k.astype(np.int64)):
                own = [rows[i] for i in unpack(block, np.int64)[0].tolist()]
                data = np.frombuffer(b"".join(r[3] for r in own), np.uint8)
                yield bucket, major, minor, pack(np.array([r[0] for r in own], np.int64).view(np.uint64), np.array([r[1] for r in own], np.int64), np.array([r[2] for r in own], np.int32), np.array([len(r[3]) for r in own], np.int32), data)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        out, hasher, rows, size = _Out(names, ranges), Hasher(), [], 0
        for batch in batches:
            for rid, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py() or b""
                apart = [s for s in spans if s["name"] in wide]
                for at in range(0, len(apart), 1 << 12):
                    yield from out.add(windows(rid, np.frombuffer(text, np.uint8), apart[at : at + (1 << 12)], hasher))
                for s in spans:
                    if s["name"] not in wide:
                        part = text[s["lo"] : s["lo"] + s["n"] - 1 + length]
                        rows.append((s["name"], rid, s["lo"], part))
                        size += len(part)
                if size >= 8 * SHARD:
                    yield from given(rows)
                    rows, size = [], 0
        if rows:
            yield from given(rows)
        yield from out.done()

    return given_back(lambda batches: batched(made(batches)))


def _cut(fields: int, length: int):
    """Rows with text and spans last: the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(fields), batch.column(fields + 1).to_pylist(), strict=True):
                raw, kept, at, removed, n = text.as_py() or b"", [], 0, 0, 0
                for lo, many in sorted((s["lo"], s["n"]) for s in spans or ()):
                    hi = lo + many - 1 + length
                    if lo > at or not n:
                        kept.append(raw[at:lo])
                        n += 1
                        removed += hi - lo
                    elif hi > at:
                        removed += hi - at
                    at = max(at, hi)
                kept.append(raw[at:])
                rows.append((len(raw), removed, n, b"".join(kept)))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            digest = pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:fields], *columns, digest], names=[*batch.schema.names[:fields], "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return given_back(run)


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes) and kept_sha256.

    A byte goes if a string of that many bytes that covers it also starts anywhere else, in the same text or another; all copies go.
    Texts are judged whole and as they come in. Null texts count as empty; texts shorter than length lose nothing; rows that repeat are each
    other's copies. An empty table gives an empty table; columns that clash with the new ones are replaced."""
    spark = docs.sparkSession
    bounded_batches(spark)
    gram = max(1, length * GRAM // LENGTH)
    clean = stable(without(docs, ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "__rid", "__t", "__spans"])).withColumn("__rid", F.monotonically_increasing_id())
    texts = clean.select("__rid", F.col(f"`{text_col}`").cast("string").cast("binary").alias("__t"))
    names = labels(spark)
    n, ranges = len(names), n_ranges(names, RANGES)

    def decided(rows: DataFrame) -> DataFrame:
        return dealt(rows, n).mapInArrow(_settled(length), _FOUND)

    def spans(found: DataFrame, *fields: str) -> DataFrame:
        return found.groupBy(F.col("rid").alias("__rid")).agg(F.collect_set(F.struct(*fields)).alias("__spans"))

    found = staged(decided(texts.mapInArrow(_document_runs(names, ranges, length, gram), SCHEMA)), "runs")
    unsure = found.where("not sure")
    size = F.sum(F.col("n").cast("long") + length - 1)
    total = unsure.agg(size).first()[0] or 0
    most = max(WIDE, total // (4 * n))
    wide = frozenset(r.name for r in unsure.groupBy("name").agg(size.alias("size")).where(F.col("size") > most).select("name").collect())  # 4 * n at most
    looked = texts.join(spans(unsure, "lo", "n", "name"), "__rid").mapInArrow(_looked_into(names, ranges, length, wide), SCHEMA)
    inside = staged(decided(looked).where("sure"), "matches")
    every = spans(found.where("sure").unionByName(inside), "lo", "n")
    carried = [c for c in clean.columns if c != "__rid" and (keep is None or c in keep)]
    joined = clean.select("__rid", *[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").cast("string").cast("binary").alias("__t")).join(every, "__rid", "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in carried], "__t", "__spans")
    out = StructType([*joined.schema.fields[: len(carried)], *StructType.fromDDL("n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string").fields])
    return joined.mapInArrow(_cut(len(carried), length), out)
