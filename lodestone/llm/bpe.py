"""Byte-level BPE: encode and decode whole texts with the ranks of a public vocabulary.

The merge loop keeps, for each merge rank, the positions of the pairs that have that rank, and finds the smallest rank that
is in use with a three-level bitmap (find-first-set on each level). A pre-token is a linked list of parts; a position whose
pair has changed since it was put into a bucket is stale and is skipped when taken out. Each merge costs the same, however
long the pre-token is, so a pre-token of 100,000 bytes takes time in proportion to its length. Pre-tokens of fewer than SHORT bytes have
nothing to gain from that and are merged by scanning their pairs.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

from pyspark.sql import DataFrame

from .common import per_text

#: Remembered pre-tokens and cuts of each of two generations; about 250 bytes each.
PIECES = 1 << 19
CHUNKS = 1 << 19


#: Pre-tokens of fewer bytes are merged by scanning their pairs, not by the queue.
SHORT = 16


class RankQueue:
    """Positions by merge rank. Bits of three levels of 64-bit words tell which ranks have positions: low for ranks, mid for the
    words of low, top for those of mid. A rank's bucket is 0, a position plus one, or a heap of these. Empty between pre-tokens, so that one serves all of them."""

    __slots__ = ("buckets", "low", "mid")

    def __init__(self, ranks: int) -> None:
        self.buckets: list = [0] * ranks
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)


def merge_scanned(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids, from a look at all pairs for each merge: for a few bytes that costs a third of what the queue does."""
    get, none = ranks.get, 1 << 30
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pair and (rank := min(pair)) < none:
        i = pair.index(rank)
        parts[i] += parts.pop(i + 1)
        del pair[i]
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def merge_piece(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Ids of one pre-token: merge the adjacent pair of smallest rank, leftmost first, until no pair has a rank. The queue's steps stand in the
    loop itself, since calls would cost more than they do."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < SHORT:
        return merge_scanned(piece, ranks)
    buckets, low, mid, top = queue.buckets, queue.low, queue.mid, 0
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; parts are their start positions
    before = list(range(-1, n))
    pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the part at i with the next one; -1: none, or i is no part's start any more
    pair.append(-1)
    fresh = enumerate(pair)
    while True:
        # put what is new into its rank's bucket
        for i, r in fresh:
            if r < 0:
                continue
            held = buckets[r]
            if not held:
                buckets[r] = i + 1
                a = r >> 6
                b = a >> 6
                low[a] |= 1 << (r & 63)
                mid[b] |= 1 << (a & 63)
                top |= 1 << b
            elif type(held) is int:
                buckets[r] = [held, i + 1] if held <= i else [i + 1, held]
            else:
                heappush(held, i + 1)
        # take out the leftmost position of the smallest rank; one whose pair has changed since is stale
        while top:
            b = (top & -top).bit_length() - 1
            m = mid[b]
            a = b << 6 | (m & -m).bit_length() - 1
            x = low[a]
            rank = a << 6 | (x & -x).bit_length() - 1
            held = buckets[rank]
            if type(held) is int:
                i = held - 1
                buckets[rank] = 0
                # the bits found are the lowest of their words
                low[a] = x = x & (x - 1)
                if not x:
                    mid[b] = m = m & (m - 1)
                    if not m:
                        top &= top - 1
            else:
                i = heappop(held) - 1
                if len(held) == 1:
                    buckets[rank] = held[0]
            if pair[i] == rank:
                break
        else:
            break
        j = end[i]
        k = end[i] = end[j]
        pair[j] = -1
        fresh = []
        if k < n:
            before[k] = i
            r = pair[i] = get(piece[i : end[k]], -1)
            fresh.append((i, r))
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            r = get(piece[h:k], -1)
            if pair[h] != r:
                pair[h] = r
                fresh.append((h, r))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Codec:
    """encode(text) gives ids, decode(ids) gives bytes; memory is bounded whatever the texts are.

    A boundary between pre-tokens always lies where white space follows another character, so texts are first cut before
    spaces that do; ids of recent cuts and pre-tokens are remembered (at most twice CHUNKS and PIECES, or twice
    remembered of each)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int | None = None) -> None:
        import regex

        self.ranks = ranks
        self.most_pieces, self.most_chunks = remembered or PIECES, remembered or CHUNKS
        self.tokens = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        # when the younger generation is full it becomes the older one; what is used again is young again
        self.pieces: dict[str, list[int]] = {}
        self.old_pieces: dict[str, list[int]] = {}
        self.chunks: dict[str, list[int]] = {}
        self.old_chunks: dict[str, list[int]] = {}

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a cut: those of its pre-tokens, of which the cut itself may be the only one."""
        ids = self.old_chunks.get(chunk)
        if ids is None:
            parts = self.split(chunk)
            ids = self.merged(chunk) if len(parts) == 1 and parts[0] == chunk else [i for p in parts for i in self.piece(p)]
        if len(chunk) <= 64:
            if len(self.chunks) >= self.most_chunks:
                self.old_chunks, self.chunks = self.chunks, {}
            self.chunks[chunk] = ids
        return ids

    def piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.old_pieces.get(piece)
            if ids is None:
                ids = self.merged(piece)
            if len(piece) <= 64:
                if len(self.pieces) >= self.most_pieces:
                    self.old_pieces, self.pieces = self.pieces, {}
                self.pieces[piece] = ids
        return ids

    def merged(self, piece: str) -> list[int]:
        return merge_piece(piece.encode("utf-8", "surrogateescape"), self.ranks, self.queue)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, own, extend = self.chunks.get, self.chunk, out.extend
        held: list[str] = []  # parts that end with white space: what follows belongs to the same cut
        for k, part in enumerate(text.split(" ")):
            now = " " + part if k else part
            if not part or part[-1].isspace():
                held.append(now)
                continue
            if held:
                held.append(now)
                now = "".join(held)
                held = []
            ids = get(now)
            extend(own(now) if ids is None else ids)
        if held:
            extend(own("".join(held)))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: The codecs of this process, so that tasks that follow each other in one worker share what it remembers.
_CODECS: dict[tuple[str, str, int | None], Codec] = {}


def codec_of(vocabulary: str, pattern: str, remembered: int | None = None) -> Codec:
    key = vocabulary, pattern, remembered
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(load_ranks(vocabulary), pattern, remembered)
    return _CODECS[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Adds n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256, and ids (comma-joined) if with_ids.
    vocabulary is a path that the executors can open, with the form of the tiktoken rank files. A null text counts as
    empty (0 tokens, hashes of nothing); bytes that aren't valid UTF-8 are encoded one by one, each a character of its own, and come
    back as they were; repeated rows are kept; input columns of these names are replaced, in any case; an empty table gives an
    empty table. keep: input columns to carry, else all. remembered bounds a worker's memory, which lasts beyond the task, and has no part in the result. Nothing is shuffled, and a row never needs another row."""
    fields = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *([("ids", "string")] if with_ids else [])]

    def start():
        codec = codec_of(vocabulary, pattern, remembered)
        decimal = {i: str(i) for i in codec.tokens}

        def one(raw: bytes) -> tuple:
            ids = codec.encode(raw.decode("utf-8", "surrogateescape"))
            joined = ",".join([decimal[i] for i in ids])
            out = (len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())
            return (*out, joined) if with_ids else out

        return one

    return per_text(docs, text_col, fields, start, keep)
