"""Byte-level BPE over a rank file, with a hierarchical-bitmap rank queue for the merges.

A pre-token's bytes form a linked list. Every mergeable neighbouring pair waits in the bucket of its rank; a
two-level bitmap over ranks gives the lowest rank that has a bucket (find-first-set at each level). Buckets
hold list positions; an entry whose pair has changed since is stale and skipped. A pre-token of n bytes takes
O(n) queue operations of constant cost, so white-space-free texts of any length are no special case.

Pre-tokens don't affect one another, so the distinct ones of a block share one queue: their lists lie behind one
another with a barrier between them, and a bucket is merged at once, the leftmost entry of each pre-token; its other
entries go back, as a lower rank may come up before them. Long pre-tokens have a queue of their own.

Cases: null and empty texts give no ids; ties within a rank go from left to right; repeated rows give repeated
results; special tokens' strings are ordinary text. Only the named columns of the input are read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_blocks

#: Pre-tokens of more bytes have a queue of their own and aren't remembered.
LONG = 48
#: Bytes that a worker's table of remembered pre-tokens takes, about; there is one older table of the same size.
REMEMBER_BYTES, ENTRY_BYTES = 12 << 20, 220


_BIT = [1 << i for i in range(1024)]


class RankQueue:
    """Buckets of positions by rank, and the lowest rank that has one. A word of the lower level has 1024 bits, and
    the upper level has a bit for each word that isn't 0."""

    def __init__(self, n_ranks: int):
        self.low = [0] * ((n_ranks >> 10) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, entry: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.fill(rank, [entry])
        else:
            bucket.append(entry)

    def fill(self, rank: int, bucket: list[int]) -> None:
        """Sets the bucket of a rank that has none."""
        self.buckets[rank] = bucket
        a = rank >> 10
        self.low[a] |= _BIT[rank & 1023]
        self.top |= _BIT[a]

    def pop(self) -> tuple[int, list[int]]:
        """Takes the lowest rank and its bucket; there has to be one."""
        a = (self.top & -self.top).bit_length() - 1
        w = self.low[a]
        bit = w & -w
        self.low[a] = w = w ^ bit
        if not w:
            self.top ^= _BIT[a]
        rank = (a << 10) + bit.bit_length() - 1
        return rank, self.buckets.pop(rank)


class Codec:
    """Encoder and decoder for a rank file in tiktoken's format and a pre-tokenisation pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))
        self.find = regex.compile(pattern).findall
        self.barrier = max(self.ranks.values()) + 1
        self.queue = RankQueue(self.barrier)
        self.of_byte = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        # Rank of what two ids make together, by both ids.
        made = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    made[a * (self.barrier + 1) + b] = rank
        self.made = np.array(sorted(made), np.int64)
        self.made_rank = np.array([made[k] for k in self.made.tolist()], np.int32)
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank merges first, the leftmost of equals."""
        get, queue, n = self.ranks.get, self.queue, len(piece)
        if (whole := get(piece)) is not None:
            return [whole]
        push = queue.push
        after, before = list(range(1, n + 2)), list(range(-1, n))  # after[i]: end of the part that starts at i
        pair = [get(piece[i : i + 2], -1) for i in range(n)]  # rank of the part at i with the next one; -1: none
        pair[-1] = -1
        for i, r in enumerate(pair):
            if r >= 0:
                push(r, i)
        while queue.top:
            rank, bucket = queue.pop()
            if len(bucket) > 1:
                bucket.sort()
            for k, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale: i has gone, or it or its neighbour has grown
                j = after[i]
                after[i] = end = after[j]
                pair[i] = pair[j] = x = y = -1
                if end < n:
                    before[end] = i
                    pair[i] = x = get(piece[i : after[end]], -1)
                    if x >= 0:
                        push(x, i)
                if i:
                    h = before[i]
                    pair[h] = y = get(piece[h:end], -1)
                    if y >= 0:
                        push(y, h)
                if 0 <= x < rank or 0 <= y < rank:  # a lower rank has come up: it goes first
                    for e in bucket[k + 1 :]:
                        push(rank, e)
                    break
        out, i = [], 0
        while i < n:
            end = after[i]
            out.append(self.ranks[piece[i:end]])
            i = end
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of what a and b make together; -1: none."""
        key = a.astype(np.int64) * (self.barrier + 1) + b
        at = np.minimum(np.searchsorted(self.made, key), len(self.made) - 1)
        return np.where(self.made[at] == key, self.made_rank[at], -1)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens that aren't tokens themselves, as encode() gives them; as merge() does for each."""
        if not pieces:
            return []
        if not len(self.made):
            return [np.array(self.merge(p), "<u4").tobytes() for p in pieces]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        barriers = np.cumsum(size) - 1
        ids = self.of_byte[np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)]
        ids[barriers] = self.barrier
        n = len(ids)
        piece_of = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.append(self._rank(ids[:-1], ids[1:]), np.int32(-1))
        queue = RankQueue(self.barrier)
        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        start = np.flatnonzero(np.diff(pair[at], prepend=-1))
        for rank, bucket in zip(pair[at[start]].tolist(), np.split(at, start[1:]), strict=False):
            queue.fill(rank, bucket.tolist())
        while queue.top:
            rank, bucket = queue.pop()
            p = np.array(bucket)
            p = p[pair[p] == rank]  # the others are stale
            if not len(p):
                continue
            p.sort()
            first = np.diff(piece_of[p], prepend=-1) != 0
            if not first.all():
                queue.fill(rank, p[~first].tolist())
                p = p[first]
            gone = after[p]
            after[p] = end = after[gone]
            before[end] = p
            ids[p], ids[gone], pair[gone] = rank, -1, -1
            h = before[p]
            left, right = np.concatenate([p, h]), np.concatenate([end, p])
            pair[left] = new = self._rank(ids[left], ids[right])
            some = np.flatnonzero(new >= 0)
            for r, i in zip(new[some].tolist(), left[some].tolist(), strict=True):
                queue.push(r, i)
        ids[barriers] = -1
        live = ids >= 0
        count = np.add.reduceat(live, barriers - size + 1, dtype=np.int64)
        packed, ends = ids[live].astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Each distinct pre-token is merged once."""
        found = list(map(self.find, texts))
        table, many = {}, []
        for token in set(chain.from_iterable(found)):
            ids = self.seen.get(token) or self.older.get(token)
            if ids is not None:
                table[token] = ids
                continue
            raw = token.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                table[token] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                table[token] = np.array(self.merge(raw), "<u4").tobytes()
            else:
                many.append((token, raw))
        table.update(zip([t for t, _ in many], self.merge_all([raw for _, raw in many]), strict=True))
        out = [b"".join(map(table.__getitem__, tokens)) for tokens in found]
        most = REMEMBER_BYTES // ENTRY_BYTES
        for token, ids in table.items():
            if len(token) <= LONG and token not in self.seen:
                if len(self.seen) >= most:
                    self.seen, self.older = {}, self.seen
                self.seen[token] = ids
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process, whichever tasks it runs."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): the whole text's token ids, without special tokens."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches):
        c = codec(path, pattern)
        for block in text_blocks(batches, text):
            ids = [np.frombuffer(x, "<i4") for x in c.encode_all([t or "" for t in block.column(1).to_pylist()])]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, data binary): the bytes that the ids stand for."""
    schema = f"`{key}` {encoded.schema[key].dataType.simpleString()}, data binary"

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            data = [c.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [key, "data"])

    return encoded.select(key, ids).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, decodes what was encoded, and returns counts and checksums of both."""
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"]
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"

    def run(batches):
        c = codec(path, pattern)
        for block in text_blocks(batches, text):
            rows = []
            for ids in c.encode_all([t or "" for t in block.column(1).to_pylist()]):
                back = c.decode(ids)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), len(back)))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return docs.select(key, text).mapInArrow(run, schema)
