"""Counts of keys over all documents, brought back to the documents that hold them.

Joining (document, key) rows with a table of key counts would shuffle each row twice. Here
documents are taken in blocks of half a million entries or more. A block sends each range of the
hashed key space one byte string of its sorted keys (differences of neighbours, by byte
planes, which the shuffle's compression shrinks to the bytes that carry information). The
task of a range counts its keys over all blocks and answers each block, and the answers of a
block meet again in one task. A key that several documents of a block hold is sent once with
its count, and the list of those documents goes straight to the block's own group: what a
frequent key costs its range depends on the number of blocks, not of documents.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a block and of a range on average, for small tables and at most.
BLOCK_ENTRIES, MOST_BLOCK = 500_000, 2_000_000
RANGE_ENTRIES, MOST_RANGE = 2_000_000, 4_000_000
#: Entries that a block should send to a range: blocks and then ranges grow with the data until their bounds for it.
SENT_ENTRIES = 2000
#: Entries of a block for each document that it may hold.
DOC_ENTRIES = 16

SCHEMA = "bucket long, blk binary, kind int, payload binary"
U64 = np.uint64


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned integer arrays by byte planes, high planes of zeros left out."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, U64)
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        out += [struct.pack("<IB", len(a), width), a.view("u1").reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width = struct.unpack_from("<IB", data, at)
        at += 5
        a = np.zeros((n, 8), "u1")
        a[:, :width] = np.frombuffer(data, "u1", n * width, at).reshape(width, n).T
        at += n * width
        out.append(a.view(U64).ravel())
    return out


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=U64(0))


def sums(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=U64)


class Layout(NamedTuple):
    """How a number of entries is dealt out: ranges of the key space, a power of two, and entries of a block."""

    ranges: int
    block: int


def layout(entries: int) -> Layout:
    size = RANGE_ENTRIES
    while True:
        ranges = 1 << max(4, int(max(1, entries // size) - 1).bit_length())
        if ranges * SENT_ENTRIES <= MOST_BLOCK or size >= MOST_RANGE:
            return Layout(ranges, min(max(BLOCK_ENTRIES, ranges * SENT_ENTRIES), MOST_BLOCK))
        size *= 2


def by_range(sent: DataFrame, ranges: int, answer: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``answer`` of all rows of each range. A range is a task of its own, dealt by number, so no task gets two where another gets none."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from answer(pa.Table.from_batches(held)).to_batches()

    return sent.repartitionById(ranges, F.col("bucket").cast("int")).mapInArrow(run, schema)


class Block:
    """Entries of some documents: ``add()`` each document, then ``rows()``.

    Its id is the task's partition and its number there, so a task that runs again makes
    the same blocks again.
    """

    def __init__(self, at: Layout, number: int):
        self.blk = struct.pack(">QQ", TaskContext.get().partitionId(), number)
        self.ranges, self.most = at
        self.shift = U64(64 - (self.ranges.bit_length() - 1))
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.marked: list[bool] = []
        self.info: list[tuple] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None, info: tuple, marked: bool = False) -> None:
        """keys: the document's distinct ones; counts: how often it holds each (None: once)."""
        self.keys.append(keys)
        self.counts.append(np.ones(len(keys), U64) if counts is None else counts.astype(U64))
        self.marked.append(marked)
        self.info.append(info)
        self.size += len(keys)

    @property
    def full(self) -> bool:
        return self.size >= self.most or len(self.info) >= self.most // DOC_ENTRIES

    def rows(self) -> tuple[list[tuple], bytes]:
        """Rows (bucket, blk, 1, payload) for the ranges, and the lists of this block's shared keys."""
        blk = self.blk
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        docs = np.repeat(np.arange(len(self.info), dtype=U64), [len(k) for k in self.keys])
        marked = np.repeat(np.array(self.marked, bool), [len(k) for k in self.keys])
        order = np.argsort(keys, kind="stable")
        keys, counts, docs, marked = keys[order], counts[order], docs[order], marked[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
        holders = np.diff(np.append(first, len(keys)))
        solo = np.repeat(holders == 1, holders)
        sk, sd, sc, sm = keys[solo], docs[solo], counts[solo], marked[solo]
        many = first[holders > 1]
        mk, mh = keys[many], holders[holders > 1]
        total = np.add.reduceat(counts, first)[holders > 1] if len(first) else np.empty(0, U64)
        inside = np.add.reduceat(counts * marked, first)[holders > 1] if len(first) else np.empty(0, U64)
        edges = np.arange(1, self.ranges, dtype=U64) << self.shift
        s_at, m_at = (np.r_[0, np.searchsorted(k, edges), len(k)] for k in (sk, mk))
        rows = []
        for b in np.flatnonzero(np.diff(s_at) + np.diff(m_at)).tolist():
            s, m = slice(s_at[b], s_at[b + 1]), slice(m_at[b], m_at[b + 1])
            rows.append((b, blk, 1, pack(deltas(sk[s]), sd[s], sc[s] * U64(2) + sm[s], deltas(mk[m]), mh[m], total[m], inside[m])))
        return rows, pack(mh, docs[~solo], counts[~solo])


def batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of SCHEMA."""
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)], ["bucket", "blk", "kind", "payload"])


class Range:
    """What the blocks sent to one range of the key space, with the counts over all of them.

    Payloads are taken one at a time; of each only what an answer needs is kept.
    """

    def __init__(self, payloads):
        self.parts, keys = [], []
        for p in payloads:
            sk, sd, scm, mk, mh, total, inside = unpack(p)
            keys += [sums(sk), sums(mk)]
            self.parts.append((sd.astype(np.uint32), (scm >> U64(1)).astype(np.uint32), (scm & U64(1)).astype(bool), mh, total, inside))
        ends = np.cumsum([len(k) for k in keys])
        whole = np.concatenate([*keys, np.empty(0, U64)])
        del keys
        self.keys, at = np.unique(whole, return_inverse=True)
        self.at = np.split(at, ends[:-1]) if len(ends) else []

    def _weight(self, solo, many) -> np.ndarray:
        """Sums by key of a weight of each solo key and of each shared key, block by block."""
        out = np.zeros(len(self.keys))
        for i, p in enumerate(self.parts):  # a block's keys are distinct
            out[self.at[2 * i]] += solo(p)
            out[self.at[2 * i + 1]] += many(p)
        return out

    @cached_property
    def documents(self) -> np.ndarray:
        """By key: documents that hold it."""
        return self._weight(lambda p: 1, lambda p: p[3]).astype(np.int64)

    @cached_property
    def total(self) -> np.ndarray:
        """By key: occurrences."""
        return self._weight(lambda p: p[1], lambda p: p[4])

    @cached_property
    def marked(self) -> np.ndarray:
        """By key: occurrences in marked documents."""
        return self._weight(lambda p: p[1] * p[2], lambda p: p[5])

    def each(self):
        """For each block: its solo keys' places in ``keys``, documents and counts; its shared keys' places."""
        for i, p in enumerate(self.parts):
            yield self.at[2 * i], p[0].astype(np.int64), p[1], self.at[2 * i + 1]
