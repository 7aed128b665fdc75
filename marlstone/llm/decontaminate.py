"""Benchmark decontamination: document words inside windows of benchmark items.

Method: a prefix-filtered set join. The words of all items are the tokens; they are ordered
by rarity, counted over all documents. A window occurs whole or not at all, so its prefix is
one token, its rarest. Documents are joined with the windows on that token; the length and
positional bounds fix where in the document the window would have to lie, and the window is
verified there word by word.

The index of windows is sent to all tasks, in blocks of items of a bounded number of words:
a benchmark within the bound takes one pass over the documents, a larger one takes a pass
for each block, written between passes, so a task has one index at a time.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import words as W
from marlstone.llm.whole_rows import packed
from marlstone.session import ship
from marlstone.staging import Staged

WINDOW = 10
#: Words of the items that one index may hold; what is sent to each executor stays below about 200 MB.
INDEX_WORDS = 1_000_000
#: Document words handled at once.
SLICE_WORDS = 1_000_000

_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(64)], np.uint64)


def _blocks(items: DataFrame, limit: int):
    """Items with words, in blocks of about ``limit`` words at most; the driver holds one at a time."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // (6 * limit)) or 1
    dealt = items.withColumn("k", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    for k in range(n):
        yield [(r[0], r[1].encode()) for r in dealt.where(F.col("k") == k).select("item", "text").collect()]


class _Index:
    """Windows of some items, by length; words are numbers from 1, 0 is any other word."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in W.split(text, W.ALNUM)], np.int32)
            m = min(size, len(ids))
            for k in range(len(ids) - m + 1 if m else 0):
                found.setdefault(m, {}).setdefault(ids[k : k + m].tobytes(), set()).add(item)
        self.windows = found

    def order(self, counts: dict[int, int]) -> None:
        """Choose each window's rarest word as its prefix."""
        rank = np.full(len(self.vocabulary) + 1, 0, np.int64)
        for word, n in counts.items():
            rank[word] = n
        self.by_length = []
        for m, found in self.windows.items():
            rows = np.frombuffer(b"".join(found), np.int32).reshape(-1, m)
            at = np.lexsort((np.broadcast_to(np.arange(m), rows.shape), rows, rank[rows]), axis=-1)[:, 0]
            where = np.unique(np.stack([rows[np.arange(len(rows)), at], at], 1), axis=0)
            begin = np.searchsorted(where[:, 0], np.arange(len(rank) + 1))
            hashes = np.unique(self.hashes(rows.ravel(), np.arange(len(rows)) * m, m))
            self.by_length.append((m, begin, where[:, 1].astype(np.int64), hashes, found))

    @staticmethod
    def hashes(ids: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
        total = np.zeros(len(starts), np.uint64)
        for k in range(m):
            total += ids[starts + k].astype(np.uint64) * _FACTORS[k % 64]
        return W.mix(total)

    def find(self, ids: np.ndarray, ends: np.ndarray):
        """(start, length, items) of all windows in texts that lie one after the other and end at ``ends``."""
        for m, begin, offsets, hashes, found in self.by_length:
            per = begin[ids + 1] - begin[ids]
            at = np.flatnonzero(per)
            if not len(at):
                continue
            reps = per[at]
            pick = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(begin[ids[at]], reps)
            at = np.repeat(at, reps)
            start = at - offsets[pick]
            text = np.searchsorted(ends, at, side="right")
            lower = np.where(text > 0, ends[text - 1], 0)
            start = np.unique(start[(start >= lower) & (start + m <= ends[text])])
            h = self.hashes(ids, start, m)
            near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for s in start[hashes[near] == h].tolist():
                if items := found.get(ids[s : s + m].tobytes()):
                    yield s, m, items


def _tokens(batch: pa.RecordBatch, index: _Index):
    """Slices (first row, word numbers, ends) of a batch's texts."""
    get, first, parts, ends, total = index.vocabulary.get, 0, [], [], 0
    column = W.texts(batch.column("text"))
    for row, text in enumerate(column):
        words = W.split(text, W.ALNUM)
        parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        total += len(words)
        ends.append(total)
        if total >= SLICE_WORDS or row == len(column) - 1:
            yield first, np.concatenate(parts), np.array(ends)
            first, parts, ends, total = row + 1, [], [], 0


def _count(sent):
    def run(batches):
        index = sent.value
        total = np.zeros(len(index.vocabulary) + 1, np.int64)
        for batch in batches:
            for _, ids, _ in _tokens(batch, index):
                total += np.bincount(ids, minlength=len(total))
        held = np.flatnonzero(total[1:]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["word", "n"])

    return run


def _scan(sent):
    def run(batches):
        index = sent.value
        for batch in batches:
            before, had = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            sizes, spans, items = [], [], []
            for first, ids, ends in _tokens(batch, index):
                starts = np.r_[0, ends[:-1]]
                edge = np.zeros(len(ids) + 1, np.int32)
                named: dict[int, set[str]] = {}
                for s, m, got in index.find(ids, ends):
                    edge[s] += 1
                    edge[s + m] -= 1
                    named.setdefault(int(np.searchsorted(ends, s, side="right")), set()).update(got)
                touched = set(named)
                for k in range(len(ends)):
                    if before[first + k]:
                        touched.add(k)
                        for a, b in zip(before[first + k][::2], before[first + k][1::2], strict=True):
                            edge[starts[k] + a] += 1
                            edge[starts[k] + b] -= 1
                hit = np.cumsum(edge[:-1]) > 0
                for k in range(len(ends)):
                    sizes.append(int(ends[k] - starts[k]))
                    if k in touched:
                        own = np.r_[False, hit[starts[k] : ends[k]], False]
                        spans.append(np.flatnonzero(own[1:] != own[:-1]).tolist())
                    else:
                        spans.append([])
                    items.append(sorted(named.get(k, set()) | set(had[first + k] or ())))
            cols = {name: batch.column(name) for name in batch.schema.names}
            cols |= {"n_words": pa.array(sizes, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, index_words: int = INDEX_WORDS) -> DataFrame:
    """Each row of ``docs`` with what it shares with the benchmark.

    Returns ``row`` (a struct of all columns of ``docs``, so clashing names do no harm),
    ``n_words``, ``spans`` (starts and ends of the hit runs of words, flat), ``items`` (sorted
    names of the items with occurring windows), ``n_hit``, ``contaminated``. A null or empty
    text has no words and no hits. Items with a null id, a null text or no words are none.
    Items that share an id are one item with the windows of all its texts; repeated
    documents are each scanned. Long texts are scanned whole. Empty tables give no hits or no
    rows.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text_col].cast("string").alias("text")).dropna()
    out = docs.select(packed(docs), docs[text_col].cast("string").alias("text")).withColumns(
        {"n_words": F.lit(None).cast("long"), "spans": F.lit(None).cast("array<int>"), "items": F.lit(None).cast("array<string>")}
    )
    narrow = docs.select(docs[text_col].cast("string").alias("text"))
    written = None
    for k, block in enumerate(_blocks(items, index_words)):
        if k:
            before, written = written, Staged(out, "op3-pass")
            out = written.df
            if before is not None:
                before.drop()
        index = _Index(block, window)
        counts = {r[0]: r[1] for r in narrow.mapInArrow(_count(spark.sparkContext.broadcast(index)), "word int, n long").groupBy("word").agg(F.sum("n")).collect()}
        index.order(counts)
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(index)), out.schema)
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("row", "n_words", "spans", "items", hit.alias("n_hit"), (hit > 0).alias("contaminated"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """``contamination`` by document id: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = contamination(docs.select(docs[id_col].alias("doc_id"), docs[kwargs.get("text_col", "text")].alias(kwargs.get("text_col", "text"))), benchmark, **kwargs)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )
