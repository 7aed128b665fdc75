"""Cross-entropy difference between a target and a background bigram model.

Both models are of the same kind and smoothing and share the vocabulary of all documents:
``P(w | v) = (c(v, w) + k) / (c(v) + k V)``, where the background counts over all documents
and the target over the documents marked as such. A document's score is the mean over its
words of the target's loss minus the background's: the lower, the more it is like the target.

A loss is a sum of a term for the pair and a term for its context, so each is the business of
one key. Keys are counted by the block exchange (see ``blocks``): a range of keys counts over
all documents and answers each block with sums by document, never with the table of counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import blocks as B
from marlstone.llm import words as W
from marlstone.session import ship

SMOOTHING = 0.05
#: Bits of the hashes of pairs and contexts, the last of which tells the two apart.
KEY_BITS = 56
#: Losses add up as whole multiples of this, so the order of additions does not matter.
UNIT = 2.0**-24
#: Ids of target documents that may be broadcast.
BROADCAST_IDS = 1_000_000

_START = np.uint64(0x5851F42D4C957F2D)
_OUT = "doc_id long, n_tokens long, loss_target double, loss_background double"


def pair_keys(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a text's pairs (even) and contexts (odd), with their counts."""
    before = np.r_[_START, h[:-1]]
    low = np.uint64(64 - bits)
    cut = lambda x, tag: (((x >> low) | np.uint64(1)) ^ np.uint64(1 - tag)) << low
    keys = np.r_[cut(W.mix(before * W._ODD[0] + h * W._ODD[1]), 0), cut(W.mix(before * W._ODD[2]), 1)]
    return np.unique(keys, return_counts=True)


def _sent(at: B.Layout, bits: int):
    def info(block: B.Block):
        rows, lists = block.rows()
        home = xxhash.xxh3_64_intdigest(block.blk) % at.ranges
        ids = [x[0] for x in block.info]
        known = np.array([x is not None for x in ids], np.uint64)
        head = B.pack(known, np.array([x or 0 for x in ids], np.int64).view(np.uint64), np.array([x[1] for x in block.info], np.uint64))
        return B.batch([*rows, (home, block.blk, 0, lists), (home, block.blk, 2, head)])

    def run(batches):
        block, made = B.Block(at, 0), 0
        for batch in batches:
            for doc, marked, text in zip(batch.column("doc_id").to_pylist(), batch.column("marked").to_pylist(), W.texts(batch.column("text")), strict=True):
                words = W.split(text)
                keys, counts = pair_keys(W.word_hashes(words), bits) if words else (np.empty(0, np.uint64), np.empty(0, np.int64))
                block.add(keys, counts, (doc, len(words)), bool(marked))
                if block.full:
                    yield info(block)
                    made += 1
                    block = B.Block(at, made)
        if block.info:
            yield info(block)
        del block
        W.release()

    return run


def _folded(x: np.ndarray) -> np.ndarray:
    """Signed as unsigned, small ones small."""
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _unfolded(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def _answer(bits: int, k: float, vocabulary: int):
    def run(table: pa.Table) -> pa.Table:
        kinds, blks = (table.column(c).to_pylist() for c in ("kind", "blk"))
        payload = lambda i: table.column("payload")[i].as_py()
        bucket = table.column("bucket")[0].as_py()
        sent = [i for i, x in enumerate(kinds) if x == 1]
        out = [(bucket, blks[i], kinds[i], payload(i)) for i in range(len(kinds)) if kinds[i] != 1]
        r = B.Range(map(payload, sent))
        context = ((r.keys >> np.uint64(64 - bits)) & np.uint64(1)).astype(bool)
        term = lambda c: np.rint(np.where(context, np.log(c + k * vocabulary), -np.log(c + k)) / UNIT).astype(np.int64)
        target, back = term(r.marked), term(r.total)
        for i, (at, docs, counts, many) in zip(sent, r.each(), strict=True):
            held = np.unique(docs)
            where = np.searchsorted(held, docs)
            sums = []
            for t in (target, back):
                s = np.zeros(len(held), np.int64)
                np.add.at(s, where, t[at] * counts.astype(np.int64))
                sums.append(_folded(s))
            out.append((bucket, blks[i], 1, B.pack(held.astype(np.uint64), *sums, _folded(target[many]), _folded(back[many]))))
        return pa.Table.from_batches([B.batch(out)])

    return run


def _losses(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("payload").to_pylist(), strict=True))
    holders, docs, counts = B.unpack(next(p for k, _, p in rows if k == 0))
    known, ids, sizes = B.unpack(next(p for k, _, p in rows if k == 2))
    got = [B.unpack(p) for k, _, p in rows if k == 1]
    out = []
    for side in (0, 1):
        total = np.zeros(len(ids), np.int64)
        for g in got:
            np.add.at(total, g[0].astype(np.int64), _unfolded(g[1 + side]))
        each = np.concatenate([*(_unfolded(g[3 + side]) for g in got), np.empty(0, np.int64)])
        np.add.at(total, docs.astype(np.int64), np.repeat(each, holders.astype(int)) * counts.astype(np.int64))
        out.append(total * UNIT)
    names = [int(i) if f else None for i, f in zip(ids.view(np.int64), known, strict=True)]
    return pa.table([pa.array(names, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(out[0]), pa.array(out[1])], names=["doc_id", "n_tokens", "loss_target", "loss_background"])


def _distinct(ranges: int):
    """Sorted distinct word hashes of parts of the documents, by range."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))
    edges = np.arange(1, ranges, dtype=np.uint64) << shift

    def rows(parts):
        h = np.unique(np.concatenate(parts) >> np.uint64(8))
        at = np.r_[0, np.searchsorted(h, edges >> np.uint64(8)), len(h)]
        return B.batch([(b, b"", 1, B.pack(B.deltas(h[at[b] : at[b + 1]]))) for b in range(ranges) if at[b + 1] > at[b]])

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            for text in W.texts(batch.column("text")):
                if words := W.split(text):
                    parts.append(np.unique(W.word_hashes(words)))
                    n += len(parts[-1])
                if n >= 4 * B.BLOCK_ENTRIES:
                    yield rows(parts)
                    parts, n = [], 0
        if parts:
            yield rows(parts)

    return run


def _number(table: pa.Table) -> pa.Table:
    found = np.unique(np.concatenate([B.sums(B.unpack(p)[0]) for p in table.column("payload").to_pylist()]))
    return pa.table([pa.array([len(found)], pa.int64())], names=["n"])


def vocabulary_size(docs: DataFrame) -> int:
    """Distinct words of all documents."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = B.layout(size // 24).ranges
    sent = docs.select("text").mapInArrow(_distinct(ranges), B.SCHEMA)
    return B.by_range(sent, ranges, _number, "n long").agg(F.sum("n")).first()[0] or 0


def entropy_difference(docs: DataFrame, targets: DataFrame, k: float = SMOOTHING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, loss_target, loss_background, score`` for each row of ``docs``.

    ``targets`` names the target documents by id. Losses are in nats, summed over the words
    between ASCII white space after A-Z became lower case; ``score`` is their difference per
    word, and null for a null or blank text. With no target document the target model is
    uniform over the vocabulary. A null id is no target; repeated rows count each. Long texts
    count whole. Other columns are ignored. An empty table gives no rows. Pairs and contexts
    are told apart by 55 bits: among n of them one shares its count with another with a chance
    of ``n / 2**55``, or one in 36,000 at 1e12 of them.
    """
    ship(docs.sparkSession)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, at = KEY_BITS, B.layout(size // 12)
    marks = targets.select(targets[id_col].cast("long").alias("doc_id")).dropna().distinct().withColumn("marked", F.lit(True))
    if marks.count() <= BROADCAST_IDS:
        marks = F.broadcast(marks)
    both = docs.join(marks, "doc_id", "left").select("doc_id", "marked", "text")
    sent = both.mapInArrow(_sent(at, bits), B.SCHEMA)
    answers = B.by_range(sent, at.ranges, _answer(bits, k, max(1, vocabulary_size(docs))), B.SCHEMA)
    out = answers.groupBy("blk").applyInArrow(_losses, _OUT)
    return out.withColumn("score", F.when(F.col("n_tokens") > 0, (F.col("loss_target") - F.col("loss_background")) / F.col("n_tokens")))
