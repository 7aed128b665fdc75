"""Packing documents into sequences of bounded length by minimum bin slack.

For a sequence the longest piece at hand is taken, and subset sums on a bitset of reachable lengths
find the fullest combination with the others. The combination is taken as often as the numbers of pieces
allow and then removed; it uses up one of its lengths.

Each task does so with the pieces it has encoded, some millions of ids at a time, and keeps the
combinations without any slack: no packing has better ones. They are written where they were made, so
most ids are never shuffled. It stops while it has pieces enough to choose from, and what all tasks leave over,
short pieces for the most part, is packed together. Pieces of
equal length are the same to a packing, so their plan is made from the numbers of pieces of each
length, at most a few thousand whatever the data. Sums over the tasks' counts make the numbers of
the pieces global without a sort, and a piece's number says by the plan in which sequence it goes and where.
"""

from __future__ import annotations

import zlib
from collections import deque
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import words as W
from marlstone.llm.token_files import SUMMED, VERIFIED, encoder, slices
from marlstone.session import ship
from marlstone.staging import Staged, new_path

CAPACITY = 2048
END_ID = 0
#: Ids that a task packs at a time; it leaves an eighth over, and what is beyond a half for want of full combinations.
TASK_IDS = 4_000_000
#: Counts of (task, length) of pieces left over that are broadcast; more are joined by a shuffle of those pieces.
BROADCAST_COUNTS = 200_000
#: Bytes of input that a task takes at least where there are more tasks than cores, and tasks beyond which that is left alone.
LEAST_BYTES, MOST_TASKS = 4 << 20, 1 << 20
#: Files of small tables, and ids of a file of the pieces left over.
FILES, FILE_IDS = 8, 1 << 24
#: Sequences of a task are numbered from its own number times 2^32, those of the pieces left over from here.
REST = 1 << 62

#: Rows of a packed data set, those of a sequence in one file, one after the other by ``offset``.
PACKED = "sequence_id long, offset long, doc_id long, piece int, start long, length int, ids binary"
#: What a task writes: the same, and ``number`` among its pieces of a length where a piece is left over and has no sequence.
WRITTEN = f"{PACKED}, part int, number long"


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of at most ``counts`` pieces of each length that fills most of ``room``; ``lengths`` descend.

    Of equally full ones it has the longest pieces: a length is used only for a sum that longer ones can't make.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for size in lengths:
        left = min(counts[size], room // size)
        take = 1
        while left > 0:
            take = min(take, left)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            left -= take
            take *= 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            used[size] = used.get(size, 0) + take
            at -= size * take
    return used


def combinations(counts: dict[int, int], capacity: int, full: bool = False):
    """(pieces of each length in a sequence, sequences of that kind) for numbers of pieces by length, which are used up.

    ``full``: only those without slack; a longest piece without such a combination is passed over and stays.
    """
    lengths = sorted((n for n in counts if counts[n]), reverse=True)
    while lengths:
        longest = lengths[0]
        room = capacity - longest
        counts[longest] -= 1
        used = fullest([n for n in lengths if n <= room], counts, room) if room else {}
        counts[longest] += 1
        if full and sum(n * k for n, k in used.items()) < room:
            lengths = lengths[1:]
            continue
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * times
        yield used, times
        lengths = [n for n in lengths if counts[n]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """The combinations of all pieces, for their numbers by length."""
    return list(combinations(dict(histogram), capacity))


def _entries(patterns: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """(length, first number, number after the last, how many in a sequence, first sequence, first offset) of the plan."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for used, times in patterns:
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            low = taken.get(n, 0)
            taken[n] = low + k * times
            rows.append((n, low, low + k * times, k, sequence, offset))
            offset += n * k
        sequence += times
    return rows


class _Packer:
    """Pieces of one task: ``add()`` them, ``rows()`` of full sequences, and in the end ``rest()``."""

    def __init__(self, part: int, capacity: int, least: int):
        self.part, self.capacity, self.least = part, capacity, least
        self.held: dict[int, deque] = {}
        self.size, self.sequences = 0, part << 32
        self.numbers = np.zeros(capacity + 1, np.int64)

    def add(self, piece: tuple) -> None:
        self.held.setdefault(len(piece[3]), deque()).append(piece)
        self.size += len(piece[3])

    def rows(self):
        counts = {n: len(x) for n, x in self.held.items()}
        for used, most in combinations(counts, self.capacity, full=True):
            times = min(most, (self.size - self.least) // self.capacity)
            if times <= 0:
                return
            for _ in range(times):
                offset = 0
                for n, k in sorted(used.items(), reverse=True):
                    for _ in range(k):
                        yield (self.sequences, offset, *self.held[n].popleft(), None)
                        offset += n
                self.sequences += 1
            self.size -= times * self.capacity

    def rest(self):
        for n, pieces in sorted(self.held.items()):
            for piece in pieces:
                yield (None, None, *piece, int(self.numbers[n]))
                self.numbers[n] += 1
        self.held, self.size = {}, 0

    def batches(self, rows):
        """Record batches of ``WRITTEN`` of bounded size."""
        while held := list(islice(rows, 2000)):
            seq, offset, doc, piece, start, ids, number = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(seq, pa.int64()), pa.array(offset, pa.int64()), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array([len(x) for x in ids], pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(np.full(len(held), self.part, np.int32)), pa.array(number, pa.int64()),
                ],
                ["sequence_id", "offset", "doc_id", "piece", "start", "length", "ids", "part", "number"],
            )


def _packed(tokenizer: str, end_id: int, capacity: int, task_ids: int):
    def run(batches):
        enc, packer = encoder(tokenizer), _Packer(TaskContext.get().partitionId(), capacity, task_ids // 8)
        kind, tail = "<u2" if max(enc.size - 1, end_id) < 1 << 16 else "<u4", np.array([end_id], "<u4")
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for first, texts in slices(batch):
                for doc, ids in zip(docs[first:], enc.encode(texts), strict=False):
                    ids = np.concatenate([ids, tail]).astype(kind)
                    for k in range(-(-len(ids) // capacity)):
                        packer.add((doc, k, k * capacity, ids[k * capacity : (k + 1) * capacity]))
                if packer.size >= task_ids:
                    yield from packer.batches(packer.rows())
                    if packer.size > task_ids // 2:
                        yield from packer.batches(packer.rest())
        yield from packer.batches(packer.rows())
        yield from packer.batches(packer.rest())
        W.trim()

    return run


def pack(docs: DataFrame, path: str | None = None, tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", task_ids: int = TASK_IDS) -> str:
    """Encode each text, append ``end_id``, pack all and write the data set ``PACKED``; returns its path.

    Only a document of more than ``capacity`` ids is cut, into pieces of ``capacity`` and a last one that
    may be shorter. Ids take two bytes, or four where the vocabulary needs them. Null texts are empty, so
    they are the end id alone. Null ids stay; repeated rows and ids are each packed. Texts of any length
    are encoded whole. Other columns are ignored. An empty table gives an empty data set.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or new_path(spark, "packed")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # Tasks of a few rows have little to choose from and leave small files.
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, min(-(-size // LEAST_BYTES), MOST_TASKS)))
    rows.mapInArrow(_packed(tokenizer, end_id, capacity, task_ids), WRITTEN).write.options(**SUMMED).parquet(f"{path}/full")
    left = spark.read.schema(WRITTEN).parquet(f"{path}/full").where("sequence_id IS NULL").drop("sequence_id", "offset")
    counts = Staged(left.groupBy("part", "length").agg(F.count("*").alias("n")).coalesce(FILES), "pack-counts")
    # At most ``capacity`` rows, and a plan of at most as many kinds of sequences as their lengths can be used up.
    patterns = plan(dict(counts.df.groupBy("length").agg(F.sum("n")).collect()), capacity)
    places = spark.createDataFrame(_entries(patterns), "_length int, low long, high long, each long, first long, at long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.df.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if counts.df.count() <= BROADCAST_COUNTS else bases
    numbered = left.join(bases, ["part", "length"]).withColumn("slot", F.col("base") + F.col("number"))
    put = numbered.join(F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("slot") >= F.col("low")) & (F.col("slot") < F.col("high")))
    sequence, offset = F.expr("first + (slot - low) div each") + REST, F.col("at") + (F.col("slot") - F.col("low")) % F.col("each") * F.col("length")
    out = put.select(sequence.alias("sequence_id"), offset.alias("offset"), "doc_id", "piece", "start", "length", "ids")
    ids = sum(n * k * times for used, times in patterns for n, k in used.items())
    out.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").coalesce(max(FILES, ids // FILE_IDS)).write.options(**SUMMED).parquet(f"{path}/rest")
    counts.drop()
    return path


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    full, rest = (spark.read.options(**VERIFIED).schema(PACKED).parquet(f"{path}/{k}") for k in ("full", "rest"))
    return full.where("sequence_id IS NOT NULL").unionByName(rest)


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """``sequence_id, n_tokens, parts`` (doc_id, piece, start, length of each piece in order) ``, ids`` of each packed sequence."""
    rows = read_packed(spark, path).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids"))).alias("p"))
    parts = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["start"].alias("start"), x["length"].alias("length")))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), parts.alias("parts"), joined.alias("ids"))


def _summed(batches):
    for batch in batches:
        crcs = []
        for ids, n in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist(), strict=True):
            crcs.append(zlib.crc32(np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "piece", "start")), batch.column("length").cast(pa.int64()), pa.array(crcs, pa.int64()), batch.column("sequence_id"), batch.column("offset")], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """From the packed files: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece."""
    ship(spark)
    return read_packed(spark, path).mapInArrow(_summed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
