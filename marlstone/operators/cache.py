"""A keyed cache of results with a time to live, as tables."""

from __future__ import annotations

import json
import random
import re
import unicodedata
import zlib
from collections.abc import Iterable
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marlstone.functions.fixed import CACHE_SECONDS, SPACE, SWEEP_CHANCE
from marlstone.session import ship
from marlstone.staging import stage

ENTRY = "key string, payload string, expires_at timestamp"


def seconds(raw: object = None) -> float:
    """A time to live from a setting; the default unless it is a positive, finite number."""
    try:
        n = float(raw)
    except (TypeError, ValueError):
        return CACHE_SECONDS
    return n if 0 < n < float("inf") else CACHE_SECONDS


def normal_keyword(keyword: str) -> str:
    return re.sub(f"[{SPACE}]+", " ", unicodedata.normalize("NFKC", keyword).lower()).strip(" ")


def key(keyword: str, sources: Iterable[str] = (), prefer: str | None = None, limit: int | None = None, offset: int | None = None, refined: bool = False) -> str:
    """One text for all spellings of a query."""
    parts = {"k": normal_keyword(keyword), "s": sorted(sources), "p": prefer, "l": limit, "o": offset, "llm": refined}
    return json.dumps(parts, ensure_ascii=False, separators=(",", ":"))


@F.arrow_udf(StringType())
def composed(text: pa.Array) -> pa.Array:
    """Unicode normal form NFKC of the distinct values of a batch; Spark has no function for it, and Arrow's own leaves letters and marks apart."""
    coded = text.cast(pa.string()).dictionary_encode()
    normal = [x if x.isascii() else unicodedata.normalize("NFKC", x) for x in coded.dictionary.to_pylist()]
    return pa.array(normal, pa.string()).take(coded.indices)


def key_column(keyword: Column, sources: Column, prefer: Column, limit: Column, offset: Column, refined: Column) -> Column:
    """``key`` over columns."""
    from marlstone.functions.text import collapse

    ship(SparkSession.active())
    parts = F.struct(collapse(F.lower(composed(keyword))).alias("k"), F.array_sort(F.coalesce(sources, F.array().cast("array<string>"))).alias("s"), prefer.alias("p"), limit.alias("l"), offset.alias("o"), refined.alias("llm"))
    return F.to_json(parts, {"ignoreNullFields": "false"})


#: Folders that the keys of a store are dealt over, and files from which on a folder is written anew.
BUCKETS, COMPACT_FILES = 64, 16
_STORED = f"{ENTRY}, at timestamp"


def bucket_of(key: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(key.encode()) % buckets


class Store:
    """Entries of a cache in a shared folder, dealt over folders by the hash of their key.

    A folder is a log: a write adds a file, and of a key's writes the last holds. ``get`` reads the files of one
    folder. A folder of many files is compacted: its last live writes become one file, and the files that were
    read are deleted. Deletion, on a read that finds an expired entry and in ``sweep``, is such a compaction, so expired
    entries leave the disk. A compaction that breaks off leaves entries twice, which changes no answer. One
    writer compacts at a time; a read that meets a deleted file counts as a miss.
    """

    def __init__(self, spark: SparkSession, path: str, ttl: float = CACHE_SECONDS, buckets: int = BUCKETS, compact_files: int = COMPACT_FILES, sweep_chance: float = SWEEP_CHANCE):
        self.spark, self.path, self.ttl = spark, path.rstrip("/"), ttl
        self.buckets, self.compact_files, self.sweep_chance = buckets, compact_files, sweep_chance

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _files(self, buckets: list[int] | None = None) -> list[str]:
        """Files of the log, of some folders or all."""
        fs, path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
        folders = [f"{self.path}/bucket={b}" for b in buckets] if buckets is not None else [s.getPath().toString() for s in (fs.listStatus(path(self.path)) if fs.exists(path(self.path)) else []) if "/bucket=" in s.getPath().toString()]
        found = [s.getPath().toString() for f in folders if fs.exists(path(f)) for s in fs.listStatus(path(f))]
        return [f for f in found if f.endswith(".parquet")]

    def _read(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(_STORED).parquet(*files) if files else self.spark.createDataFrame([], _STORED)

    def entries(self) -> DataFrame:
        """``key, payload, expires_at``: the last write of each key, expired or not."""
        return upsert(self._read(self._files()), "at", "expires_at", "payload").select("key", "payload", "expires_at")

    def get(self, key: str, now: datetime) -> str | None:
        """The payload that is live at ``now``; None without one, or if the store can't be read. An expired entry is deleted."""
        try:
            row = upsert(self.scan(key), "at", "expires_at", "payload").first()
            if row is not None and row.expires_at <= now:
                self._compact([bucket_of(key, self.buckets)], now)
                return None
        except Exception:  # a cache that fails is a cache without the entry
            return None
        return row.payload if row else None

    def scan(self, key: str) -> DataFrame:
        """All writes of a key, from the files of its folder."""
        return self._read(self._files([bucket_of(key, self.buckets)])).where(F.col("key") == key)

    def put(self, key: str, payload: str, now: datetime) -> bool:
        """Whether the entry was written; a failure is no error of the search. Now and then a write sweeps the store."""
        try:
            row = (key, payload, now + timedelta(seconds=self.ttl), now)
            self._append(self.spark.createDataFrame([row], _STORED).coalesce(1))
            bucket = bucket_of(key, self.buckets)
            if random.random() < self.sweep_chance:
                self.sweep(now)
            elif len(self._files([bucket])) >= self.compact_files:
                self._compact([bucket], now)
        except Exception:
            return False
        return True

    def put_all(self, writes: DataFrame) -> None:
        """Writes (key, payload, at): one file for each folder and task, all at once."""
        rows = writes.select("key", "payload", (F.col("at") + F.make_dt_interval(secs=F.lit(self.ttl))).alias("expires_at"), "at")
        self._append(rows.repartition(self._bucket()))

    def delete(self, keys: DataFrame, now: datetime) -> None:
        """Drops ``keys`` (key): an entry that has run out is written over each, and the folders are compacted."""
        gone = stage(keys.select("key", F.lit(None).cast("string").alias("payload"), F.lit(now).alias("expires_at"), F.lit(now).alias("at")), "cache-gone")
        self._append(gone)
        self._compact([r[0] for r in gone.select(self._bucket()).distinct().collect()], now)

    def sweep(self, now: datetime) -> int:
        """Deletes what has run out at ``now``; how many folders were written anew. Folders without expired entries stay as they are."""
        files = self._files()
        # A folder for each row at most; the condition on the time goes to the files' statistics.
        old = [r[0] for r in self._read(files).where(F.col("expires_at") <= now).select(self._bucket()).distinct().collect()]
        self._compact(old, now)
        return len(old)

    def _bucket(self) -> Column:
        return (F.crc32("key") % self.buckets).cast("int").alias("bucket")

    def _append(self, rows: DataFrame) -> None:
        rows.withColumn("bucket", self._bucket()).write.mode("append").partitionBy("bucket").parquet(self.path)

    def _compact(self, buckets: list[int], now: datetime) -> None:
        files = self._files(buckets)
        if files:
            last = upsert(self._read(files), "at", "expires_at", "payload").where(F.col("expires_at") > now)
            kept = stage(last.select("key", "payload", "expires_at", "at"), "cache-kept")
            self._append(kept.repartition(self._bucket()))
            fs, path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
            for f in files:
                fs.delete(path(f), False)


def upsert(writes: DataFrame, *order: str) -> DataFrame:
    """The last write of each key, reduced before the shuffle."""
    cols = [c for c in writes.columns if c != "key"]
    return writes.groupBy("key").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_w")).select("key", "_w.*")


def live(entries: DataFrame, now: Column) -> DataFrame:
    """Entries that have not run out; what runs out at ``now`` has."""
    return entries.where(F.col("expires_at") > now)


def expired(entries: DataFrame, now: Column) -> DataFrame:
    """Keys to drop."""
    return entries.where(F.col("expires_at") <= now).select("key")


def lookup(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (key, now) with ``payload``, null where nothing live is found."""
    found = asked.join(entries, "key", "left")
    return found.withColumn("payload", F.when(F.col("expires_at") > F.col("now"), F.col("payload"))).drop("expires_at")


def preferred(entries: DataFrame) -> DataFrame:
    """Of (query, refined, payload) one for each query: the refined entry where there is one."""
    return entries.groupBy("query").agg(F.max_by(F.struct("refined", "payload"), F.col("refined").cast("int")).alias("_e")).select("query", "_e.*")
