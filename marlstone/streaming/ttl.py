"""The cache as keyed state of a stream, and requests gathered by a micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marlstone.functions.fixed import CACHE_SECONDS
from marlstone.session import ship


class TtlCache(StatefulProcessor):
    """Events (key, op: put or get, payload, seq): each get is answered with what the key holds.

    The state store drops a value when its time to live is over. Within a micro-batch a key's
    events are taken by ``seq``.
    """

    def __init__(self, seconds: float = CACHE_SECONDS):
        self.ms = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("payload", "payload string", ttlDurationMs=self.ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        import pandas as pd

        events = pd.concat(list(rows)).sort_values("seq")
        out = []
        for op, payload, seq in zip(events["op"], events["payload"], events["seq"], strict=True):
            if op == "put":
                self.value.update((payload,))
            else:
                held = self.value.get() if self.value.exists() else None
                out.append((key[0], int(seq), held[0] if held else None))
        yield pd.DataFrame(out, columns=["key", "seq", "payload"])

    def close(self) -> None:
        pass


def cached(events: DataFrame, seconds: float = CACHE_SECONDS) -> DataFrame:
    """Answers ``(key, seq, payload)`` to the gets of a stream of cache events."""
    ship(events.sparkSession)
    return events.groupBy("key").transformWithStateInPandas(TtlCache(seconds), "key string, seq long, payload string", "Append", "ProcessingTime")


def coalesced(requests: DataFrame, handle: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, window: str = "100 milliseconds"):
    """Starts a stream that hands ``handle`` each micro-batch's distinct labels and groups.

    ``requests`` has (request, label, series_key, name, ord). Of a label's keys the first
    holds. The writer starts; the caller stops it.
    """

    def batch(df: DataFrame, number: int) -> None:
        labels = df.where("label IS NOT NULL").groupBy("label").agg(F.min_by("series_key", "ord").alias("series_key"), F.min("ord").alias("ord"))
        names = df.where("name IS NOT NULL").groupBy("name").agg(F.min("ord").alias("ord"))
        handle(labels, names, number)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=window).start()
