"""Requests gathered by keyed state with a timer: one combined answer, sent to every request of the window."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marlstone.session import ship

#: From the labels (name, key) and the groups that all requests of a window ask for, in order, to their answer.
Answer = Callable[[list[tuple[str, str]], list[str]], str]

#: Columns of the requests.
REQUEST = "pool string, request string, label string, series_key string, name string, ord long"


def union_text(labels: list[tuple[str, str]], names: list[str]) -> str:
    """The combined request itself, as JSON."""
    return json.dumps({"labels": dict(labels), "groups": names}, ensure_ascii=False)


class Gatherer(StatefulProcessor):
    """Rows of ``REQUEST``, a request in one or more: the first opens the pool's window and sets its timer, which answers all.

    State is what came within one window: the requests, of a label's keys the first, and the groups' names.
    """

    def __init__(self, milliseconds: int, answer: Answer = union_text):
        self.ms, self.answer = milliseconds, answer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.labels = handle.getMapState("labels", "label string", "series_key string, ord long")
        self.names = handle.getMapState("names", "name string", "ord long")
        self.requests = handle.getMapState("requests", "request string", "ord long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        if not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ms)
        events = pd.concat(list(rows)).sort_values("ord")
        for r in events.itertuples():
            at = int(r.ord)
            for state, name, value in ((self.requests, r.request, (at,)), (self.labels, r.label, (r.series_key, at)), (self.names, r.name, (at,))):
                if isinstance(name, str) and not state.containsKey((name,)):
                    state.updateValue((name,), value)
        yield pd.DataFrame({"pool": [], "request": [], "answer": []}, dtype=str)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        labels = sorted((v[1], k[0], v[0]) for k, v in self.labels.iterator())
        names = sorted((v[0], k[0]) for k, v in self.names.iterator())
        text = self.answer([(k, s) for _, k, s in labels], [n for _, n in names])
        asked = [r for _, r in sorted((v[0], k[0]) for k, v in self.requests.iterator())]
        for state in (self.labels, self.names, self.requests):
            state.clear()
        yield pd.DataFrame({"pool": [key[0]] * len(asked), "request": asked, "answer": [text] * len(asked)})

    def close(self) -> None:
        pass


def answered_together(requests: DataFrame, milliseconds: int = 100, answer: Answer = union_text) -> DataFrame:
    """``pool, request, answer`` for a stream of ``REQUEST``; needs the RocksDB state store.

    A pool is what shares a model and so a window; its state lives for one window.
    """
    ship(requests.sparkSession)
    return requests.groupBy("pool").transformWithStateInPandas(Gatherer(milliseconds, answer), "pool string, request string, answer string", "Append", "ProcessingTime")
