"""A data source for saved JSON answers, one a line: their results as rows, and what could not be read as warnings.

``spark.read.format("answers").option("path", folder).load()``. Files are partitions, and lines stream by. A condition on
``pos`` is pushed to the reader, which then skips the results before a page and makes no rows of those after
it. A line that is no such answer, or a path that is missing, is a row with ``warning`` and no result, so the other answers
are still read. Paths are those of file systems that pyarrow opens.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from marlstone.session import ship
from marlstone.sources.feeds import TORRENT

SCHEMA = "file string, line long, pos long, result string, warning string"
ROWS = 2000


class _File(InputPartition):
    def __init__(self, path: str, warning: str | None = None):
        self.path, self.warning = path, warning


class AnswerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.field = options.get("field", "torrents")
        self.low = max(0, int(options.get("offset", 0)))
        self.high = self.low + max(0, int(options["limit"])) if "limit" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes bounds of ``pos``; Spark evaluates the others. Warnings have no ``pos`` and so no place on a page."""
        for f in filters:
            kind = type(f)
            if getattr(f, "attribute", None) != ("pos",) or kind not in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                yield f
                continue
            if kind in (EqualTo, GreaterThan, GreaterThanOrEqual):
                self.low = max(self.low, f.value + (kind is GreaterThan))
            if kind in (EqualTo, LessThan, LessThanOrEqual):
                high = max(0, f.value + (kind is not LessThan))
                self.high = high if self.high is None else min(self.high, high)
            self.warn = False

    #: Whether rows of warnings are wanted.
    warn = True

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        out: list[InputPartition] = []
        for path in self.paths:
            uri = re.sub("^(file:)?/+", "file:///", path)
            store, at = fs.FileSystem.from_uri(uri)
            info = store.get_file_info(at)
            scheme = uri.removesuffix(at)
            if info.type == fs.FileType.NotFound:
                out.append(_File(path, "no such file"))
            elif info.type == fs.FileType.Directory:
                below = store.get_file_info(fs.FileSelector(at, recursive=True))
                out += [_File(scheme + x.path) for x in sorted(below, key=lambda x: x.path) if x.is_file and not x.base_name.startswith(("_", "."))]
            else:
                out.append(_File(scheme + at))
        return out

    def _lines(self, path: str) -> Iterator[bytes]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_stream(at) as stream:
            rest = b""
            while chunk := stream.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from lines
            if rest:
                yield rest

    def _rows(self, partition: _File) -> Iterator[tuple]:
        import json

        if partition.warning:
            yield partition.path, None, None, None, partition.warning
            return
        try:
            for number, line in enumerate(self._lines(partition.path)):
                if not line.strip():
                    continue
                try:
                    found = json.loads(line)
                    if not isinstance(found, dict) or not isinstance(found.get(self.field) or [], list):
                        raise ValueError("no answer")
                except (ValueError, RecursionError) as e:
                    yield partition.path, number, None, None, str(e).split(":")[0]
                    continue
                for pos, result in enumerate((found.get(self.field) or [])[self.low : self.high], self.low):
                    yield partition.path, number, pos, json.dumps(result, ensure_ascii=False), None
        except OSError as e:
            yield partition.path, None, None, None, f"{type(e).__name__}"

    def read(self, partition: InputPartition) -> Iterator:
        from itertools import islice

        import pyarrow as pa

        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        rows = (r for r in self._rows(partition) if self.warn or r[4] is None)
        while held := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], ["file", "line", "pos", "result", "warning"])


class AnswerSource(DataSource):
    """Options: ``path`` or ``paths`` (comma-separated), ``field`` (the results' name), ``offset`` and ``limit`` of a page."""

    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return AnswerReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AnswerSource)


def results(answers: DataFrame) -> DataFrame:
    """``file, line, pos, t``: the results as ``feeds.json_items`` takes them."""
    return answers.where("result IS NOT NULL").select("file", "line", "pos", F.from_json("result", TORRENT).alias("t"))
