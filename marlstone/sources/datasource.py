"""A data source for saved feeds, the model for adding a source of one's own."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from marlstone.session import ship


class _Path(InputPartition):
    def __init__(self, path: str):
        self.path = path


#: Bytes of a feed that are read at a time.
CHUNK = 1 << 20


def items(chunks: Iterator[str], tag: str) -> Iterator[str]:
    """Bodies of a feed's elements of a name, in order; of the text only what may still be part of one is held."""
    import re

    whole, opened = re.compile(rf"<{tag}\b[^>]*>([\s\S]*?)</{tag}>"), re.compile(rf"<{tag}\b")
    held = ""
    for chunk in chunks:
        held += chunk
        end = 0
        for m in whole.finditer(held):
            yield m[1]
            end = m.end()
        start = opened.search(held, end)
        # Without an open element the next one's first letters may be the last ones here.
        held = held[start.start() if start else max(end, len(held) - len(tag) - 1) :]


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.tag = options.get("tag", "item")

    def partitions(self) -> list[InputPartition]:
        return [_Path(p) for p in self.paths]

    def _text(self, path: str) -> Iterator[str]:
        import codecs
        import re

        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(re.sub("^(file:)?/+", "file:///", path))
        decode = codecs.getincrementaldecoder("utf-8")("replace").decode
        with store.open_input_stream(at) as stream:
            while data := stream.read(CHUNK):
                yield decode(data)
            yield decode(b"", True)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for pos, block in enumerate(items(self._text(partition.path), self.tag)):
            yield partition.path, pos, block


class FeedSource(DataSource):
    """``spark.read.format("feed").option("paths", "a.xml,b.xml").load()``: ``(path, pos, block)``.

    Each feed is a partition and streams by. Paths are those of file systems that pyarrow opens; for
    other stores read whole texts with ``spark.read.text`` and use ``feeds.items_of``.
    """

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "path string, pos int, block string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FeedReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FeedSource)
