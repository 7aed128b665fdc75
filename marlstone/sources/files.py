"""Files asked for by path, with a status for each request in place of an exception."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.fixed import FILE_BYTES
from marlstone.operators.skew import looked_up
from marlstone.session import ship
from marlstone.staging import PLAIN, stage

#: Status of a request, as of an answer over HTTP: found, no such file, beyond the limit.
FOUND, MISSING, TOO_LARGE = 200, 404, 413
FILE = "path string, modificationTime timestamp, length long, content binary"


def plain_path(path: Column) -> Column:
    """One spelling of a path: a local one begins with ``file:/``, wherever slashes were doubled."""
    scheme = F.when(path.startswith("/"), F.concat(F.lit("file:"), path)).otherwise(path)
    return F.regexp_replace(scheme, "^file:/+", "file:/")


def existing(spark: SparkSession, roots: list[str]) -> list[str]:
    """Those of a few folders or files that are there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(root: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(root)
        return path.getFileSystem(conf).exists(path)

    return [r for r in roots if there(r)]


def write_lines(rows: DataFrame, root: str, name: str, text: str) -> None:
    """Each row's ``text`` and a line end as a file of its own below ``root``; ``name`` and its value are in the path, as ``/name=value``.

    In a folder that executors share the tasks write the files themselves, a folder for each task: Spark's writer makes a
    folder for each file and starts two processes beside it, about 18 ms of a core. Elsewhere Spark's writer does it,
    and tasks move their files into place; by default the driver moves one after the other at the end.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    rows = rows.select(name, text).where(F.col(name).isNotNull()).repartition(name)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() != "file":
        rows.write.options(**PLAIN, **{"mapreduce.fileoutputcommitter.algorithm.version": "2"}).partitionBy(name).text(root)
        return
    ship(spark)
    local = unquote(urlparse(root).path)

    def save(part: Iterable) -> None:
        folder = None
        for number, value, data in part:
            if folder is None:
                folder = f"{local}/{number}"
                os.makedirs(folder, exist_ok=True)
            # A task that runs again writes the same files; each takes its place at once, and what is half written is hidden from readers.
            half = f"{folder}/.{uuid.uuid4().hex}"
            with open(half, "wb") as f:
                f.write(bytes(data) + b"\n")
            os.replace(half, f"{folder}/{name}={value}")

    os.makedirs(local, exist_ok=True)
    rows.select(F.spark_partition_id(), F.col(name).cast("string"), F.coalesce(F.col(text).cast("binary"), F.lit(b""))).foreachPartition(save)


def files_below(spark: SparkSession, roots: list[str]) -> DataFrame:
    """All files below some folders; reading ``path`` and ``length`` alone opens none of them."""
    there = existing(spark, roots)
    if not there:
        return spark.createDataFrame([], FILE)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(there)


def fetched(requests: DataFrame, roots: list[str], spread: Column, key: str = "path", key_of: Callable[[Column], Column] = plain_path, most: int = FILE_BYTES) -> DataFrame:
    """``requests`` with ``status``, ``n_bytes`` (null for a missing file) and ``data`` (null unless found).

    ``key`` is the column that ``key_of`` gives for the wanted file's path. Only files that are asked for and not
    beyond ``most`` bytes are read. Spark's source leaves out files without any bytes, so these count as
    missing. The limit goes down to the source, which looks at a file's length first.
    ``spread`` tells requests apart, as one file may be wanted by many.
    """
    spark = requests.sparkSession
    asked, below = stage(requests, "requests"), files_below(spark, roots)  # one listing for both reads
    listing = stage(below.select(key_of(F.col("path")).alias(key), F.col("length").alias("n_bytes")).join(asked.select(key).distinct(), key, "left_semi"), "listing")
    good = below.where(F.col("length") <= most).select(key_of(F.col("path")).alias(key), F.col("content").alias("data"))
    status = F.when(F.col("n_bytes").isNull(), MISSING).when(F.col("n_bytes") > most, TOO_LARGE).otherwise(FOUND)
    known = looked_up(asked, listing, [key], spread).withColumn("status", status)
    return looked_up(stage(known, "requests"), good, [key], spread)
