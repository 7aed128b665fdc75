"""Intermediate tables in the shared folder of the cluster.

A staged table cuts lineage: it is written once as Parquet below the folder that
``spark.checkpoint.dir`` names and read back, so a lost executor costs a re-read and
never a recomputation of everything before it.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}

#: Staged files on a local path get no checksum file beside them: to set the mode of each, a process would be started
#: from the executor's JVM, whose memory is counted twice meanwhile. Other file systems are not touched by this.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session wins. Where it is unset, a single-machine
    session gets a temporary folder; on a cluster no folder is known to be shared, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _local_roots[app] = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        root = _local_roots[app]
    return f"{root.rstrip('/')}/marlstone/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Staged:
    """A table written to the shared folder; ``df`` reads it, ``drop()`` deletes it."""

    def __init__(self, df: DataFrame, tag: str, **write_options):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, tag)
        df.write.options(**PLAIN | write_options).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def stage(df: DataFrame, tag: str, **write_options) -> DataFrame:
    """Write and read back a table that the caller's result goes on reading."""
    return Staged(df, tag, **write_options).df


@atexit.register
def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):
            remove(spark, shared_root(spark))
