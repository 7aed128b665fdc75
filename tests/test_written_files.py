from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.sources import files


@pytest.mark.parametrize("store", ["file", "viewfs"])
def test_lines_as_files(spark, tmp_path, store):
    """Every row is a file with its bytes, in a store that tasks reach as a folder by a folder for each task, and found again by its name."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.written.link./d", f"file://{tmp_path}")
    root = f"file://{tmp_path}/p q" if store == "file" else "viewfs://written/d/p"
    rows = spark.range(200).select("id", F.when(F.col("id") == 7, None).when(F.col("id") == 8, "ä\nb").otherwise(F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("t"), F.lit(1).alias("other"))
    files.write_lines(rows, root, "id", "t")
    if store == "file":
        folders = [p for p in Path(tmp_path, "p q").iterdir()]
        assert 1 <= len(folders) <= 8 and sum(len(list(p.iterdir())) for p in folders) == 200
    asked = spark.range(0, 400, 2).select("id", F.col("id").cast("string").alias("page"))
    got = {r.id: r for r in files.fetched(asked, [root], F.col("id"), "page", lambda path: F.regexp_extract(path, r"/id=(\d+)(?:/|$)", 1), most=151).collect()}
    assert bytes(got[8].data) == "ä\nb\n".encode() and got[100].n_bytes == 101 and bytes(got[100].data) == b"x" * 100 + b"\n"
    assert [got[k].status for k in (0, 150, 152, 198, 200, 398)] == [200, 200, 413, 413, 404, 404] and len(got) == 200
