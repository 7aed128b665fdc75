"""A local session for tests, benchmarks and examples."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("marlstone").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


#: Bytes of a batch of rows on their way to Python, where the session has Spark's own 64 MB:
#: executor and worker each hold a few batches for each task beside the heap.
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, and bound their batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "64MB", "64m"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="marlstone-code-")) / "marlstone_code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
