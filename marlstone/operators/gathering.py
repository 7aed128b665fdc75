"""Requests of one pool that come within a short time are answered together: which ones, as tables.

A window opens with the first request that finds none open, and takes what comes before its width is over. All
its requests get one answer, over the union of what they ask for. ``streaming.gather`` does the same as the
requests come in.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ranking import scanned
from marlstone.session import ship


def _opened(width: int):
    def run(batches):
        held, start = None, 0
        for batch in batches:
            starts = []
            for key, at in zip(zip(batch.column("_pool").to_pylist(), batch.column("_stretch").to_pylist(), strict=True), batch.column("_at").to_pylist(), strict=True):
                if key != held or at >= start + width:
                    held, start = key, at
                starts.append(start)
            yield batch.set_column(batch.schema.get_field_index("_start"), "_start", pa.array(starts, pa.int64()))

    return run


def windows(requests: DataFrame, pool: str, at: str, tie: str, milliseconds: int, out: str = "window") -> DataFrame:
    """Adds the time at which the request's window opened.

    ``at`` is a timestamp, ``tie`` orders requests of one time. A pause of a window's width always ends a window, so
    each stretch between pauses is worked out by itself, its rows streaming by in order with one number of state;
    the pauses are found by numbers inside the pools, which large pools get over many tasks.
    """
    ship(requests.sparkSession)
    width, time = milliseconds * 1000, F.unix_micros(F.col(at).cast("timestamp"))
    rows = scanned(requests.withColumns({"_pool": F.col(pool).cast("string"), "_at": time}), ["_pool"], [F.col("_at"), F.col(tie)], "_n")
    before = rows.select(F.col("_pool").alias("_p"), (F.col("_n") + 1).alias("_m"), F.col("_at").alias("_before"))
    rows = rows.join(before, rows["_pool"].eqNullSafe(before["_p"]) & (rows["_n"] == before["_m"]), "left")
    pause = F.when(F.col("_before").isNull() | (F.col("_at") >= F.col("_before") + width), 1).otherwise(0)
    rows = scanned(rows.withColumn("_pause", pause).drop("_p", "_m", "_before"), ["_pool"], [F.col("_n")], sums={"_stretch": "_pause"}).withColumn("_start", F.lit(0).cast("long"))
    found = rows.repartition("_pool", "_stretch").sortWithinPartitions("_pool", "_stretch", "_n").mapInArrow(_opened(width), rows.schema)
    return found.select(*requests.columns, F.timestamp_micros("_start").cast(dict(requests.dtypes)[at]).alias(out))


def gathered(requests: DataFrame, pool: str, request: str, at: str, label: Column, value: Column, milliseconds: int) -> DataFrame:
    """``pool, request, window, n_requests, labels``: the union that answers each request, ``label=value`` by label; of a label's values the first holds.

    Labels and requests of a window are summed up before they are shuffled. Null labels ask for nothing.
    """
    rows = windows(requests.withColumns({"_label": label, "_value": value}), pool, at, request, milliseconds)
    order = F.struct(F.col(at), F.col(request))
    first = rows.where("_label IS NOT NULL").groupBy(pool, "window", "_label").agg(F.min_by("_value", order).alias("_value"))
    pair = F.struct("_label", F.concat_ws("=", "_label", "_value").alias("t"))
    union = first.groupBy(pool, "window").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["t"]), ",").alias("labels"))
    # A window has at most the requests of its short time.
    counts = rows.groupBy(pool, "window").agg(F.countDistinct(request).alias("n_requests"))
    return rows.select(pool, request, "window").distinct().join(counts, [pool, "window"]).join(union, [pool, "window"], "left")
