"""Contiguous shards of balanced bytes, by global prefix sums from partition totals.

Rows have one order: copies of a text next to each other, the largest groups of copies
first, other texts by hash. The order is cut into a few thousand ranges that follow from
each row's own keys; the ranges' totals, summed up, give each range's place in the whole,
and a window inside a range each row's. Shards are cut at equal targets.

Copies of a text stay in one shard: the group goes where its middle lies. Only a group
larger than a whole shard's target is cut, row by row, for the shards to stay balanced. A
large group is spread over ranges of its own, so no task sees more than about a range.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.staging import Staged, stage

#: Ranges of rows that are not in large groups; a group beyond this share of all is large.
RANGES = 2048


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs``.

    ``law`` is ``bytes``: the shards' sums of ``size`` (UTF-8 bytes and 1) are near equal, and
    off by half a group of copies at most. ``slot`` numbers a shard's rows without gaps from 0.
    A null text has size 1 and a null ``text_crc32``; null texts are copies of each other.
    Repeated rows are each placed. ``grown_shard`` is null under this law. An empty table
    gives no rows. Other columns are ignored.
    """
    text = docs[text_col].cast("string")
    base = Staged(
        docs.select(
            docs[id_col].alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.xxhash64(F.lit(1), text).alias("g1"), F.xxhash64(F.lit(2), text).alias("g2"), F.xxhash64(docs[id_col]).alias("h"),
        ),
        "op6-rows",
    ).df
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    share_b, share_n = -(-total // RANGES) or 1, -(-rows // RANGES) or 1
    groups = base.groupBy("g1", "g2").agg(F.sum("size").alias("gb"), F.count("*").alias("gn"))
    # At most 2 * RANGES groups can be large.
    by_size = Window.orderBy(F.desc("gb"), F.desc("gn"), "g1", "g2")
    large = Staged(
        groups.where((F.col("gb") > share_b) | (F.col("gn") > share_n))
        .select("g1", "g2", "gb", F.row_number().over(by_size).alias("rank"), F.sum("gb").over(by_size).alias("upto"), F.ceil(F.greatest(F.col("gb") / share_b, F.col("gn") / share_n)).alias("parts"))
        .select("g1", "g2", "gb", "rank", (F.col("upto") - F.col("gb")).alias("gstart"), "parts"),
        "op6-large",
    ).df
    placed = base.join(F.broadcast(large), ["g1", "g2"], "left")
    placed = placed.withColumns(
        {
            "k0": F.when(F.col("rank").isNull(), 1).otherwise(0),
            "k1": F.coalesce(F.col("rank"), F.pmod("g1", F.lit(RANGES)).cast("int")),
            "k2": F.when(F.col("rank").isNull(), F.lit(0)).otherwise(F.pmod("h", "parts")).cast("long"),
        }
    )
    keys = ["k0", "k1", "k2"]
    # At most a few times RANGES rows.
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    ranges = ranges.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    placed = placed.join(F.broadcast(ranges), keys)
    inside = Window.partitionBy(*keys).orderBy("g1", "g2", "h", "doc_id", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    copies = Window.partitionBy(*keys, "g1", "g2")
    placed = placed.withColumns({"at": F.col("b0") + F.sum("size").over(inside) - F.col("size"), "number": F.col("n0") + F.count("*").over(inside) - 1})
    placed = placed.withColumns({"start": F.coalesce("gstart", F.min("at").over(copies)), "whole": F.coalesce("gb", F.sum("size").over(copies))})
    twice = F.when(F.col("whole") * shards > total, 2 * F.col("at") + F.col("size")).otherwise(2 * F.col("start") + F.col("whole"))
    cut = F.least(F.floor(twice * shards / (2 * total)) if total else F.lit(0), F.lit(shards - 1)).cast("int")
    placed = stage(placed.select("doc_id", "size", "text_crc32", "number", cut.alias("shard")), "op6-placed")
    first = placed.groupBy("shard").agg(F.min("number").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("number") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
