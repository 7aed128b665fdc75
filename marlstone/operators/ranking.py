"""Numbers and running sums in a global order, or inside groups, without one task that holds all rows or a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.staging import stage


def numbered(df: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    """Adds the row's number from 0 in the order; sorted in parallel, with the parts' counts added up.

    The only window without keys runs over one row for each task of the sort.
    """
    at = stage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return at.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_start")


def scanned(df: DataFrame, by: list[str], order: list[Column], rank: str | None = None, sums: dict[str, str] | None = None, xors: dict[str, str] | None = None) -> DataFrame:
    """Adds each row's number from 1 inside its group (``rank``), and running sums and exclusive ors of columns (new name: column).

    One range sort by group and order deals a large group over as many tasks as its rows take.
    Each task numbers and sums the stretch of a group that it holds. A stretch that begins in an
    earlier task then gets what that group had before it: at most one row for each task of the
    sort, so that table is broadcast. ``order`` must leave no ties for reruns to agree. Null keys
    are a group. Names that begin with ``_scan_`` are taken.
    """
    sums, xors = sums or {}, xors or {}
    dealt = df.repartitionByRange(*by, *order).withColumn("_scan_part", F.spark_partition_id())
    upto = Window.partitionBy("_scan_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = {"_scan_rank": F.count(F.lit(1)).over(upto)} | {k: F.sum(c).over(upto) for k, c in sums.items()} | {k: F.bit_xor(c).over(upto) for k, c in xors.items()}
    rows = stage(dealt.withColumns(local), "scanned")
    held = rows.groupBy("_scan_part", *by).agg(F.count("*").alias("_scan_n"), *(F.sum(c).alias(f"_scan_{k}") for k, c in sums.items()), *(F.bit_xor(c).alias(f"_scan_{k}") for k, c in xors.items()))
    before = Window.partitionBy(*by).orderBy("_scan_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = {"_scan_n": F.sum("_scan_n").over(before)} | {f"_scan_{k}": F.sum(f"_scan_{k}").over(before) for k in sums} | {f"_scan_{k}": F.bit_xor(f"_scan_{k}").over(before) for k in xors}
    carry = held.withColumns(carried).where("_scan_n IS NOT NULL").select(F.col("_scan_part").alias("_scan_at"), *(F.col(c).alias(f"_scan_by{i}") for i, c in enumerate(by)), *carried)
    same = [rows[c].eqNullSafe(F.col(f"_scan_by{i}")) for i, c in enumerate(by)]
    whole = rows.join(F.broadcast(carry), reduce(Column.__and__, same, F.col("_scan_part") == F.col("_scan_at")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = {k: zero(F.col(k)) + zero(F.col(f"_scan_{k}")) for k in sums} | {k: zero(F.col(k)).bitwiseXOR(zero(F.col(f"_scan_{k}"))) for k in xors}
    if rank:
        out[rank] = (F.col("_scan_rank") + zero(F.col("_scan_n"))).cast("long")
    return whole.withColumns(out).select(*(c for c in df.columns if c not in out), *out)


#: Parts over which tasks are dealt when a group's best are chosen.
TOP_PARTS = 64


def top(df: DataFrame, by: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their number from 1.

    A task sends at most ``k`` rows of a group to one of ``TOP_PARTS`` parts, and each of these as many to the
    group's own task, so that what a task sends or receives depends on ``k`` and the tasks, and not on the group's size.
    ``k`` is a bound of the answer; all rows take part. ``order`` must leave no ties for reruns to agree.
    """
    n, part = F.row_number(), F.pmod(F.spark_partition_id(), F.lit(TOP_PARTS))
    first = df.withColumn("_top", part).withColumn(out, n.over(Window.partitionBy(*by, "_top").orderBy(*order))).where(F.col(out) <= k).drop("_top", out)
    last = first.withColumn(out, n.over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= k)
    return last.withColumn(out, F.col(out).cast("long"))
