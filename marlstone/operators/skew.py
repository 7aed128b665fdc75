"""Lookups by a key that may hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is dealt over several tasks; at most as many keys can have it.
SHARE = 1000
#: Rows below which a key is never dealt out.
LEAST = 10_000


def heavy_keys(rows: DataFrame, on: list[str], share: int = SHARE, least: int = LEAST) -> DataFrame:
    """``on`` with ``_pieces``: into how many parts the rows of a key go. At most ``share`` keys, counted with sums before the shuffle."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("_n"))
    limit = max(least, rows.count() // share)
    return counts.where(F.col("_n") > limit).select(*on, F.ceil(F.col("_n") / limit).cast("int").alias("_pieces"))


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], spread: Column, how: str = "left", heavy: DataFrame | None = None, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """``rows`` joined with ``table`` on equal keys, where a key of ``rows`` may be frequent.

    The heavy keys' rows are dealt by ``spread``, an expression that differs between rows and is the same
    when they are read again, and the rows of ``table`` with such a key are repeated for each part. Other keys
    are joined as they are. ``rows`` should be cheap to read twice. Null keys match nothing.
    """
    heavy = heavy_keys(rows, on, share, least) if heavy is None else heavy
    heavy = F.broadcast(heavy.select(*(F.col(c).alias(f"_h{i}") for i, c in enumerate(on)), "_pieces"))

    def marked(df: DataFrame) -> DataFrame:
        return df.join(heavy, reduce(Column.__and__, (df[c] == F.col(f"_h{i}") for i, c in enumerate(on))), "left").drop(*(f"_h{i}" for i in range(len(on))))

    left = marked(rows).withColumn("_piece", F.when(F.col("_pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_pieces"))).cast("int")).drop("_pieces")
    right = marked(table).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1))).drop("_pieces")
    return left.join(right, [*on, "_piece"], how).drop("_piece")
