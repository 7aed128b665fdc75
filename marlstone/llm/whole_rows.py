"""Whole rows of a table, whatever the names and types of their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """A column by its name alone, which may hold dots and quotes."""
    return F.col("`{}`".format(name.replace("`", "``")))


def packed(df: DataFrame) -> Column:
    """The row as a struct; ``select("row.*")`` gives its columns back."""
    return F.struct(*(column(c).alias(c) for c in df.columns)).alias("row")


def digest(df: DataFrame, seed: int) -> Column:
    """64 bits of a row. Maps are hashed by their sorted entries, types that hold maps or variants as JSON."""
    cols = []
    for name, kind in df.dtypes:
        if kind.startswith("map<") and "map<" not in kind[4:] and "variant" not in kind:
            cols.append(F.array_sort(F.map_entries(column(name))))
        elif "map<" in kind or "variant" in kind:
            cols.append(F.to_json(F.struct(column(name).alias("c"))))
        else:
            cols.append(column(name))
    return F.xxhash64(F.lit(seed), *cols)
