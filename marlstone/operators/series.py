"""Series names of one work: edges by rules, components, canonical names, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.fixed import CONTAINED_RATIO, GROUP_REPUTATION, LOOSE_LENGTH, NOISE_SUFFIXES
from marlstone.functions.titles import aliases
from marlstone.operators.graph import connected_components
from marlstone.operators.skew import looked_up
from marlstone.staging import stage


def entries(annotated: DataFrame) -> DataFrame:
    """``series_key, label, title, ord`` of each key's first item."""
    rows = annotated.where(F.col("series_key").isNotNull() & (F.coalesce("parsed.series", F.lit("")) != ""))
    return rows.groupBy("series_key").agg(F.min_by(F.col("parsed.series"), "ord").alias("label"), F.min_by("title", "ord").alias("title"), F.min("ord").alias("ord"))


def _stars(named: DataFrame) -> DataFrame:
    """Edges (a, b) from each name's first key to its others, for rows (name, series_key, ord)."""
    first = named.groupBy("name").agg(F.min_by("series_key", "ord").alias("a"))
    return named.join(first, "name").where("series_key <> a").select("a", F.col("series_key").alias("b")).distinct()


def alias_names(series: DataFrame) -> DataFrame:
    names = X.once(series.select("series_key", "ord", F.explode(aliases(F.col("title"))).alias("alias")), name=X.series_key(F.col("alias")))
    return names.where(X.utf16_length(F.col("name")) >= LOOSE_LENGTH).select("name", "series_key", "ord").distinct()


def alias_edges(series: DataFrame) -> DataFrame:
    return _stars(alias_names(series))


def without_noise(c):
    """Key without the suffixes that say nothing, each tried once in order."""
    shorter = lambda x, s: F.when(F.endswith(x, s), X.trim(F.left(x, F.length(x) - F.length(s)))).otherwise(x)
    return F.aggregate(F.array(*map(F.lit, NOISE_SUFFIXES)), c, shorter)


def noise_edges(series: DataFrame) -> DataFrame:
    named = series.select(without_noise(F.col("series_key")).alias("name"), "series_key", "ord")
    return _stars(named.where(X.utf16_length(F.col("name")) >= LOOSE_LENGTH))


def containment_edges(series: DataFrame) -> DataFrame:
    """(a, b): key ``a`` lies in key ``b`` and is at least ``CONTAINED_RATIO`` as long.

    A longer key lists its substrings of the lengths in question, some hundred for a title,
    and these meet the keys in an equi-join: no pair is looked at that does not match.
    """
    n16, n = X.utf16_length(F.col("b")), F.length("b")
    least = F.greatest(F.lit(LOOSE_LENGTH), F.ceil(n16 * CONTAINED_RATIO - 1e-9).cast("int"))
    least = F.when(n16 == n, least).otherwise(F.ceil(least / 2).cast("int"))
    longer = series.select(F.col("series_key").alias("b")).where(n > least)
    lengths = longer.withColumn("m", F.explode(F.sequence(least, n - 1)))
    parts = lengths.select("b", F.explode(F.transform(F.sequence(F.lit(1), F.length("b") - F.col("m") + 1), lambda i: F.substring("b", i, F.col("m")))).alias("a")).distinct()
    met = parts.join(series.select(F.col("series_key").alias("a")), "a")
    short, long_ = X.utf16_length(F.col("a")), X.utf16_length(F.col("b"))
    return met.where((short >= LOOSE_LENGTH) & (short / long_ >= CONTAINED_RATIO)).select("a", "b")


def edges(series: DataFrame) -> DataFrame:
    return alias_edges(series).unionByName(containment_edges(series)).unionByName(noise_edges(series)).distinct()


def remap(series: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``(key, canonical)`` of all keys that are not their component's shortest (then first) one."""
    comps = connected_components(edges(series) if links is None else links, "a", "b")
    rows = stage(comps.join(series.select(F.col("series_key").alias("node"), "ord"), "node"), "members")
    best = rows.groupBy("component").agg(F.min_by("node", F.struct(X.utf16_length(F.col("node")), "ord")).alias("canonical"))
    return looked_up(rows, best, ["component"], F.col("node"), "inner").where("node <> canonical").select(F.col("node").alias("key"), "canonical")


def overlay(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """Two lookups as one; ``over`` wins where both have a key."""
    b, o = base.select(key, F.col(value).alias("_b")), over.select(key, F.col(value).alias("_o"))
    return b.join(o, key, "full").select(key, F.coalesce("_o", "_b").alias(value))


def reputation(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GROUP_REPUTATION.items()), "name string, score long")


def group_ranking(annotated: DataFrame) -> DataFrame:
    """``(name, score)`` of the groups that are present and known."""
    names = annotated.select(F.lower(X.empty_as_null(F.col("parsed.group"))).alias("name")).dropna().distinct()
    return names.join(F.broadcast(reputation(annotated.sparkSession)), "name")  # a table of fixed size
