"""Best release of each episode, and groups of releases for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.fixed import RESOLUTION_SCORE
from marlstone.functions.titles import with_parsed
from marlstone.operators.ranking import numbered, scanned
from marlstone.operators.skew import looked_up

_ANNOTATED = ("series", "season", "episode", "episode_range", "version", "resolution", "group")


def annotate(items: DataFrame) -> DataFrame:
    """Adds the parsed title's fields, where a field that the title lacks keeps the item's own, and ``published`` in milliseconds."""
    if "parsed" not in items.columns:
        items = with_parsed(items)
    own = lambda c: F.coalesce(F.col(f"parsed.{c}"), F.col(c)) if c in items.columns else F.col(f"parsed.{c}")
    return X.once(items, **{c: own(c) for c in _ANNOTATED}, series_key=X.empty_as_null(F.col("parsed.series_key")), published=F.coalesce(F.unix_millis(X.timestamp(F.col("published_at"))), F.lit(0)))


def resolution_score(c: str = "resolution") -> Column:
    table = F.create_map(*(F.lit(x) for kv in RESOLUTION_SCORE.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.coalesce(c, F.lit(""))), F.lit(0))


def canonical(items: DataFrame, remap: DataFrame | None) -> DataFrame:
    """Adds ``canonical``: the key that ``remap`` (key, canonical) gives, or the own one."""
    if remap is None:
        return items.withColumn("canonical", F.col("series_key"))
    to = remap.select(F.col("key").alias("series_key"), F.col("canonical").alias("_to"))
    return items.join(to, "series_key", "left").withColumn("canonical", F.coalesce("_to", "series_key")).drop("_to")


def scored(items: DataFrame, ranking: DataFrame | None) -> DataFrame:
    """Adds ``group_score`` by ``ranking`` (name in lower case, score); 0 for others."""
    if ranking is None:
        return items.withColumn("group_score", F.lit(0).cast("long"))
    by = ranking.select(F.col("name").alias("_name"), F.col("score").cast("long").alias("_score"))
    return items.join(by, F.lower("group") == F.col("_name"), "left").withColumn("group_score", F.coalesce("_score", F.lit(0))).drop("_name", "_score")


def best_per_episode(items: DataFrame, remap: DataFrame | None = None, ranking: DataFrame | None = None, prefer: str | None = None) -> DataFrame:
    """Of the annotated items one for each (series, season, episode or range); others pass.

    The order is version, preferred script, seeders, standing of the group, resolution, time,
    and then first come. Adds ``passed`` and ``place``, the output's order. The choice is a
    minimum by a struct, so rows of a slot are reduced before they are shuffled.
    """
    rows = scored(canonical(items, remap), ranking)
    slot = F.when(F.col("episode").isNotNull(), F.concat(F.lit("e"), F.col("episode").cast("string"))).when(
        F.col("episode_range").isNotNull(), F.concat(F.lit("r"), F.col("episode_range.start").cast("string"), F.lit("-"), F.col("episode_range.end").cast("string"))
    )
    rows = rows.withColumns({"slot": F.when(F.col("series_key").isNotNull(), slot), "slot_season": F.coalesce("season", F.lit(0))})
    match = F.when(X.script(F.col("title")) == prefer, 1).otherwise(0) if prefer else F.lit(0)
    order = F.struct(-F.coalesce("version", F.lit(1)), -match, -F.coalesce("seeders", F.lit(-1)), -F.col("group_score"), -resolution_score(), -F.col("published"), F.col("ord"))
    cols = [c for c in rows.columns if c not in ("slot", "slot_season")]
    whole = rows.withColumn("_row", F.struct(*cols)).withColumn("_order", order)
    best = whole.where("slot IS NOT NULL").groupBy("canonical", "slot_season", "slot").agg(F.min_by("_row", "_order").alias("_row"), F.min("ord").alias("place"))
    return best.select("_row.*", F.lit(False).alias("passed"), "place").unionByName(rows.where("slot IS NULL").select(*cols, F.lit(True).alias("passed"), F.col("ord").alias("place")))


def _display() -> list[Column]:
    return [F.col("episode").desc_nulls_last(), F.col("published").desc(), F.col("passed"), F.col("place")]


def _keyed(pruned: DataFrame) -> DataFrame:
    """The items with ``group_key``."""
    season = F.when(F.coalesce("season", F.lit(0)) != 0, F.concat(F.lit("::s"), F.col("season").cast("string"))).otherwise("")
    return pruned.withColumn("group_key", F.when(F.col("series_key").isNotNull(), F.concat("canonical", season)))


def _counted(rows: DataFrame) -> DataFrame:
    """``group_key, n_items`` of each key."""
    return rows.where("group_key IS NOT NULL").groupBy("group_key").agg(F.count("*").alias("n_items"))


def _in_groups(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The keyed items joined with a table of groups, with ``item_rank`` from 1 inside each; a group of any size goes over as many tasks as it takes."""
    joined = looked_up(rows.where("group_key IS NOT NULL"), table, ["group_key"], F.col("place"), "inner")
    return scanned(joined, ["group_key"], _display(), "item_rank")


def groups(pruned: DataFrame) -> DataFrame:
    """``group_key, group_series, group_season, n_items, group_rank`` of the groups of several items, summed without a look at an item's rank."""
    at = F.struct("passed", "place")
    label = F.coalesce(X.empty_as_null(F.col("parsed.series")), F.col("title"))
    sums = _keyed(pruned).where("group_key IS NOT NULL").groupBy("group_key").agg(
        F.count("*").alias("n_items"), F.max("published").alias("fresh"), F.min(at).alias("first"),
        F.min_by(label, at).alias("group_series"), F.min_by(F.struct("season"), at)["season"].alias("group_season"),
    )
    ranked = numbered(sums.where("n_items > 1"), F.desc("fresh"), F.col("first"), out="group_rank")
    return ranked.withColumn("group_rank", F.col("group_rank") + 1).drop("first", "fresh")


def items_of_groups(pruned: DataFrame) -> DataFrame:
    """The items of groups of several with ``group_key``, ``n_items`` and ``item_rank`` from 1, but without what orders the groups among each other."""
    rows = _keyed(pruned)
    return _in_groups(rows, _counted(rows).where("n_items > 1"))


def ungrouped(pruned: DataFrame) -> DataFrame:
    """The items without a key, then those alone in their group, with ``item_rank`` from 1."""
    rows = _keyed(pruned)
    # A group of one item gives that item back from its sums, so no item is looked up by its group.
    cols = [c for c in rows.columns if c != "group_key"]
    single = rows.where("group_key IS NOT NULL").groupBy("group_key").agg(F.count("*").alias("_n"), F.min_by(F.struct(*(F.col(f"`{c}`") for c in cols)), "place").alias("_row")).where("_n = 1")
    single = single.select("group_key", "_row.*").select(*(F.col(f"`{c}`") for c in rows.columns)).withColumn("late", F.lit(1))
    rest = rows.where("group_key IS NULL").withColumn("late", F.lit(0)).unionByName(single)
    rest = numbered(rest, F.col("episode").desc_nulls_last(), F.col("published").desc(), F.col("late"), F.col("passed"), F.col("place"), out="item_rank")
    return rest.withColumn("item_rank", F.col("item_rank") + 1).drop("late")


def grouped(pruned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items of groups, ungrouped items).

    Items of groups carry ``group_key, group_series, group_season, group_rank, item_rank``
    (from 1) and ``n_items``; groups of one item are ungrouped, after the items without a
    key. Ungrouped items carry ``item_rank``.
    """
    return _in_groups(_keyed(pruned), groups(pruned)), ungrouped(pruned)


def all_items(items: DataFrame, rest: DataFrame) -> DataFrame:
    """All items of a response as one list, by ``place_in_list`` from 1: those of the groups in their order, then the ungrouped ones."""
    cols = [c for c in rest.columns if c in items.columns and c != "item_rank"]
    both = items.select(*cols, "group_rank", "item_rank").unionByName(rest.select(*cols, F.lit(None).cast("long").alias("group_rank"), "item_rank"))
    return numbered(both, F.col("group_rank").asc_nulls_last(), F.col("item_rank"), out="place_in_list").withColumn("place_in_list", F.col("place_in_list") + 1)
