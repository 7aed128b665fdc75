"""A whole search: pages of the sources, one relation of items, entities, series, best releases, groups."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.fixed import LIMIT_DEFAULT, LIMIT_MOST, SOURCES, SPACE
from marlstone.operators import releases, series
from marlstone.operators.cache import Store, normal_keyword
from marlstone.operators.cache import key as cache_key
from marlstone.operators.dedupe import ITEM, dedupe
from marlstone.operators.ranking import top
from marlstone.operators.refine import Refiner
from marlstone.staging import stage

Loader = Callable[[SparkSession, "Query"], DataFrame]


def _whole(raw: object, default: int, least: int, most: int | None) -> int:
    try:
        n = int(float(raw))
    except (TypeError, ValueError, OverflowError):
        return default
    return max(least, n if most is None else min(n, most))


@dataclass
class Query:
    """What is asked for; ``of`` reads it from request parameters."""

    keyword: str
    limit: int = LIMIT_DEFAULT
    offset: int = 0
    sources: tuple[str, ...] = ()
    prefer: str | None = None
    refine: bool = True

    @classmethod
    def of(cls, params: dict[str, str]) -> Query:
        keyword = (params.get("q") or "").strip()
        if not keyword:
            raise ValueError("q is missing")
        named = tuple(s for s in (x.strip() for x in (params.get("sources") or "").split(",")) if s in SOURCES)
        prefer = params.get("prefer") if params.get("prefer") in ("simplified", "traditional") else None
        return cls(keyword, _whole(params.get("limit"), LIMIT_DEFAULT, 1, LIMIT_MOST), _whole(params.get("offset"), 0, 0, None), named, prefer, params.get("refine") != "0")

    @property
    def cleaned(self) -> str:
        return re.sub(f"[{SPACE}]+", " ", self.keyword).strip(" ")


def arguments(requests: DataFrame) -> DataFrame:
    """``Query.of`` over a table of request parameters as texts (``q, limit, offset, sources, prefer, refine``), such as a log of requests.

    Adds ``keyword`` (null where a request is refused for want of one), ``n_limit``, ``n_offset``, ``named`` (sources), ``script`` and ``refined``.
    """
    number = lambda c: F.floor(X.number(F.col(c)))
    cut = lambda c, default, least, most: F.least(F.greatest(F.coalesce(F.when(number(c) < 0, F.ceil(X.number(F.col(c)))).otherwise(number(c)), F.lit(default)), F.lit(least)), F.lit(most)).cast("long")
    known = F.filter(F.transform(F.split(F.coalesce("sources", F.lit("")), ","), X.trim), lambda x: x.isin(*SOURCES))
    return requests.withColumns(
        {
            "keyword": X.empty_as_null(X.collapse(F.col("q"))), "n_limit": cut("limit", LIMIT_DEFAULT, 1, LIMIT_MOST), "n_offset": cut("offset", 0, 0, (1 << 53) - 1), "named": known,
            "script": F.when(F.col("prefer").isin("simplified", "traditional"), F.col("prefer")), "refined": F.coalesce(F.col("refine") != "0", F.lit(True)),
        }
    )


@dataclass
class Response:
    total: int
    groups: DataFrame
    ungrouped: DataFrame
    refined: bool
    warnings: list[str] = field(default_factory=list)


def chosen(loaders: dict[str, Loader], sources: tuple[str, ...]) -> list[str]:
    """Names of the sources to read, in the order of the registry."""
    return [s for s in loaders if not sources or s in sources]


def page(items: DataFrame, limit: int, offset: int) -> DataFrame:
    """The rows at places ``offset`` to ``offset + limit`` of a source's own order ``ord``."""
    return items.where((F.col("ord") >= offset) & (F.col("ord") < offset + limit))


def pages(items: DataFrame, source: str, order: list, limit: int, offset: int) -> DataFrame:
    """A page of each source of one table, with ``ord`` from 0 in the source's order; a task sends at most ``offset + limit`` rows of a source."""
    first = top(items, [source], order, offset + limit, "ord").withColumn("ord", F.col("ord") - 1)
    return page(first, limit, offset)


def union(parts: list[DataFrame]) -> DataFrame:
    """Items of all sources; ``ord`` goes by source, then by place."""
    return reduce(DataFrame.unionByName, [p.withColumn("ord", F.col("ord") + F.lit(k << 40)) for k, p in enumerate(parts)])


@dataclass
class Prepared:
    """What the fast and the refined answer have in common, staged: entities with parsed titles, and the rules' lookups."""

    entities: DataFrame
    annotated: DataFrame
    remap: DataFrame
    ranking: DataFrame
    warnings: list[str] = field(default_factory=list)


#: What the rules, the choice and the places in groups read of an annotated entity.
_READ = ("ord", "title", "parsed", "series_key", "season", "episode", "episode_range", "version", "resolution", "group", "seeders", "published")


def prepared(items: DataFrame, warnings: list[str] | None = None, shown: tuple[str, ...] | None = None) -> Prepared:
    """``shown``: the columns of items that the answer shows, if not all; no others are carried on from the entities."""
    entities = dedupe(items)
    if shown is None:
        entities = stage(entities, "entities")
        annotated = stage(releases.annotate(entities), "annotated")
    else:
        annotated = releases.annotate(entities)
        annotated = stage(annotated.select(*(c for c in annotated.columns if c in _READ or c in shown)), "annotated", compression="zstd")
        entities = annotated
    remap, ranking = series.remap(series.entries(annotated)), series.group_ranking(annotated)
    return Prepared(entities, annotated, stage(remap, "remap"), stage(ranking, "ranking"), warnings or [])


def finished(ready: Prepared, prefer: str | None = None, refiner: Refiner | None = None, shown: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(items of groups, ungrouped items), with what a refiner's answer says laid over the rules."""
    remap, ranking, annotated = ready.remap, ready.ranking, ready.annotated
    if refiner is not None:
        more, scores = refiner.lookups(annotated)
        remap, ranking = series.overlay(remap, more, "key", "canonical"), series.overlay(ranking, scores, "name", "score")
    if shown is not None:
        # A group is named by its series; the title stands in for a missing name alone, unless it is shown.
        name = X.empty_as_null(F.col("parsed.series"))
        annotated = annotated.withColumn("parsed", F.struct(name.alias("series")))
        annotated = annotated if prefer or "title" in shown else annotated.withColumn("title", F.when(name.isNull(), F.col("title")))
    best = releases.best_per_episode(annotated, remap, ranking, prefer)
    if shown is not None:
        best = best.select(*(c for c in best.columns if c in shown or c in _PLACED))
    return releases.grouped(stage(best, "best", **({} if shown is None else {"compression": "zstd"})))


def arranged(items: DataFrame, prefer: str | None = None, refiner: Refiner | None = None, shown: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, items of groups, ungrouped items) of a relation of items; with ``shown``, only these columns of items and those that order them."""
    ready = prepared(items, shown=shown)
    return ready.entities, *finished(ready, prefer, refiner, shown)


#: What places an item of the best ones in its group and the group among others.
_PLACED = ("ord", "title", "parsed", "series_key", "canonical", "season", "episode", "published", "passed", "place")
#: Columns of a response's item that order it or belong to its group.
_PLACES = ("ord", "group_key", "group_series", "group_season", "group_rank", "item_rank", "n_items", "place", "passed", "parsed")


def response_json(response: Response) -> DataFrame:
    """``group_rank, item_rank, ord, item``: a row of JSON for each item, groups first; keys without a value are left out."""
    items = response.groups.unionByName(response.ungrouped, allowMissingColumns=True)
    return items.select("group_rank", "item_rank", "ord", F.to_json(F.struct(*items.columns)).alias("item"))


def response_groups(response: Response) -> DataFrame:
    """``group_rank, group``: JSON of each group with ``key``, ``series``, ``season`` and its ``items`` in order.

    A group of a response has at most the items of its pages.
    """
    cols = [c for c in response.groups.columns if c not in _PLACES]
    item = F.struct("item_rank", F.struct(*cols).alias("item"))
    keys = ["group_rank", "group_key", *(c for c in ("group_series", "group_season") if c in response.groups.columns)]
    held = response.groups.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias("items"))
    shown = F.struct(F.col("group_key").alias("key"), *(F.col(c).alias(c.removeprefix("group_")) for c in keys[2:]), "items")
    return held.select("group_rank", F.to_json(shown).alias("group"))


def response_text(response: Response, query: Query | None = None) -> str:
    """The answer to a request as one JSON text: ``query, total, warnings, groups, ungrouped, refined``."""
    groups = [json.loads(r.group) for r in response_groups(response).orderBy("group_rank").collect()]
    cols = [c for c in response.ungrouped.columns if c not in _PLACES]
    rest = [json.loads(r.item) for r in response.ungrouped.select("item_rank", F.to_json(F.struct(*cols)).alias("item")).orderBy("item_rank").collect()]
    asked = {"query": {"keyword": query.cleaned, "limit": query.limit, "offset": query.offset, "sources": list(query.sources), "prefer": query.prefer}} if query else {}
    return json.dumps(asked | {"total": response.total, "warnings": response.warnings, "groups": groups, "ungrouped": rest, "refined": response.refined}, ensure_ascii=False)


class Sequence:
    """Numbers of requests: an answer counts only while its request is the last one."""

    def __init__(self):
        self.last = 0

    def begin(self) -> int:
        self.last += 1
        return self.last

    def is_last(self, number: int) -> bool:
        return number == self.last


def _key(query: Query, refined: bool) -> str:
    return cache_key(query.keyword, query.sources, query.prefer, query.limit, query.offset, refined)


def _held(query: Query, store: Store | None, now: datetime) -> str | None:
    """The cached answer: a refined entry answers any request, a fast one only a request for a fast answer."""
    for refined in (True,) if query.refine else (True, False):
        if store is not None and (found := store.get(_key(query, refined), now)) is not None:
            return found
    return None


def answered(spark: SparkSession, query: Query, loaders: dict[str, Loader], refiner: Refiner | None = None, store: Store | None = None, now: datetime | None = None) -> str:
    """``search`` as JSON text by way of the cache."""
    now = now or datetime.now()
    if (found := _held(query, store, now)) is not None:
        return found
    text = response_text(search(spark, query, loaders, refiner), query)
    if store is not None:
        store.put(_key(query, query.refine), text, now)
    return text


def two_phases(spark: SparkSession, query: Query, loaders: dict[str, Loader], refiner: Refiner | None = None, store: Store | None = None, now: datetime | None = None, sequence: Sequence | None = None):
    """The fast answer, then the refined one unless the first was refined already.

    Both come from one prepared table, so sources are read and entities resolved once. With a ``sequence``, what a
    later request has overtaken is not yielded, and its refined phase is not begun.
    """
    now, sequence = now or datetime.now(), sequence or Sequence()
    number, ready = sequence.begin(), None
    for refine in (False, True):
        asked = replace(query, refine=refine)
        text = _held(asked, store, now)
        if text is None:
            ready = ready or prepared(*read_sources(spark, query, loaders))
            groups, rest = finished(ready, query.prefer, refiner if refine else None)
            text = response_text(Response(ready.entities.count(), groups, rest, refine, ready.warnings), query)
            if store is not None:
                store.put(_key(query, refine), text, now)
        if not sequence.is_last(number):
            return
        yield text
        if json.loads(text)["refined"] or not sequence.is_last(number):
            return


def read_sources(spark: SparkSession, query: Query, loaders: dict[str, Loader]) -> tuple[DataFrame, list[str]]:
    """(items of all sources, warnings). A source that fails gives a warning and no rows; the others go on."""
    parts, warnings = [], []
    if normal_keyword(query.keyword):
        for name in chosen(loaders, query.sources):
            try:
                parts.append(stage(page(loaders[name](spark, query), query.limit, query.offset), "source"))
            except Exception as e:  # one source's failure must not end the search
                warnings.append(f"{name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
    return union(parts or [spark.createDataFrame([], ITEM)]), warnings


def search(spark: SparkSession, query: Query, loaders: dict[str, Loader], refiner: Refiner | None = None) -> Response:
    """Runs a query."""
    ready = prepared(*read_sources(spark, query, loaders))
    groups, rest = finished(ready, query.prefer, refiner if query.refine else None)
    return Response(ready.entities.count(), groups, rest, query.refine, ready.warnings)
