"""Entity resolution: records of one release from several sources become one.

Records are keyed by content hash, or by title where no record with that title has a hash.
Within a key they are merged in order, the richer record winning and gaps being filled. That
merge is not associative, but it has a closed form. A record's richness is a set of three
flags, and what has been merged so far has the union of all flags before; so who wins follows
from the first record of each (flags, source), at most a few dozen for a key. Gaps are then
filled by the last winner, the winners before it backwards, and the losers in order. So the
first records of those that have values in the same columns and one source give all that the
merge needs, and Spark sums them up before the shuffle. Lookups by title
and by key deal out the keys that are frequent (``skew``): one that holds a third of all rows
never meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.fixed import SOURCE_PRIORITY
from marlstone.operators.skew import heavy_keys, looked_up
from marlstone.staging import stage

MIRROR = "struct<source:string,magnet_url:string,torrent_url:string,detail_url:string>"
#: Columns of an item; ``ord`` is its place in the order of all items.
ITEM = (
    f"ord long, id string, title string, subtitle string, source string, sources array<string>, mirrors array<{MIRROR}>, published_at string, size string, "
    "seeders long, leechers long, info_hash string, magnet_url string, torrent_url string, detail_url string, tags array<string>"
)


def _has(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def with_keys(items: DataFrame) -> DataFrame:
    """Adds ``title_key`` and ``own_hash``, worked out once for each item."""
    own = X.normal_hash(F.coalesce(X.empty_as_null(F.col("info_hash")), X.magnet_hash(F.col("magnet_url"))))
    return X.once(items, title_key=X.title_key(F.col("title")), own_hash=own)


def keyed(rows: DataFrame) -> DataFrame:
    """Adds ``hash`` (own or by title) and ``bucket`` to items, or to rows with ``ord`` and ``with_keys``'s columns that are cheap to read more than once.

    A title that a third of all rows bear is dealt over tasks.
    """
    if "own_hash" not in rows.columns:
        rows = stage(with_keys(rows), "items")
    known = rows.where(_has("own_hash") & (F.col("title_key") != "")).groupBy("title_key").agg(F.min_by("own_hash", "ord").alias("alias_hash"))
    # Only rows without a hash of their own ask for one, so the others are not shuffled by their titles.
    asks = F.col("own_hash").isNull()
    found = looked_up(rows.where(asks), known, ["title_key"], F.col("ord"))
    own = rows.where(~asks).withColumn("alias_hash", F.lit(None).cast("string"))
    rows = own.unionByName(found).withColumn("hash", F.coalesce("own_hash", "alias_hash"))
    return rows.withColumn("bucket", F.when(_has("hash"), F.concat(F.lit("hash:"), "hash")).otherwise(F.concat(F.lit("title:"), F.coalesce("title_key", F.lit("")))))


def _winners(cands: Column) -> Column:
    """Places of the records that won, from (ord, flags, priority) in order."""
    first = F.struct(F.lit(-1).alias("seen"), F.lit(99).alias("best"), F.array().cast("array<long>").alias("won"))

    def step(s, c):
        wins = (c.flags > s.seen) | ((c.flags == s.seen) & (c.priority < s.best))
        return F.struct(
            F.when(s.seen < 0, c.flags).otherwise(s.seen.bitwiseOR(c.flags)).alias("seen"),
            F.when(wins, c.priority).otherwise(s.best).alias("best"), F.when(wins, F.concat(s.won, F.array(c.ord))).otherwise(s.won).alias("won"),
        )

    return F.aggregate(cands, first, step, lambda s: s.won)


#: Bits that say which titles are shared, in words of 64: at most 2^20 rows of two numbers are broadcast.
BITS = 1 << 26
_TEXTS = ("size", "magnet_url", "torrent_url", "detail_url", "subtitle", "published_at")
_LINKS = ("magnet_url", "torrent_url", "detail_url")
_PLACES = Decimal(10**19)  # more than any place


def _digest(c: Column) -> Column:
    """128 bits of a text, in place of a long key."""
    return F.unhex(F.md5(c))


def _shared_titles(whole: DataFrame) -> DataFrame:
    """``key, alias_hash, bucket_key`` of the titles that a record without a hash shares with any other record, summed before the shuffle."""
    short = F.col("own_hash").rlike(r"^[0-9a-f]{40}\z")  # such a hash goes as 20 bytes
    gives = _has("own_hash") & (F.coalesce("title_key", F.lit("")) != "")
    given = F.struct("ord", F.when(short, F.unhex("own_hash")).alias("bytes"), F.when(~short, F.col("own_hash")).alias("text"))
    sums = whole.groupBy(_digest(F.coalesce("title_key", F.lit(""))).alias("key")).agg(F.count_if(~_has("own_hash")).alias("n"), F.min(F.when(gives, given)).alias("given"))
    alias = F.coalesce(F.lower(F.hex("given.bytes")), F.col("given.text"))
    return sums.where((F.col("n") > 1) | ((F.col("n") > 0) & F.col("given").isNotNull())).select("key", alias.alias("alias_hash"), _digest(F.concat(F.lit("hash:"), alias)).alias("bucket_key"))


def _among(rows: DataFrame, keys: DataFrame, key: str, bits: int) -> DataFrame:
    """``rows`` with ``among``: true for all whose ``key`` is in ``keys`` and, by a bitmap, for a few others."""
    place = F.xxhash64(key).bitwiseAND(bits - 1)
    bit = F.expr("shiftleft(1L, CAST(_at & 63 AS INT))")
    words = keys.select(place.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    rows = rows.withColumn("_at", place).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(words), "_word", "left")
    return rows.withColumn("among", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits", "_at")


def _link(of: Callable[[str], Column]) -> Column:
    return F.struct(of("source").alias("source"), *(X.empty_as_null(of(c)).alias(c) for c in _LINKS)).cast(MIRROR)


def _alone(rows: DataFrame) -> DataFrame:
    """The entities of records that share neither hash nor title and bring no links of others."""
    text = lambda c: X.empty_as_null(F.col(c)).alias(c)
    sources = F.array_distinct(F.coalesce("sources", F.array("source")))
    return rows.select(
        F.concat(F.lit("title:"), F.coalesce("title_key", F.lit(""))).alias("bucket"), F.lit(1).cast("long").alias("n_merged"), "ord", "id", "title", "source", *(text(c) for c in _TEXTS if c != "published_at"),
        X.empty_as_null(F.col("own_hash")).alias("info_hash"), "seeders", "leechers", F.when(F.col("time").isNotNull(), F.col("published_at")).otherwise(X.empty_as_null(F.col("published_at"))).alias("published_at"),
        F.when(F.size(sources) > 0, sources).alias("sources"), F.array(_link(F.col)).alias("mirrors"), F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"),
    )


def _cells(pool: DataFrame) -> DataFrame:
    """Each cell's first place, its number of records and, in one number, its latest time with the first place at that time; numbers alone are summed."""
    has = [_has(c) for c in ("info_hash", "own_hash", *_TEXTS)] + [F.col(c).isNotNull() for c in ("seeders", "leechers", "sources")] + [F.coalesce(F.size("mirrors"), F.lit(0)) > 0]
    mask = reduce(Column.__add__, (F.when(h, 1 << k).otherwise(0) for k, h in enumerate(has)))
    # A hash of blanks counts as none in a bucket's first record alone, so such records do not stand for each other.
    blank = F.when(_has("info_hash") & ~_has("own_hash"), F.col("ord"))
    late = (F.unix_micros("time").cast("decimal(19,0)") * _PLACES + (_PLACES - 1 - F.col("ord").cast("decimal(19,0)"))).cast("decimal(38,0)")
    rows = pool.select("key", "asks", mask.alias("mask"), "source", blank.alias("blank"), "ord", late.alias("late"))
    return rows.groupBy("key", "asks", "mask", "source", "blank").agg(F.min("ord").alias("ord"), F.count("*").alias("n"), F.max("late").alias("late"))


def _with_records(cells: DataFrame, whole: DataFrame, bits: int) -> DataFrame:
    """The cells with their first ``record`` and, as ``late``, their latest time, its place and its text; no other records are shuffled."""
    place = F.pmod("late", _PLACES)
    cells = cells.withColumns({"t": ((F.col("late") - place) / _PLACES).cast("long"), "late_ord": (_PLACES - 1 - place).cast("long")}).drop("late")
    cells = stage(cells, "cells", compression="zstd")
    rows = _among(whole, cells.select(F.explode(F.array("ord", "late_ord")).alias("ord")).dropna(), "ord", bits).where("among")
    title_key = F.when(~_has("own_hash"), F.col("title_key")).alias("title_key")
    rows = stage(rows.select("ord", F.struct("id", "title", "info_hash", "own_hash", title_key, *_TEXTS, "seeders", "leechers", "sources", "mirrors", "tags").alias("record")), "records", compression="zstd")
    late = rows.select(F.col("ord").alias("late_ord"), F.col("record.published_at").alias("text"))
    at = F.when(F.col("t").isNotNull(), F.struct("t", (-F.col("late_ord")).alias("b"), F.col("text").alias("published_at")))
    return cells.join(late, "late_ord", "left").withColumn("late", at).drop("t", "late_ord", "text").join(rows, "ord")


def _in_turn(cells: DataFrame) -> DataFrame:
    """A row for each bucket with its cells' first records, at most some hundred, in order of precedence."""
    priority = F.array_position(F.array(*map(F.lit, SOURCE_PRIORITY)), F.col("source")).cast("int") - 1
    own = _has("record.own_hash")
    rich = F.when(F.col("record.seeders").isNotNull(), 4).otherwise(0) + F.when(_has("record.size"), 2).otherwise(0)
    cell = F.struct("ord", rich.alias("rich"), _has("record.info_hash").alias("raw"), own.alias("own"), priority.alias("priority"), "source", "record", "late", "hash")
    rows = cells.groupBy("bucket_key").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.sum("n").alias("n_merged"))
    flags = lambda x, k: x.rich + F.when(F.when(k == 0, x.own).otherwise(x.raw), 1).otherwise(0)
    rows = X.once(rows, won=_winners(F.transform("cells", lambda x, k: F.struct(x.ord.alias("ord"), flags(x, k).alias("flags"), x.priority.alias("priority")))))

    def turned(x, k):
        won = F.array_contains("won", x.ord)
        info_hash = F.when(k == 0, x.record.own_hash).otherwise(x.record.info_hash)
        return F.struct(F.when(won, 0).otherwise(1).alias("lost"), F.when(won, -x.ord).otherwise(x.ord).alias("at"), x.source.alias("source"), x.record.withField("info_hash", info_hash).alias("record"), x.late.alias("late"))

    return rows.select("bucket_key", "n_merged", F.get("cells", 0).alias("first"), F.array_sort(F.transform("cells", turned)).alias("cells"))


def _merged(rows: DataFrame) -> DataFrame:
    """What the cells give but for lists."""
    has = lambda v: F.coalesce(v, F.lit("")) != ""
    first = lambda c, ok: F.get(F.filter("cells", lambda x: ok(x.record[c])), 0).record[c]
    rows = rows.withColumn("latest", F.array_max(F.transform("cells", lambda x: x.late.t)))
    # Of the records at the latest time the last winner comes first, then the first loser. A winner is its cell's first record.
    at_last = lambda x: x.late.t == F.col("latest")
    winner = F.get(F.filter("cells", lambda x: at_last(x) & (x.lost == 0) & (x.late.b == x["at"])), 0).late.published_at
    other = F.array_max(F.transform(F.filter("cells", at_last), lambda x: x.late)).published_at
    top = F.get("cells", 0)
    bucket = F.when(F.col("first.hash").isNotNull(), F.concat(F.lit("hash:"), "first.hash")).otherwise(F.concat(F.lit("title:"), F.coalesce("first.record.title_key", F.lit(""))))
    return rows.select(
        "bucket_key", bucket.alias("bucket"), "n_merged", F.col("first.ord").alias("ord"), top.record.id.alias("id"), top.record.title.alias("title"), top.source.alias("source"),
        *(first(c, has).alias(c) for c in ("size", "info_hash", "magnet_url", "torrent_url", "detail_url", "subtitle")), *(first(c, Column.isNotNull).alias(c) for c in ("seeders", "leechers")),
        F.coalesce(winner, other, first("published_at", has)).alias("published_at"),
    )


def dedupe(items: DataFrame, bits: int = BITS) -> DataFrame:
    """One row for each bucket, ``ord`` being its first record's place, with ``n_merged``.

    Columns as in ``ITEM``; ``sources``, ``mirrors`` and ``tags`` are sets in order of precedence.

    Records that share neither hash nor title are not shuffled in whole. Of the others a cell holds those of one hash or title
    that have values in the same columns and one source. Its first record has all that the cell can give but for lists, so cells
    are summed as numbers before the shuffle, and their first records alone are put together, at most some hundred for a bucket.
    """
    whole = stage(X.once(with_keys(items), time=X.timestamp(F.col("published_at"))), "items", compression="zstd")
    shared = stage(_shared_titles(whole), "shared", compression="zstd")
    hashed = whole.where(_has("own_hash")).withColumns({"key": _digest(F.concat(F.lit("hash:"), "own_hash")), "asks": F.lit(False)})
    rest = whole.where(~_has("own_hash")).withColumns({"key": _digest(F.coalesce("title_key", F.lit(""))), "asks": F.col("own_hash").isNull()})
    rest = _among(rest, shared, "key", bits).withColumn("shares", F.col("among") | (F.coalesce(F.size("mirrors"), F.lit(0)) > 0)).drop("among")
    pool = hashed.unionByName(rest.where("shares").drop("shares"))
    heavy = stage(heavy_keys(pool, ["key"]), "heavy")
    alias = shared.where("alias_hash IS NOT NULL")

    def placed(rows: DataFrame, spread: Column) -> DataFrame:
        """Sums by ``key`` and ``asks`` with their ``bucket_key``; ``alias_hash`` where they take another's hash."""
        found = looked_up(rows, alias, ["key"], spread, heavy=heavy)
        return found.withColumns({"bucket_key": F.when(F.col("asks"), F.coalesce("bucket_key", "key")).otherwise(F.col("key")), "alias_hash": F.when(F.col("asks"), F.col("alias_hash"))})

    cells = placed(_cells(pool), F.col("ord")).groupBy("bucket_key", "mask", "source", "blank").agg(F.min("ord").alias("ord"), F.sum("n").alias("n"), F.max("late").alias("late"), F.max("alias_hash").alias("alias_hash"))
    cells = _with_records(cells, whole, bits).withColumn("hash", F.coalesce(X.empty_as_null(F.col("record.own_hash")), "alias_hash"))
    turns = stage(_in_turn(cells), "turns", compression="zstd")
    each = turns.select("bucket_key", F.explode("cells").alias("x")).select("bucket_key", "x.lost", "x.at", "x.source", "x.record")

    def listed(c: str, cell: Column) -> DataFrame:
        """``bucket_key, turn`` and an element as ``s``: of the cells' first records by their turn, and of lists that any record has by its place."""
        lists = pool.where(F.size(c) > 0).groupBy("key", "asks", c).agg(F.min("ord").alias("at"))
        lists = placed(lists, F.col("at")).select("bucket_key", F.lit(1).alias("lost"), "at", F.posexplode(c).alias("k", "s"))
        return each.select("bucket_key", "lost", "at", F.posexplode(cell).alias("k", "s")).unionByName(lists).select("bucket_key", F.struct("lost", "at", "k").alias("turn"), "s")

    own = F.struct("source", *(F.col(f"record.{c}").alias(c) for c in _LINKS)).cast(MIRROR)
    links = listed("mirrors", F.when(F.coalesce(F.size("record.mirrors"), F.lit(0)) > 0, F.col("record.mirrors")).otherwise(F.array(own))).select("bucket_key", "turn", "s.*")
    links = links.groupBy("bucket_key", "source").agg(F.min("turn").alias("turn"), *(F.min_by(F.when(_has(c), F.col(c)), F.when(_has(c), F.col("turn"))).alias(c) for c in _LINKS))
    in_turn = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn", c))), lambda x: x[c])
    links = links.select("bucket_key", "turn", F.struct("source", *_LINKS).alias("m")).groupBy("bucket_key").agg(in_turn("m").alias("mirrors"))
    ordered = lambda df, name: df.groupBy("bucket_key", "s").agg(F.min("turn").alias("turn")).groupBy("bucket_key").agg(in_turn("s").alias(name))
    sources = ordered(listed("sources", F.coalesce("record.sources", F.array("source"))), "sources")
    out = _merged(turns).join(links, "bucket_key", "left").join(sources, "bucket_key", "left").join(ordered(listed("tags", F.col("record.tags")), "tags"), "bucket_key", "left")
    out = out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).drop("bucket_key")
    out = out.unionByName(_alone(rest.where("NOT shares")))
    return out.select("bucket", "n_merged", *[c.strip().split(" ")[0] for c in ("ord", "id", "title", "subtitle", "source", "sources", "mirrors", "published_at", "size", "seeders", "leechers", "info_hash", "magnet_url", "torrent_url", "detail_url", "tags")])
