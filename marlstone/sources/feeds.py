"""Items from feeds and from JSON answers: splitting, fields, and one schema for all sources."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.fixed import UNTITLED
from marlstone.operators.dedupe import ITEM

TORRENT = (
    "_id string, title string, category_tag variant, content string, publish_time string, size variant, seeders long, leechers long, infoHash string, "
    "magnet string, torrent string, download string, team struct<name:string>, tags array<variant>"
)
ANSWER = f"torrents array<struct<{', '.join(re.sub(r'^(\w+) ', r'\1:', p) for p in TORRENT.split(', '))}>>"


def blocks(xml: Column, tag: str = "item") -> Column:
    """Bodies of all elements of a name, in order."""
    return F.regexp_extract_all(xml, F.lit(rf"<{tag}\b[^>]*>([\s\S]*?)</{tag}>"), F.lit(1))


def decoded(c: Column) -> Column:
    """Five entities, the ampersand first, so that twice encoded text decodes twice."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def text_of(block: Column, tag: str) -> Column:
    """Text of the first element of a name, its CDATA section opened; null if empty or missing."""
    body = F.regexp_extract(block, rf"<{re.escape(tag)}(?:{X.WS}[^>]*)?>([\s\S]*?)</{re.escape(tag)}>", 1)
    bare = F.regexp_replace(body, rf"^{X.WS}*<!\[CDATA\[([\s\S]*?)\]\]>{X.WS}*\z", "$1")
    return X.empty_as_null(X.trim(decoded(bare)))


def attr_of(block: Column, tag: str, name: str) -> Column:
    """An attribute in double quotes of the first element that has it; null if missing."""
    pattern = rf'<{re.escape(tag)}{X.AFTER}[^>]*{X.BEFORE}{re.escape(name)}="([^"]*)"'
    return F.when(block.rlike(pattern), decoded(F.regexp_extract(block, pattern, 1)))


def _item(df: DataFrame, source: str, **cols: Column) -> DataFrame:
    """Projects to ``ITEM``; columns that are not given are null."""
    types = {}
    for part in re.split(r", (?=\w+ )", ITEM):
        name, kind = part.split(" ", 1)
        types[name] = kind
    cols |= {"source": F.lit(source), "ord": F.col("pos").cast("long")}
    cols.setdefault("tags", F.array())
    return df.select(*(cols.get(n, F.lit(None)).cast(k).alias(n) for n, k in types.items()))


def _title(block: Column) -> Column:
    return F.coalesce(text_of(block, "title"), F.lit(UNTITLED))


def items_of(feed: DataFrame, tag: str = "item") -> DataFrame:
    """``(pos, block)`` of a table of feed texts ``xml``."""
    return feed.select(F.posexplode(blocks(F.col("xml"), tag)).alias("pos", "block"))


def rich_feed(rows: DataFrame, source: str = "nyaa") -> DataFrame:
    """Feed whose items carry hash, category, counts and size in elements of its own namespace; a count with a fraction is cut to a whole one."""
    b = F.col("block")
    own = lambda name: text_of(b, f"{source}:{name}")
    title, link, guid, digest, category = _title(b), text_of(b, "link"), text_of(b, "guid"), own("infoHash"), own("category")
    return _item(
        rows, source, id=F.coalesce(guid, digest, F.concat(F.lit(f"{source}-"), title)), title=title, subtitle=category, published_at=X.iso_date(text_of(b, "pubDate")),
        size=own("size"), seeders=X.number(own("seeders")).try_cast("long"), leechers=X.number(own("leechers")).try_cast("long"), info_hash=digest, magnet_url=X.magnet(digest, title), torrent_url=link,
        detail_url=guid, tags=F.when(category.isNotNull(), F.array(category)).otherwise(F.array().cast("array<string>")),
    )


def magnet_feed(rows: DataFrame, source: str = "dmhy") -> DataFrame:
    """Feed whose enclosure is a magnet link or nothing of use."""
    b = F.col("block")
    title, detail, url = _title(b), text_of(b, "link"), attr_of(b, "enclosure", "url")
    return _item(
        rows, source, id=F.coalesce(detail, F.concat(F.lit(f"{source}-"), title)), title=title, published_at=X.iso_date(text_of(b, "pubDate")),
        magnet_url=F.when(url.startswith("magnet:"), url), detail_url=detail,
    )


def file_feed(rows: DataFrame, source: str = "acg-rip") -> DataFrame:
    """Feed whose enclosure is a file; it has no hash and so no magnet link."""
    b = F.col("block")
    title, detail = _title(b), F.coalesce(text_of(b, "link"), text_of(b, "guid"))
    return _item(
        rows, source, id=F.coalesce(detail, F.concat(F.lit(f"{source}-"), title)), title=title, published_at=X.iso_date(text_of(b, "pubDate")),
        torrent_url=attr_of(b, "enclosure", "url"), detail_url=detail,
    )


def tag_label(tag: Column) -> Column:
    """A tag's text: the text itself, or the first name that its object has."""
    get = lambda path: X.empty_as_null(F.try_variant_get(tag, path, "string"))
    return F.when(F.schema_of_variant(tag) == "STRING", get("$")).otherwise(F.coalesce(*(get(f"$.locale.{k}") for k in ("zh_cn", "zh_tw", "ja", "en")), get("$.name")))


def json_answers(answers: DataFrame) -> DataFrame:
    """``(pos, t)`` of a table of JSON texts ``json``; no rows from texts that are no such answer."""
    return answers.select(F.posexplode(F.from_json("json", ANSWER)["torrents"]).alias("pos", "t"))


def json_items(rows: DataFrame, source: str = "bangumi-moe", base: str = "") -> DataFrame:
    """Items of a JSON answer; the team's name is the first tag."""
    t = lambda c: F.col(f"t.{c}")
    e = X.empty_as_null
    title = F.coalesce(e(t("title")), F.lit(UNTITLED))
    tags = F.filter(F.transform(F.coalesce(t("tags"), F.array().cast("array<variant>")), tag_label), lambda x: x.isNotNull())
    team = F.when(F.coalesce(t("team.name"), F.lit("")) != "", F.array(t("team.name"))).otherwise(F.array().cast("array<string>"))
    return _item(
        rows, source, id=F.coalesce(e(t("_id")), F.concat(F.lit(f"{source.split('-')[0]}-"), F.coalesce(e(t("infoHash")), title))), title=title,
        subtitle=F.coalesce(e(t("content")), tag_label(t("category_tag"))), published_at=X.iso_date(t("publish_time")),
        size=F.when(F.schema_of_variant(t("size")) == "STRING", F.try_variant_get(t("size"), "$", "string")), seeders=t("seeders"), leechers=t("leechers"), info_hash=t("infoHash"),
        magnet_url=F.coalesce(e(t("magnet")), X.magnet(t("infoHash"), title)), torrent_url=F.coalesce(e(t("download")), t("torrent")),
        detail_url=F.when(F.coalesce(t("_id"), F.lit("")) != "", F.concat(F.lit(f"{base}/torrent/"), t("_id"))), tags=F.concat(team, tags),
    )
