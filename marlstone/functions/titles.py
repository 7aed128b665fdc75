"""Release titles as columns: group, series, season, episode or range, version, resolution, codec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.fixed import BRACKETS, CODECS, METADATA, NUMERALS, RESOLUTIONS

_OPEN, _CLOSE = "".join(a for a, _ in BRACKETS), "".join(b for _, b in BRACKETS)
_ANY = "[" + "".join(f"\\{c}" for c in _OPEN + _CLOSE) + "]"
_FILLED = "|".join(rf"\{a}[^\{b}]+\{b}" for a, b in BRACKETS)
# Each pattern begins with the characters that a match can begin with, so that other places of a title cost one look.
_SEASON = rf"(?=[Ss第])(?i:S(\d{{1,2}}){X.AFTER}|Season{X.WS}*(\d{{1,2}})|第([{''.join(NUMERALS)}\d]+)[季期])"
_RANGE = rf"\d(?<=[{X.SPACE}\[-]\d)\d{{0,2}}{X.WS}*[-~]{X.WS}*\d{{1,3}}(?:[{X.SPACE}\]]|\z)"
_EPISODE = (
    rf"(?=[-\[Ee第])(?i:-{X.WS}*\d{{1,3}}(?:v\d)?{X.AFTER}|\[\d{{1,3}}(?:v\d)?\]|"
    rf"{X.BEFORE}EP?\d{{1,3}}(?:v\d)?{X.AFTER}|第\d{{1,3}}[话集話])"
)
_initials = lambda words: "".join(sorted({f(w[0]) for w in words for f in (str.lower, str.upper)}))
_RESOLUTION = rf"(?=[{_initials(RESOLUTIONS)}])(?i:{'|'.join(RESOLUTIONS)})"
_CODEC = rf"(?=[{_initials(CODECS)}]){X.BEFORE}(?i:{'|'.join(CODECS)}){X.AFTER}"
_TAIL = rf"{X.WS}+-{X.WS}+\d{{1,3}}(?:v\d)?[^\n\r\u2028\u2029]*\z"
_FREE = "^[^" + "".join(f"\\{c}" for c in _OPEN + _CLOSE) + "]*"

PARSED = "struct<group:string,series:string,series_key:string,season:int,episode:int,episode_range:struct<start:int,end:int>,version:int,resolution:string,codec:string>"


def is_metadata(c: Column) -> Column:
    return c.rlike(r"(?i)^(?:" + "|".join(METADATA) + r")\z")


def bracketed(c: Column) -> Column:
    """Names inside brackets, in order, without metadata."""
    inner = F.transform(F.regexp_extract_all(c, F.lit(_FILLED), F.lit(0)), lambda x: X.trim(F.substring(x, F.lit(2), F.length(x) - 2)))
    return F.filter(inner, lambda x: (x != "") & ~is_metadata(x))


def _latin(c: Column) -> Column:
    return c.rlike("[A-Za-z]") & ~c.rlike(r"[\u3400-\u9fff\u3040-\u30ff]")


def with_parsed(df: DataFrame, title: str = "title", out: str = "parsed") -> DataFrame:
    """Adds the struct ``out``; null for a null or empty title.

    The steps are projections of their own: each is used more than once by the next, so the
    optimizer keeps them apart and works out each once. A pattern runs once over a title, and
    what its match holds is taken from the match.
    """
    raw, at, r, cut = F.col("_raw"), F.col("_at"), F.col("_rest"), F.col("_cut")
    close = F.lit(0)
    for a, b in reversed(BRACKETS):
        close = F.when(raw.startswith(a), F.instr(raw, b)).otherwise(close)
    df = df.withColumn("_raw", X.trim(F.col(title))).withColumn("_at", close)
    df = df.withColumns({"_group": F.when(at > 0, X.empty_as_null(X.trim(F.substring(raw, F.lit(2), at - 2)))), "_rest": F.when(at > 0, X.trim(F.substring(raw, at + 1, F.length(raw)))).otherwise(raw)})
    packed = r.rlike("^[" + "".join(f"\\{c}" for c in _OPEN) + "]")
    df = df.withColumns(
        {
            "_res": X.extract(r, _RESOLUTION, 0), "_codec": X.extract(r, _CODEC, 0), "_season": X.extract(r, _SEASON, 0), "_range": X.extract(r, _RANGE, 0), "_ep": X.extract(r, _EPISODE, 0),
            "_names": F.when(packed, bracketed(r)), "_cut": F.when(~packed, F.substring_index(F.regexp_extract(r, _FREE, 0), "/", 1)),
        }
    )
    season, range_, ep, names = F.col("_season"), F.col("_range"), F.col("_ep"), F.col("_names")
    # The free text begins the rest and ends before a character of no word, so it has a season only where the rest has one.
    bare = F.when(cut.contains("-"), F.regexp_replace(cut, _TAIL, "")).otherwise(cut)
    free = X.empty_as_null(X.trim(F.when(season.isNotNull(), X.remove_first(bare, _SEASON)).otherwise(bare)))
    df = df.withColumns(
        {
            "_free": free, "_season": F.when(season.startswith("第"), F.substring(season, F.lit(2), F.length(season) - 2)).otherwise(F.ltrim(season, F.lit("SEASONseason" + X.BLANKS))),
            "_a": X.extract(range_, r"^\d+", 0).cast("int"), "_b": X.extract(range_, rf"[-~]{X.WS}*(\d+)").cast("int"),
            "_ep": X.extract(ep, r"\d+", 0).cast("int"), "_ver": X.extract(ep, r"[Vv](\d)").cast("int"),
        }
    )
    numerals = F.create_map(*(F.lit(x) for kv in NUMERALS.items() for x in kv))
    df = df.withColumns({"_series": F.coalesce(F.get(names, 0), F.col("_free")), "_keyed": F.coalesce(F.get(F.filter(names, _latin), 0), F.get(names, 0), F.col("_free"))})
    ranged = F.coalesce(F.col("_b") > F.col("_a"), F.lit(False))
    number = F.coalesce(F.try_element_at(numerals, season), season.try_cast("int"))  # a cast that fails is an exception, so it comes last
    parsed = F.struct(
        F.col("_group").alias("group"), F.col("_series").alias("series"), X.series_key(F.col("_keyed")).alias("series_key"),
        F.nullif(number, F.lit(0)).alias("season"), F.when(~ranged, ep).alias("episode"),
        F.when(ranged, F.struct(F.col("_a").alias("start"), F.col("_b").alias("end"))).alias("episode_range"), F.when(~ranged, F.col("_ver")).alias("version"),
        F.replace(F.lower("_res"), F.lit("k"), F.lit("K")).alias("resolution"), F.lower("_codec").alias("codec"),
    )
    work = ["_raw", "_at", "_group", "_rest", "_res", "_codec", "_season", "_range", "_a", "_b", "_ep", "_ver", "_names", "_cut", "_free", "_series", "_keyed"]
    return X.once(df, **{out: F.when(F.coalesce(F.col(title), F.lit("")) != "", parsed)}).drop(*work)


def aliases(c: Column) -> Column:
    """Other names in a title: parts after the first slash of the free text, then names inside brackets."""
    lead = "|".join(rf"\{a}[^\{b}]*\{b}" for a, b in BRACKETS)
    rest = F.regexp_replace(c, rf"^{X.WS}*(?:{lead}){X.WS}*", "")
    free = F.regexp_extract(rest, f"(?s)^((?:(?!{_ANY}).)*)", 1)
    parts = F.split(free, "/")
    slashed = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: X.trim(F.regexp_replace(x, _TAIL, "")))
    return F.concat(F.filter(slashed, lambda x: x != ""), bracketed(rest))
