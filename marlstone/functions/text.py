"""Text expressions: trimming, keys, scripts, links, dates and sizes. All of them are built-in functions."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.fixed import SPACE, UNKNOWN_TIME

WS = f"[{SPACE}]"
#: The same characters as a text.
BLANKS = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
#: Runs of punctuation and white space; the first look, of one step, passes over the letters and digits that make up most of a name.
MARKS = rf"(?![abcdefghijklmnopqrstuvwxyz0123456789])[\p{{P}}\p{{S}}{SPACE}]+"
#: Word boundaries of ASCII words, which Java's own boundary is not.
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns that are worked out once for each row.

    The optimizer puts a projection's expressions in the place of each use of its columns; a
    generator of one row it leaves where it is.
    """
    return df.select(*(c for c in df.columns if c not in cols), F.inline(F.array(F.struct(*(v.alias(k) for k, v in cols.items())))))


def empty_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return trim(F.regexp_replace(c, f"{WS}+", " "))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if there is no match or the group is empty."""
    return empty_as_null(F.regexp_extract(c, pattern, group))


def remove_first(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, f"(?s)^(.*?)(?:{pattern})", "$1")


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


@cache
def _script_tables(app: str) -> tuple[str, str, str, str]:
    """(traditional, its simplified, simplified, its traditional), one character each, by the ICU rules that Spark ships."""
    jvm = SparkSession.getActiveSession()._jvm
    chars = "".join(map(chr, range(0x3400, 0xA000)))
    out = []
    for rule in ("Traditional-Simplified", "Simplified-Traditional"):
        done = jvm.com.ibm.icu.text.Transliterator.getInstance(rule).transliterate(chars)
        pairs = [(a, b) for a, b in zip(chars, done, strict=True) if a != b] if len(done) == len(chars) else []
        out += ["".join(a for a, _ in pairs), "".join(b for _, b in pairs)]
    return tuple(out)


def _tables() -> tuple[str, str, str, str]:
    return _script_tables(SparkSession.getActiveSession().sparkContext.applicationId)


def simplified(c: Column) -> Column:
    """Traditional characters as simplified ones, character by character."""
    return _in_script(c, *_tables()[:2])


def traditional(c: Column) -> Column:
    return _in_script(c, *_tables()[2:])


def _in_script(c: Column, chars: str, done: str) -> Column:
    """Characters exchanged; a text of ASCII has none of them and is left as it is."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, chars, done))


def script(c: Column) -> Column:
    """``traditional``, ``simplified``, or null if a text is neither or could be both."""
    trad, simp = simplified(c) != c, traditional(c) != c
    return F.when(trad & ~simp, "traditional").when(simp & ~trad, "simplified")


def series_key(c: Column) -> Column:
    """Name as a key: one script, lower case, punctuation as blanks."""
    return trim(F.regexp_replace(F.lower(simplified(c)), MARKS, " "))


def title_key(c: Column) -> Column:
    """Title up to the first slash as a key: one script, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(simplified(F.substring_index(c, "/", 1))), MARKS, "")


def magnet_hash(c: Column) -> Column:
    return extract(c, "xt=urn:btih:([a-zA-Z0-9]+)")


def base32_hex(c: Column) -> Column:
    """40 hex digits of a 32-character base32 text in upper case.

    Its digits as Spark's digits of base 32 are read 12, 12 and 8 at a time, each in a number of 60 bits at most.
    """
    digits = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    return F.lower(F.concat(*(F.lpad(F.conv(F.substring(digits, at, n), 32, 16), n * 5 // 4, "0") for at, n in ((1, 12), (13, 12), (25, 8)))))


def normal_hash(c: Column) -> Column:
    """Hashes of one content as one text: hex in lower case; null and empty are absent."""
    h = trim(c)
    out = F.when(h.rlike(r"^[a-fA-F0-9]{40}\z"), F.lower(h)).when(h.rlike(r"(?i)^[A-Z2-7]{32}\z"), base32_hex(F.upper(h))).otherwise(F.lower(h))
    return F.when(F.coalesce(c, F.lit("")) != "", out)


def uri_component(c: Column) -> Column:
    done = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        done = F.replace(done, F.lit(a), F.lit(b))
    return done


def magnet(info_hash: Column, title: Column) -> Column:
    """A link for a hash of 40 hex digits; null for others."""
    h = F.lower(trim(info_hash))
    name = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("&dn="), uri_component(title))).otherwise("")
    return F.when(h.rlike(r"^[a-f0-9]{40}\z"), F.concat(F.lit("magnet:?xt=urn:btih:"), h, name))


def timestamp(c: Column) -> Column:
    """A time from ISO or mail-style text; null for others.

    What begins like an ISO date is no mail-style text, so it is not tried as one: each try that fails is an exception.
    """
    whole = trim(c)
    bare = F.regexp_replace(whole, r"^[A-Za-z]{3},\s*", "")
    zone = F.regexp_replace(bare, r"\s(?:GMT|UTC|UT|Z)\z", " +0000")
    return F.when(whole.rlike(r"^\d{4}-\d\d"), F.try_to_timestamp(whole)).otherwise(_any_time(bare, zone))


def _any_time(bare: Column, zone: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(F.when(bare.rlike(r"^\d{4}-\d\d"), bare)), F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm xx")))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_date(c: Column) -> Column:
    """Any known date text as ISO 8601 in UTC with milliseconds."""
    return iso(timestamp(c))


def short_date(ts: Column) -> Column:
    """Date and time in short Chinese form; a text of its own where there is none."""
    return F.coalesce(F.date_format(ts, "yyyy/M/d HH:mm"), F.lit(UNKNOWN_TIME))


def number(c: Column) -> Column:
    """A decimal number, with a fraction or an exponent as it may be; null for any other text and beyond all bounds."""
    plain = trim(c)
    n = F.when(plain.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), plain).try_cast("double")
    return F.when(F.abs(n) < float("inf"), n)


def bytes_text(c: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB"), even: bool = False) -> Column:
    """A size with a unit: one decimal below 10, none above and for bytes; null for null.

    A value midway between two texts takes the larger one, or with ``even`` the one with an even last digit.
    """
    # Such values are multiples of a quarter, so their doubles are exact.
    fixed = lambda v, digits: F.format_string(f"%.{digits}f", F.bround(v, digits) if even else v)
    out, size = None, c.cast("double")
    for k, unit in reversed(list(enumerate(units))):
        v = size / 1024**k
        text = F.concat(fixed(v, 0) if k == 0 else F.when(v >= 10, fixed(v, 0)).otherwise(fixed(v, 1)), F.lit(f" {unit}"))
        out = text if out is None else F.when(size < 1024.0 ** (k + 1), text).otherwise(out)
    return F.when(c.isNotNull(), out)


def episode_label(season: Column, episode: Column) -> Column:
    pad = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    has_season = F.coalesce(season, F.lit(0)) != 0
    named = F.when(has_season, F.concat(F.lit("S"), season.cast("string"), F.lit("E"), pad(episode))).otherwise(F.concat(F.lit("EP"), pad(episode)))
    return F.when(episode.isNotNull(), named).when(has_season, F.concat(F.lit("S"), season.cast("string"))).otherwise("—")
