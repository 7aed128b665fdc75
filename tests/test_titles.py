import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.titles import aliases, with_parsed

# title, group, series, season, episode, range, version, resolution
CASES = [
    ("[Grp] Show S01E05 [1080p]", "Grp", "Show S01E05", None, None, None, None, "1080p"),
    ("[Grp] Some Show 2 - 05 [1080p]", "Grp", "Some Show 2", None, None, (2, 5), None, "1080p"),
    ("[Grp] Heroes2 - 01 [720p]", "Grp", "Heroe", 2, 1, None, None, "720p"),
    ("[Grp] 某番 第十二季 - 03", "Grp", "某番", None, 3, None, None, None),
    ("[Grp] 某番 第二季 [03v2]", "Grp", "某番", 2, 3, None, 2, None),
    ("[Grp]【某番】【01】", "Grp", "某番", None, None, None, None, None),
    ("[Grp] Show - 01-12 [x]", "Grp", "Show", None, None, (1, 12), None, None),
    ("Show - 07v3 [4k]", None, "Show", None, 7, None, 3, "4K"),
    ("[only]", "only", None, None, None, None, None, None),
    ("[Sub][机动战士][Mobile Suit][09][WebRip][1080p][HEVC-10bit]", "Sub", "机动战士", None, 9, None, None, "1080p"),
    ("【组】作品 第08话 720P", "组", "作品 第08话 720P", None, 8, None, None, "720p"),
    ("　[G]　Name - 02 ", "G", "Name", None, 2, None, None, None),
]


def test_parse(spark):
    rows = with_parsed(spark.createDataFrame([(c[0],) for c in CASES], "title string")).collect()
    for row, case in zip(sorted(rows, key=lambda r: r.title), sorted(CASES), strict=True):
        p = row.parsed
        r = p.episode_range
        assert (row.title, p.group, p.series, p.season, p.episode, (r.start, r.end) if r else None, p.version, p.resolution) == case


def test_null_and_empty_titles(spark):
    rows = with_parsed(spark.createDataFrame([(None,), ("",)], "title string")).collect()
    assert [r.parsed for r in rows] == [None, None]


def test_key_prefers_latin_and_folds_scripts(spark):
    titles = ["[A][機動戰士][Mobile Suit!][01]", "[B][机动战士][mobile  suit][02]", "[C] 機動戰士 - 01", "[D] 机动战士 - 02"]
    keys = [r.parsed.series_key for r in with_parsed(spark.createDataFrame([(t,) for t in titles], "title string").coalesce(1)).collect()]
    assert keys == ["mobile suit", "mobile suit", keys[3], keys[3]]


def test_aliases(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(aliases(F.col("t"))).first()[0]
    assert one("[G] 中文 / English Name - 12 / Romaji [x264][Other]") == ["English Name", "Romaji", "Other"]
    assert one("[G] plain - 01 [1080p]") == []


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: X.normal_hash(F.lit("MFRGGZDFMZTWQ2LKNNWG23TPOBYXE43U")), "6162636465666768696a6b6c6d6e6f7071727374"),
        (lambda: X.normal_hash(F.lit(" " + "AB" * 20 + " ")), "ab" * 20),
        (lambda: X.normal_hash(F.lit("")), None),
        (lambda: X.magnet(F.lit("zz"), F.lit("t")), None),
        (lambda: X.magnet(F.lit("A" * 40), F.lit("a b!'()*~")), f"magnet:?xt=urn:btih:{'a' * 40}&dn=a%20b!'()*~"),
        (lambda: X.bytes_text(F.lit(0)), "0 B"),
        (lambda: X.bytes_text(F.lit(1536)), "1.5 KB"),
        (lambda: X.bytes_text(F.lit(15 * 1024)), "15 KB"),
        (lambda: X.bytes_text(F.lit(1 << 50)), "1024 TB"),
        (lambda: X.bytes_text(F.lit(12.5 * 1024)), "13 KB"),
        (lambda: X.bytes_text(F.lit(12.5 * 1024), even=True), "12 KB"),
        (lambda: X.bytes_text(F.lit(2.25 * 1024), even=True), "2.2 KB"),
        (lambda: X.bytes_text(F.lit(1 << 40), ("B", "KB", "MB", "GB")), "1024 GB"),
        (lambda: X.bytes_text(F.lit(None).cast("long")), None),
        (lambda: X.iso_date(F.lit("Tue, 01 Jul 2025 12:34:56 +0800")), "2025-07-01T04:34:56.000Z"),
        (lambda: X.iso_date(F.lit("2025-07-01T12:34:56Z")), "2025-07-01T12:34:56.000Z"),
        (lambda: X.iso_date(F.lit("never")), None),
        (lambda: X.number(F.lit("")), None),
        (lambda: X.episode_label(F.lit(2), F.lit(5)), "S2E05"),
        (lambda: X.episode_label(F.lit(None).cast("int"), F.lit(112)), "EP112"),
    ],
)
def test_scalars(spark, make, want):
    assert spark.range(1).select(make()).first()[0] == want


def test_each_pattern_runs_once_over_a_title(spark):
    plan = with_parsed(spark.createDataFrame([("x",)], "title string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 10
    assert plan.count("hevc|x265") == 1


def test_an_iso_time_is_read_before_mail_style_ones(spark):
    plan = spark.range(1).select(X.timestamp(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("d MMM yyyy") > plan.index("ELSE")
    times = ["2025-07-01T12:34:56Z", "Tue, 2025-07-01T12:34:56Z", " 1 Jul 2025 12:34:56 GMT", "2025-13-01", "2025-07-01 12:00 GMT"]
    got = spark.createDataFrame(list(enumerate(times)), "n int, t string").select("n", X.iso_date(F.col("t")).alias("t")).orderBy("n").collect()
    assert [r.t for r in got] == ["2025-07-01T12:34:56.000Z", "2025-07-01T12:34:56.000Z", "2025-07-01T12:34:56.000Z", None, None]


def test_seasons_ranges_and_versions_at_the_edges(spark):
    titles = ["[G] Show S1/b - 2v3", "[G] Show Season 2 [1-2-3]", "[G] a 第3季 (2~12 x", "[] - 01", "【G] x"]
    got = spark.createDataFrame(list(enumerate(titles)), "n int, title string")
    p = [r.parsed for r in with_parsed(got).orderBy("n").collect()]
    assert [(x.group, x.series, x.season, x.episode, x.version) for x in p] == [("G", "Show", 1, 2, 3), ("G", "Show", 2, None, None), ("G", "a", 3, None, None), (None, "- 01", None, 1, None), (None, None, None, None, None)]
    assert [x.episode_range and tuple(x.episode_range) for x in p] == [None, (2, 3), None, None, None]


def test_a_base32_hash_is_a_short_expression(spark):
    plan = spark.range(1).select(X.normal_hash(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(") <= 6
