"""Release items derived from the star schema, so that all operators have a large input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators.dedupe import MIRROR

_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item for each line of an order, in one of four styles of titles; see ``RELEASES_SQL``."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE)))
    parts = read("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", F.lower("p_type").alias("p_type"), "p_brand")
    rows = lines.join(parts, "l_partkey").join(read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    c, lit = F.col, F.lit
    pick = lambda col, *values: F.get(F.array(*map(F.lit, values)), (col % len(values)).cast("int"))
    number = F.concat(lit("0"), c("l_linenumber").cast("string"))
    season = F.when(c("l_partkey") % 5 == 0, F.concat(lit(" S0"), (c("l_partkey") % 3 + 1).cast("string"))).otherwise("")
    lead = F.concat(lit("["), c("s_name"), lit("]"))
    title = (
        F.when(c("l_orderkey") % 4 == 0, F.concat(lead, lit(" "), c("p_name"), lit(" "), c("p_type"), season, lit(" / "), c("p_brand"), lit(" "), c("p_name"), lit(" - "), number, F.when(c("l_tax") > 0.06, "v2").otherwise(""), lit(" ["), pick(c("l_suppkey"), "1080p", "720p", "4k"), lit("][HEVC]")))
        .when(c("l_orderkey") % 4 == 1, F.concat(lead, lit("["), c("p_name"), lit(" "), c("p_type"), lit("]["), number, lit("][WebRip][1080P]")))
        .when(c("l_orderkey") % 4 == 2, F.concat(lead, lit(" "), c("p_name"), lit(" "), c("p_type"), lit(" [01-"), (c("l_linenumber") + 5).cast("string"), lit("][1080p]")))
        .otherwise(F.concat(lead, lit(" "), c("p_name"), lit(" "), c("p_type"), lit(" Movie [720p]")))
    )
    ord_ = c("l_orderkey") * 1000 + c("rn")
    digest = F.md5((c("l_orderkey") % 5000).cast("string"))
    digest = F.when(c("l_linenumber") % 3 != 0, F.concat(digest, F.left(digest, lit(8))))
    return rows.select(
        ord_.alias("ord"), ord_.cast("string").alias("id"), title.alias("title"), lit(None).cast("string").alias("subtitle"),
        pick(c("l_suppkey"), "nyaa", "bangumi-moe", "dmhy", "acg-rip").alias("source"), lit(None).cast("array<string>").alias("sources"), lit(None).cast(f"array<{MIRROR}>").alias("mirrors"),
        X.iso(c("l_shipdate")).alias("published_at"), F.when(c("l_linestatus") == "O", F.concat(F.floor("l_extendedprice").cast("string"), lit(" MB"))).alias("size"),
        F.when(c("l_returnflag") == "R", c("l_quantity").cast("long")).alias("seeders"), lit(None).cast("long").alias("leechers"), digest.alias("info_hash"),
        F.when(c("l_linenumber") % 2 == 0, F.concat(lit("magnet:?xt=urn:btih:"), digest)).alias("magnet_url"), F.when(c("l_partkey") % 2 == 0, F.concat(lit("https://files.example/"), ord_.cast("string"))).alias("torrent_url"),
        lit(None).cast("string").alias("detail_url"), F.array(c("p_brand"), F.concat(lit("t"), (c("l_suppkey") % 3).cast("string"))).alias("tags"),
    )


RELEASES_SQL = """
releases AS (
  SELECT ord, CAST(ord AS VARCHAR) AS id, title, ['nyaa', 'bangumi-moe', 'dmhy', 'acg-rip'][CAST(l_suppkey % 4 AS INT) + 1] AS source, l_shipdate AS published,
    CASE WHEN l_linestatus = 'O' THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || ' MB' END AS size,
    CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END AS seeders, CASE WHEN l_linenumber % 3 <> 0 THEN h || left(h, 8) END AS info_hash,
    CASE WHEN l_linenumber % 2 = 0 AND l_linenumber % 3 <> 0 THEN 'magnet:?xt=urn:btih:' || h || left(h, 8) END AS magnet_url, CASE WHEN l_partkey % 2 = 0 THEN 'https://files.example/' || ord END AS torrent_url,
    [p_brand, 't' || (l_suppkey % 3)] AS tags
  FROM (
    SELECT *, l_orderkey * 1000 + rn AS ord, md5(CAST(l_orderkey % 5000 AS VARCHAR)) AS h,
      CASE WHEN l_orderkey % 4 = 0 THEN '[' || s_name || '] ' || p_name || ' ' || lower(p_type) || CASE WHEN l_partkey % 5 = 0 THEN ' S0' || (l_partkey % 3 + 1) ELSE '' END
          || ' / ' || p_brand || ' ' || p_name || ' - 0' || l_linenumber || CASE WHEN l_tax > 0.06 THEN 'v2' ELSE '' END || ' [' || ['1080p', '720p', '4k'][CAST(l_suppkey % 3 AS INT) + 1] || '][HEVC]'
        WHEN l_orderkey % 4 = 1 THEN '[' || s_name || '][' || p_name || ' ' || lower(p_type) || '][0' || l_linenumber || '][WebRip][1080P]'
        WHEN l_orderkey % 4 = 2 THEN '[' || s_name || '] ' || p_name || ' ' || lower(p_type) || ' [01-' || (l_linenumber + 5) || '][1080p]'
        ELSE '[' || s_name || '] ' || p_name || ' ' || lower(p_type) || ' Movie [720p]' END AS title
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem)
    JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  )
)"""
