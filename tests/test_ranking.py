import random

from pyspark.sql import functions as F

from marlstone.operators.ranking import scanned, top
from marlstone.operators.skew import heavy_keys, looked_up


def test_scan_inside_groups_that_span_tasks(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abcde") if rng.random() < 0.9 else None, k, rng.randint(-9, 9)) for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    got = {(r.g, r.k): (r.n, r.s, r.x) for r in scanned(df, ["g"], [F.col("k")], "n", {"s": "v"}, {"x": "k"}).collect()}
    want, state = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        n, s, x = state.get(g, (0, 0, 0))
        state[g] = want[g, k] = n + 1, s + v, x ^ k
    assert got == want
    assert scanned(df.limit(0), ["g"], [F.col("k")], "n").collect() == []


def test_the_rows_of_a_large_group_go_to_many_tasks(spark):
    df = spark.range(40_000).select(F.lit("one").alias("g"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few bytes
    try:
        plan = scanned(df, ["g"], [F.col("id")], "n")
        assert sorted(r.n for r in plan.collect()) == list(range(1, 40_001))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in plan.inputFiles()}).groupBy("_scan_part").count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 20_000


def test_top_of_each_group(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"), F.lit("x").alias("a.b"))
    got = sorted((r.g, r["rank"], r.v) for r in top(df, ["g"], [F.desc("v")], 4).collect())
    assert got == [(g, n, v) for g in range(3) for n, v in enumerate([x for x in range(4999, 0, -1) if x % 3 == g][:4], 1)]


def test_lookup_of_a_key_with_a_third_of_all_rows(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"), "id")
    table = spark.createDataFrame([("hot", 1), ("k5", 2), ("none", 3)], "k string, v int")
    heavy = heavy_keys(rows, ["k"], least=500)
    assert [tuple(r) for r in heavy.collect()] == [("hot", 6)]
    joined = looked_up(rows, table, ["k"], F.col("id"), heavy=heavy)
    got = {r.id: r.v for r in joined.collect()}
    assert len(got) == 9000 and all(got[i] == (1 if i % 3 == 0 else 2 if i % 700 == 5 else None) for i in got)
    pieces = looked_up(rows, table, ["k"], F.col("id"), "inner", heavy=heavy)
    assert pieces.count() == sum(v is not None for v in got.values())
    # The rows of the frequent key meet the lookup in several parts of the exchange.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        where = looked_up(rows, table, ["k"], F.col("id"), heavy=heavy).where("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
        text = looked_up(rows, table, ["k"], F.col("id"), heavy=heavy)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(where) > 1 and "hashpartitioning(k" in text and "_piece" in text


def test_one_group_of_a_million_items(spark):
    """Its rank comes without a window over the group and in parts of like size."""
    from marlstone.operators import releases

    rows = spark.range(1_000_000).select(F.col("id").alias("place"), F.lit("g").alias("group_key"), (F.col("id") % 1000).cast("int").alias("episode"), (F.col("id") % 7).alias("published"), F.lit(False).alias("passed"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = releases._in_groups(rows, rows.groupBy("group_key").agg(F.count("*").alias("n_items")))
        top_row = out.where("item_rank = 1").first()
        n = out.agg(F.count("*"), F.max("item_rank"), F.countDistinct("item_rank")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # 999 is the last episode; of its items those of the greatest time come first, and of these the first place.
    assert tuple(n) == (1_000_000,) * 3 and (top_row.episode, top_row.published) == (999, 6) and top_row.place == min(i for i in range(999, 60_000, 1000) if i % 7 == 6)
    sizes = [r["count"] for r in spark.read.parquet(*{f.rsplit("/", 1)[0] for f in out.inputFiles()}).groupBy("_scan_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_entities_with_one_key_of_a_third_of_all_rows(spark, monkeypatch):
    """The same entities whether frequent keys are dealt out or not."""
    from marlstone.operators import dedupe as D
    from marlstone.operators import skew

    rows = spark.range(600).select(
        F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "[g] Hot - 01").otherwise(F.concat(F.lit("[g] T"), (F.col("id") % 40).cast("string"))).alias("title"), F.lit(None).cast("string").alias("subtitle"),
        F.get(F.array(*map(F.lit, ("nyaa", "dmhy", "acg-rip"))), (F.col("id") % 3).cast("int")).alias("source"), F.lit(None).cast("array<string>").alias("sources"), F.lit(None).cast(f"array<{D.MIRROR}>").alias("mirrors"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("2025-01-0"), F.col("id") % 9 + 1)).alias("published_at"), F.when(F.col("id") % 4 == 1, "3 MB").alias("size"), F.when(F.col("id") % 7 == 2, F.col("id")).alias("seeders"), F.lit(None).cast("long").alias("leechers"),
        F.when(F.col("id") % 11 == 6, F.md5((F.col("id") % 2).cast("string"))).alias("info_hash"), F.lit(None).cast("string").alias("magnet_url"), F.concat(F.lit("u"), "id").alias("torrent_url"), F.lit(None).cast("string").alias("detail_url"), F.array(F.concat(F.lit("t"), F.col("id") % 6)).alias("tags"),
    )
    plain = sorted(map(str, D.dedupe(rows).collect()))
    seen = []

    def dealt(rows, on, share=1000, least=10):
        seen.append(skew.heavy_keys(rows, on, 50, 10))
        return seen[-1]

    monkeypatch.setattr(D, "heavy_keys", dealt)
    assert sorted(map(str, D.dedupe(rows).collect())) == plain and max(r["_pieces"] for r in seen[0].collect()) > 5
