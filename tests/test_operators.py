import io
import json
import os
import random
import zipfile

import duckdb
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import archive, cache, refine, releases, series
from marlstone.operators.dedupe import ITEM, dedupe
from marlstone.operators.graph import connected_components
from marlstone.plans import registry
from marlstone.plans.search import Query, page, search, union
from marlstone.sources import feeds
from marlstone.staging import Staged

NAMES = [p.split(" ")[0] for p in ITEM.split(", ") if " " in p and ":" not in p.split(" ")[0]]


def item(ord_, title="[G] Show - 01", source="nyaa", **kw):
    base = dict.fromkeys(NAMES) | {"ord": ord_, "id": f"i{ord_}", "title": title, "source": source, "tags": []}
    return tuple((base | kw)[n] for n in NAMES)


def model_fold(rows):
    """The ordered merge, record by record."""
    priority = ("nyaa", "bangumi-moe", "dmhy", "acg-rip")
    flags = lambda r: 4 * (r["seeders"] is not None) + 2 * bool(r["size"]) + bool(r["info_hash"])
    acc = dict(rows[0], sources=[rows[0]["source"]])
    for r in rows[1:]:
        r = dict(r, sources=[r["source"]])
        a, b = flags(acc), flags(r)
        wins = b > a or (a == b and priority.index(r["source"]) < priority.index(acc["source"]))
        x, y = (r, acc) if wins else (acc, r)
        acc = {k: x[k] if x[k] not in (None, "") else y[k] for k in x} | {k: list(dict.fromkeys(x[k] + y[k])) for k in ("sources", "tags")}
    return acc


def test_dedupe_is_the_ordered_merge(spark):
    rng = random.Random(1)
    rows = []
    for k in range(300):
        rows.append(item(k, f"[G] Show {rng.randint(0, 40)} - 01", rng.choice(["nyaa", "dmhy", "acg-rip", "bangumi-moe"]), seeders=rng.choice([None, None, 3, k]), size=rng.choice([None, "", f"{k} MB"]),
                         info_hash=rng.choice([None, *("0123456789abcdef"[d] * 40 for d in range(12))]), detail_url=rng.choice([None, f"d{k}"]), tags=rng.sample("abcd", 2)))
    df = spark.createDataFrame(rows, ITEM)
    from marlstone.operators.dedupe import keyed

    buckets = {}
    for r in keyed(df).orderBy("ord").collect():
        buckets.setdefault(r.bucket, []).append(r.asDict())
    got = {r.bucket: r for r in dedupe(df).collect()}
    assert set(got) == set(buckets)
    for b, members in buckets.items():
        members[0]["info_hash"] = members[0]["own_hash"]
        want = model_fold(members)
        for c in ("id", "source", "size", "seeders", "info_hash", "detail_url", "tags", "sources"):
            assert (got[b][c] or None) == (want[c] or None), (b, c)
        assert got[b].n_merged == len(members)


def test_items_without_hash_join_by_title(spark):
    rows = [item(0, info_hash="MFRGGZDFMZTWQ2LKNNWG23TPOBYXE43U", source="dmhy"), item(1, info_hash="6162636465666768696A6B6C6D6E6F7071727374"), item(2, source="acg-rip"), item(3, "other")]
    out = dedupe(spark.createDataFrame(rows, ITEM)).orderBy("ord").collect()
    assert [r.n_merged for r in out] == [3, 1] and out[0].sources == ["nyaa", "dmhy", "acg-rip"]
    assert [m.source for m in out[0].mirrors] == ["nyaa", "dmhy", "acg-rip"]


def test_best_release_order(spark):
    rows = [item(0, "[a] S - 01", seeders=9), item(1, "[b] S - 01v2", seeders=1), item(2, "[c] S - 02 [720p]"), item(3, "[d] S - 02 [1080p]"), item(4, "[e] S"), item(5, "[f] S [01-12]"), item(6, "[g] S [01-12]", seeders=1)]
    best = releases.best_per_episode(releases.annotate(spark.createDataFrame(rows, ITEM)))
    assert sorted(r.ord for r in best.collect()) == [1, 3, 4, 6]
    groups, rest = releases.grouped(best)
    assert [r.ord for r in groups.orderBy("item_rank").collect()] == [3, 1, 6, 4] and rest.count() == 0


def test_series_rules_and_overlay(spark):
    titles = ["[a] 某番 / Long English Name - 01", "[b][另名][Long English Name][02]", "[c] Long English Name TV - 03", "[d] Long English - 01", "[e] Unrelated - 01", "[f] Air - 01"]
    ann = releases.annotate(spark.createDataFrame([item(k, t) for k, t in enumerate(titles)], ITEM))
    got = {r[0]: r[1] for r in series.remap(series.entries(ann)).collect()}
    assert set(got.values()) == {"某番"} and set(got) == {"long english name", "long english name tv", "long english"}
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "k string, v int")
    assert sorted(map(tuple, series.overlay(a, b, "k", "v").collect())) == [("x", 1), ("y", 3), ("z", 4)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_archives(spark):
    rows = [("z", 1, "https://a", "x.torrent", 200, b"1"), ("z", 2, "https://b", "x.torrent", 200, b"22"), ("z", 3, "ftp://c", "y", 200, b"3"), ("z", 4, "https://d", "a/b:c", 200, b"4"), ("z", 5, "https://e", None, 404, None), ("n", 1, "x", "y", 200, b"1")]
    df = spark.createDataFrame(rows, "archive string, ord int, url string, filename string, status int, data binary")
    out = {r.archive: r for r in archive.archives(df).collect()}
    with zipfile.ZipFile(io.BytesIO(out["z"].data)) as z:
        assert z.testzip() is None and z.namelist() == ["x.torrent", "x-1.torrent", "a_b_c", "_errors.txt"] and z.read("x-1.torrent") == b"22"
        assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    assert out["n"].data is None and out["n"].error and out["z"].n_errors == 2
    assert archive.archives(df.where("archive = 'z'"), limit=2).first().n_files == 2
    assert archive.archives(df.where("archive = 'z'"), most=3).first().error == "too many items"


def test_cache_keys_and_tables(spark):
    spellings = ["GQuux x", "  gquux\tX ", "ＧＱｕｕｘ ｘ", "GQUUX\nx"]
    assert len({cache.key(s, ["b", "a"]) for s in spellings} | {cache.key("gquux x", ["a", "b"])}) == 1
    assert cache.key("a") != cache.key("a", refined=True) and cache.seconds("x") == 900 and cache.seconds("60") == 60 and cache.seconds("-1") == 900
    w = spark.sql("select * from values ('k', 'old', timestamp'2025-01-01 00:00:00', 1), ('k', 'new', timestamp'2025-01-01 00:10:00', 2) as t(key, payload, expires_at, seq)")
    e = cache.upsert(w, "seq").select("key", "payload", "expires_at")
    ask = lambda now: cache.lookup(e, spark.sql(f"select 'k' key, timestamp'{now}' now")).first().payload
    assert ask("2025-01-01 00:09:59") == "new" and ask("2025-01-01 00:10:00") is None


def test_chunks_and_refiner(spark):
    names = [f"label {k:04d}" for k in range(5000)]
    parts = refine.chunks(names, ["g"], 3000)
    assert [x for p, _ in parts for x in p] == names and len(parts) > 1 and all(g == ["g"] for _, g in parts)
    assert refine.chunks(["a"], ["b"]) == [(["a"], ["b"])]
    ann = releases.annotate(spark.createDataFrame([item(0, "[A] Foo - 01"), item(1, "[b] Fuu - 02"), item(2, "[C] Bar - 01")], ITEM))
    answer = json.dumps({"groups": [{"canonical": "Foo!", "originals": ["Foo", "Fuu", "Nope"]}, {"originals": ["Bar"]}], "ranking": ["B", "x", "a"]})
    calls = []
    model = refine.Refiner(lambda a, b: calls.append(1) or f"```json\n{answer}\n```")
    for _ in range(2):
        remap, ranks = model.lookups(ann)
        assert [tuple(r) for r in remap.collect()] == [("fuu", "foo")] and sorted(map(tuple, ranks.collect())) == [("a", 2), ("b", 3)]
    assert len(calls) == 1
    bad, _ = refine.Refiner(lambda a, b: "no json").lookups(ann)
    assert bad.collect() == []


FEED = """<rss><item><title><![CDATA[[G] Show & Co - 01]]></title><link>https://x/1</link><pubDate>Tue, 01 Jul 2025 12:34:56 +0000</pubDate>
<enclosure url="magnet:?xt=urn:btih:abc&amp;dn=x" /><s:seeders>7</s:seeders></item><item a="b"><title>A &amp;lt; B</title></item></rss>"""


def test_feeds_and_json(spark):
    rows = feeds.items_of(spark.createDataFrame([(FEED,)], "xml string"))
    got = feeds.magnet_feed(rows, "dmhy").orderBy("ord").collect()
    assert [(r.title, r.magnet_url, r.id) for r in got] == [("[G] Show & Co - 01", "magnet:?xt=urn:btih:abc&dn=x", "https://x/1"), ("A < B", None, "dmhy-A < B")]
    assert feeds.rich_feed(rows, "s").orderBy("ord").first().seeders == 7
    answer = json.dumps({"torrents": [{"_id": "1", "title": "T", "size": "3 MB", "team": {"name": "G"}, "tags": ["x", {"name": "n", "locale": {"zh_cn": "", "ja": "j"}}, {}]}, {"infoHash": "a" * 40, "size": 5}]})
    got = feeds.json_items(feeds.json_answers(spark.createDataFrame([(answer,), ("junk",)], "json string")), "bangumi-moe", "https://b").orderBy("ord").collect()
    assert (got[0].id, got[0].tags, got[0].size, got[0].detail_url) == ("1", ["G", "x", "j"], "3 MB", "https://b/torrent/1")
    assert got[1].size is None and got[1].title == "未命名资源" and got[1].magnet_url.startswith("magnet:?xt=urn:btih:aaaa")


def test_search_goes_on_when_a_source_fails(spark):
    good = lambda s, q: s.createDataFrame([item(k, f"[G] Show - {k:02d}") for k in range(9)], ITEM)

    def broken(s, q):
        raise OSError("no route")

    out = search(spark, Query("show", limit=4, offset=2), {"a": good, "b": broken})
    assert out.total == 4 and out.warnings == ["b: no route"] and [r.episode for r in out.groups.orderBy("item_rank").collect()] == [5, 4, 3, 2]
    assert search(spark, Query("show", sources=("b",)), {"a": good, "b": broken}).total == 0
    assert union([page(good(spark, None), 2, 0), page(good(spark, None), 2, 0)]).select("ord").distinct().count() == 4


def test_query_parameters():
    q = Query.of({"q": " a  b ", "limit": "500", "offset": "-3", "sources": "nyaa, x,dmhy", "prefer": "no", "refine": "0"})
    assert (q.cleaned, q.limit, q.offset, q.sources, q.prefer, q.refine) == ("a b", 100, 0, ("nyaa", "dmhy"), None, False)
    assert Query.of({"q": "a", "limit": "x"}).limit == 20
    assert F is not None


def test_format_bytes_is_its_sql_on_ties_and_without_a_count(spark, tmp_path):
    counts = [None, 0, 1, 512, 768, 1536, 2304, 2560, 10240, 10752, 1 << 20, 1 << 31, 1 << 33, 1 << 62]
    spark.createDataFrame(list(enumerate(counts)), "doc_id long, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(registry.ORACLE_SQL["format_bytes"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, registry.QUERIES["format_bytes"](spark, str(tmp_path)).collect())) == sorted(want)


def test_group_queries_parse_a_title_once_and_are_their_sql(spark, monkeypatch):
    data, plans, real = "/root/testdata/sf0.001", [], registry.stage
    monkeypatch.setattr(registry, "stage", lambda df, tag: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, tag))
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name in ("group_items", "ungrouped_items"):
        plans.clear()
        with monkeypatch.context() as m:
            if name == "group_items":
                m.setattr(releases, "numbered", None)  # the order of the other items is not its business
            got = registry.QUERIES[name](spark, data).collect()
        assert sum(p.count("Generate inline") for p in plans) == 2, name  # the parsed title and the fields from it
        assert sorted(map(tuple, got)) == sorted(con.execute(registry.ORACLE_SQL[name]).fetchall()), name


def test_a_staged_table_is_written_without_files_beside_it(spark):
    at = Staged(spark.range(10).repartition(3), "plain")
    names = os.listdir(at.path.removeprefix("file://"))
    assert at.df.count() == 10 and sorted(n for n in names if not n.startswith("part-")) == ["_SUCCESS"]
    at.drop()


def test_components_of_a_hub_beyond_one_task(spark, monkeypatch):
    """A hub's edges are dealt over tasks in the star steps, and the result is as it was."""
    from marlstone.operators import graph

    edges = spark.range(60_000).selectExpr("CAST(7 AS BIGINT) AS a", "id + 100 AS b").unionByName(spark.range(500).selectExpr("id * 2 + 1000000 AS a", "id * 2 + 1000001 AS b")).unionByName(spark.range(499).selectExpr("id * 2 + 1000001 AS a", "id * 2 + 1000002 AS b"))
    got = connected_components(edges, "a", "b", limit=2000)
    rows = {r["component"]: r["count"] for r in got.groupBy("component").count().collect()}
    assert rows == {7: 60_001, 1_000_000: 1000}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        star = graph.large_star(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v"))
        sizes = [r["count"] for r in star.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) > 4 and max(sizes) < 0.6 * sum(sizes)


def test_numbers_of_feeds(spark):
    texts = ["7", " 3.5 ", "1e3", ".5", "-2", "0x1F", "1d", "NaN", "Infinity", "1e999", "", None, "12a"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.number(F.col("t")).alias("n")).collect()]
    assert got == [7.0, 3.5, 1000.0, 0.5, -2.0, None, None, None, None, None, None, None, None]


def test_only_items_without_a_hash_are_looked_up_by_title(spark, monkeypatch):
    from marlstone.operators import dedupe as module

    sizes, whole = [], module.looked_up
    monkeypatch.setattr(module, "looked_up", lambda rows, *a, **k: sizes.append(rows.count()) or whole(rows, *a, **k))
    rows = spark.createDataFrame([(1, "a", "h1"), (2, "a", None), (3, "b", None), (4, "a", "h2"), (5, "", None), (6, None, None)], "ord long, title_key string, own_hash string")
    got = {r.ord: r.bucket for r in module.keyed(rows).collect()}
    assert got == {1: "hash:h1", 2: "hash:h1", 3: "title:b", 4: "hash:h2", 5: "title:", 6: "title:"}
    assert sizes == [4]


def test_records_that_share_nothing_are_not_summed(spark, monkeypatch):
    """Only records with a hash and those of titles that several share go by their key; lists of any record of a cell count."""
    from marlstone.operators import dedupe as module

    counts, whole = [], module.heavy_keys
    monkeypatch.setattr(module, "heavy_keys", lambda rows, *a, **k: counts.append(rows.count()) or whole(rows, *a, **k))
    link = ("dmhy", "m", None, "")
    rows = [item(k, f"Lone {k}", tags=["a", "b", "a"]) for k in range(200)] + [item(200 + k, "Pair", mirrors=[link] if k == 0 else None, torrent_url=f"u{k}", tags=["x", f"y{k}"]) for k in range(3)]
    rows += [item(300, "Own", info_hash="a" * 40), item(301, "Own", published_at="2025-01-02"), item(302, "Given", mirrors=[link, link])]
    got = {r.ord: r for r in dedupe(spark.createDataFrame(rows, ITEM)).collect()}
    assert counts[0] == 6 and len(got) == 203
    assert got[7].tags == ["a", "b"] and [tuple(m) for m in got[7].mirrors] == [("nyaa", None, None, None)] and got[7].sources == ["nyaa"]
    assert got[200].n_merged == 3 and got[200].tags == ["x", "y0", "y1", "y2"] and [tuple(m) for m in got[200].mirrors] == [("dmhy", "m", None, None), ("nyaa", None, "u1", None)]
    assert got[300].n_merged == 2 and got[300].published_at == "2025-01-02" and [tuple(m) for m in got[302].mirrors] == [("dmhy", "m", None, None)]
