import json

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull, LessThan

from marlstone.operators import archive
from marlstone.sources import answers, feeds, files


def test_files_have_a_status_each(spark, tmp_path):
    for name, data in (("a", b"1"), ("b c", b"22"), ("big", b"x" * 100), ("empty", b"")):
        (tmp_path / name).write_bytes(data)
    rows = [(1, f"{tmp_path}/a"), (2, f"file://{tmp_path}/a"), (3, f"file:{tmp_path}/none"), (4, f"{tmp_path}/big"), (5, f"{tmp_path}/empty"), (6, None), (7, f"{tmp_path}/a")]
    asked = spark.createDataFrame(rows, "ord long, raw string").withColumn("path", files.plain_path(F.col("raw")))
    got = files.fetched(asked, [str(tmp_path), f"{tmp_path}/no such folder"], F.col("ord"), most=50)
    assert sorted((r.ord, r.status, r.n_bytes, None if r.data is None else bytes(r.data)) for r in got.collect()) == [(1, 200, 1, b"1"), (2, 200, 1, b"1"), (3, 404, None, None), (4, 413, 100, None), (5, 404, None, None), (6, 404, None, None), (7, 200, 1, b"1")]
    plan = got._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,50)" in plan
    packed = archive.archives(got.select(F.lit("z").alias("archive"), "ord", F.lit("https://x").alias("url"), F.col("raw").alias("filename"), "status", "data")).first()
    assert (packed.n_files, packed.n_errors) == (4, 4)  # with the list of errors
    assert files.fetched(asked, [], F.col("ord")).where("status <> 404").count() == 0


LINES = [{"torrents": [{"title": f"T{k}", "_id": f"i{k}", "seeders": k} for k in range(6)]}, "junk", {"torrents": None}, [1], {"torrents": 5}, {"torrents": [{"title": "last"}]}]


def saved(tmp_path):
    (tmp_path / "one").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in LINES) + "\n\n")
    (tmp_path / "_hidden").write_text("junk")
    return f"{tmp_path}/one,file:{tmp_path}/two"


def test_answers_and_warnings(spark, tmp_path):
    answers.register(spark)
    df = spark.read.format("answers").option("paths", saved(tmp_path)).load()
    rows = df.collect()
    assert sorted((r.line, r.pos) for r in rows if r.warning is None) == [(0, k) for k in range(6)] + [(5, 0)]
    warned = sorted((r.file.rsplit("/", 1)[1], -1 if r.line is None else r.line) for r in rows if r.warning)
    assert warned == [("one", 1), ("one", 3), ("one", 4), ("two", -1)]
    page = spark.read.format("answers").option("path", f"{tmp_path}/one").option("offset", 4).option("limit", 3).load()
    assert [r.id for r in feeds.json_items(answers.results(page)).orderBy("ord").collect()] == ["i4", "i5"]


def test_a_page_is_pushed_to_the_reader(spark, tmp_path):
    answers.register(spark)
    reader = answers.AnswerReader({"path": saved(tmp_path).split(",")[0]})
    rest = list(reader.pushFilters([GreaterThanOrEqual(("pos",), 2), LessThan(("pos",), 4), IsNotNull(("pos",)), EqualTo(("line",), 0)]))
    assert rest == [IsNotNull(("pos",)), EqualTo(("line",), 0)]
    made = [b for p in reader.partitions() for b in reader.read(p)]
    assert [x for b in made for x in b.column("pos").to_pylist()] == [2, 3]
    df = spark.read.format("answers").option("path", f"{tmp_path}/one").load().where("pos >= 2 AND pos < 4")
    assert [r.pos for r in df.orderBy("pos").collect()] == [2, 3]
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The bounds are gone from Spark's own filter, as the reader has taken them.
    assert "pos#" in plan and ">= 2" not in plan.split("Filter")[-1].split("BatchScan")[0]
    low = answers.AnswerReader({"path": "x", "offset": "-4"})
    list(low.pushFilters([LessThan(("pos",), -2)]))
    assert (low.low, low.high) == (0, 0)


def test_files_are_listed_once(spark, tmp_path, monkeypatch):
    from marlstone.sources import files as module

    (tmp_path / "1").write_text("one")
    (tmp_path / "22").write_text("twenty-two")
    calls, whole = [], module.files_below
    monkeypatch.setattr(module, "files_below", lambda *a: calls.append(a) or whole(*a))
    asked = spark.createDataFrame([(1, "1"), (2, "22"), (3, "333")], "n int, page string")
    got = module.fetched(asked, [f"file://{tmp_path}"], F.col("n"), "page", lambda p: F.substring_index(p, "/", -1), most=5).orderBy("n").collect()
    assert [(r.status, r.n_bytes, r.data and bytes(r.data)) for r in got] == [(200, 3, b"one"), (413, 10, None), (404, None, None)]
    assert len(calls) == 1
