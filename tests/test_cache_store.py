import unicodedata
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marlstone.operators import cache
from marlstone.operators.cache import Store, bucket_of

NOW = datetime(2026, 1, 1)


def later(seconds):
    return NOW + timedelta(seconds=seconds)


def test_a_read_takes_the_files_of_one_folder(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/c", 60, buckets=8)
    writes = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("v"), "id").alias("payload"), F.lit(NOW).alias("at"))
    store.put_all(writes)
    assert store.get("k77", later(1)) == "v77" and store.get("none", later(1)) is None
    read = store.scan("k77").inputFiles()
    assert read and all(f"/bucket={bucket_of('k77', 8)}/" in f for f in read) and len(read) < len(store._files())
    assert {r.key for r in store.entries().collect()} == {f"k{i}" for i in range(2000)}


def test_writes_are_compacted_and_the_last_one_holds(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/c", 60, buckets=2, compact_files=4, sweep_chance=0)
    for k in range(6):
        assert store.put("key", f"v{k}", later(k))
        assert store.get("key", later(k)) == f"v{k}"
        assert len(store._files([bucket_of("key", 2)])) < 4
    assert store.get("key", later(64)) == "v5" and store.get("key", later(65)) is None


def test_what_has_run_out_leaves_the_disk(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/c", 60, buckets=4, sweep_chance=0)
    store.put("old", "x", NOW)
    store.put("new", "y", later(50))
    held = lambda: {r.key for r in store._read(store._files()).collect()}
    assert store.get("old", later(59)) == "x" and held() == {"old", "new"}
    assert store.get("old", later(60)) is None and held() == {"new"}
    store.put("a", "1", NOW)
    store.put("b", "2", later(50))
    assert store.sweep(later(70)) == 1 and held() == {"b", "new"} and store.sweep(later(70)) == 0
    store.delete(spark.createDataFrame([("b",), ("unknown",)], "key string"), later(71))
    assert held() == {"new"} and store.get("new", later(72)) == "y"
    always = Store(spark, f"file://{tmp_path}/c", 60, buckets=4, sweep_chance=1)
    always.put("c", "3", later(200))
    assert held() == {"c"}


def test_keys_in_full_width_and_with_marks_apart(spark):
    words = ["ＧＱｕｕｘ　ｘ", "café", "ｶﾞ ①", "plain", "", None, "가"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", cache.composed("w").alias("c")).collect()
    assert [r.c for r in got] == [None if w is None else unicodedata.normalize("NFKC", w) for w in words]
    col = cache.key_column(F.col("w"), F.array(F.lit("b"), F.lit("a")), F.lit(None).cast("string"), F.lit(20), F.lit(0), F.lit(True))
    rows = spark.createDataFrame([("ＧＱｕｕｘ　ｘ",), ("gquux \t X",)], "w string").select(col.alias("k")).collect()
    assert {r.k for r in rows} == {cache.key("gquux x", ["a", "b"], None, 20, 0, True)}
