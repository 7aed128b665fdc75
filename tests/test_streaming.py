from marlstone.streaming.ttl import cached, coalesced

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_cache_as_state(spark, tmp_path):
    schema = "key string, op string, payload string, seq long"
    rows = [("a", "get", None, 1), ("a", "put", "x", 2), ("a", "get", None, 3), ("b", "put", "y", 4), ("b", "put", "z", 5), ("b", "get", None, 6)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        out = cached(spark.readStream.schema(schema).json(f"{tmp_path}/in"), 600)
        q = out.writeStream.format("memory").queryName("ttl_answers").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(once=True).start()
        assert q.awaitTermination(90)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r.key, r.seq, r.payload) for r in spark.table("ttl_answers").collect()) == [("a", 1, None), ("a", 3, "x"), ("b", 6, "z")]


def test_requests_are_gathered(spark, tmp_path):
    schema = "request string, label string, series_key string, name string, ord long"
    spark.createDataFrame([("r1", "L", "k1", "g", 1), ("r2", "L", "k2", "h", 2), ("r2", "M", "m", None, 3)], schema).coalesce(1).write.json(f"{tmp_path}/in")
    seen = []
    q = coalesced(spark.readStream.schema(schema).json(f"{tmp_path}/in"), lambda labels, names, n: seen.append((sorted(tuple(r)[:2] for r in labels.collect()), sorted(r.name for r in names.collect()))), f"{tmp_path}/cp")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == [([("L", "k1"), ("M", "m")], ["g", "h"])]
