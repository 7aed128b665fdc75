import json
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marlstone.operators.gathering import gathered, windows
from marlstone.operators.refine import Refiner
from marlstone.streaming.gather import REQUEST, answered_together

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_requests_of_a_window_get_the_same_union(spark, tmp_path):
    rows = [("p", "r1", "L", "k1", "g", 1), ("p", "r1", "M", "m", None, 2), ("p", "r2", "L", "k2", "h", 3), ("q", "r3", "X", "x", None, 4)]
    spark.createDataFrame(rows, REQUEST).coalesce(1).write.json(f"{tmp_path}/in")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        stream = spark.readStream.schema(REQUEST).json(f"{tmp_path}/in")
        q = answered_together(stream, 100).writeStream.format("memory").queryName("together").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="100 milliseconds").start()
        end = time.time() + 90
        while time.time() < end and spark.table("together").count() < 3 and q.exception() is None:
            time.sleep(0.5)
        got = sorted((r.pool, r.request, r.answer) for r in spark.table("together").collect())
        assert q.exception() is None
        q.stop()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    both = json.dumps({"labels": {"L": "k1", "M": "m"}, "groups": ["g", "h"]})
    assert got == [("p", "r1", both), ("p", "r2", both), ("q", "r3", json.dumps({"labels": {"X": "x"}, "groups": []}))]


def test_callers_of_a_window_share_one_call_and_each_is_remembered():
    calls = []
    answer = '{"groups": [], "ranking": ["g"]}'
    model = Refiner(lambda names, crews: calls.append((names, crews)) or answer)
    requests = [(["a", "b"], ["g"]), (["b", "c"], ["g", "h"]), (["z"], [])]
    assert model.ask_together(requests) == [[answer], [answer], []] and calls == [(["a", "b", "c"], ["g", "h"])]
    assert model.ask(["b", "c"], ["g", "h"]) == [answer] and model.ask_together(requests[:1]) == [[answer]] and len(calls) == 1
    failing = Refiner(lambda names, crews: "no json")
    assert failing.ask_together(requests) == [[], [], []] and not failing.memo


def test_windows_open_with_a_request_that_finds_none(spark):
    t0 = datetime(2026, 1, 1)
    times = {"p": [0, 50, 99, 100, 150, 199, 230, 500, 599, 600], None: [0, 10], "q": [k * 30 for k in range(400)]}
    rows = [(p, k, t0 + timedelta(milliseconds=m)) for p, ms in times.items() for k, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "pool string, k long, at timestamp").withColumn("label", F.lit("x")).repartition(5)
    want = {}
    for p, ms in times.items():
        start = None
        for k, m in enumerate(ms):
            start = m if start is None or m >= start + 100 else start
            want[p, k] = t0 + timedelta(milliseconds=start)
    assert {(r.pool, r.k): r["window"] for r in windows(df, "pool", "at", "k", 100).collect()} == want
    assert windows(df.limit(0), "pool", "at", "k", 100).collect() == []
    out = gathered(df.where("pool = 'p'"), "pool", "k", "at", F.when(F.col("k") != 1, F.concat(F.lit("l"), F.col("k") % 2)), F.col("k").cast("string"), 100).orderBy("k").collect()
    assert [(r.n_requests, r.labels) for r in out][:4] == [(3, "l0=0")] * 3 + [(3, "l0=4,l1=3")]
