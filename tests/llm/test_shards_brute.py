"""Operator 6's shards and operator 10's copies, worked out again row by row."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string"


def placed(spark, docs, shards, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "RANGES", ranges)
    return sharding.byte_shards(docs, shards).collect()


def assigned(rows, shards, ranges):
    """Shards by the law of the module, over plain lists: (doc_id, crc, size) -> shards of its rows, sorted."""
    total, n = sum(r["size"] for r in rows), len(rows)
    share_b, share_n = -(-total // ranges) or 1, -(-n // ranges) or 1
    groups = {}
    for r in rows:
        groups.setdefault((r["g1"], r["g2"]), []).append(r)
    sums = {g: (sum(r["size"] for r in x), len(x)) for g, x in groups.items()}
    large = sorted((g for g, (b, k) in sums.items() if b > share_b or k > share_n), key=lambda g: (-sums[g][0], -sums[g][1], g))
    rank = {g: i + 1 for i, g in enumerate(large)}

    def key(r):
        g = (r["g1"], r["g2"])
        if g in rank:
            parts = -(-max(sums[g][0] / share_b, sums[g][1] / share_n) // 1)
            return 0, rank[g], r["h"] % parts, g, r["h"]
        return 1, r["g1"] % ranges, 0, g, r["h"]

    at, out, starts = 0, {}, {}
    ordered = sorted(rows, key=lambda r: (*key(r), r["doc_id"] is not None, r["doc_id"] or 0))
    for r in ordered:
        starts.setdefault((r["g1"], r["g2"]), at)
        r["at"] = at
        at += r["size"]
    for r in ordered:
        g = (r["g1"], r["g2"])
        twice = 2 * r["at"] + r["size"] if sums[g][0] * shards > total else 2 * starts[g] + sums[g][0]
        out.setdefault((r["doc_id"], r["crc"], r["size"]), []).append(min(twice * shards // (2 * total), shards - 1))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("ranges", [2048, 7])
def test_shards_by_brute_force(spark, monkeypatch, ranges):
    rng = random.Random(ranges)
    texts = ["hot copy " * 40] * 60 + ["warm"] * 25 + [None] * 5 + [""] * 3 + ["w " * rng.randint(1, 400) + str(k) for k in range(150)] + ["very long " * 1000]
    docs = spark.createDataFrame([(k if k % 17 else None, t, "s") for k, t in enumerate(texts)], SCHEMA).repartition(4)
    text = F.col("text")
    keyed = docs.select("doc_id", F.coalesce(F.crc32(text), F.lit(-1)).alias("crc"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).alias("size"), F.xxhash64(F.lit(1), text).alias("g1"), F.xxhash64(F.lit(2), text).alias("g2"), F.xxhash64("doc_id").alias("h"))
    want = assigned([r.asDict() for r in keyed.collect()], 4, ranges)
    got = {}
    for r in placed(spark, docs, 4, monkeypatch, ranges):
        got.setdefault((r.doc_id, -1 if r.text_crc32 is None else r.text_crc32, r.size), []).append(r.shard)
    assert {k: sorted(v) for k, v in got.items()} == want and {s for v in want.values() for s in v} == {0, 1, 2, 3}


def test_copies_follow_the_rates(spark):
    """Whole copies of each source: never beyond the cap, and in sum within one document of the target."""
    rng = random.Random(4)
    rows = [(k, "w " * rng.choice([1, 3, 10, 200]), rng.choice(["a", "b", "c", None])) for k in range(400)] + [(7, "w w", "a")] * 6
    done = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(done) == len(rows) and all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in done)
    sums = {}
    for r in done:
        sums.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert len(sums) == 4
    for (_, target), taken in sums.items():
        assert abs(sum(taken) - target) <= 201
    # What operator 10 says is taken is what its rows are.
    kept = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).groupBy("doc_id", "text").count().collect()
    want = {}
    for r in done:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert {r.doc_id: r["count"] for r in kept if r.doc_id != 7} == {k: v for k, v in want.items() if v and k != 7}
