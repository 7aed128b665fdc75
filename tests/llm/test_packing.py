import random
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import packing
from marlstone.llm.token_files import resolve

SCHEMA = "doc_id long, text string"


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(resolve("word_bpe_49k.json"))


def encoded(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def best_fit(lengths, capacity):
    """Sequences that best-fit decreasing takes."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in room if r >= n), default=None)
        if fit is None:
            room.append(capacity - n)
        else:
            room.remove(fit)
            room.append(fit - n)
    return len(room)


def check(rows, got, capacity):
    """All pieces of all rows once, in sequences without gaps; how many sequences."""
    want = []
    for doc, text in rows:
        ids = encoded(text)
        for k in range(-(-len(ids) // capacity)):
            cut = ids[k * capacity : (k + 1) * capacity]
            want.append((doc if doc is not None else -1, k, k * capacity, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= capacity
    return len(held), [w[3] for w in want]


def test_plan_is_full_and_no_worse_than_best_fit():
    rng = random.Random(5)
    for _ in range(30):
        capacity = rng.choice([10, 64, 2048])
        lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else 1 for _ in range(rng.randint(1, 400))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        made = packing.plan(histogram, capacity)
        back = {}
        for used, times in made:
            assert sum(n * k for n, k in used.items()) <= capacity and times > 0
            for n, k in used.items():
                back[n] = back.get(n, 0) + k * times
        assert back == histogram
        assert sum(t for _, t in made) <= best_fit(lengths, capacity)
    big = {n: 10**12 + n for n in range(1, 2049)}
    made = packing.plan(big)
    assert sum(t for _, t in made) <= sum(n * k for n, k in big.items()) / 2048 * 1.001 + 1 and len(made) < 20_000


def test_fullest_by_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        pool = [rng.randint(1, 12) for _ in range(rng.randint(0, 7))]
        room = rng.randint(1, 30)
        counts = {n: pool.count(n) for n in set(pool)}
        used = packing.fullest(sorted(counts, reverse=True), counts, room)
        sums = {0}
        for n in pool:
            sums |= {s + n for s in sums}
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room) and all(k <= counts[n] for n, k in used.items())


@pytest.mark.parametrize(("broadcast", "task_ids"), [(packing.BROADCAST_COUNTS, packing.TASK_IDS), (-1, 300), (-1, 1)])
def test_pack_round_trip(spark, tmp_path, monkeypatch, broadcast, task_ids):
    monkeypatch.setattr(packing, "BROADCAST_COUNTS", broadcast)
    rng = random.Random(7)
    words = "the of and a longer wording, Ünïcode 漢字 x1 y2 . ! supercalifragilistic".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    rows += [(None, "null id"), (None, None), (3, ""), (3, ""), (3, None), (900, "long text " * 3000), (901, "word " * 63)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    docs = docs.withColumns({"a.b": F.lit(1), "length": F.lit("x"), "slot": F.lit(2), "m": F.create_map(F.lit(1), F.lit(2))})
    path = packing.pack(docs, f"file://{tmp_path}/packed", capacity=64, task_ids=task_ids)
    got = packing.digest(spark, path).collect()
    n, lengths = check(rows, got, 64)
    small = task_ids < packing.TASK_IDS  # tasks that choose among few pieces
    assert n <= best_fit(lengths, 64) + 2 * small and n <= -(-sum(lengths) // 64) + 2 + 2 * small
    own = {r.sequence_id for r in got if r.sequence_id < packing.REST}
    assert {r.sequence_id - packing.REST for r in got if r.sequence_id >= packing.REST} == set(range(n - len(own)))
    full = [r.length for r in got if r.sequence_id in own]
    assert sum(full) == 64 * len(own) and (len(own) > 100 if small else not own)
    by_doc = {d: t for d, t in rows if d is not None and d != 3}
    for s in packing.sequences(spark, path).collect():
        ids = np.frombuffer(bytes(s.ids), "<u2").tolist()
        assert len(ids) == s.n_tokens == sum(p.length for p in s.parts)
        at = 0
        for p in s.parts:
            if p.doc_id in by_doc:
                assert ids[at : at + p.length] == encoded(by_doc[p.doc_id])[p.start : p.start + p.length]
            at += p.length


def test_empty(spark, tmp_path):
    assert packing.digest(spark, packing.pack(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/p")).collect() == []
