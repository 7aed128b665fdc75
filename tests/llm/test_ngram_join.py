import random
import re

import numpy as np

from marlstone.llm import ngram_join
from marlstone.llm.ngram_join import jaccard_components

SCHEMA = "doc_id long, text string, n_shingles long"


def brute(rows):
    """Component and size of each row, by all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, x in enumerate(sets):
        for b in range(a):
            if x and sets[b] and 100 * len(x & sets[b]) >= 80 * len(x | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in jaccard_components(df).collect()), key=str)


def near_copies(rng, n, size, vocabulary=4000):
    rows, words = [], [f"w{k}" for k in range(vocabulary)]
    for g in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(3, size))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(rng.randint(0, 1 + len(t) // 30)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    rng.shuffle(rows)
    return rows


def test_random_near_copies(spark):
    rows = near_copies(random.Random(3), 120, 120)
    assert run(spark, rows) == brute(rows)


def test_one_group_of_near_copies_and_a_shared_passage(spark):
    rng = random.Random(5)
    base, passage = [f"a{k}" for k in range(60)], " ".join(f"p{k}" for k in range(55))
    rows = []
    for k in range(300):
        t = list(base)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(60)] = f"x{rng.random()}"
        rows.append((k, " ".join(t)))
    rows += [(300 + k, f"{passage} " + " ".join(f"q{k}_{j}" for j in range(rng.randint(2, 14)))) for k in range(80)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three four five"), (6, "one two three four five"), (None, "ONE two three four five"), (9, "Ä b"), (10, "ä b"), (11, "x " * 5000), (None, "lonely words here"), (None, None)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_blocks_of_hot_tokens(spark, monkeypatch):
    """A family whose members are apart, so that its tokens stay open, in blocks of few texts."""
    monkeypatch.setattr(ngram_join, "SIDE", 7)
    monkeypatch.setattr(ngram_join, "CHUNK", 50)
    rng = random.Random(11)
    base, rows = [f"b{k}" for k in range(150)], []
    for k in range(160):
        t = list(base)
        for _ in range(rng.randint(0, 7)):
            t[rng.randrange(150)] = f"y{rng.randrange(40)}"
        rows.append((k, " ".join(t)))
    assert run(spark, rows) == brute(rows)
    assert len({r[2] for r in brute(rows)}) > 3


def test_one_long_text_and_a_passage_that_many_share(spark):
    rng = random.Random(8)
    long_ = [f"l{k}" for k in range(40_000)]
    other = list(long_)
    for k in rng.sample(range(40_000), 400):
        other[k] = f"m{k}"
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(0, " ".join(long_)), (1, " ".join(other)), (2, " ".join(long_[:30_000]))]
    rows += [(3 + k, f"{passage} " + " ".join(f"q{k}_{j}" for j in range(rng.randint(0, 40)))) for k in range(1500)]
    got = {r[0]: r[2] for r in run(spark, rows)}
    assert (got[0], got[1], got[2]) == (0, 0, 2)
    # n own words add n shingles to the passage's 56; two texts are alike if both have few
    assert {k: got[k] for k in got if k > 2} == {k: c for k, _, c in brute(rows[3:])}


def test_coarse_counts_are_never_less():
    counts = np.arange(0, 200_000, 7)
    bound = ngram_join._FINE[np.frombuffer(ngram_join.coarse(counts), "u1")]
    assert (bound >= counts).all() and (bound[counts <= 128] == counts[counts <= 128]).all()
