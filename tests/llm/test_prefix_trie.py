import hashlib
import random
import zlib

from pyspark.sql import functions as F

from marlstone.llm import prefix_trie
from marlstone.operators import skew

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n] for n in members}
    out = []
    for n, cs in members.items():
        below = [m for m in members if m[: len(n)] == n]
        ends = ",".join(str(c) for c in sorted(c for c in cs if built[c] == n))
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        out.append((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), len(children[n]), sum(not children[m] for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in prefix_trie.prefix_trie(df).select(*COLUMNS).collect())


def talks(seed, count, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * count), count):
        hot = rng.random() < 0.4
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, ["user", "assistant"][t % 2], "same" if hot or rng.random() < 0.4 else rng.choice(["a", "bé", "日本", ""])))
    rng.shuffle(rows)
    return rows


def test_equal_to_brute_force(spark):
    rows = talks(1, 70, 9)
    rows += [(None, 1, "user", "x"), (900, None, None, "first"), (900, 1, "user", None), (901, None, "user", None), (905, 5, "", ""), (2, 0, "user", "ends at once")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert len(want) > 60 and any(r[4] > 2 for r in want) and found(df) == want


def test_long_conversations_many_copies_and_frequent_prefixes(spark, monkeypatch):
    rows = [(c, t, "user", f"t{t}" if t < 40 - c % 7 or c % 3 else f"own {c}") for c in range(40) for t in range(30 + c % 20)]
    monkeypatch.setattr(skew, "LEAST", 3)
    monkeypatch.setattr(prefix_trie, "looked_up", lambda *a, **k: skew.looked_up(*a, least=3, share=10, **k))
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 2)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_a_chain_of_chains(spark):
    """Each conversation leaves the one before it a turn later: the tree of chains is as high as it can be."""
    rows = [(5 * c, t, "user", f"{min(t, c)}" if t < 40 else "end") for c in range(30) for t in range(c + 9)]
    rows += [(5 * c, t, "user", f"s{t}" if t <= c else f"{c} ends {t}") for c in range(40, 60) for t in range(c - 20)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_ties_repeated_rows_and_odd_columns(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "user", "y"), (6, 0, "user", "x"), (6, 0, "user", "y"), (6, 0, "user", "x")]
    base = spark.createDataFrame(rows, SCHEMA)
    odd = base.withColumns({"a.b": F.lit(1), "depth": F.lit("x"), "owner": F.lit(2), "_part": F.lit(0), "m": F.create_map(F.lit(1), F.lit(2))})
    got = found(odd)
    assert got == found(base.repartition(3)) and {r[:2] for r in got if r[1] == 0} == {(1, 0)}
    # Equal turns in any order make one sequence, so the conversations share all of their turns.
    assert len(got) == len({r[:2] for r in got})


def test_long_text_and_empty(spark):
    rows = [(0, 0, "user", "long " * 200_000), (1, 0, "user", "long " * 200_000), (1, 1, "user", "more")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == [] and found(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []
