import hashlib
import random
import re

from marlstone.llm.decontaminate import report

DOCS, ITEMS = "doc_id long, text string, n_hit string", "item_id long, text string"


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def brute(docs, items):
    windows = {}
    for item, t in items:
        w = words(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m and item is not None else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(str(item))
    out = []
    for doc, t in docs:
        w, hit, named = words(t), set(), set()
        for k in range(len(w)):
            for m in range(1, 11):
                if k + m <= len(w) and (got := windows.get(tuple(w[k : k + m]))):
                    hit |= set(range(k, k + m))
                    named |= got
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **kwargs):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS)
    return sorted((tuple(r) for r in report(d, spark.createDataFrame(items, ITEMS), **kwargs).collect()), key=str)


def tables(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klm") for _ in range(n))
    items = [(k, text(rng.choice([3, 8, 10, 14, 30]))) for k in range(30)] + [(7, text(12)), (31, items_twice := text(15)), (32, items_twice)]
    docs = []
    for k in range(150):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1].split()
            a = rng.randint(0, 4)
            parts += [", ".join(w[a : a + rng.randint(8, 20)]), text(3)]
        docs.append((k, ". ".join(parts).title()))
    return docs, items


def test_matches_brute_force(spark):
    docs, items = tables(1)
    assert run(spark, docs, items) == brute(docs, items)


def test_index_in_several_blocks(spark):
    docs, items = tables(2)
    assert run(spark, docs, items, index_words=20) == brute(docs, items)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "?!"), (None, "one two three"), (5, "ONE, two-three"), (5, "ONE, two-three"), (6, "one two"), (7, "z " * 30000 + "one two three")]
    items = [(1, "one two three"), (1, "one two three"), (2, None), (3, "..."), (None, "z z"), (10, "One Two Three!")]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    docs = [(1, "a b")]
    assert run(spark, docs, []) == brute(docs, [])
