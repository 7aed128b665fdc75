import random
import re
from collections import Counter

from marlstone.llm import phrases

SCHEMA = "doc_id long, text string, lang string"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least, max_n=5, best=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, max_n + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    cands = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}

    def inside(p, q):
        return any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))

    out = []
    for (lang, p), a in cands.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= 100 * a and inside(p, q) for (g, q), b in cands.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    place, rows = Counter(), []
    for lang, *rest in out:
        place[lang] += 1
        if place[lang] <= best:
            rows.append((lang, place[lang], *rest))
    return rows


def found(df, **how):
    return sorted(tuple(r) for r in phrases.collocations(df, **how).select(*COLUMNS).collect())


def texts(seed, count):
    rng = random.Random(seed)
    words = ["a", "b", "Ab", "é", "É", "x-y", " z", "日本", "of", "the"]
    seps = [" ", "  ", "\t", ". ", ",", ";\n", "\r\n", "? ", ": "]
    fixed = ["the end of the line", "The End of", "of the of the of the of"]
    for k in range(count):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 30))]
        yield k, "".join(p + rng.choice(seps[:2] if rng.random() < 0.8 else seps) for p in parts), rng.choice(["en", "en", "fr", "und", None])


def test_equal_to_brute_force(spark):
    rows = [*texts(1, 120), (None, None, "en"), (7, "", "en"), (7, "the end of the line", "en"), (7, "the end of the line", "en"), (8, " .,; \n", None), (9, "sole", "xx")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, 6)
    assert len(want) > 60 and {r[0] for r in want} == {"en", "fr", "und"}
    assert found(df, least=6) == want
    assert found(df, least=6, best=5) == brute(rows, 6, best=5)
    assert found(df, least=4, max_n=3) == brute(rows, 4, 3)


def test_slices_and_long_texts_change_nothing(spark, monkeypatch):
    rows = list(texts(2, 60))
    rows.append((99, "the end of the line " * 4000 + "a b. " * 5000, "en"))
    want = brute(rows, 40)
    monkeypatch.setattr(phrases, "SLICE_CHARS", 700)  # for the driver's own use of the cutter
    pieces = [p for p in phrases._bounded(rows[-1][1].encode())]
    assert b"".join(pieces).decode() == rows[-1][1] and len(pieces) > 10
    assert found(spark.createDataFrame(rows, SCHEMA), least=40) == want


def test_a_full_bitmap_costs_work_and_no_row(spark, monkeypatch):
    rows = list(texts(3, 80))
    monkeypatch.setattr(phrases, "_bitmap", lambda pairs: b"\xff" * (phrases.FILTER_BITS // 8))
    assert found(spark.createDataFrame(rows, SCHEMA), least=5) == brute(rows, 5)


def test_products_beyond_64_bits_and_odd_columns(spark):
    from pyspark.sql import functions as F

    rows = [(k, "big small " * 30 + "other " * 5, "en") for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    odd = df.withColumns({"a.b": F.lit(1), "rank": F.lit("x"), "phrase": F.lit(2), "f": F.lit(3), "n": F.create_map(F.lit("k"), F.lit(1)), "_top": F.lit(0)})
    assert found(odd, least=50) == brute(rows, 50)
    wide = spark.range(1).select(F.expr("(cast(1000 as decimal(4,0)) * cast(8000000000000000000 as decimal(19,0)) * cast(900000000000000 as decimal(15,0))) div (cast(3 as decimal(19,0)) * cast(8000000000000000001 as decimal(19,0)))").alias("s")).first().s
    assert wide == 1000 * 8000000000000000000 * 900000000000000 // (3 * 8000000000000000001)


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, None, None), (2, "one", "en")], SCHEMA), least=1) == []
