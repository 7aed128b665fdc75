"""Embedding near-dedup, classifier, shards, LM scores, token counts, license scan, mixing."""

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from marlstone.llm import licenses, lm_score, mixing, quality, queries, sharding, token_counts
from marlstone.llm.embedding_dedup import near_duplicates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near_brute(rows):
    n = len(rows)
    x = [None if r[1] is None or r[2] is None or any(v is None or not math.isfinite(v) for v in r[1]) or not any(r[1]) else np.array(r[1], float) for r in rows]
    links = [set() for _ in rows]
    for a in range(n):
        for b in range(a):
            if x[a] is not None and x[b] is not None and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]):
                if x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.93:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for c in links[todo.pop()] - seen:
                seen.add(c)
                todo.append(c)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[a][0], len(links[a]), min(ids, default=None), rows[a][0] is not None and rows[a][0] == min(ids)))
    return sorted(out, key=str)


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(60):
        base = rng.standard_normal(64)
        for _ in range(rng.integers(1, 5)):
            noise = rng.standard_normal(64) * rng.choice([0, 0.1, 0.3])
            rows.append((len(rows), (base + noise).astype(np.float32).astype(float).tolist(), int(k % 3)))
    base = rng.standard_normal(64)
    rows += [(1000 + k, (base + rng.standard_normal(64) * 0.05).astype(np.float32).astype(float).tolist(), 1) for k in range(150)]
    rows += [(2000, None, 1), (2001, [0.0] * 64, 1), (2002, [math.nan] * 64, 1), (2003, [None] * 64, 1), (2004, rows[0][1], None), (2005, [], 1), (None, rows[1][1], 0), (1, rows[1][1], 0), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [math.inf] * 64, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    want = near_brute(rows)
    assert got == want
    assert near_duplicates(df.limit(0)).collect() == []


def test_large_group_in_parts(spark, monkeypatch):
    import marlstone.llm.embedding_dedup as E

    monkeypatch.setattr(E, "GROUP", 20)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(64)
    rows = [(k, (base + rng.standard_normal(64) * 0.2).astype(np.float32).astype(float).tolist(), 0) for k in range(90)]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()), key=str)
    assert got == near_brute(rows)


def test_classifier_learns_and_keeps_good_documents(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "len"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for k in range(400):
        good = k % 5 > 0
        text = " ".join(word() + ("" if good else rng.choice(["%%%", "&&&"])) for _ in range(60))
        docs.append((k, text, "en", rng.choice("ab"), len(text)))
        if k % 2:
            labels.append((k, int(good), 0))
    docs += [(900, None, None, None, None), (901, "", "en", "a", 0), (None, "ta ri mo", "en", "a", 8)]
    d = spark.createDataFrame(docs, DOCS)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(d, lab)
    out = {r[0]: r[1] for r in quality.scored(d, model).selectExpr("row.doc_id", "keep").collect() if r[0] is not None and r[0] < 400}
    unseen = [k for k in range(400) if k % 2 == 0]
    assert sum(out[k] == (k % 5 > 0) for k in unseen) >= 0.97 * len(unseen)
    again = quality.train(d.repartition(5), lab)
    assert np.array_equal(model.joint, again.joint)
    assert quality.train(d, lab.limit(0)) is None
    assert all(r[0] for r in quality.scored(d, None).select("keep").collect())
    assert quality.scored(d.limit(0), model).collect() == []


def test_shards(spark):
    rng = random.Random(3)
    docs = [(k, "x" * rng.choice([1, 5, 80, 300]) + str(rng.randint(0, 400))) for k in range(3000)]
    docs += [(5000 + k, "copy " * 20) for k in range(150)] + [(None, "é"), (1, None), (2, None), (7, "same"), (7, "same")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, shard int").repartition(5)
    got = sharding.byte_shards(df).collect()
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t in docs)
    bytes_, slots, where = Counter(), {}, {}
    for r in got:
        bytes_[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    by_text = {(i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())): t for i, t in docs}
    for r in got:
        where.setdefault(by_text[(r[0], r[1], r[2])], set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert max(bytes_.values()) - min(bytes_.values()) <= 0.02 * sum(bytes_.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sharding.byte_shards(df.limit(0)).collect() == []


def test_one_group_beyond_a_shard_is_cut(spark):
    docs = [(k, "hot " * 50) for k in range(1000)] + [(1000 + k, f"text {k} " * 25) for k in range(500)]
    got = sharding.byte_shards(spark.createDataFrame(docs, "doc_id long, text string")).groupBy("shard").sum("size").collect()
    assert len(got) == 8 and max(r[1] for r in got) <= 1.05 * min(r[1] for r in got)


def test_losses_match_direct_counts(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.choice([0, 1, 7, 60])))) for k in range(120)] + [(500, None), (None, "a b"), (3, "a b"), (3, "a b")]
    target = {k for k in range(120) if k % 4 == 0} | {3}
    pairs, ctx = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    vocabulary = {w for _, t in docs for w in words(t)}
    for i, t in docs:
        for a, b in zip([None, *words(t)], words(t), strict=False):
            for side in (True, False) if i in target else (False,):
                pairs[side][a, b] += 1
                ctx[side][a] += 1
    k, v = lm_score.SMOOTHING, len(vocabulary)
    loss = lambda t, s: sum(math.log(ctx[s][a] + k * v) - math.log(pairs[s][a, b] + k) for a, b in zip([None, *words(t)], words(t), strict=False))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in target] + [(None,)], "doc_id long")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.loss_target, r.loss_background, r.score) for r in lm_score.entropy_difference(df, ids).collect())
    want = sorted((i is None, i or 0, len(words(t)), loss(t, True), loss(t, False), (loss(t, True) - loss(t, False)) / max(1, len(words(t))) if words(t) else None) for i, t in docs)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-4) and g[4] == pytest.approx(w[4], abs=1e-4)
        assert (g[5] is None) == (w[5] is None) and (g[5] is None or g[5] == pytest.approx(w[5], abs=1e-5))
    assert lm_score.entropy_difference(df.limit(0), ids).collect() == []


def test_rollup_is_idempotent_and_compacts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, None, None, "s", 0), (3, "c, d-e", "en", "t", 6)], DOCS)
    rows = token_counts.counted(docs, "spaced-1", "alnum-1")
    old, new = token_counts.version(rows, "spaced-1"), token_counts.version(rows, "alnum-1")
    roll = token_counts.Rollup(spark, f"file://{tmp_path}/roll")
    assert roll.totals().collect() == []
    assert roll.commit("one", token_counts.inserts(old)) and not roll.commit("one", token_counts.inserts(old))
    state = lambda: sorted((tuple(r) for r in roll.totals().collect()), key=str)
    assert state() == sorted([("s", "en", "spaced-1", 1, 2), ("s", None, "spaced-1", 1, 0), ("t", "en", "spaced-1", 1, 2)], key=str)
    roll.commit("two", token_counts.revisions(old, new))
    after = sorted([("s", "en", "alnum-1", 1, 2), ("s", None, "alnum-1", 1, 0), ("t", "en", "alnum-1", 1, 3)], key=str)
    assert state() == after
    roll.compact()
    assert state() == after and roll.committed() == {"one", "two"} and not roll.commit("two", token_counts.inserts(old))
    roll.commit("three", token_counts.deletes(new))
    roll.compact()
    assert state() == [] and roll.committed() == {"one", "two", "three"}
    with pytest.raises(ValueError):
        roll.commit("a/b", token_counts.inserts(old))


def test_license_scan(spark):
    filler = " ".join(f"w{k}" for k in range(300))
    gpl = licenses.NOTICES["gpl-3.0"]
    near = gpl.replace("version 3.", "version three.")  # 7 of 8 shingles
    far = gpl.replace("GNU", "BSD")  # 3 of 8
    docs = [(1, f"{filler} {gpl} {filler}"), (2, near.upper()), (3, far), (4, None), (5, ""), (6, "Released under\nthe MIT License."), (6, "Released under\nthe MIT License."), (None, f"x {licenses.NOTICES['cc-by-nc-4.0']}"), (7, f"{gpl} and {gpl}")]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, template_id string")
    got = sorted(((r[0], r[1], round(r[2], 4), r[3]) for r in licenses.scan(df, licenses.notices(spark)).collect()), key=str)
    assert got == sorted([(1, "gpl-3.0", 1.0, 300), (2, "gpl-3.0", 0.875, 0), (6, "mit", 1.0, 0), (None, "cc-by-nc-4.0", 1.0, 1), (7, "gpl-3.0", 1.0, 0)], key=str)
    assert licenses.scan(df.limit(0), licenses.notices(spark)).collect() == []
    assert licenses.scan(df, licenses.notices(spark).limit(0)).collect() == []


def test_license_texts_and_headers(spark, tmp_path):
    texts = {f.stem: f.read_text() for f in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    cut = " ".join(texts["gpl-2.0"].split()[200:])
    rows = [(1, f"some code {texts['mit']} more code", "mit"), (2, texts["bsd-3-clause"], "bsd-3-clause"), (3, cut, "gpl-2.0"), (4, licenses.HEADERS["apache-2.0"], "apache-2.0"), (5, "It is Released under the MIT License by all", "mit"), (6, f"x {licenses.HEADERS['agpl-3.0']}", "agpl-3.0"), (7, "nothing of the kind is said in here", None)]
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.template_id) for r in queries.op9_license_scan(spark, f"file://{tmp_path}").collect()}
    assert {(i, k) for i, _, k in rows if k} <= got and 7 not in {i for i, _ in got}


def test_mix(spark):
    rng = random.Random(6)
    docs = []
    for s, n in (("a", 300), ("b", 200), ("B", 3), (None, 50), ("c", 150), ("é", 80)):
        docs += [(len(docs) + k, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300 if n > 10 else 5])), "en", s, 0) for k in range(n)]
    docs += [(5, None, "en", "a", 0), (None, "w w", "en", "c", 0), (None, "w w", "en", "c", 0)]
    df = spark.createDataFrame(docs, DOCS)
    got = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, _, s, _ in docs:
        sizes[s] += len((t or "").split())
    weight = dict(zip(sorted(s for s in sizes if s is not None) + [None], [5, 2, 1] * 9, strict=False))
    goal, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = goal - sum(2 * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and left * weight[s] / free > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / free for s in sizes}
    by = {}
    for r in got:
        by.setdefault((r.source_size, round(r.target, 6)), Counter()).update({"taken": r.taken, "n": 1})
        assert r.taken <= 2 * r.size
    assert {(sizes[s], round(target[s], 6)) for s in sizes} == set(by)
    assert all(abs(c["taken"] - t) <= 3 for (_, t), c in by.items())
    key = lambda rows: Counter(tuple(r[:6]) for r in rows)
    assert key(got) == key(mixing.mix(df.repartition(7)).collect())
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).collect() == []
    assert [r.target for r in mixing.mix(spark.createDataFrame([(1, "", "en", "a", 0)], DOCS)).collect()] == [0.0]


def test_paths_for_large_lookups_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "so Released under the MIT License. ok"), (2, "plain words that say nothing at all"), (3, f"x {licenses.NOTICES['gpl-3.0']}")], "doc_id long, text string")
    scan = lambda: sorted(map(tuple, licenses.scan(docs, licenses.notices(spark)).collect()))
    score = lambda: sorted(map(tuple, lm_score.entropy_difference(docs, docs.select("doc_id").limit(1)).collect()))
    small = scan(), score()
    monkeypatch.setattr(licenses, "LITERALS", 0)
    monkeypatch.setattr(lm_score, "BROADCAST_IDS", 0)
    assert small[0] and (scan(), score()) == small


def test_rates_match_a_single_machine_solver(spark):
    """Newton over the table against bisection in numpy, for targets below, above and at the cap."""
    rng = np.random.default_rng(5)
    sizes = {s: rng.integers(0, m, 400) for s, m in (("a", 50), ("b", 900), ("c", 7))} | {None: rng.integers(0, 20_000, 30)}
    share = {"a": 0.2, "b": 1.4, "c": 1.97, None: 2.0}
    cells = spark.createDataFrame([(s, int(z), int(n)) for s, x in sizes.items() for z, n in zip(*np.unique(x, return_counts=True), strict=True)], "source string, size long, n long")
    sources = spark.createDataFrame([(s, int(x.sum()), share[s] * float(x.sum())) for s, x in sizes.items()], "source string, source_size long, target double")
    for tilt in ("tokens", "source"):
        for r in mixing.rates(sources, cells, 2.0, tilt).collect():
            x = sizes[r.source].astype(float)
            x = x[x > 0]
            z = x / x.mean() if tilt == "tokens" else np.ones(len(x))
            assert r.mean == pytest.approx(x.mean())
            low, high = -1e4, 1e4
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if (x * np.minimum(2, np.exp(np.minimum(mid * z, 5)))).sum() < r.target else (low, mid)
            got = np.minimum(2, np.exp(np.minimum(r.lam * z, 5)))
            assert np.allclose(got, np.minimum(2, np.exp(np.minimum(high * z, 5))), atol=1e-5)


def test_mixed_with_clashing_columns_repeated_rows_and_a_long_text(spark):
    rows = [(k % 50, "w " * (k % 9), "s", k % 3, 1, 2, 3, 4, 5) for k in range(120)] + [(999, "v " * 300_000, "t", 0, 1, 2, 3, 4, 5), (7, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, source string, h1 int, h2 int, copies int, k int, row int, _kept int")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.size] += r.copies
    assert Counter((r.doc_id, len((r.text or "").split())) for r in out.collect()) == +want
    assert mixing.mixed(df.limit(0)).collect() == []


def test_pseudo_labels_are_the_surest_of_all_unlabelled_documents(spark, monkeypatch):
    """Each round against scores and shares worked out in Python."""
    rng = random.Random(9)
    docs = [(k, " ".join(rng.choice(["ta", "ri", "mo"] if k % 3 else ["xx", "yy", "ri"]) for _ in range(30)), "en", rng.choice("ab") if k % 3 else "c", 90 + k) for k in range(300)]
    docs += [docs[5], (7, "another text of seven", "en", "a", 3), (None, "ta ri", None, None, None)]
    labels = {k: int(k % 3 > 0) for k in range(0, 300, 2)}
    given, cotrain = [], quality.cotrain
    monkeypatch.setattr(quality, "cotrain", lambda t, m, y, ask, rounds: cotrain(t, m, y, lambda w: given.append(([x.copy() for x in w], ask(w))) or given[-1][1], rounds))
    d = spark.createDataFrame(docs, DOCS)
    quality.train(d, spark.createDataFrame([(k, y, 0) for k, y in labels.items()], "doc_id long, quality int, toxic int"), passed=1000)
    assert len(given) == quality.ROUNDS
    for weights, found in given:
        rest = [r for r in docs if r[0] is not None and r[0] not in labels]
        for v in (0, 1):
            rows = [quality.text_features(r[1].encode()) if v == 0 else quality.meta_features(r[3], r[2], r[4]) for r in rest]
            p = np.array([1 / (1 + math.exp(-float((weights[v][s] * x).sum()))) for s, x in rows])
            step = np.floor(p * quality.BINS)
            cut = sorted(step)[max(0, math.ceil(len(rest) * quality.EXCHANGED) - 1)], sorted(step)[-max(1, math.ceil(len(rest) * quality.EXCHANGED))]
            want = {r[0]: 1 for r, b in zip(rest, step, strict=True) if b >= max(cut[1], quality.SURE * quality.BINS)}
            want |= {r[0]: 0 for r, b in zip(rest, step, strict=True) if b <= min(cut[0], (1 - quality.SURE) * quality.BINS - 1)}
            assert {i: f[0] for i, f in found[v].items()} == want


def test_a_round_of_the_classifier_writes_one_table_of_few_files(spark, monkeypatch):
    written = []

    class Recorded(quality.Staged):
        def __init__(self, df, tag):
            super().__init__(df, tag)
            written.append((tag, len(list(Path(self.path.removeprefix("file:")).glob("part-*")))))

    monkeypatch.setattr(quality, "Staged", Recorded)
    docs = [(k, ("good words here " if k % 3 else "%% bad !! ") * 5, "en", "s", 10) for k in range(120)]
    d = spark.createDataFrame(docs, DOCS).repartition(7)
    quality.train(d, spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(60)], "doc_id long, quality int, toxic int"))
    assert [t for t, _ in written] == ["op5-features", *["op5-unlabelled"] * quality.ROUNDS]
    assert all(n == 1 for t, n in written if t == "op5-unlabelled")


def test_classifier_on_empty_tables_clashing_columns_and_a_long_text(spark):
    docs = [(k, ("good words here " if k % 2 else "%% bad !! ") * 5, "en", "s", 10, 1, 2) for k in range(60)] + [(60, "good words here " * 100_000, "en", "s", 10, 1, 2), (None,) * 7, (3, None, None, None, None, None, None)]
    df = spark.createDataFrame(docs, f"{DOCS}, row int, score int")
    lab = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 60)], "doc_id long, quality int, toxic int")
    out = quality.scored(df, quality.train(df, lab))
    assert out.count() == len(docs) and {r[0]: r[1] for r in out.select("row.doc_id", "keep").collect()}[60]
    assert quality.train(df.limit(0), lab) is None and out.select("row.*").columns == df.columns


def test_counts_by_a_tokenizer_file_and_two_compactions_at_once(spark, tmp_path, monkeypatch):
    from marlstone.llm import token_files

    texts = ["Some words, and more of them.", None, "", "é ï " * 40]
    docs = spark.createDataFrame([(k, t, "en", "s", 1, k) for k, t in enumerate(texts)], f"{DOCS}, n long")
    name = "word_bpe_49k.json"
    rows = token_counts.counted(docs, "spaced-1", name)
    enc = token_files.encoder(name).tokenizer
    want = {k: len(enc.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert {r.doc_id: r[name] for r in rows.collect()} == want
    assert token_counts.counted(docs.limit(0), name).collect() == []
    roll = token_counts.Rollup(spark, f"file://{tmp_path}/roll")
    roll.commit("one", token_counts.inserts(token_counts.version(rows, name)))
    roll.commit("two", token_counts.revisions(token_counts.version(rows, name), token_counts.version(rows, "spaced-1")))
    before = sorted(map(tuple, roll.totals().collect()))
    monkeypatch.setattr(token_counts, "remove", lambda *a: None)  # both fold before either clears up
    folders = roll._folders()
    roll.compact()
    monkeypatch.setattr(roll, "_folders", lambda: folders)
    roll.compact()
    monkeypatch.undo()
    assert sorted(map(tuple, roll.totals().collect())) == before and roll.committed() == {"one", "two"}


def test_recall_of_caps_at_any_size_of_label():
    from marlstone.llm import embedding_dedup as E

    for largest in (10**4, 10**6, 10**9):
        assert E.recall(64, largest, 0.93, 300) >= 0.98
    codes = E.Codes(64, 10**9)
    caps = codes.caps(np.eye(64)[:1])[0]
    assert (codes.unpack(codes.pack(caps)) == caps).all() and len(caps) >= E.CODES * E.CAPS


def test_vectors_of_extreme_numbers_and_clashing_columns(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(8)
    rows = [(k, (base * z).tolist(), 1, 5, 6, 7) for k, z in enumerate((1.0, 1e200, 1e-200, -1.0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cls int, caps int, w int")
    assert sorted(tuple(r)[:3] for r in near_duplicates(df).collect()) == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 0, 3)]
