import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402

from marlstone.llm import decontaminate, mixing, quality, token_files  # noqa: E402
from tests.llm.test_decontaminate import brute as decontaminated  # noqa: E402
from tests.llm.test_ngram_join import brute as components  # noqa: E402


def test_each_stage_on_its_own_input(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, f) in enumerate(P.STAGES):
        out = f(spark, docs, data)
        path = f"file://{tmp_path}/{k}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        before = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
        ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
        if k < len(P.STAGES) - 1:
            assert after.columns == docs.columns, name
        if k == 0:
            kept = quality.scored(docs, quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))).where("keep")
            assert ids(after) == sorted(r[0] for r in kept.select("row.doc_id").collect()) and 0 < after.count() < docs.count()
        elif k == 1:
            assert ids(after) == sorted(i for i, _, c in components(before) if i == c)
        elif k == 2:
            assert ids(after) == sorted(r[0] for r in decontaminated(before, items) if not r[-1])
        elif k == 3:
            want = [i for i, n in mixing.mix(docs).select("doc_id", "copies").collect() for _ in range(n)]
            assert ids(after) == sorted(want)
        else:
            assert ids(after) == sorted(i for i, _ in before)
            enc = token_files.encoder("word_bpe_49k.json")
            sizes = {i: len(enc.encode([t])[0]) + 1 for i, t in before}
            at = 0
            for doc, start, n, _ in sorted(map(tuple, after.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]):
                assert (start, n) == (at, sizes[doc])
                at += n
        docs = after


def test_repeated_documents_stay_once(spark):
    rows = [(1, "a b c d e f", "en", "s", 11)] * 3 + [(2, "a b c d e f", "en", "t", 11), (3, None, None, None, None), (None, "lonely", "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r[0] or 0) for r in P.join_near_copies(spark, docs, "").collect()) == [0, 1, 3]
    assert decontaminate.WINDOW == 10


def test_unlinked_documents_without_or_with_one_id_all_stay(spark):
    texts = [(None, "one two three four five six"), (None, "seven eight nine ten eleven"), (None, None), (None, ""), (7, "red green blue black white"), (7, "oak ash elm fir yew"), (7, "oak ash elm fir yew"), (7, "Oak ash elm fir yew"), (8, "red green  blue black white"), (None, "OAK ash elm fir yew"), (9, ""), (9, "")]
    texts += [(None, "lone copy of a text here"), (None, "lone copy of a text here"), (None, "Lone copy of a text here")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.join_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    left = sorted((r.doc_id or 0, (r.text or "").lower()) for r in got.collect())
    assert left == sorted([(0, "one two three four five six"), (0, "seven eight nine ten eleven"), (0, ""), (0, ""), (7, "red green blue black white"), (7, "oak ash elm fir yew"), (9, ""), (0, "lone copy of a text here")])
