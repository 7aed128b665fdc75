"""Extra columns of any name and type, repeated rows and empty tables, for the pipeline's stages and the operators on documents."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402

from marlstone.llm import decontaminate, licenses, lm_score, mixing, quality, sharding, token_counts, token_files  # noqa: E402
from marlstone.llm.embedding_dedup import near_duplicates  # noqa: E402
from marlstone.llm.ngram_join import jaccard_components  # noqa: E402

DATA = "/root/testdata/sf0.001"
NAMES = ("_key", "_id", "_tag", "_again", "a.b", "a`c", "row", "id", "tag", "kept_id", "h1", "k", "p_text", "keep", "n_words", "copies", "size", "slot", "score")


def with_odd(df):
    more = {name: F.lit(f"own {name}") for name in NAMES}
    more |= {"m": F.create_map(F.lit("x"), F.lit(1), F.lit("a"), F.lit(2)), "n.m": F.array(F.create_map(F.lit(1), F.create_map(F.lit(2), F.lit(3)))), "v": F.parse_json(F.lit('{"a":1}'))}
    return df.withColumns(more)


@pytest.fixture(scope="module")
def plain(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return docs.unionByName(docs.where("doc_id % 9 = 0")).unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), *(c for c in docs.columns if c != "doc_id")))


@pytest.mark.parametrize("stage", range(len(P.STAGES)))
def test_stages_keep_every_column(spark, plain, stage):
    name, f = P.STAGES[stage]
    odd = with_odd(plain)
    quote = lambda c: F.col("`{}`".format(c.replace("`", "``")))
    for docs in (odd, odd.dropDuplicates(["doc_id", "text"]), odd.limit(0)):
        out = f(spark, docs, DATA)
        if stage == len(P.STAGES) - 1:
            assert out.count() == docs.count()
            continue
        assert out.columns == docs.columns, name
        got = sorted(map(str, out.select("doc_id", "text").collect()))
        if stage == 3:  # which of equally long documents is taken more often follows from the whole row
            assert set(got) <= set(map(str, docs.select("doc_id", "text").collect())) and bool(got) == bool(docs.count())
        else:
            assert got == sorted(map(str, f(spark, docs.select(*plain.columns), DATA).select("doc_id", "text").collect()))
        assert all(r[c] == f"own {c}" for r in out.select(*map(quote, NAMES)).collect() for c in NAMES)
        assert all(r.m == {"x": 1, "a": 2} for r in out.select("m").collect())


def test_operators_pass_odd_columns_by(spark, plain, tmp_path):
    odd, bench = with_odd(plain), spark.read.parquet(f"{DATA}/benchmark.parquet")
    good = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1")
    same = {
        "op1": lambda d: token_files.encode_and_read(d, path=f"file://{tmp_path}/{id(d)}").select("doc_id", "n_tokens", "ids_crc32"),
        "op2": jaccard_components,
        "op3": lambda d: decontaminate.report(d, bench),
        "op5": lambda d: quality.scored(d, None).select("row.doc_id", "keep"),
        "op6": sharding.byte_shards,
        "op7": lambda d: lm_score.entropy_difference(d, good),
        "op8": lambda d: token_counts.counted(d, "spaced-1"),
        "op9": lambda d: licenses.scan(d, licenses.templates(spark)),
        "op10": mixing.mix,
    }
    for name, f in same.items():
        assert sorted(map(str, f(odd).collect())) == sorted(map(str, f(plain).collect())) or name == "op10", name
        assert f(odd.limit(0)).count() == 0, name
    assert sorted(r.size for r in mixing.mix(odd).select("size").collect()) == sorted(r.size for r in mixing.mix(plain).select("size").collect())
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    assert sorted(map(str, near_duplicates(with_odd(vectors)).collect())) == sorted(map(str, near_duplicates(vectors).collect()))


def test_equal_maps_in_any_order_are_equal_rows(spark):
    docs = spark.sql("select 1L doc_id, 'a b' text, 's' source, map('x', 1, 'y', 2) m union all select 1L, 'a b', 's', map('y', 2, 'x', 1)")
    assert [r.copies for r in mixing.mix(docs, cap=2.0).select("copies").collect()] in ([2, 1], [1, 2])
