import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import token_files as T
from marlstone.llm import words

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(T.resolve(NAME))


@given(st.lists(st.integers(0, 2**17 - 1), max_size=60), st.integers(0, 59), st.sampled_from([17, 18, 20, 32]))
def test_bits_round_trip(ids, first, bits):
    data = T.pack_bits(np.array(ids, np.uint32), bits)
    first = min(first, len(ids))
    assert len(data) == (len(ids) * bits + 7) // 8
    assert T.unpack_bits(data, bits, len(ids) - first, first).tolist() == ids[first:]


@settings(deadline=None)
@given(st.text(alphabet=st.sampled_from("abcXYZ '.,!\n\t\r<|>0123é́İΣσ　\x1c\x85​東ß-_"), max_size=40))
def test_chunks_encode_as_the_whole(text):
    tokenizer = Tokenizer.from_file(T.resolve(NAME)) if not hasattr(test_chunks_encode_as_the_whole, "t") else test_chunks_encode_as_the_whole.t
    test_chunks_encode_as_the_whole.t = tokenizer
    for t in (text, text + "<|endoftext|>" + text, "don't " + text):
        assert T.encoder(NAME).encode([t])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("word", ["TÜRKİ", "İ", "İzmir", "\u0915\u0958", "\u05d0\ufb2a", "\ufb2a", "Straße", "ΟΔΟΣ", "東京", "한국", "e\u0301te\u0301"])
def test_letters_that_become_letter_and_mark(whole, word):
    for t in (f"{word}{tail}" for tail in ("", ".", ",", "?!", "...")):
        text = f"so {t} {word} then {t} word. {word}"
        assert T.Encoder(NAME).encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_every_letter_before_punctuation(whole):
    """Each character that Python takes for a letter, at the end of a word and inside one."""
    letters = [chr(c) for c in range(128, 0x32000) if chr(c).isalpha() and not 0x3400 <= c <= 0x9FFF and not 0xAC00 <= c <= 0xD7A3 and not 0x17000 <= c <= 0x18CFF and not 0x20000 <= c <= 0x31FFF]
    enc = T.Encoder(NAME)
    texts = [" ".join(f"x{c}. x{c}y, {c}" for c in letters[k : k + 50]) for k in range(0, len(letters), 50)]
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert got.tolist() == whole.encode(t, add_special_tokens=False).ids


def test_other_tokenizer_encodes_text_by_text():
    enc, t = T.Encoder("byte_bpe_50k.json"), Tokenizer.from_file(T.resolve("byte_bpe_50k.json"))
    assert not enc.chunked
    assert enc.encode(["Hello there, world", None])[0].tolist() == t.encode("Hello there, world", add_special_tokens=False).ids


def test_round_trip_through_files(spark, tmp_path, whole):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice(["alpha", "Beta,", "gamma!", "déjà", "42"]) for _ in range(rng.choice([0, 3, 50, 20000 if k == 7 else 10])))) for k in range(200)]
    docs += [(None, "no id"), (3, None), (5, "twice"), (5, "twice")]
    path = f"file://{tmp_path}/tokens"
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int").repartition(7)
    T.write_tokens(df, path, NAME)
    got = sorted((tuple(r) for r in T.digest(spark, path).collect()), key=lambda r: r[1])
    ids = {}
    for i, t in docs:
        own = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        ids.setdefault(i, []).append((len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    at, seen = 0, {}
    for doc, start, n, crc in got:
        assert start == at
        at += n
        seen.setdefault(doc, []).append((n, crc))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in ids.items()}
    order = [r[0] for r in got]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    part = T.read_ids(spark, path, 100, 500)
    every = T.read_ids(spark, path, 0, at)
    assert len(every) == at and part.tolist() == every[100:600].tolist()
    for _, start, n, crc in got:
        assert zlib.crc32(every[start : start + n].tobytes()) == crc


def test_words_and_marks_are_learned_once_for_all_chunks(whole, monkeypatch):
    """Words of ASCII letters skip the file's patterns, a chunk of word and marks is not encoded as such."""
    enc, raw = T.Encoder(NAME), []
    monkeypatch.setattr(enc, "_raw", lambda words, real=enc._raw: raw.extend(words) or real(words))
    texts = ["word%%% WORD&&& word's Word, x2## (word) é.*** dogs' <|endoftext|>\n\n ta_ a<|", "Word%%% été&&& été", "", None, " "]
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode(texts)] == want and [x.tolist() for x in enc.encode(texts[::-1])] == want[::-1]
    assert enc.plain is not None and enc.encode([]) == []
    assert not {"word%%%", "word&&&", "Word%%%", "été&&&", "ta_"} & set(raw) and {"%%%", "x2##"} <= set(raw)


def test_every_mark_after_a_word(whole):
    enc = T.Encoder(NAME)
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    for m in marks:
        text = " ".join(f"word{m} s{m}{n} é{n}{m} word{m}s{n} it{m}s" for n in marks)
        assert enc.encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_few_files_and_tasks(spark, tmp_path):
    """No checksum files beside the token files; blocks of many small files are read by few tasks."""
    path = f"file://{tmp_path}/tokens"
    docs = spark.range(0, 400, 1, 8).selectExpr("id AS doc_id", "'some words' AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        T.write_tokens(docs, path, NAME)
        found = T.digest(spark, path)
        assert found.count() == 400 and found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(list(tmp_path.rglob("*.parquet"))) > 4 and not list(tmp_path.rglob("*.crc"))


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    T.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, NAME)
    assert T.digest(spark, path).collect() == []


def test_another_operators_task_gives_the_encoder_back():
    enc = T.encoder(NAME)
    assert T.encoder(NAME) is enc
    words.release()
    assert not T._encoders and T.encoder(NAME) is not enc


def test_a_changed_byte_fails_the_read(spark, tmp_path):
    """Files carry checksums of their pages, without checksum files beside them."""
    import os

    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(k, f"the text number {k} " * 50) for k in range(40)], "doc_id long, text string").coalesce(1)
    T.write_tokens(docs, f"file://{tmp_path}/t", "word_bpe_49k.json")
    whole = T.digest(spark, f"file://{tmp_path}/t").count()
    name = max((os.path.join(d, f) for d, _, fs in os.walk(f"{tmp_path}/t/data") for f in fs if f.endswith(".parquet")), key=os.path.getsize)
    row = pq.ParquetFile(name).metadata.row_group(0)
    payload = row.column(row.num_columns - 1)
    with open(name, "r+b") as f:
        f.seek(payload.data_page_offset + payload.total_compressed_size // 2)
        byte = f.read(1)[0]
        f.seek(-1, os.SEEK_CUR)
        f.write(bytes([byte ^ 1]))
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        T.digest(spark, f"file://{tmp_path}/t").collect()
    assert whole == 40
