"""Phrase collocation mining: counted n-grams, exact scores, no phrase that a longer one explains.

Texts are cut into pieces and words. Each task takes a few million characters at a time, numbers
their words, and explodes their n-grams into rows (lang, phrase, count), equal ones of the slice
as one row; Spark's hash aggregate sums them up by language and phrase. Words and pairs come first, then
longer n-grams: as an n-gram cannot be more frequent than its parts, only those are exploded of which every
pair is frequent enough. A bitmap of fixed size says which pairs those are. It holds all of them and,
by its hashes, some others, whose n-grams are counted exactly like all and dropped for their count. So the
result does not depend on it; where the data outgrow it, more rows are exploded.

Counts of the parts come by joins with the table of frequent n-grams, whose frequent keys are dealt
out. Scores are integer divisions of decimals of 38 digits.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import words as W
from marlstone.operators.ranking import top
from marlstone.operators.skew import looked_up
from marlstone.session import ship
from marlstone.staging import Staged, stage

#: Bits of the bitmap: 8 MB, whatever the data.
FILTER_BITS = 1 << 26
#: Characters of text that are exploded at a time.
SLICE_CHARS = 4_000_000
NO_LANG = "und"

_SPLIT = np.zeros(256, "u1")
_SPLIT[[0x20, 0x09]] = 1
_SPLIT[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_MULTIPLIERS = 40_503, 2_654_435, 65_599


def _slot(lang: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Bit of a pair from the crc32 of its language and words."""
    return (lang * _MULTIPLIERS[1] + first * _MULTIPLIERS[0] + second * _MULTIPLIERS[2]) % FILTER_BITS


def _bitmap(pairs: DataFrame) -> bytes:
    """The bits of the frequent pairs (lang, phrase), by the rule of ``_slot`` in Spark: ``FILTER_BITS`` / 8 bytes on the driver."""
    word = F.split("phrase", " ")
    slot = (F.crc32("lang") * _MULTIPLIERS[1] + F.crc32(word[0]) * _MULTIPLIERS[0] + F.crc32(word[1]) * _MULTIPLIERS[2]) % FILTER_BITS
    one = F.col("slot") + 1  # the functions count from 1
    rows = pairs.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number(one).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
    out = np.zeros((-(-FILTER_BITS // 32768), 4096), "u1")
    for r in rows.toLocalIterator():
        out[r.b - 1] = np.frombuffer(r.bits, "u1")
    return out.tobytes()


def _has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype("u1")) & 1 == 1


def cut_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words in lower case, and at each whether it begins a piece; a text's end ends a piece."""
    raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", "u1")
    kind = _SPLIT[raw]
    inside = kind == 0
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    ends = np.flatnonzero(~inside & np.r_[False, inside[:-1]])
    breaks = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else np.empty(0, np.int32)
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[inside].tobytes())])
    return words, np.r_[True, breaks[1:] != breaks[:-1]] if len(starts) else np.empty(0, bool)


def _bounded(text: bytes):
    """A text in parts of about ``SLICE_CHARS`` that end with a piece."""
    at = 0
    while len(text) - at > SLICE_CHARS and (end := _PIECE_END.search(text, at + SLICE_CHARS)):
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def _ngrams(texts: list[bytes], lang: str, lengths: range, bits: np.ndarray | None):
    """(phrases, counts) for each length of a slice of texts."""
    words, begins = cut_words(texts)
    if not len(words):
        return
    coded = words.dictionary_encode()
    ids, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    if 1 in lengths:
        yield vocabulary, np.bincount(ids)
    good = ~begins[1:]  # pairs that an n-gram may hold
    if bits is not None:
        crc = np.fromiter(map(zlib.crc32, vocabulary.to_pylist()), np.int64, len(vocabulary))
        good &= _has(bits, _slot(zlib.crc32(lang.encode()), crc[ids[:-1]], crc[ids[1:]]))
    at = np.flatnonzero(good)
    key, size = ids, len(vocabulary)
    for n in range(2, lengths[-1] + 1):
        if n > 2:  # places from which n - 1 pairs in a row are good
            at = at[: -1 if len(at) and at[-1] + n - 1 >= len(ids) else None]
            at = at[good[at + n - 2]]
        if not len(at):
            return
        _, first, dense, counts = np.unique(key[at] * size + ids[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
        if n in lengths:
            places = at[first]
            yield pc.binary_join_element_wise(*(vocabulary.take(pa.array(ids[places + k])) for k in range(n)), pa.scalar(b" ", pa.large_binary())), counts
        key = np.zeros(len(ids), np.int64)
        key[at] = dense


def _exploded(lengths: range, bits):
    def run(batches):
        table = None if bits is None else np.frombuffer(bits.value, "u1")

        def made(lang: str, texts: list[bytes]):
            for phrases, counts in _ngrams(texts, lang, lengths, table):
                rows = pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(counts), np.int32))), phrases.cast(pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "phrase", "f"])
                yield from (rows.slice(k, 50_000) for k in range(0, len(rows), 50_000))

        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), W.texts(batch.column("text")), strict=True):
                for part in _bounded(text or b""):
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part)
                    if size[lang] >= SLICE_CHARS or sum(size.values()) >= 2 * SLICE_CHARS:
                        largest = max(size, key=size.get)
                        del size[largest]
                        yield from made(largest, held.pop(largest))
        for lang, texts in held.items():
            yield from made(lang, texts)
        W.trim()

    return run


def frequent_ngrams(docs: DataFrame, least: int, max_n: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(``lang, phrase, n, f`` of all n-grams with f >= ``least``, ``lang, total`` of all words); see the module."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(NO_LANG)).alias("lang"), docs[text_col].cast("string").alias("text"))
    schema = "lang string, phrase string, f long"

    def counted(lengths: range, bits) -> DataFrame:
        return rows.mapInArrow(_exploded(lengths, bits), schema).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))

    sized = lambda df: df.withColumn("n", F.size(F.split("phrase", " ")))
    short = sized(counted(range(1, 3) if max_n > 1 else range(1, 2), None))
    # Rare n-grams end here, but for the words' sum.
    kept = F.when(F.col("f") >= least, F.col("phrase"))
    short = Staged(short.where((F.col("f") >= least) | (F.col("n") == 1)).groupBy("lang", kept.alias("phrase"), "n").agg(F.sum("f").alias("f")), "phrases-short")
    totals = short.df.where("n = 1").groupBy("lang").agg(F.sum("f").alias("total"))
    many = short.df.where("phrase IS NOT NULL").select("lang", "phrase", "f", "n")
    if max_n > 2:
        bits = spark.sparkContext.broadcast(_bitmap(many.where("n = 2")))
        longer = stage(sized(counted(range(3, max_n + 1), bits).where(F.col("f") >= least)), "phrases-long")
        bits.unpersist()
        many = many.unionByName(longer)
    return many, totals


def collocations(docs: DataFrame, least: int = 100, max_n: int = 5, best: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``best`` phrases of each language.

    A phrase has 2 to ``max_n`` words of one piece and at least ``least`` occurrences ``a``, overlaps
    included. Of its cuts into two parts with ``l`` and ``r`` occurrences the one with the least
    floor(1000 a n / (l r)) counts, ``n`` being the language's words; of equal ones the first. A phrase
    inside a longer one of at least as many occurrences is left out; as counts only fall with more
    words, the extensions by one word tell. Order: score and ``a`` descending, phrase by its bytes.

    Null texts are empty, a null language is ``und``. Repeated rows count each. Texts of any length
    are taken whole, a few million characters of texts together. Other columns are ignored. An
    empty table gives no rows.
    """
    many, totals = frequent_ngrams(docs, least, max_n, text_col, lang_col)
    many = stage(many.select("lang", "phrase", "n", "f"), "phrases-frequent")
    found = many.where("n >= 2")
    part = lambda first, count: F.array_join(F.slice("w", first, count), " ")
    longer = found.where("n >= 3").withColumn("w", F.split("phrase", " "))
    inner = longer.select("lang", F.explode(F.array(part(F.lit(1), F.col("n") - 1), part(F.lit(2), F.col("n") - 1))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = found.join(inner, ["lang", "phrase"], "left").where("longest IS NULL OR longest < f").drop("longest")
    cuts = kept.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = stage(cuts.select("lang", "phrase", "f", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("n")).alias("right")), "phrases-cuts")
    for side, name in (("left", "l"), ("right", "r")):
        counts = many.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = looked_up(cuts, counts, ["lang", side], F.struct("phrase", "k"), "inner").drop(side)
        cuts = stage(cuts, "phrases-cuts") if side == "left" else cuts
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(F.broadcast(totals), "lang")  # a row for each language
    products = cuts.withColumns({"_up": F.lit(1000).cast("decimal(4,0)") * whole("f") * whole("total").cast("decimal(15,0)"), "_down": whole("l") * whole("r")})
    scored = products.withColumn("score", F.expr("_up div _down"))
    least_cut = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("f").alias("a"), F.first("total").alias("n"))
    rows = least_cut.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
    return top(rows, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
