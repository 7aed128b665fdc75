"""Token ids in files: fixed-width bit packing in blocks with offsets.

Format: a Parquet data set whose rows are blocks, in ascending order of the document id.

    part int, block int          place in the file; ascending (part, block) is the order of documents
    local_start long             ids in the part before this block
    bits int, n_tokens long      width of an id, the fewest bits that hold the vocabulary; ids in the block
    docs array<long>, lens array<int>   documents of the block and their numbers of ids
    payload binary               ids, little-endian bit by bit, id i at bit ``i * bits``

A block unpacks with numpy at once, or from any id on without the ids before it. The table
``parts`` beside it holds ``(part, start)``: all ids before a part.

Each page of a file has a checksum, and a read that meets a page of another content fails. Each task of the sorted documents packs its own blocks and Spark's committer puts its file in
place, so a lost executor costs a task. A document is never cut: one longer than a block is a
block of its own.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import words as W
from marlstone.session import ship
from marlstone.staging import PLAIN, new_path

BLOCK_TOKENS = 65_536
END_ID = 1
#: Bytes of token files that a task reads back; their rows are few bytes, so smaller tasks only make more files.
TASK_BYTES = 64 << 20
#: Chunks of text whose ids a worker remembers, twice.
MEMO_CHUNKS = 300_000

#: Pages carry a checksum of their own, which readers of the format verify, on whatever store the files are.
SUMMED, VERIFIED = {"parquet.page.write-checksum.enabled": "true"}, {"parquet.page.verify-checksum.enabled": "true"}

_DATA = "part int, block int, local_start long, bits int, n_tokens long, docs array<long>, lens array<int>, payload binary"


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype("u1").ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, count: int, first: int = 0) -> np.ndarray:
    """``count`` ids from place ``first`` on."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, first * bits // 8).astype("<u4")
    low = first * bits // 8
    raw = np.unpackbits(np.frombuffer(data, "u1")[low : ((first + count) * bits + 7) // 8], bitorder="little")
    skip = first * bits - 8 * low
    return (raw[skip : skip + count * bits].reshape(count, bits).astype("<u4") << np.arange(bits, dtype="<u4")).sum(1, dtype="<u4")


def resolve(tokenizer: str) -> str:
    """A path, or the name of a file of ``public_tokenizers``."""
    if os.path.isabs(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def _rows(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of rows one after the other, and how many each has."""
    return np.frombuffer(b"".join(rows), "<u4"), np.fromiter(map(len, rows), np.int64, len(rows)) // 4


def _gathered(ids: np.ndarray, lens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows one after the other those at the places ``at``, and where each begins and the last ends."""
    each = lens[at]
    ends = np.r_[0, np.cumsum(each)]
    first = (np.cumsum(lens) - lens)[at] - ends[:-1]
    places = np.repeat(first, each)
    places += np.arange(ends[-1])
    return ids[places], ends


class Encoder:
    """Ids of whole texts by a file of the tokenizers library, special tokens not added.

    Where the file's pre-tokenizer keeps only matches that hold no white space, and a
    word's last piece is marked, a text's ids are those of its chunks between blanks one
    after the other. Then distinct chunks alone are encoded, words many at a time, and the ids of
    chunks that are no word of ASCII letters are remembered. Other files encode text by text.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        path = resolve(tokenizer)
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        suffix = spec["model"].get("end_of_word_suffix")
        matched = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "[^\\s" in first.get("pattern", {}).get("Regex", "")
        self.chunked = bool(matched and suffix)
        norms = (spec.get("normalizer") or {}).get("normalizers") or []
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.small = any(n.get("type") == "Lowercase" for n in norms) and all(t.startswith("<|") for t in added)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bits = max(1, (max(self.size - 1, END_ID)).bit_length())
        self.ends = np.zeros(self.size, bool)
        #: Marks that end a word of letters and, in a row, are one piece of their own.
        self.marks = ""
        #: For ASCII words in lower case: the same model, without patterns and normal forms that leave them as they are.
        self.plain: Tokenizer | None = None
        if self.chunked:
            for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.ends[i] = piece.endswith(suffix)
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.marks = "".join(m for m in string.punctuation if cut(f"ab{m}{m}") == [("ab", (0, 2)), (m + m, (2, 4))])
            low, every = string.ascii_lowercase, string.ascii_lowercase + string.ascii_uppercase + string.ascii_lowercase
            if self.small and cut(every) == [(every, (0, len(every)))] and self.tokenizer.normalizer.normalize_str(every) == low * 3:
                self.plain = Tokenizer(self.tokenizer.model)
                self.plain.pre_tokenizer = WhitespaceSplit()
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        #: Letters whose normal form is letters to the file too, and the others that were met.
        self.letters: set[str] = set()
        self.others: set[str] = set()

    def _is_letter(self, char: str) -> bool:
        norm = self.tokenizer.normalizer.normalize_str(char) if self.tokenizer.normalizer else char
        pieces = [(f"a{c}a.", self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}a.")) for c in norm]
        return all(len(p) == 2 and p[1][1] == (len(t) - 1, len(t)) for t, p in pieces)

    def _stable(self, core: str) -> bool:
        """Whether a word's normal form is letters alone, as it is if each letter's is: some become a letter and a mark, which joins the punctuation after it."""
        if core.isascii() or self.letters.issuperset(core):
            return True
        for c in set(core) - self.letters - self.others:
            (self.letters if self._is_letter(c) else self.others).add(c)
        return self.letters.issuperset(core)

    def _raw(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, tokenizer: Tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, and how many each has: encoded as texts of many words and cut at the marked ends."""
        out, lens = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        parts = [words[k : k + 500] for k in range(0, len(words), 500)]
        for part in parts:
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            sizes = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
            if len(sizes) != len(part) or sizes.sum() != len(ids):
                ids, sizes = _rows(self._raw(part))
            out.append(ids)
            lens.append(sizes)
        return np.concatenate(out), np.concatenate(lens)

    def _words(self, words: list[str]) -> list[bytes]:
        ids, lens = self._joined(self.tokenizer, words)
        data, at = ids.tobytes(), (4 * np.cumsum(lens)).tolist()
        return [data[a:b] for a, b in zip([0, *at], at, strict=False)]

    def _learn(self, chunks: list[str]) -> None:
        young, old = self.young, self.old
        if len(young) > MEMO_CHUNKS:
            self.old = old = young
            self.young = young = {"": b""}
        cores: dict[str, None] = {}
        tails: list[tuple[str, str, str]] = []
        whole: list[str] = []
        for c in chunks:
            if c in young:
                continue
            if (known := old.get(c)) is not None:
                young[c] = known
                continue
            core = c.rstrip(self.marks)
            if core.isalpha() and self._stable(core):
                if core is not c:
                    tails.append((c, core, c[len(core) :]))
                if core not in young:
                    cores[core] = None
            else:
                whole.append(c)
        young.update(zip(cores, self._words(list(cores)), strict=True))
        marks = [t for t in {t for _, _, t in tails} if t not in young]
        young.update(zip(marks, self._raw(marks), strict=True))
        for c, core, tail in tails:
            young[c] = young[core] + young[tail]
        young.update(zip(whole, self._raw(whole), strict=True))

    def _spaced(self, text: str) -> str:
        """A text with blanks alone between chunks; capitals that the file makes small anyway are so at once, for fewer chunks."""
        if self.small and text.isascii() and "<|" not in text:
            text = text.lower()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")

    def _known(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self._learn(chunks)
        return _rows([self.young[c] for c in chunks])

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks one after the other, and how many each has.

        Most distinct words are rare: those of ASCII letters are encoded again for each slice, which
        takes less than a memo of them.
        """
        if self.plain is None:
            return self._known(chunks.to_pylist())
        words = pc.ascii_rtrim(chunks, characters=self.marks)
        plain = pc.ascii_is_alpha(words)
        cores = pc.ascii_lower(words.filter(plain)).dictionary_encode()
        tails = pc.ascii_ltrim(chunks.filter(plain), characters=string.ascii_letters).dictionary_encode()
        others = chunks.filter(pc.invert(plain)).to_pylist()
        sets = self._joined(self.plain, cores.dictionary.to_pylist()), self._known(tails.dictionary.to_pylist()), self._known(others), _rows([b""])
        starts = np.cumsum([0, *(len(lens) for _, lens in sets)])
        at, mask = np.empty((len(chunks), 2), np.int64), plain.to_numpy(zero_copy_only=False)
        at[mask, 0], at[mask, 1] = cores.indices.to_numpy(), starts[1] + tails.indices.to_numpy()
        at[~mask, 0], at[~mask, 1] = starts[2] + np.arange(len(others)), starts[3]
        ids, ends = _gathered(*map(np.concatenate, zip(*sets, strict=True)), at.ravel())
        return ids, np.diff(ends[::2])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.chunked:
            return [np.frombuffer(b, "<u4") for b in self._raw([t or "" for t in texts])]
        if not texts:
            return []
        parts = pc.split_pattern(pa.array([self._spaced(t or "") for t in texts], pa.large_string()), " ")
        coded = parts.flatten().dictionary_encode()
        ids, ends = _gathered(*self._chunks(coded.dictionary), coded.indices.to_numpy())
        cuts = ends[parts.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_encoders: dict[str, Encoder] = {}
W.memos.append(_encoders)


def encoder(tokenizer: str) -> Encoder:
    """One for each worker process and file, until a task of another operator releases it."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    return _encoders[tokenizer]


#: Characters of text that are encoded at a time.
SLICE_CHARS = 4_000_000


def slices(batch: pa.RecordBatch, column: str = "text"):
    """(first row, texts) of a batch, by parts of bounded length."""
    first, part, chars = 0, [], 0
    rows = batch.column(column).to_pylist()
    for k, t in enumerate(rows):
        part.append(t)
        chars += len(t or "")
        if chars >= SLICE_CHARS or k == len(rows) - 1:
            yield first, part
            first, part, chars = k + 1, [], 0


def _blocks(tokenizer: str, end_id: int):
    def run(batches):
        enc = encoder(tokenizer)
        part, block, start, held = TaskContext.get().partitionId(), 0, 0, []
        tail = np.array([end_id], "<u4")

        def made():
            ids = np.concatenate([x for _, x in held])
            cols = [pa.array([v], t) for v, t in ((part, pa.int32()), (block, pa.int32()), (start, pa.int64()), (enc.bits, pa.int32()), (len(ids), pa.int64()), ([d for d, _ in held], pa.list_(pa.int64())), ([len(x) for _, x in held], pa.list_(pa.int32())), (pack_bits(ids, enc.bits), pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, ["part", "block", "local_start", "bits", "n_tokens", "docs", "lens", "payload"]), len(ids)

        size = 0
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for first, texts in slices(batch):
                for doc, ids in zip(ids_of[first:], enc.encode(texts), strict=False):
                    held.append((doc, np.concatenate([ids, tail])))
                    size += len(ids) + 1
                    if size >= BLOCK_TOKENS:
                        out, n = made()
                        yield out
                        block, start, held, size = block + 1, start + n, [], 0
        if held:
            yield made()[0]
        W.trim()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each text, append ``end_id`` and write the data set at ``path``, by ascending id.

    A null text counts as an empty one. Null ids come first. Rows that share an id stay next
    to each other, by a hash of their text; rows that are equal are each written. Other
    columns are ignored. An empty table gives a data set without blocks.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(_blocks(tokenizer, end_id), _DATA).write.options(**PLAIN | SUMMED).parquet(f"{path}/data")
    totals = spark.read.schema(_DATA).parquet(f"{path}/data").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each task of the sort, whatever the number of documents.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("start")).coalesce(1).write.options(**PLAIN | SUMMED).parquet(f"{path}/parts")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``: all ids of the data set before the block."""
    parts = spark.read.options(**VERIFIED).schema("part int, start long").parquet(f"{path}/parts")
    data = spark.read.options(**VERIFIED).schema(_DATA).parquet(f"{path}/data")
    return data.join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("local_start"))


def read_ids(spark: SparkSession, path: str, first: int, count: int) -> np.ndarray:
    """Ids ``first`` to ``first + count`` of the data set; only their blocks are read."""
    got = read_blocks(spark, path).where((F.col("start") < first + count) & (F.col("start") + F.col("n_tokens") > first)).orderBy("start").select("start", "n_tokens", "bits", "payload").collect()
    out = []
    for start, n, bits, payload in got:
        low, high = max(first - start, 0), min(first + count - start, n)
        out.append(unpack_bits(bytes(payload), bits, high - low, low))
    return np.concatenate(out) if out else np.empty(0, "<u4")


def _digest(batches):
    for batch in batches:
        docs, starts, sizes, sums = [], [], [], []
        for start, n, bits, ids_of, lens, payload in zip(*(batch.column(k).to_pylist() for k in ("start", "n_tokens", "bits", "docs", "lens", "payload")), strict=True):
            ids, at = unpack_bits(payload, bits, n), 0
            for doc, m in zip(ids_of, lens, strict=True):
                docs.append(doc)
                starts.append(start + at)
                sizes.append(m)
                sums.append(zlib.crc32(ids[at : at + m].tobytes()))
                at += m
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (docs, starts, sizes, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """From the files: ``doc_id, start, n_tokens, ids_crc32`` of each document."""
    ship(spark)
    blocks = read_blocks(spark, path).select("start", "n_tokens", "bits", "docs", "lens", "payload")
    size = int(spark.read.schema(_DATA).parquet(f"{path}/data")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    blocks = blocks.coalesce(max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    return blocks.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", path: str | None = None) -> DataFrame:
    """Write ``docs`` in the format at ``path`` (default: the shared folder) and digest what the files hold."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return digest(spark, path)
