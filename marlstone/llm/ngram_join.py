"""N-gram Jaccard join: documents linked when their sets of 5-word shingles are alike.

Method: tokens (shingles) are put in one order, rarest first, by their counts over all
documents. A text of n tokens that is to share 80 % of the union with another must share at
least ``ceil(0.8 n)`` of its own, so one of its first ``n - ceil(0.8 n) + 1`` tokens is
shared. Tokens that one document alone holds come first: a text whose prefix is made of them
has no partner and is done. The prefixes of the rest are joined on their tokens, with the
length filter, the positional filter and the suffix filter; each pair is then verified once.

The result needs components, so pairs inside a component that is known already are not
needed. First each token's texts meet the one among them with the fewest tokens of its own,
which of a family of near copies is the original or close to it. Then only tokens whose texts
are in more than one component are looked at, where the largest component of a token stands
on one side only: their texts meet in blocks of bounded size, in which all filters run, and
only pairs that pass leave a block. No link between different components is lost, and no
list of the pairs of a token is made.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import blocks as B
from marlstone.llm import words as W
from marlstone.llm.whole_rows import packed
from marlstone.operators.graph import connected_components
from marlstone.session import ship
from marlstone.staging import Staged, stage

#: Tokens for counting, joining and verifying are cut to so many bits; sizes of sets come from 64 bits.
TOKEN_BITS = 56
#: Bytes of the tag that a row may carry through.
TAG = 16
#: Parts of the token space whose counts bound what two texts can share.
SUFFIX_PARTS = 256
#: Texts of one side of a block, pairs that are filtered and rows that are verified at a time.
SIDE, CHUNK, SLICE = 2000, 1 << 17, 256
#: Bytes of texts, and prefix tokens, for which a file of an intermediate table is written.
FILE_BYTES, FILE_POSTS = 32 << 20, 100_000

_DONE = "doc_id long, n long, fp binary, tag binary, uniq long, prefix array<long>, tokens binary, parts binary"

#: What a byte of ``parts`` stands for: counts to 128, then steps of a sixteenth of an octave, rounded up; the last has no bound.
_FINE = np.r_[np.arange(129), np.ceil(128 * 2 ** (np.arange(1, 127) / 16)), 1 << 40].astype(np.int64)


def coarse(counts: np.ndarray) -> bytes:
    """Counts as bytes that stand for no less."""
    return np.searchsorted(_FINE, counts).astype("u1").tobytes()


def shared_at_most(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By row of two matrices of ``parts``: what two texts can share, as no part holds more in common than the text with fewer tokens there."""
    low = np.minimum(x, y)
    return low.sum(1, dtype=np.int64) if not low.size or low.max() <= 128 else _FINE[low].sum(1)


def _sent(at: B.Layout, words: int):
    cut = np.uint64(((1 << TOKEN_BITS) - 1) << (64 - TOKEN_BITS))

    def info(block: B.Block):
        rows, lists = block.rows()
        ids = [x[0] for x in block.info]
        home = xxhash.xxh3_64_intdigest(block.blk) % at.ranges
        rows.append((home, block.blk, 0, lists))
        known = np.array([x is not None for x in ids], np.uint64)
        head = B.pack(known, np.array([x or 0 for x in ids], np.int64).view(np.uint64), np.array([x[1] for x in block.info], np.uint64))
        rows.append((home, block.blk, 2, head + b"".join(x[2] + x[3] for x in block.info)))
        return B.batch(rows)

    def run(batches):
        block, made = B.Block(at, 0), 0
        for batch in batches:
            tags = batch.column(2).to_pylist() if batch.num_columns > 2 else [b""] * batch.num_rows
            for doc, text, tag in zip(batch.column(0).to_pylist(), W.texts(batch.column(1)), tags, strict=True):
                full = W.shingles(W.split(text), words)
                block.add(np.unique(full & cut), None, (doc, len(full), xxhash.xxh3_128_digest(full.tobytes()), tag))
                if block.full:
                    yield info(block)
                    made += 1
                    block = B.Block(at, made)
        if block.info:
            yield info(block)
        del block
        W.release()

    return run


def _answer(table: pa.Table) -> pa.Table:
    """One range: to each block the keys that more than one document holds, with how many do."""
    kinds, blks = (table.column(k).to_pylist() for k in ("kind", "blk"))
    payload = lambda i: table.column("payload")[i].as_py()
    sent = [i for i, k in enumerate(kinds) if k == 1]
    out = [(table.column("bucket")[i].as_py(), blks[i], kinds[i], payload(i)) for i in range(len(kinds)) if kinds[i] != 1]
    r = B.Range(map(payload, sent))
    bucket = table.column("bucket")[0].as_py()
    for i, (at, docs, _, many) in zip(sent, r.each(), strict=True):
        shared = r.documents[at] > 1
        out.append((bucket, blks[i], 1, B.pack(B.deltas(r.keys[at[shared]]), docs[shared], r.documents[at[shared]], B.deltas(r.keys[many]), r.documents[many])))
    found = pa.Table.from_batches([B.batch(out)])
    del r, out
    W.release()
    return found


def _prefixes(num: int, den: int, tagged: bool):
    width = 16 + TAG * tagged

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("payload").to_pylist(), strict=True))
        holders, m_docs, _ = B.unpack(next(p for k, _, p in rows if k == 0))
        head = next(p for k, _, p in rows if k == 2)
        count = int.from_bytes(head[:4], "little")
        fps = head[-width * count :]
        known, ids, sizes = B.unpack(head[: len(head) - width * count])
        got = [B.unpack(p) for k, _, p in rows if k == 1]
        cat = lambda xs: np.concatenate([*xs, np.empty(0, np.uint64)]).astype(np.uint64)
        keys = cat([*(B.sums(g[0]) for g in got), np.repeat(cat(B.sums(g[3]) for g in got), holders.astype(int))])
        docs = cat([*(g[1] for g in got), m_docs]).astype(np.int64)
        held = cat([*(g[2] for g in got), np.repeat(cat(g[4] for g in got), holders.astype(int))])
        order = np.lexsort((keys, held, docs))
        keys, docs = keys[order], docs[order]
        at = np.searchsorted(docs, np.arange(count + 1))
        out = []
        for d in range(count):
            n, own = int(sizes[d]), keys[at[d] : at[d + 1]]
            uniq = n - len(own)
            wanted = n - (num * n + den - 1) // den + 1 - uniq
            alive = n > 0 and wanted > 0 and len(own) > 0
            parts = coarse(np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=SUFFIX_PARTS)) if alive else None
            out.append((int(ids[d].view(np.int64)) if known[d] else None, n, fps[width * d : width * d + 16], fps[width * d + 16 : width * (d + 1)] if tagged else None, uniq, own[:wanted].view(np.int64).tolist() if alive else None, B.pack(B.deltas(np.sort(own))) if alive else None, parts))
        del keys, docs, held, order, got, own
        W.release()
        cols = list(zip(*out, strict=True))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n", "fp", "tag", "uniq", "prefix", "tokens", "parts"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(-1, SUFFIX_PARTS)


def _verify(num: int, den: int):
    """Whether pairs of texts are alike; the suffix filter spares most others the comparison."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
                bound = shared_at_most(*(_matrix(batch.column(c)) for c in ("pa", "pb")))
                good = den * bound >= num * (na + nb - bound)
                for i in np.flatnonzero(good):
                    x, y = (B.sums(B.unpack(batch.column(c)[int(i)].as_py())[0]) for c in ("ta", "tb"))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[i] = den * both >= num * (na[i] + nb[i] - both)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good)], ["a", "b", "linked"])

    return run


def _meet(num: int, den: int):
    """Pairs of blocks, rows sorted by (tok, i, j): across part i and part j, or within part i if they are the same."""

    def pairs(t: pa.Table):
        col = lambda k: t.column(k).to_numpy()
        tok, i, j, part, n, p = (col(k) for k in ("tok", "i", "j", "part", "n", "p"))
        block = np.cumsum(np.r_[0, (tok[1:] != tok[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        order = np.lexsort((part, block))
        t, block, same, first, n, p = t.take(order), block[order], (i == j)[order], (part == i)[order], n[order], p[order]
        fp, c = (t.column(k).combine_chunks().dictionary_encode() for k in ("fp", "c"))
        names = fp.dictionary
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        fp, c, parts = fp.indices.to_numpy(), c.indices.to_numpy(), _matrix(t.column("parts"))
        ends = np.searchsorted(block, block, side="right")
        middle = np.searchsorted(block * 2 + ~first, block * 2 + 1)
        start = np.where(same, np.arange(len(block)) + 1, middle)
        many = np.where(first, ends - start, 0)
        before = np.cumsum(many) - many
        seen: set[int] = set()
        for at in range(0, int(many.sum()), CHUNK):
            k = np.arange(at, min(at + CHUNK, int(many.sum())))
            x = np.searchsorted(before, k, side="right") - 1
            y = start[x] + k - before[x]
            bound = np.minimum(n[x] - p[x], n[y] - p[y])
            near = (c[x] != c[y]) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])) & ((den + num) * bound >= num * (n[x] + n[y]))
            x, y = x[near], y[near]
            for z in range(0, len(x), 1 << 14):
                a, b = x[z : z + (1 << 14)], y[z : z + (1 << 14)]
                bound = shared_at_most(parts[a], parts[b])
                good = (den + num) * bound >= num * (n[a] + n[b])
                a, b = fp[a[good]], fp[b[good]]
                swap = rank[a] > rank[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                new = np.array([v for v in np.unique(a.astype(np.int64) << 32 | b) if v not in seen], np.int64)
                if len(seen) < 1_000_000:
                    seen.update(new.tolist())
                if len(new):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(new >> 32)), names.take(pa.array(new & 0xFFFFFFFF))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 2 * SIDE:
                continue
            keys = [held.column(k).to_numpy() for k in ("tok", "i", "j")]
            last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
            if len(last):
                yield from pairs(held.slice(0, int(last[-1]) + 1))
                held = held.slice(int(last[-1]) + 1)
        if held is not None and held.num_rows:
            yield from pairs(held)

    return run


def _links(texts: DataFrame, posts: int, num: int, den: int) -> DataFrame:
    """(node, component): components of ``texts`` (fp, n, uniq, prefix, tokens, parts), which have so many posts; a text without links is left out."""
    ship(texts.sparkSession)
    files = max(1, -(-posts // FILE_POSTS))
    least, most = F.least("xn", "yn"), F.greatest("xn", "yn")
    bound = F.least(F.col("xn") - F.col("xp"), F.col("yn") - F.col("yp"))
    near = (den * least >= num * most) & ((den + num) * bound >= num * (F.col("xn") + F.col("yn")))

    def verified(found: DataFrame) -> DataFrame:
        side = lambda k: texts.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("parts").alias(f"p{k}"), F.col("tokens").alias(f"t{k}"))
        checked = found.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb", "ta", "tb")
        return stage(checked.coalesce(files).mapInArrow(_verify(num, den), "a binary, b binary, linked boolean"), "op2-tested")

    p = texts.select("fp", "n", "uniq", F.posexplode("prefix").alias("k", "tok")).select("tok", "fp", "n", "uniq", (F.col("uniq") + F.col("k")).alias("p"))
    central = F.min(F.struct((F.col("uniq") / F.col("n")).alias("own"), F.xxhash64("fp").alias("r"), "fp", "n", "p")).alias("l")
    lead = p.groupBy("tok").agg(central, F.count("*").alias("c")).where("c > 1").select("tok", F.col("l.fp").alias("yfp"), F.col("l.n").alias("yn"), F.col("l.p").alias("yp"))
    star = p.select("tok", *(F.col(k).alias(f"x{k}") for k in ("fp", "n", "p"))).join(lead, "tok").where(near & (F.col("xfp") != F.col("yfp")))
    tested = verified(star.select(F.least("xfp", "yfp").alias("a"), F.greatest("xfp", "yfp").alias("b")).distinct())
    comp = stage(connected_components(tested.where("linked"), "a", "b", stored=True).coalesce(files), "op2-comp")

    of = texts.select("fp", "n", "uniq", "prefix").join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left")
    p = of.select("fp", "n", "uniq", F.coalesce("component", "fp").alias("c"), F.posexplode("prefix").alias("k", "tok")).select("tok", "fp", "n", "c", (F.col("uniq") + F.col("k")).alias("p"))
    sizes = p.groupBy("tok", "c").agg(F.count("*").alias("k")).groupBy("tok").agg(F.count("*").alias("comps"), F.max_by("c", "k").alias("top"), F.max("k").alias("tops"), F.sum("k").alias("all"))
    parts = lambda n: F.ceil(n / F.lit(SIDE)).cast("int")
    sizes = sizes.where("comps > 1").select("tok", "top", parts(F.col("all") - F.col("tops")).alias("lp"), parts(F.col("tops")).alias("rp"))
    top = F.col("c") == F.col("top")
    own = F.when(top, F.col("lp") + F.pmod(F.xxhash64("fp"), F.col("rp"))).otherwise(F.pmod(F.xxhash64("fp"), F.col("lp"))).cast("int")
    to = F.explode(F.sequence(F.lit(0), F.when(top, F.col("lp") - 1).otherwise(F.col("lp") + F.col("rp") - 1)))
    met = p.join(sizes, "tok").withColumn("part", own).join(texts.select("fp", "parts"), "fp").withColumn("to", to)
    met = met.select("tok", F.least("part", "to").alias("i"), F.greatest("part", "to").alias("j"), "part", "fp", "c", "n", "p", "parts")
    found = met.repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j").mapInArrow(_meet(num, den), "a binary, b binary").distinct()
    more = verified(found.join(tested.select("a", "b"), ["a", "b"], "left_anti")).where("linked").select("a", "b")
    return stage(connected_components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b", stored=True).coalesce(files), "op2-comp")


def _components(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, tag, c) of each row (doc_id, text, and a tag of ``TAG`` bytes if there is one); texts of equal c are linked if n > 0."""
    ship(docs.sparkSession)
    entries = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    at = B.layout(entries // 6)
    answers = B.by_range(docs.mapInArrow(_sent(at, words), B.SCHEMA), at.ranges, _answer, B.SCHEMA)
    found = stage(answers.groupBy("blk").applyInArrow(_prefixes(num, den, "tag" in docs.columns), _DONE), "op2-docs")
    alive = found.where("prefix IS NOT NULL")
    posts, size = alive.agg(F.sum(F.size("prefix")), F.sum(F.length("tokens") + 8 * F.size("prefix") + SUFFIX_PARTS)).first()
    texts = Staged(alive.select("fp", "n", "uniq", "prefix", "tokens", "parts").dropDuplicates(["fp"]).coalesce(max(1, -(-(size or 0) // FILE_BYTES))), "op2-texts")
    comps = _links(texts.df, posts or 0, num, den)
    texts.drop()
    return found.select("doc_id", "n", "tag", "fp").join(comps.select(F.col("node").alias("fp"), "component"), "fp", "left").select("doc_id", "n", "tag", F.coalesce("component", "fp").alias("c"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row for each row of ``docs``.

    Texts are split into words at ASCII white space after A-Z became lower case. A null,
    empty or blank text has no shingles and is linked with nothing; a text of fewer words
    than a shingle has its whole sequence as one. Equal sets are one text from the start, so
    repeated rows and copies cost no pairs. Null ids are carried along; a component's id is
    its least id that is not null, and null if there is none. Columns besides the two are
    ignored, whatever their names. An empty table gives an empty result.
    """
    keyed = _components(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), words, num, den)
    least = keyed.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"))
    return keyed.join(least, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` with one row of each component, whole and with all columns.

    The row with the least id stays, null ids last, then by a digest of the text. Ids need
    not be unique: rows are told apart by id and text, so rows that share an id or have none
    and are not linked all stay. A text without shingles is linked with nothing; of such
    rows only those that repeat an id and a text go.
    """
    digest = F.coalesce(F.unhex(F.md5(docs[text_col].cast("string").cast("binary"))), F.lit(bytes(TAG)))
    # Of one component the digests of 128 bits tell apart the texts of one id.
    keyed = _components(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), digest.alias("tag")), words, num, den)
    rows = keyed.groupBy(F.when(F.col("n") > 0, F.col("c")).alias("c"), "doc_id", "tag").agg(F.count("*").alias("k"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag", "k")).alias("r")
    linked = rows.where("c IS NOT NULL").groupBy("c").agg(first).select("r.doc_id", "r.tag", (F.col("r.k") > 1).alias("again"))
    alone = rows.where("c IS NULL").select("doc_id", "tag", F.expr("k > 1 AND doc_id IS NOT NULL").alias("again"))
    kept = stage(linked.unionByName(alone).select(F.col("doc_id").alias("kept_id"), F.col("tag").alias("kept_tag"), "again"), "op2-kept")
    full = docs.select(packed(docs), docs[id_col].cast("long").alias("id"), digest.alias("tag"))  # no name of the table can clash
    same = full["id"].eqNullSafe(kept["kept_id"]) & (full["tag"] == kept["kept_tag"])
    if kept.where("again").isEmpty():
        return full.join(kept, same, "left_semi").select("row.*")
    found = full.join(kept, same)
    once = found.where("again").dropDuplicates(["kept_id", "kept_tag"])
    return found.where("NOT again").select("row").unionByName(once.select("row")).select("row.*")
