"""Embedding near-duplicates by spherical-cap filters.

Method: a filter is a direction; a vector is in its cap if their inner product exceeds a
threshold. Directions form random product codes: after a random rotation the space is cut
into blocks, each block has its own random codewords, and each choice of one codeword per
block is a direction. A vector's caps are listed from the blocks' sorted scores, cutting off
every partial sum that the best rest cannot lift over the threshold, so the cost follows the
length of the list and not the number of directions. Vectors that share a cap (and a label)
are compared in double precision.

The number of directions grows with the largest label so that a vector meets about as many
others in its caps at any size. The threshold comes from the exact tail of an inner product
with a random direction, so that a random vector is in ``caps`` caps of a code on average, and
is lowered for a vector in fewer. Caps of one code are not independent of each other, so one
code misses more pairs the more directions it has; ``CODES`` codes with rotations of their own
are, and a pair is missed if all miss it. ``recall`` measures the share of pairs found; at the
linking cosine it stays above 0.99 from 1e4 to 1e9 vectors of a label (figures in the README).

Equal vectors are one from the start. A pair is counted in the least cap that it shares and
nowhere else, so counts need no list of pairs; links between components are a spanning
forest of each cap's group. A cap's group beyond ``GROUP`` rows is split into parts that
meet two by two in tasks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.graph import connected_components
from marlstone.session import ship
from marlstone.staging import Staged, stage

#: Rows of a part of a cap's group.
GROUP = 1000
#: Random vectors that a vector should meet in the caps of a code, codes, and a vector's caps in each.
MET, CODES, CAPS = 512, 4, 6
#: Codewords of a block, about; the fewest directions of a code.
WORDS, LEAST_DIRECTIONS = 4096, 512


def tail(dims: int, share: float) -> float:
    """The inner product that a unit vector has with ``share`` of all directions at least."""
    if dims < 2:
        return 0.0
    angle = np.linspace(0, math.pi, 400_001)
    inside = np.cumsum(np.sin(angle) ** (dims - 2))
    return math.cos(angle[np.searchsorted(inside, share * inside[-1])])


class Code:
    """A rotation, the blocks' codewords and the threshold, all from a seed."""

    def __init__(self, dims: int, largest: int, caps: float, seed: int):
        rng = np.random.default_rng(seed)
        wanted = max(float(LEAST_DIRECTIONS), largest * caps * caps / MET)
        self.blocks = min(dims, max(2, math.ceil(math.log(wanted) / math.log(WORDS)))) if dims > 1 else 1
        self.words = max(2, math.ceil(wanted ** (1 / self.blocks)))
        self.rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        self.cuts = np.linspace(0, dims, self.blocks + 1).astype(int)
        self.code = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            c = rng.standard_normal((self.words, b - a))
            self.code.append((c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt((b - a) / dims)).T)
        self.directions = self.words**self.blocks
        self.threshold = tail(dims, min(0.25, caps / self.directions))
        self.least, self.step = min(math.ceil(caps), self.directions), 0.1 / math.sqrt(dims)

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        y = x @ self.rotation
        return [y[:, a:b] @ c for (a, b), c in zip(zip(self.cuts[:-1], self.cuts[1:], strict=True), self.code, strict=True)]

    def caps(self, x: np.ndarray) -> list[np.ndarray]:
        """For each row the sorted numbers of its caps, ``least`` at least.

        A row in fewer caps than that lowers its own threshold until it has them.
        """
        scores = self.scores(x)
        orders = [np.argsort(-s, axis=1) for s in scores]
        ranked = [np.take_along_axis(s, o, 1) for s, o in zip(scores, orders, strict=True)]
        best = np.stack([r[:, 0] for r in ranked], 1)
        rest = np.cumsum(best[:, ::-1], 1)[:, ::-1] - best
        out = []
        for k in range(len(x)):
            threshold = self.threshold
            while len(found := self._listed(k, threshold, rest, ranked, orders)) < self.least:
                threshold -= self.step
            out.append(np.sort(found))
        return out

    def _listed(self, k: int, threshold: float, rest: np.ndarray, ranked: list, orders: list) -> np.ndarray:
        """Numbers of all caps of row ``k``, block by block; sums that the best rest cannot lift over the threshold end at once."""
        total, number = np.zeros(1), np.zeros(1, np.int64)
        for b, (r, o) in enumerate(zip(ranked, orders, strict=True)):
            n = np.searchsorted(-r[k], total + rest[k, b] - threshold, side="right")
            pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            total, number = np.repeat(total, n) + r[k][pick], np.repeat(number, n) * self.words + o[k][pick]
        return number


class Codes:
    """Codes with rotations of their own; caps are numbered through all of them."""

    def __init__(self, dims: int, largest: int, caps: float = CAPS, codes: int = CODES, seed: int = 17):
        self.each = [Code(dims, largest, caps, seed + k) for k in range(codes)]
        self.width = (codes * self.each[0].directions - 1).bit_length() // 8 + 1

    def caps(self, x: np.ndarray) -> list[np.ndarray]:
        """For each row the sorted numbers of its caps."""
        lists = [code.caps(x) for code in self.each]
        return [np.sort(np.concatenate([c * len(lists) + k for k, c in enumerate(own)])) for own in zip(*lists, strict=True)]

    def pack(self, caps: np.ndarray) -> bytes:
        return caps.astype("<i8").view("u1").reshape(-1, 8)[:, : self.width].tobytes()

    def unpack(self, data: bytes) -> np.ndarray:
        out = np.zeros((len(data) // self.width, 8), "u1")
        out[:, : self.width] = np.frombuffer(data, "u1").reshape(-1, self.width)
        return out.view("<i8").ravel()


def recall(dims: int, largest: int, cosine: float, pairs: int = 1000, caps: float = CAPS, codes: int = CODES, seed: int = 17) -> float:
    """Share of random pairs at a cosine that meet in a cap, for codes made for a label of ``largest`` vectors."""
    rng = np.random.default_rng(seed + 1000)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x, r = unit(rng.standard_normal((pairs, dims))), rng.standard_normal((pairs, dims))
    y = cosine * x + math.sqrt(1 - cosine * cosine) * unit(r - (r * x).sum(1, keepdims=True) * x)
    made = Codes(dims, largest, caps, codes, seed)
    return float(np.mean([len(np.intersect1d(a, b, assume_unique=True)) > 0 for a, b in zip(made.caps(x), made.caps(y), strict=True)]))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length; scaled first, so that squares neither overflow nor vanish."""
    rows = column.combine_chunks()
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _listed(sent):
    def run(batches):
        codes = sent.value
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                caps = codes.caps(_vectors(pa.chunked_array([batch.column("v")])))
                cols = {n: batch.column(n) for n in batch.schema.names} | {"caps": pa.array(caps, pa.list_(pa.int64())), "packed": pa.array(list(map(codes.pack, caps)), pa.binary())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def _compare(sent, least: float):
    """Counts and links of one pair of parts of a cap's group, of the pairs that share no lesser cap."""

    def run(table: pa.Table) -> pa.Table:
        cap, i, j = (table.column(k)[0].as_py() for k in ("cap", "i", "j"))
        x, part = _vectors(table.column("v")), table.column("part").to_numpy()
        weight = table.column("w").to_numpy().astype(float)
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        if i != j:
            near &= part[:, None] != part[None, :]
        rows = np.flatnonzero(near.any(1))
        out = []
        if len(rows):
            near = near[np.ix_(rows, rows)]
            names = table.column("cls").take(pa.array(rows)).to_pylist()
            lower = [c[c < cap] for c in map(sent.value.unpack, table.column("packed").take(pa.array(rows)).to_pylist())]
            both, n = np.unique(np.concatenate(lower), return_counts=True)
            both = both[n > 1]
            if len(both):
                held = np.zeros((len(rows), len(both)), np.float32)
                for k, c in enumerate(lower):
                    held[k, np.searchsorted(both, c[np.isin(c, both)])] = 1
                near &= held @ held.T == 0
            links = near @ weight[rows]
            label = np.arange(len(rows))
            while True:
                after = np.minimum(label, np.where(near, label[None, :], len(rows)).min(1))
                after = after[after]
                if (after == label).all():
                    break
                label = after
            out = [(names[k], names[label[k]], int(links[k])) for k in np.flatnonzero(links)]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.int64())], names=["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, caps: float = CAPS, codes: int = CODES, seed: int = 17, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Vectors are compared if their labels are equal and not null and their lengths are the
    same. Null, empty and zero vectors and those with a null or non-finite component link
    with nothing. Repeated rows link with each other. A null id counts as a vector; a
    component's id is its least id that is not null. Vectors may be of any length and size of
    numbers; other columns are ignored, whatever their names. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "array<float>" if "float" in dict(vectors.dtypes)[vector_col] else "array<double>"
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast(kind).alias("v"), vectors[label_col].alias("label"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    wide = F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(k), "label", "v")), 16, "0") for k in (1, 2))))
    rows = rows.withColumn("cls", F.when(F.col("label").isNotNull() & F.coalesce(good, F.lit(False)), wide))
    keys = Staged(rows.select("vec_id", "cls"), "op4-keys")
    classes = Staged(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("w"), F.min("vec_id").alias("first"), F.min("label").alias("label"), F.first("v").alias("v")), "op4-classes")
    sizes = classes.df.groupBy(F.size("v").alias("d"), "label").agg(F.count("*").alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()  # a row for each length of vector
    links = None
    for d, largest in sizes:
        made = spark.sparkContext.broadcast(Codes(d, largest, caps, codes, seed))
        some = classes.df.where(F.size("v") == d).select("cls", "w", "label", "v")
        schema = f"cls binary, w long, label {dict(some.dtypes)['label']}, v {kind}, caps array<long>, packed binary"
        posts = Staged(some.mapInArrow(_listed(made), schema), "op4-caps")
        each = posts.df.select("label", F.explode("caps").alias("cap"), "cls", "w", "v", "packed")
        met = posts.df.select("label", F.explode("caps").alias("cap")).groupBy("label", "cap").agg(F.count("*").alias("n")).where("n > 1")
        each = each.join(met.withColumn("parts", F.ceil(F.col("n") / GROUP).cast("int")), ["label", "cap"])
        each = each.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
        each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        each = each.select("label", "cap", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cls", "w", "v", "packed")
        found = Staged(each.groupBy("label", "cap", "i", "j").applyInArrow(_compare(made, least), "a binary, b binary, n long"), "op4-links")
        posts.drop()
        links = found.df if links is None else links.unionByName(found.df)
    out = keys.df
    if links is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counts = links.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    comps = connected_components(links, "a", "b", stored=True).select(F.col("node").alias("cls"), "component")
    known = stage(classes.df.select("cls", "w", "first").join(counts, "cls", "left").join(comps, "cls", "left").select("cls", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component"), "first"), "op4-known")
    least_id = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(least_id, "component").select("cls", "n_links", "component_id")
    out = out.join(known, "cls", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
