"""Connected components of an edge table: local contraction, then large-star and small-star steps.

Each task turns the edges it holds into a star for each component among them, which leaves at
most a row for each node. Tables whose edges fit one task of bounded size are done with that;
larger ones alternate star steps over all tasks, with a contraction after each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.skew import looked_up
from marlstone.session import ship
from marlstone.staging import Staged

MAX_ROUNDS = 60
#: Edges that one task contracts at a time.
LOCAL_EDGES = 400_000
#: Types whose order is the same in Arrow.
_PLAIN = ("tinyint", "smallint", "int", "bigint", "string", "binary", "date")


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number that each of ``n`` nodes reaches over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def _stars(edges: pa.Table) -> pa.Table:
    """The edges (u, v) as stars: each node with the least of its component, the least left out."""
    both = pa.concat_arrays([x for k in ("u", "v") for x in edges.column(k).chunks]).dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[both.indices.to_numpy()]
    label = _labels(codes[: edges.num_rows], codes[edges.num_rows :], len(order))
    nodes = np.flatnonzero(label != np.arange(len(order)))
    return pa.table([both.dictionary.take(pa.array(order[x])) for x in (nodes, label[nodes])], schema=edges.schema)


def _contracted(limit: int):
    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                rows += batch.num_rows
            if rows > 2 * limit:
                held = [_stars(pa.concat_tables(held))]
                rows = held[0].num_rows
                if rows > limit:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
        if rows:
            yield from _stars(pa.concat_tables(held)).to_batches(max_chunksize=50_000)

    return run


def large_star(edges: DataFrame) -> DataFrame:
    """Each greater neighbour of a node, linked with the least of the node and its neighbours. A node with a share of all edges is dealt over tasks."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return looked_up(both, least, ["u"], F.col("v"), "inner").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, linked with the least of these; edges lead from the greater node ``u``."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = looked_up(edges, low, ["u"], F.col("v"), "inner").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, src: str, dst: str, stored: bool = False, limit: int = LOCAL_EDGES) -> DataFrame:
    """``(node, component)`` for each node of at least one edge; component is the least node.

    Nodes may have any type that orders; only whole numbers, strings, bytes and dates are
    contracted. Null ends and loops are left out. ``stored`` says that the edges are a table
    that is cheap to read twice. A round of star steps is two groupings with map-side minima
    and two lookups of the nodes' minima, in which a hub's edges are dealt over tasks; its edge tables are
    staged, so lineage stays short, and they never grow beyond the number of edges.
    """
    a, b = F.col(src), F.col(dst)
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    local = pairs.dtypes[0][1] in _PLAIN
    ship(edges.sparkSession)

    def contracted(df: DataFrame, parts: int | None = None) -> DataFrame:
        df = df if parts is None else df.coalesce(parts)
        return df.mapInArrow(_contracted(limit), pairs.schema) if local else df.distinct()

    parts = lambda n: max(1, -(-n // limit))
    at, held = None, pairs
    if not (stored and local):
        at = Staged(contracted(pairs), "cc")
        held = at.df
    n = held.count()
    if n and local:
        after = Staged(contracted(held, parts(n)), "cc")
        if at is not None:
            at.drop()
        at, held = after, after.df
    elif at is None:
        at = Staged(pairs.limit(0), "cc")
        held = at.df
    if n and not (local and parts(n) == 1):
        mark = _mark(held)
        for _ in range(MAX_ROUNDS):
            large = Staged(large_star(at.df).distinct(), "cc")
            after = Staged(small_star(large.df).distinct(), "cc")
            at.drop()
            large.drop()
            at, before, mark = after, mark, _mark(after.df)
            if mark == before:
                break
        else:
            raise RuntimeError("connected components did not settle")
    stars = at.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
