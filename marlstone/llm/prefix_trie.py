"""The trie of conversations' prefixes: which turns many conversations begin with.

A node is a sequence of turns that some conversation begins with. Its owner is the least of its
members. Who owns a node owns all nodes below it on its own path, as their members are fewer and it
is among them. So a conversation owns one chain of nodes, from a first depth down to its end, and
finding that depth is a binary search: each round asks, for the prefix halfway between the bounds,
whether the least member is the conversation itself, in one join of all conversations with the
prefixes' minima. The chains form a tree, as each hangs below a node of another; sums over chains go
up that tree by doubling, in as many rounds as the logarithm of its height, and then up each chain.

A prefix is told by its depth and 128 bits, the exclusive or of the md5 of each (place, role, text), so
that prefixes are running values and a conversation of any length is dealt over tasks. Two of n prefixes share these
with a chance of n^2 / 2^129. Every join by a digest, where a first turn may be a third of all
conversations', deals out its frequent keys.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ranking import scanned
from marlstone.operators.skew import looked_up
from marlstone.session import ship
from marlstone.staging import Staged, stage

#: Conversations of which one lends its first turns, and the most turns that it can lend.
FAMILY, LENT = 5, 8
#: Ids of a node that are joined to one text; the texts of a node with more go through its hash one after the other.
CHUNK_IDS = 50_000

_DIGEST = ["depth", "d1", "d2"]


def _turns(rows: DataFrame) -> DataFrame:
    """``conv_id, place`` (from 1) ``, h1, h2`` (digest of role and text) ``, bytes`` of each turn in order."""
    role, text = (F.coalesce(rows[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    narrow = rows.where(rows["conv_id"].isNotNull()).select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    # Turns with the same number are ordered by their digest; equal ones are the same in any order.
    return scanned(narrow, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], "place").select("conv_id", "place", "digest", "bytes")


def _half(digest: Column, at: int) -> Column:
    """64 bits of a digest in hexadecimal, as a signed number."""
    part = lambda k: F.conv(F.substr(digest, F.lit(at + k), F.lit(8)), 16, 10).cast("long")
    return F.shiftleft(part(0), 32).bitwiseOR(part(8))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``conv_id, length``, ``conv_id, depth, d1, d2, bytes`` of each turn with the digest of the prefix that it ends).

    A conversation c of ``conversations`` (conv_id, turn, role, text) becomes the first h turns of conversation c - c % 5
    and its own turns after its first h, with h = crc32(decimal c) % 9.
    """
    turns = stage(_turns(conversations), "trie-turns")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = stage(convs.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head"), (F.crc32(F.col("conv_id").cast("string")) % (LENT + 1)).alias("h")), "trie-convs")
    lent = convs.select(F.col("conv_id").alias("head"), F.col("own").alias("held"))
    convs = convs.join(lent, "head", "left").withColumn("lent", F.least("h", F.coalesce("held", F.lit(0))))
    convs = stage(convs.select("conv_id", "head", "h", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")
    # A head has at most LENT turns here and at most FAMILY conversations that take them.
    heads = turns.where(F.col("place") <= LENT).select(F.col("conv_id").alias("head"), F.col("place").alias("depth"), "digest", "bytes")
    first = convs.join(heads, "head").where(F.col("depth") <= F.col("h")).select("conv_id", "depth", "digest", "bytes")
    own = looked_up(turns, convs.select("conv_id", "h", "lent"), ["conv_id"], F.col("place"), "inner").where(F.col("place") > F.col("h"))
    rows = first.unionByName(own.select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("depth"), "digest", "bytes"))
    placed = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")))
    rows = rows.select("conv_id", "depth", "bytes", placed.alias("digest")).select("conv_id", "depth", "bytes", _half(F.col("digest"), 1).alias("x1"), _half(F.col("digest"), 17).alias("x2"))
    paths = scanned(rows, ["conv_id"], [F.col("depth")], xors={"d1": "x1", "d2": "x2"})
    return convs.select("conv_id", "length"), stage(paths.select("conv_id", "depth", "d1", "d2", "bytes"), "trie-paths")


def first_owned(convs: DataFrame, paths: DataFrame, minima: DataFrame) -> DataFrame:
    """``conv_id, length, first, above``: the least depth that a conversation owns (``length`` + 1: none) and who owns the depth before.

    ``convs`` and ``paths`` as of ``rebuilt``; ``minima`` has ``depth, d1, d2, owner`` for each prefix but the root. By binary search:
    ``low`` is owned by another, ``high`` is owned or beyond the end.
    """
    root = convs.agg(F.min("conv_id").alias("least"), F.max("length").alias("longest")).first()
    # The root's owner owns all its depths, nobody else the root.
    owner, others = convs.where(F.col("conv_id") == root.least), convs.where(F.col("conv_id") != root.least)
    state = others.select("conv_id", "length", F.lit(0).cast("long").alias("low"), F.lit(root.least).cast("long").alias("above"), (F.col("length") + 1).alias("high"))
    at = Staged(state, "trie-search")
    for _ in range((root.longest + 1).bit_length()):
        asked = at.df.withColumn("depth", F.expr("(low + high) div 2"))
        open_, done = asked.where(F.col("high") - F.col("low") > 1), asked.where(F.col("high") - F.col("low") <= 1).drop("depth")
        probes = Staged(open_.join(paths.select("conv_id", *_DIGEST), ["conv_id", "depth"]), "trie-probes")
        found = looked_up(probes.df, minima, _DIGEST, F.col("conv_id"), "inner")
        own = F.col("owner") == F.col("conv_id")
        moved = found.select("conv_id", "length", F.when(own, F.col("low")).otherwise(F.col("depth")).alias("low"), F.when(own, F.col("above")).otherwise(F.col("owner")).alias("above"), F.when(own, F.col("depth")).otherwise(F.col("high")).alias("high"))
        after = Staged(moved.unionByName(done), "trie-search")
        at.drop()
        probes.drop()
        at = after
    return at.df.select("conv_id", "length", F.col("high").alias("first"), "above").unionByName(owner.select("conv_id", "length", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("above")))


def summed_up(chains: DataFrame, values: list[str]) -> DataFrame:
    """``chains`` (chain, parent; null for the root) with each of ``values`` summed over the chain and all below it.

    After round k a chain has the sums of all within 2^k steps below it, and what is 2^k steps above it is known.
    """
    at = Staged(chains.select("chain", F.col("parent").alias("up"), *values), "trie-chains")
    while at.df.where("up IS NOT NULL").limit(1).count():
        rows = at.df
        added = rows.where("up IS NOT NULL").groupBy(F.col("up").alias("chain")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        above = rows.select(F.col("chain").alias("up"), F.col("up").alias("_up"))
        jumped = looked_up(rows, above, ["up"], F.col("chain")).join(added, "chain", "left")
        after = Staged(jumped.select("chain", F.col("_up").alias("up"), *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)), "trie-chains")
        at.drop()
        at = after
    return at.df.drop("up")


def _hashed(batches):
    node, digest = None, None
    for batch in batches:
        out = []
        for key, text in zip(zip(batch.column("conv_id").to_pylist(), batch.column("depth").to_pylist(), strict=True), batch.column("ids").to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(text.encode())
            else:
                digest.update(f",{text}".encode())
        yield _hash_rows(out)
    if node is not None:
        yield _hash_rows([(*node, digest.hexdigest())])


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = [[r[k] for r in rows] for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "ends_sha256"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256`` of the nodes at which conversations end, from ``conv_id, depth, member``.

    A node's ids are numbered over tasks and joined to texts of ``CHUNK_IDS``. Where there are several, one task
    hashes a node's texts one after the other, as the hash asks for, and holds one of them.
    """
    rows = scanned(ends, ["conv_id", "depth"], [F.col("member")], "number")
    rows = rows.withColumn("chunk", F.expr(f"(number - 1) div {CHUNK_IDS}"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda x: x.cast("string")), ",")
    chunks = stage(rows.groupBy("conv_id", "depth", "chunk").agg(ids.alias("ids"), F.max("number").alias("upto")), "trie-ends")
    several = chunks.where("chunk = 1").select("conv_id", "depth")
    one = chunks.join(several, ["conv_id", "depth"], "left_anti").select("conv_id", "depth", F.sha2("ids", 256).alias("ends_sha256"))
    ship(ends.sparkSession)
    many = chunks.join(several, ["conv_id", "depth"], "left_semi").select("conv_id", "depth", "chunk", "ids").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk")
    return one.unionByName(many.mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node.

    ``conversations`` has conv_id, turn, role and text; other columns are ignored. Rows without a conv_id are of no
    conversation and left out; a null role or text is empty, a null turn comes first, rows with equal turns are
    ordered by a digest, and repeated rows are each a turn. Texts of any length are hashed where they are read.
    The root (depth 0) is there unless there are no conversations.
    """
    convs, paths = rebuilt(conversations)
    convs = stage(convs, "trie-convs")
    if not convs.limit(1).count():
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    minima = stage(paths.groupBy(*_DIGEST).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes")), "trie-minima")
    owned = stage(first_owned(convs, paths, minima.select(*_DIGEST, "owner")), "trie-owned")
    chains = owned.where(F.col("first") <= F.col("length"))

    # The owner's nodes: each prefix once, the root by itself.
    least, members = convs.agg(F.min("conv_id"), F.count("*")).first()
    root = conversations.sparkSession.createDataFrame([(least, 0, members, 0)], "conv_id long, depth long, n_convs long, bytes long")
    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "bytes").unionByName(root)
    hung = chains.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    nodes = nodes.join(hung, ["conv_id", "depth"], "left")
    nodes = looked_up(stage(nodes, "trie-nodes"), chains.select("conv_id", "length", "first", "above"), ["conv_id"], F.col("depth"), "inner")
    nodes = nodes.withColumn("n_children", F.coalesce("hung", F.lit(0)) + F.when(F.col("depth") < F.col("length"), 1).otherwise(0))
    nodes = nodes.withColumns({"leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    nodes = stage(nodes.withColumn("parent_conv_id", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("above"))), "trie-nodes")

    sums = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    tree = chains.join(sums, "conv_id").select(F.col("conv_id").alias("chain"), F.col("above").alias("parent"), "leaf", "saved")
    whole = summed_up(tree, ["leaf", "saved"])
    # What hangs below a node in other chains, and then all below it along its own.
    below = chains.where("above IS NOT NULL").join(whole.withColumnRenamed("chain", "conv_id"), "conv_id").groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
    nodes = nodes.join(below, ["conv_id", "depth"], "left")
    nodes = nodes.withColumns({"leaf": F.col("leaf") + F.coalesce("more_leaf", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))})
    nodes = scanned(nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "leaf", "saved"), ["conv_id"], [F.col("depth").desc()], sums={"n_leaves": "leaf", "saved_tokens": "saved"})

    # Who ends where: at the last prefix, whose owner is the conversation or the one above it.
    ends = owned.select(F.when(F.col("first") <= F.col("length"), F.col("conv_id")).otherwise(F.col("above")).alias("conv_id"), F.col("length").alias("depth"), F.col("conv_id").alias("member"))
    out = nodes.join(ends_hashes(ends), ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
