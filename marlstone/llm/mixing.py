"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, its expected number of copies. Of all rates that give each source
its target of words, and no document more than ``cap``, the ones nearest to 1 in relative
entropy are exponentially tilted by the document's words:
``rate = min(cap, exp(lambda_source * size / mean_source))``. The lambdas are the minimum of
the convex dual; its gradient ``sum(size * rate) - target`` and its curvature are sums over
all documents, which each of Newton's iterations takes anew for all sources side by side.
Documents of a source and a size have one term, so the sums run over the counts of sizes.

Rates become whole copies by carrying the remainder along, from large documents to small
ones, in parts of a source of bounded size. The small ones even out what the large ones left
over, so a part ends within about its smallest document of its share. Equal rows are one row
with a count until the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.whole_rows import digest, packed
from marlstone.session import ship
from marlstone.staging import Staged, stage

#: Documents of a part of a source, on average.
PART = 8192
WORD = r"[^\x20\x09-\x0D]+"
#: Newton ends at this share of a target, or fails after so many steps.
CLOSE, NEWTON_STEPS = 1e-9, 100


def ranked(keys: DataFrame, col: str) -> DataFrame:
    """``keys`` with ``rank`` from 0, by code point, null last; sorted in parallel, parts added up."""
    at = stage(keys.orderBy(F.col(col).asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id()), "rank")
    part = F.shiftright("_id", 33)
    counts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each task of the sort
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return at.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_start")


def targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to a table of sources with their ``source_size``.

    The level ``mu`` at which ``min(cap * size, mu * weight)`` adds up to the share of all:
    what sources at their cap leave over raises the level for the rest until none is above.
    """
    at = stage(ranked(sizes, "source").withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "op10-sources")
    total, weight = at.agg(F.sum("source_size"), F.sum("weight")).first()
    goal = share * (total or 0)
    mu = goal / weight if weight else 0.0
    while goal:
        full = F.col("source_size") * cap < mu * F.col("weight")
        used, free = at.agg(F.sum(F.when(full, F.col("source_size") * cap)), F.sum(F.when(~full, F.col("weight")))).first()
        after = (goal - (used or 0)) / free if free else mu
        if after <= mu * (1 + 1e-15):
            break
        mu = after
    return at.withColumn("target", F.least(F.col("source_size") * F.lit(cap), F.col("weight") * F.lit(mu)))


def rates(sources: DataFrame, cells: DataFrame, cap: float = 2.0, tilt: str = "tokens") -> DataFrame:
    """Adds ``lam`` and ``mean`` to a table of sources with ``source_size`` and ``target``.

    ``cells`` counts documents (``source, size, n``). With ``tilt="tokens"`` documents are the
    unit of the measure and a rate is tilted by a document's words; with ``"source"`` words are,
    and all documents of a source share a rate. A target of ``cap`` times the size has an infinite
    lambda, one of 0 a negative infinite one. Each step is Newton's, or halves the bracket where
    Newton's would leave it.
    """
    inf = float("inf")
    full, none = F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12)), F.col("target") <= 0
    docs = cells.groupBy(F.col("source").alias("s")).agg(F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("filled"))
    at = sources.join(docs, sources["source"].eqNullSafe(docs["s"])).drop("s").withColumn("mean", F.col("source_size") / F.col("filled"))
    at = at.select("source", "source_size", "target", "mean", F.when(none, -inf).when(full, inf).otherwise(0.0).alias("lam"), (none | full).alias("done"), F.lit(-inf).alias("low"), F.lit(inf).alias("high"))
    at = Staged(at.coalesce(1), "op10-lambda")
    for _ in range(NEWTON_STEPS):
        open_ = at.df.where("NOT done").select(F.col("source").alias("s"), "lam", "mean")
        z = F.col("size") / F.col("mean") if tilt == "tokens" else F.lit(1.0)
        rate, words = F.least(F.exp(F.col("lam") * z), F.lit(float(cap))), F.col("size") * F.col("n")
        terms = cells.where("size > 0").join(open_, cells["source"].eqNullSafe(open_["s"]))
        sums = terms.groupBy("s").agg(F.sum(words * rate).alias("value"), F.sum(F.when(rate < cap, words * rate * z).otherwise(0.0)).alias("slope"))
        over = F.col("value") - F.col("target")
        next_ = at.df.where("NOT done").join(sums, F.col("source").eqNullSafe(F.col("s"))).withColumns({"low": F.when(over < 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(over > 0, F.col("lam")).otherwise(F.col("high"))})
        newton = F.col("lam") - over / F.col("slope")
        # Outside the bracket: its middle, or twice as far on a side that is open still.
        middle = F.when(F.col("high") == inf, F.col("low") + F.greatest(F.lit(1.0), F.abs("low"))).when(F.col("low") == -inf, F.col("high") - F.greatest(F.lit(1.0), F.abs("high"))).otherwise((F.col("low") + F.col("high")) / 2)
        far = F.when(F.col("high") == inf, newton - F.col("lam") > 8 * F.greatest(F.lit(1.0), F.abs("lam"))).otherwise(F.lit(False))
        good = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high")) & ~far
        close = (F.abs(over) <= CLOSE * F.col("target")) | (F.col("high") - F.col("low") <= 1e-15 * F.abs("lam"))
        next_ = next_.select("source", "source_size", "target", "mean", F.when(close, F.col("lam")).when(good, newton).otherwise(middle).alias("lam"), close.alias("done"), "low", "high")
        after = Staged(at.df.where("done").unionByName(next_).coalesce(1), "op10-lambda")
        at.drop()
        at = after
        if at.df.where("NOT done").isEmpty():
            return at.df.select("source", "source_size", "target", "mean", "lam")
    raise RuntimeError("Newton's iterations did not settle")


def _rounded(table: pa.Table) -> pa.Table:
    sizes, times, rate = (np.array(table.column(k).to_pylist()) for k in ("size", "k", "rate"))
    low = np.floor(rate + 1e-9).astype(np.int64)
    part = np.maximum(0.0, rate - low)
    copies, carry = low * times, 0.0
    for i in np.lexsort((table.column("h").to_numpy(), -sizes)).tolist():
        n, k = int(sizes[i]), int(times[i])
        if n and part[i] > 1e-9:
            carry += n * k * float(part[i])
            more = min(k, int(carry / n + 1e-9))
            copies[i] += more
            carry -= n * more
    return table.append_column("copies", pa.array(copies))


def _copies(docs: DataFrame, weights: tuple, share: float, cap: float, tilt: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id, size, source_size, target, k, copies, h1, h2`` of equal rows: how many they are, and how many copies they have together."""
    ship(docs.sparkSession)
    text, source = docs[text_col].cast("string"), docs[source_col].cast("string")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        digest(docs, 1).alias("h1"), digest(docs, 2).alias("h2"),
    )
    base = Staged(rows.groupBy("doc_id", "source", "size", "h1", "h2").agg(F.count("*").alias("k")), "op10-rows").df
    cells = Staged(base.groupBy("source", "size").agg(F.sum("k").alias("n"), F.count("*").alias("m")).coalesce(16), "op10-cells").df
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("m").alias("m"))
    solved = rates(targets(sizes, weights, share, cap).select("source", "source_size", "target"), cells, cap, tilt).withColumnRenamed("source", "s")
    parts = cells.groupBy(F.col("source").alias("s2")).agg(F.ceil(F.sum("m") / PART).alias("parts"))
    known = stage(solved.join(parts, F.col("s").eqNullSafe(F.col("s2"))).drop("s2").coalesce(1), "op10-rates")
    z = F.col("size") / F.col("mean") if tilt == "tokens" else F.lit(1.0)
    # A document without words has no tilt; a source without a target is left out.
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("size") == 0, 1.0).otherwise(F.least(F.exp(F.col("lam") * z), F.lit(float(cap))))
    rows = base.join(known, base["source"].eqNullSafe(known["s"])).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "doc_id", "h1"), "parts")).withColumn("h", F.xxhash64(F.lit(4), "doc_id", "h1"))
    names = ["doc_id", "source", "size", "h1", "h2", "k", "source_size", "target", "part", "h"]
    rows = rows.select(*names, rate.alias("rate"))
    return rows.groupBy("source", "part").applyInArrow(_rounded, f"{', '.join(f'{k} {t}' for k, t in rows.dtypes)}, copies long")


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0, tilt: str = "tokens", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for each row of ``docs``.

    ``size`` counts words between ASCII white space of the whole text, 0 for a null or blank
    text; such a document is taken once if its source has a target. A null source is a source,
    the last. Equal rows share their copies out, so as a bag the result is the same in each run.
    A very long text counts whole. Without any words all targets are 0. An empty table gives
    no rows. Other columns only tell rows apart, whatever their names.
    """
    done = _copies(docs, weights, share, cap, tilt, id_col, text_col, source_col)
    each = done.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    own = (F.floor(F.col("copies") / F.col("k")) + F.when(F.col("i") < F.col("copies") % F.col("k"), 1).otherwise(0)).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * own).alias("taken"), own.alias("copies"))


def mixed(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0, tilt: str = "tokens", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; edge cases as in ``mix``."""
    taken = stage(_copies(docs, weights, share, cap, tilt, id_col, text_col, source_col).where("copies > 0").select("h1", "h2", "copies"), "op10-copies")
    rows = docs.select(packed(docs), digest(docs, 1).alias("h1"), digest(docs, 2).alias("h2"))
    rows = rows.dropDuplicates(["h1", "h2"]).join(taken, ["h1", "h2"])
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_k")).select("row.*")
