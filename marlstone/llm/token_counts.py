"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes is reduced to additive totals and committed as one folder,
``batch=<id>``. Spark's committer writes ``_SUCCESS`` last: a folder without it does not
count, and a batch that is committed already is left as it is, so a batch may be sent again at
any time. Inserts add a document's count, deletes take it away, and a revised count is the
old one taken away and the new one added. Totals are the sum over committed batches;
``compact`` folds them into one folder with a list of what it holds.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import token_files
from marlstone.session import ship
from marlstone.staging import remove

KEYS = ("source", "lang", "tokenizer")
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Tokenizer versions that count with a pattern.
PATTERNS = {"spaced-1": r"[^\x20\x09-\x0D]+", "alnum-1": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"}


def _encoded(tokenizer: str):
    def run(batches):
        enc = token_files.encoder(tokenizer)
        for batch in batches:
            sizes = [len(ids) for _, texts in token_files.slices(batch) for ids in enc.encode(texts)]
            cols = [*(batch.column(k) for k in batch.schema.names if k != "n"), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*(k for k in batch.schema.names if k != "n"), "n"])

    return run


def counted(docs: DataFrame, *tokenizers: str) -> DataFrame:
    """``doc_id, source, lang`` of each row and a column of counts for each tokenizer.

    A tokenizer is a name of ``PATTERNS``, or a file of the tokenizers library as in
    ``token_files``, whose ids of the whole text count without special tokens. Null and empty
    texts have no tokens, null sources and languages stay null, repeated rows count each,
    other columns are ignored, and an empty table gives no rows.
    """
    count = lambda t: F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(PATTERNS[t])), F.lit(0)).cast("long").alias(t)
    files = [t for t in tokenizers if t not in PATTERNS]
    rows = docs.select("doc_id", docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), *(count(t) for t in tokenizers if t in PATTERNS), *([docs["text"].cast("string").alias("text")] if files else []))
    for t in files:
        ship(docs.sparkSession)
        rows = rows.withColumn("n", F.lit(0).cast("long"))
        rows = rows.mapInArrow(_encoded(t), rows.schema).withColumnRenamed("n", t)
    return rows.select("doc_id", "source", "lang", *(f"`{t}`" for t in tokenizers))


def version(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of ``counted`` for one tokenizer: ``KEYS`` and ``n_tokens``."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(f"`{tokenizer}`").alias("n_tokens"))


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counts taken away and new ones added; keys may differ between the two."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _complete(self, prefix: str) -> list[str]:
        """Names of folders that Spark's committer has finished."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path(self.path))]
        return sorted(n for n in names if n.startswith(prefix) and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def _folders(self) -> dict[str, set[str]]:
        """Folders that count with the ids of their batches; what a larger folder holds does not count, nor the later of two that hold the same."""
        held = {n: {n.removeprefix("batch=")} for n in self._complete("batch=")}
        lists = set(self._complete("held-"))
        for n in self._complete("folded-"):
            if (ids := n.replace("folded-", "held-")) in lists:
                held[n] = {r[0] for r in self.spark.read.schema("id string").parquet(f"{self.path}/{ids}").collect()}
        return {n: ids for n, ids in held.items() if not any(ids < other or ids == other and m < n for m, other in held.items() if m != n)}

    def committed(self) -> set[str]:
        """Ids of all batches, also of those that were folded together."""
        return {i for ids in self._folders().values() for i in ids}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows (``KEYS``, ``n_docs``, ``n_tokens``); False if it was committed before.

        Null sources and languages are groups of their own. Groups whose changes cancel out are
        left out. Each key's rows are summed before they are shuffled.
        """
        if not batch or set(batch) & set("+/=") or batch.startswith("_"):
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self.committed():
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` now; groups without documents are gone."""
        at = [f"{self.path}/{n}" for n in sorted(self._folders())]
        rows = self.spark.read.schema(_TOTALS).parquet(*at) if at else self.spark.createDataFrame([], _TOTALS)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into one folder.

        The list of what it holds comes last; from then on the old folders do not count, so
        a run that breaks off at any point leaves the totals as they are.
        """
        before = self._folders()
        if len(before) < 2:
            return
        name = uuid.uuid4().hex
        self.totals().write.parquet(f"{self.path}/folded-{name}")
        self.spark.createDataFrame([(i,) for i in sorted(self.committed())], "id string").write.parquet(f"{self.path}/held-{name}")
        for n in before:
            remove(self.spark, f"{self.path}/{n}")
