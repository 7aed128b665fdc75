"""Archives of files: names, limits, checksums, and the archive's bytes."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.fixed import ARCHIVE_BYTES, ARCHIVE_ITEMS, FILE_BYTES, NAME_CHARS
from marlstone.session import ship


def safe_name(raw: Column, fallback: Column) -> Column:
    base = X.trim(F.regexp_replace(F.coalesce(X.empty_as_null(raw), fallback), r'[\\/:*?"<>|\x00-\x1f]', "_"))
    return F.coalesce(X.empty_as_null(F.left(base, F.lit(NAME_CHARS))), fallback)


def crc(data: Column) -> Column:
    return F.crc32(data)


def checked(items: DataFrame) -> DataFrame:
    """Rows (``archive, ord, url, filename, status, data``) with ``name`` and ``error``, one of them null."""
    fallback = F.concat(F.lit("torrent-"), F.col("ord").cast("string"), F.lit(".torrent"))
    at = F.concat(F.lit("#"), F.col("ord").cast("string"))
    error = (
        F.when(~F.coalesce(F.col("url").rlike("(?i)^https?:"), F.lit(False)), F.concat(at, F.lit(" bad URL")))
        .when(F.col("status").isNull() | F.col("data").isNull(), F.concat(at, F.lit(" not fetched")))
        .when(~F.col("status").between(200, 299), F.concat(at, F.lit(" HTTP "), F.col("status").cast("string")))
        .when(F.octet_length("data") > FILE_BYTES, F.concat(at, F.lit(" too large")))
    )
    return items.withColumn("error", error).withColumn("name", F.when(F.col("error").isNull(), safe_name(F.col("filename"), fallback)))


def budgeted(files: DataFrame, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows (``archive, ord, size``; null for an error) with the running sum ``upto`` and ``kept``.

    From the first file beyond the limit on nothing is kept, errors neither. An archive has
    at most a few hundred rows, so its window is small.
    """
    w = Window.partitionBy("archive").orderBy("ord")
    upto = F.sum(F.coalesce("size", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("upto", upto).withColumn("kept", F.col("upto") <= limit)


def named(files: DataFrame) -> DataFrame:
    """``final_name``: a name's later uses get ``-1, -2, ...`` before the ending."""
    n = F.row_number().over(Window.partitionBy("archive", "name").orderBy("ord")) - 1
    again = F.concat(F.regexp_extract("name", r"(?is)^(.*?)(\.torrent)?\z", 1), F.lit("-"), n.cast("string"), F.regexp_extract("name", r"(?is)^(.*?)(\.torrent)?\z", 2))
    return files.withColumn("final_name", F.when(n == 0, F.col("name")).otherwise(again))


#: The time that entries of an archive bear, so that equal files give equal bytes.
ENTRY_TIME = (1980, 1, 1, 0, 0, 0)


def zip_bytes(entries: list[tuple[str, bytes]], at: tuple = ENTRY_TIME) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name, at), data)
    return out.getvalue()


def archives(items: DataFrame, limit: int = ARCHIVE_BYTES, most: int = ARCHIVE_ITEMS) -> DataFrame:
    """``(archive, n_files, n_errors, error, data)`` for each archive asked for.

    An archive of no or more than ``most`` items, or without any good file, has an ``error`` and no
    ``data``. Where some files fail, the archive's last entry ``_errors.txt`` lists them.
    """
    ship(items.sparkSession)
    rows = budgeted(checked(items).withColumn("size", F.when(F.col("error").isNull(), F.octet_length("data"))), limit)
    over = rows.where(~F.col("kept")).groupBy("archive").agg(F.min("ord").alias("cut"))
    rows = rows.join(over, "archive", "left").where("cut IS NULL OR ord <= cut")
    rows = rows.withColumn("error", F.when(F.col("ord") == F.col("cut"), F.lit("size limit reached, the rest is left out")).otherwise(F.col("error")))
    good = named(rows.where("error IS NULL")).select("archive", "ord", F.col("final_name").alias("name"), F.lit(None).cast("string").alias("error"), "data")
    bad = rows.where("error IS NOT NULL").select("archive", "ord", F.lit(None).cast("string").alias("name"), "error", F.lit(None).cast("binary").alias("data"))
    asked = items.groupBy("archive").agg(F.count("*").alias("asked"))

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ord")
        files = [(n, bytes(d or b"")) for n, d, e in zip(pdf["name"], pdf["data"], pdf["error"], strict=True) if e is None]
        errors = [e for e in pdf["error"] if e is not None]
        why = "too many items" if pdf["asked"].iloc[0] > most else None if files else "no file could be archived"
        if files and errors:
            files.append(("_errors.txt", "\n".join([f"{len(errors)} failed:", *errors, ""]).encode()))
        data = None if why else zip_bytes(files)
        return pd.DataFrame({"archive": [pdf["archive"].iloc[0]], "n_files": [len(files)], "n_errors": [len(errors)], "error": [why], "data": [data]})

    # The bytes of an archive that is too large to be made stay where they are.
    both = good.unionByName(bad).join(asked, "archive").withColumn("data", F.when(F.col("asked") <= most, F.col("data")))
    return both.groupBy("archive").applyInPandas(build, f"archive {dict(items.dtypes)['archive']}, n_files long, n_errors long, error string, data binary")
