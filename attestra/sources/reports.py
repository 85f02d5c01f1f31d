"""Report files in, redacted copies out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.privacy import redact_table


def decode(content: Column) -> Column:
    """UTF-8 (a byte order mark goes) or, where that is invalid, GBK without what cannot be decoded.

    GBK needs ``spark.sql.legacy.javaCharsets``, which ``read_reports`` sets while it reads.
    """
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.replace(F.decode(content, "GBK"), F.lit("\ufffd"), F.lit("")))
    return F.regexp_replace(text, "^\ufeff", "")


LEGACY = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(docs, errors): docs(doc_id, text) of all files under a path, and what gave no document: files that
    are blank, and files that went or could not be read meanwhile give no row at all.

    Decoding rules are part of a plan once it is analysed, so the session's settings are as before afterwards.
    """
    before = {k: spark.conf.get(k, None) for k in LEGACY}
    try:
        for k in LEGACY:
            spark.conf.set(k, "true")
        found = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(path)
        files = found.select(F.col("path").alias("doc_id"), decode(F.col("content")).alias("text"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    blank = F.regexp_replace("text", r"(?U)\s+", "") == ""
    return files.where(~blank), files.where(blank).select("doc_id", F.lit("blank").alias("error"))


def write_redacted(docs: DataFrame, path: str) -> None:
    """Masked copies of docs(doc_id, text) at a new place; the source stays as it is."""
    redact_table(docs.select("doc_id", "text")).write.mode("errorifexists").parquet(path)


def write_redacted_files(docs: DataFrame, path: str, suffix: str = "-脱敏") -> None:
    """One masked text file for each of docs(doc_id, text), in a folder of its own under ``path`` that is named
    after the document's file with ``suffix``; the source stays as it is."""
    name = F.regexp_replace(F.regexp_extract("doc_id", r"([^/]+)$", 1), r"\.[^.]*$", "")
    out = redact_table(docs.select("doc_id", "text")).select(F.concat(name, F.lit(suffix)).alias("name"), F.col("text").alias("value"))
    out.write.mode("errorifexists").partitionBy("name").option("lineSep", "\n").text(path)
