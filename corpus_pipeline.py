"""A corpus pipeline: quality rules, near-duplicate removal, decontamination, redaction, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are
written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from contextlib import suppress

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import decontam, mixing, ngram_join, pii, quality
from attestra.llm.lean import small_table
from attestra.llm.store import read, stage
from attestra.llm.words import keep_ids, sized_broadcast

#: Bits of a row's number that tell its place in a file.
FILE_BITS = 40


def numbered(docs: DataFrame) -> DataFrame:
    """(_row, _docs): a number for each row, the same whenever it is computed, and the row itself, whatever its columns are called. Ids
    may be null or shared by different texts, so stages decide by row. Rows of Parquet files are numbered by file and place in it; other
    tables are written with numbers, as those may differ when they are computed again."""
    whole = F.struct(*docs.columns).alias("_docs")
    if "_metadata" not in map(str.lower, docs.columns) and docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        with suppress(AnalysisException):
            placed = docs.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"), whole)
            paths = sorted(r["_path"] for r in placed.select("_path").distinct().collect())
            files = small_table(docs.sparkSession, list(zip(paths, range(len(paths)), strict=True)), "_path string, _file long")
            return placed.join(F.broadcast(files), "_path").select((F.shiftleft("_file", FILE_BITS) + F.col("_at")).alias("_row"), "_docs")
    return stage(docs.select(F.monotonically_increasing_id().alias("_row"), whole), "numbered")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose posterior says keep, all their columns with them. Null and empty texts fail the base rule and go;
    repeated rows are judged each; an empty table stays empty."""
    rows = numbered(docs)
    judged = quality.judge(rows.select("_row", F.col("_docs.text").alias("_text")), "_row", "_text")
    return keep_ids(rows, "_row", stage(judged.where("NOT kept").select("_row"), "rejected"), "left_anti").select("_docs.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows: the one with the smallest doc_id (null last), and of several
    of those the one with the smallest hash of its columns. Null and empty texts are linked with nothing and stay;
    an empty table stays empty."""
    rows = numbered(docs)
    found = ngram_join.groups(rows, "_row", F.col("_docs.text")).select(F.col("_row").alias("_r"), "component_id")
    doc_id = F.col("_docs.doc_id")
    order = F.struct(doc_id.isNull().alias("o1"), doc_id.alias("o2"), F.xxhash64("_docs").alias("o3"), F.col("_row").alias("o4"))
    ranked = stage(rows.select("_row", order.alias("_order")).join(found, F.col("_row") == F.col("_r")).select("_row", "_order", "component_id"), "ranked")
    # Groups of one row need no comparison, and what goes is less than what stays.
    first = ranked.groupBy("component_id").agg(F.min("_order").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    gone = ranked.join(first, "component_id").where("_order.o4 != _first.o4").select("_row")
    return keep_ids(rows, "_row", stage(gone, "gone"), "left_anti").select("_docs.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item. Null and empty texts hold none and stay; an empty table stays empty."""
    rows = numbered(docs)
    texts = rows.select("_row", F.col("_docs.text").alias("text"))
    hit = stage(decontam.contained(texts, read(spark, sf_dir, "benchmark"), key="_row").select("_row").distinct(), "hit")
    return keep_ids(rows, "_row", hit, "left_anti").select("_docs.*")


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks; ``n_chars`` follows the text. Null texts stay null, with
    no number of characters; an empty table stays empty."""
    return pii.redact_table(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, with the number of copies in ``copies`` (which replaces a column of that name).
    Null and empty texts are not taken; an empty table stays empty."""
    rows = numbered(docs)
    flat = rows.select("_row", F.col("_docs.doc_id").alias("doc_id"), F.col("_docs.source").alias("source"), F.col("_docs.text").alias("text"))
    taken = mixing.mix(flat, key="_row", drawn_by="doc_id").where("taken > 0").select(F.col("_row").alias("_id"), F.expr("taken div size").alias("_n"))
    taken = stage(taken, "taken")
    kept = rows.join(sized_broadcast(taken, taken.count()), F.col("_row") == F.col("_id"))
    return kept.select(*[F.col("_docs")[c].alias(c) for c in docs.columns if c != "copies"], F.col("_n").alias("copies"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("redaction", redaction),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs


#: Expectation-maximisation, component search and redaction offsets are beyond SQL; the
#: tests hold the stages against brute force.
ORACLE_SQL = None
