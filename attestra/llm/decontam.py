"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is short and a document long, so their Jaccard similarity says little; what counts is
containment, the share of the item's distinct 5-word shingles that the document has. Under one
hash function the item's smallest value lies in the document with a probability equal to the
containment. Items are partitioned by size, and each partition keeps as many of its smallest
values as make the search complete: of ``q`` shingles a document may lack ``floor(q / 4)`` at
containment 0.75, so the ``floor(q / 4) + 1`` smallest values cannot all be missing. Documents
probe this sketch shingle by shingle (an equi-join, no pairs of documents); the candidates are
verified by exact shingle containment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import read, stage
from .words import LETTER_WORD, SHINGLE, keep_ids, shingle_rows, sized_broadcast, words

#: Containment in hundredths.
PERCENT = 75


def item_shingles(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, len, h, n) of every item: ``len`` is 5, or the number of words of a shorter
    item, which is then one shingle; ``n`` is the item's number of distinct shingles."""
    split = items.select(F.col(key).alias("item"), words(text, LETTER_WORD, lower=True).alias("w")).where(F.size("w") > 0)
    parts = [shingle_rows(split.where(F.size("w") >= SHINGLE), "w", "h").select("item", F.lit(SHINGLE).alias("len"), "h")]
    for size in range(1, SHINGLE):
        parts.append(shingle_rows(split.where(F.size("w") == size), "w", "h", size).select("item", F.lit(size).alias("len"), "h"))
    rows = reduce(DataFrame.unionAll, parts).distinct()
    n = rows.groupBy(F.col("item").alias("_item")).agg(F.count("*").alias("n"))
    return rows.join(n, F.col("item").eqNullSafe(F.col("_item"))).drop("_item")


def sketch(shingles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The smallest values of each item by the size of its partition: (item, len, h).

    Partitions are item sizes; the number kept follows from the size alone.
    """
    kept = F.floor(F.col("n") * (100 - percent) / 100) + 1
    smallest = shingles.groupBy("item", "n").agg(F.sort_array(F.collect_set(F.struct("h", "len"))).alias("all"))
    return smallest.select("item", F.explode(F.slice("all", 1, kept.cast("int"))).alias("s")).select("item", "s.len", "s.h")


def document_shingles(docs: DataFrame, lengths: list[int], key: str, text: str) -> DataFrame:
    """(doc, len, h) of every window of the given lengths in every whole text."""
    split = docs.select(F.col(key).alias("doc"), words(text, LETTER_WORD, lower=True).alias("w"))
    parts = [shingle_rows(split, "w", "h", size).select("doc", F.lit(size).alias("len"), "h") for size in lengths]
    return reduce(DataFrame.unionAll, parts)


def contained(
    docs: DataFrame,
    items: DataFrame,
    percent: int = PERCENT,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Pairs of documents and items with containment of at least ``percent`` hundredths:
    doc_id, item_id, n_shared, n_item, containment.

    Null and empty texts hold and are held by nothing. Rows with one doc_id (null included) count
    as one document, items with one item_id as one item. Empty tables give an empty result.
    Equal hashes stand for equal shingles (64 bits). Other columns are ignored.
    """
    spark = docs.sparkSession
    all_items = stage(item_shingles(items, item_key, item_text), "items")
    lengths = sorted(r["len"] for r in all_items.select("len").distinct().collect()) or [SHINGLE]
    n_items = all_items.count()
    probes = stage(sketch(all_items, percent), "sketch")
    n_probes = probes.count()

    found = document_shingles(docs, lengths, key, text)
    hit = found.join(sized_broadcast(probes, n_probes), ["len", "h"])
    candidates = stage(hit.select("doc", "item").distinct(), "candidates")
    if candidates.isEmpty():
        return spark.createDataFrame([], f"{key} long, {item_key} long, n_shared long, n_item long, containment double").select(
            F.col(key).cast(dict(docs.dtypes)[key]), F.col(item_key).cast(dict(items.dtypes)[item_key]), "n_shared", "n_item", "containment"
        )

    hold = stage(candidates.select("doc").distinct(), "hold")
    again = keep_ids(docs, key, hold)
    shared = document_shingles(again, lengths, key, text).join(sized_broadcast(all_items, n_items), ["len", "h"])
    shared = shared.select("doc", "item", "n", "len", "h").distinct().groupBy("doc", "item", "n").agg(F.count("*").alias("n_shared"))
    verified = shared.where(100 * F.col("n_shared") >= percent * F.col("n"))
    wanted = candidates.select(F.col("doc").alias("_doc"), F.col("item").alias("_item"))
    verified = verified.join(wanted, F.col("doc").eqNullSafe(F.col("_doc")) & F.col("item").eqNullSafe(F.col("_item")), "left_semi")
    return verified.select(
        F.col("doc").alias(key), F.col("item").alias(item_key), "n_shared", F.col("n").alias("n_item"), (F.col("n_shared") / F.col("n")).alias("containment")
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS l, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), n AS (
  SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id
), ls AS (
  SELECT DISTINCT l FROM bs
), ds AS (
  SELECT DISTINCT doc_id, l, array_to_string(w[i:i + l - 1], ' ') AS s
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)
)
SELECT ds.doc_id, bs.item_id, count(*) AS n_shared, n.n_item, count(*) / n.n_item AS containment
FROM ds JOIN bs USING (l, s) JOIN n USING (item_id) GROUP BY ds.doc_id, bs.item_id, n.n_item HAVING 100 * count(*) >= 75 * n.n_item
"""
