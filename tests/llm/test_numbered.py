"""The pipeline's row numbers."""

from pyspark.sql import functions as F


def test_files_are_numbered_without_a_copy(spark, tmp_path):
    """Rows of Parquet files have one number each, however they are split, and are not written again (they were before)."""
    import corpus_pipeline as C

    rows = [(None, "a"), (1, "b"), (1, "b"), (2, None)] * 50
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    numbered = C.numbered(docs)
    assert not hasattr(numbered, "staged_at")
    assert numbered.select("_row").distinct().count() == numbered.count() == 200
    before = {r["_row"]: r["_docs"] for r in numbered.collect()}
    assert {r["_row"]: r["_docs"] for r in C.numbered(docs).collect()} == before
    # What may hold a row twice is not a file: it is written with numbers.
    twice = C.numbered(docs.unionAll(docs))
    assert hasattr(twice, "staged_at") and twice.select("_row").distinct().count() == 400
    assert C.numbered(docs.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))).select("_row").distinct().count() == 400
