"""What Python workers hold on to, and what starts them."""

import re
import sys
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F


def _workers(spark):
    """Resident MB of each worker, once all of them have had a task: anonymous memory now, and the most since the last call."""

    def run(batches):
        import os

        for _ in batches:
            time.sleep(0.5)
        said = open("/proc/self/status").read()
        now, most = (int(re.search(rf"{k}:\s+(\d+)", said)[1]) // 1024 for k in ("RssAnon", "VmHWM"))
        with open("/proc/self/clear_refs", "w") as f:
            f.write("5")
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "now": [now], "most": [most]})

    rows = spark.range(0, 4, 1, 4).mapInArrow(run, "pid long, now long, most long").collect()
    return {r["pid"]: (r["now"], r["most"]) for r in rows}


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_workers_stay_small(spark):
    """Redaction and the shingles of some 40 MB of texts a task leave little in the workers, and take little above their batches
    (before: batches became strings as a whole, and what workers had held they kept)."""
    from attestra.llm import ngram_join, pii

    text = F.concat_ws(" ", F.lit("mail a@b.org"), F.transform(F.sequence(F.lit(1), F.lit(500)), lambda k: F.xxhash64("id", k).cast("string")))
    docs = spark.range(0, 16000, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"))
    few = docs.limit(4).repartition(4)
    for table in (few, docs):
        pii.redact_table(table).write.format("noop").mode("overwrite").save()
        ngram_join._summaries(table, "long", 1).write.format("noop").mode("overwrite").save()
        if table is few:
            base = _workers(spark)
            base = _workers(spark)
    grown = {p: (now - base[p][0], most - base[p][1]) for p, (now, most) in _workers(spark).items() if p in base}
    assert grown and max(now for now, _ in grown.values()) <= 30, grown
    assert max(most for _, most in grown.values()) <= 175, grown


def test_pieces():
    from attestra.llm.lean import pieces

    texts = ["", None, "ab", "c" * 9, None, "é", "d", ""]
    for kind in (pa.string(), pa.large_string()):
        for whole, at in ((texts, 0), (["x" * 7, None, *texts], 2), ([], 0)):
            found = list(pieces(pa.array(whole, kind).slice(at), 4))
            assert [t for p in found for t in p.to_pylist()] == whole[at:]
            assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= 4 for p in found)


def test_redaction_in_pieces(spark, monkeypatch):
    """Pieces of a batch are put together again in order, whatever their size; nulls stay."""
    from attestra.llm import pii

    texts = [None, "", "a@b.org x", "é" * 700_000 + " c@d.net", "plain", None] * 7
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)
    assert [(r["k"], r["text"]) for r in pii.redact_table(frame).collect()] == [(k, pii.redact(t)) for k, t in enumerate(texts)]
    assert pii.redact_table(frame.limit(0)).collect() == []


def test_small_tables_start_no_worker(spark):
    """Rows come as they do from a list, but without a Python step on the executors (before: with one)."""
    from attestra.llm.lean import small_table

    schema = "a int, b string, c long, d double"
    for rows in ([(1, None, 1 << 40, 0.5), (2, "é", 3, 0.1)], [(7, None, 1, 1.0)], []):
        made = small_table(spark, rows, schema)
        assert made.dtypes == spark.createDataFrame([], schema).dtypes
        assert [tuple(r) for r in made.collect()] == rows
    plan = made.sparkSession.createDataFrame([(1,)], "a int")._jdf.queryExecution().toString()
    assert "ExistingRDD" in plan
    assert "ExistingRDD" not in small_table(spark, [(1,)], "a int")._jdf.queryExecution().toString()
