"""Similarity inside a row: plans stay small, grams are not shuffled, rows agree with SQL and brute force."""

import duckdb
import pytest
from test_reference_operators import brute_similarity

from attestra.functions import lexicon
from attestra.operators import reconcile as R
from attestra.plans import catalogue

LEX = lexicon.load()


def test_reconcile_turns_plan_and_rows(spark):
    """No plan holds the plans of the tables that it reads (some 460,000 characters before)."""
    sf_dir, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = catalogue.reconcile_turns(spark, sf_dir)
    rows = sorted(map(repr, map(tuple, found.collect())))
    assert len(found._jdf.queryExecution().executedPlan().toString()) < 60_000
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalogue.ORACLES['reconcile_turns']})").fetchall()
    assert rows == sorted(map(repr, want))


def test_two_best_and_empty_items(spark):
    """Ties go to the larger text; an item without letters shares nothing, and stays."""
    items = spark.createDataFrame([("d", 1, "甲乙丙丁"), ("d", 2, "——"), ("d", 3, "——")], "doc_id string, ord long, item string")
    pool = spark.createDataFrame([("d", 1, "甲乙"), ("d", 2, "丙丁"), ("d", 3, "子丑")], "doc_id string, ord long, item string")
    found = {r["ord"]: tuple(r)[2:] for r in R.top_two(items, pool, LEX).collect()}
    assert found[1] == (pytest.approx(0.5), "甲乙", pytest.approx(0.5)) and found[2] == found[3] == (0.0, "甲乙", 0.0)
    assert sorted(r["ord"] for r in R.dedupe(items, LEX).collect()) == [1, 2, 3]


def test_best_of_keeps_grams_in_the_row(spark):
    """Texts and their grams are not dealt out (before: all grams of all documents were); one id's rows are one text."""
    docs = spark.createDataFrame([(1, "甲乙丙丁戊"), (2, "丁戊"), (3, None), (4, "——"), (5, "甲乙"), (5, "丙丁")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "甲乙丙丁戊"), (8, "戊丁戊"), (9, "子"), (6, "")], "item_id long, text string")
    found = R.best_of(docs.where("doc_id < 5"), items, LEX)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        texts = ({1: "甲乙丙丁戊", 2: "丁戊"}[r["doc_id"]], {7: "甲乙丙丁戊", 8: "戊丁戊"}[r["item_id"]])
        assert r["score"] == pytest.approx(brute_similarity(texts[1], texts[0]))
    assert [tuple(r)[:3] for r in found.orderBy("doc_id", "place").collect()] == [(1, 1, 7), (1, 2, 8), (2, 1, 8), (2, 2, 7)]
    assert [tuple(r) for r in R.best_of(docs.where("doc_id = 5"), items, LEX).collect()] == [(5, 1, 7, pytest.approx(2 * 2 / 6))]
