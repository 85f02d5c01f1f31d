"""Rules, privacy, reconciliation and evaluation on small reports of our own."""

import json
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from attestra.functions import lexicon
from attestra.operators import audit as A
from attestra.operators import prioritize as P
from attestra.operators import privacy as V
from attestra.operators import reconcile as R
from attestra.plans import catalogue, evaluate, fixtures, report
from attestra.sources import reports

LEX = lexicon.load()


@pytest.fixture(scope="module")
def docs(spark):
    some = ("good", "loose", "stack", "private", "rated", "boxes")
    return spark.createDataFrame([(k, fixtures.REPORTS[k]) for k in some], "doc_id string, text string")


def test_rules_fire_where_they_should(docs):
    found = {}
    for r in A.audit(docs, LEX).issues.collect():
        found.setdefault(r["doc_id"], []).append(r["type"])
    assert {"动作无结果", "缺具体数字", "空泛评价", "伪精确", "比例无基数", "负向指标缺时间窗", "计划缺责任/时限"} <= set(found["loose"])
    assert found["stack"] == ["活动堆砌"]
    assert found["private"].count("隐私外泄风险") == 3
    assert {"收益缺口径", "金额缺统计区间"} <= set(found["private"])
    assert {"未完成混进成果", "残留待办符号", "口径缺失"} <= set(found["boxes"])


def test_verdict_and_score(docs):
    rows = {r["doc_id"]: r for r in A.audit(docs, LEX, word_limit=500).metrics.collect()}
    assert all(0 <= r["score"] <= 100 for r in rows.values())
    assert rows["stack"]["idle_rate"] == 100.0 and rows["stack"]["verdict"] == "需返工"


def test_ratings_by_block(docs):
    found = A.audit(docs, LEX, style="self-review").issues.where("doc_id = 'rated' AND type = '等级与证据不符'")
    assert found.count() == 3


def test_style_rules_and_unknown_style(docs):
    assert A.audit(docs, LEX, style="review").issues.where("type = '文体缺件'").count() > 0
    assert A.audit(docs, LEX, style="haiku").issues.where("type = '文体未知'").count() == docs.count()


def test_over_length(docs):
    assert A.audit(docs, LEX, word_limit=10).issues.where("type = '超篇幅'").count() == docs.count()


def test_gaps_quota(docs):
    ranked = P.prioritize(A.audit(docs, LEX, mode="gaps").issues, top=3).cache()
    asked = ranked.where("bucket = 'asked'")
    assert asked.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert asked.groupBy("doc_id", "type").count().agg(F.max("count")).first()[0] <= 2


def test_empty_and_null_documents(spark):
    rows = A.audit(spark.createDataFrame([("a", None), ("b", "")], "doc_id string, text string"), LEX).metrics.collect()
    assert [r["word_count"] for r in rows] == [0, 0]
    none = spark.createDataFrame([], "doc_id string, text string")
    assert A.audit(none, LEX).metrics.count() == 0


def test_partitioning_does_not_matter(docs):
    one = A.audit(docs.repartition(1), LEX).metrics.orderBy("doc_id").collect()
    assert one == A.audit(docs.repartition(5), LEX).metrics.orderBy("doc_id").collect()


def test_redaction_closes_the_loop(docs):
    masked = V.redact_table(docs).select("doc_id", "text")
    assert V.detect(docs).where("blocking").count() > 0
    assert V.detect(masked).where("blocking").count() == 0
    assert V.redact_table(masked).agg(F.sum("n_replaced")).first()[0] == 0


def test_masks(spark):
    cases = {
        "13812345678": "138****5678",
        "卡 1234567890123456 号": "卡 12" + "*" * 12 + "56 号",
        "学号：20240101": "学号：20****01",
        "a.b@c.org": "a***@c.org",
        "月薪约 8000 元": "月薪约 〔略〕",
        "王老师": "某老师",
    }
    df = spark.createDataFrame([(k, k) for k in cases], "k string, text string")
    assert {r["k"]: r["text"] for r in V.redact_table(df).collect()} == cases


def test_reconcile_statuses(spark):
    rows = {(r["pair_id"], r["promise_no"]): r for r in catalogue.reconcile_status(spark, "").collect()}
    assert [rows["mixed", k]["status"] for k in range(1, 5)] == ["settled", "deferred", "doubtful", "rolled"]
    assert "文档类型不同" in rows["mixed", 3]["conflict"]
    assert [rows["near", k]["status"] for k in range(1, 6)] == ["doubtful"] * 5
    counts = {r["pair_id"]: r for r in catalogue.reconcile_counts(spark, "").collect()}
    assert (counts["mixed"]["settled"], counts["mixed"]["missing"]) == (1, 0)
    assert (counts["silent"]["promises"], counts["silent"]["outcome"]) == (0, "no promise found")


def test_labelled_sentences(spark):
    """All labelled sentences fire as labelled, and no others."""
    assert tuple(catalogue.rule_precision(spark, "").first()) == (27, 0, 0, 1.0, 1.0)
    assert catalogue.match_leaks(spark, "").first()[0] == 0


CHECKED = ("line_sections", "sentence_flags_gaps", "issues_self_review", "report_gaps", "report_markdown", "document_metrics", "private_rows", "private_redacted", "turn_dedupe", "doc_benchmark_top2")


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    """The rows of the catalogue's queries and of their SQL, on the smallest tables."""
    sf_dir, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = catalogue.QUERIES[name](spark, sf_dir)
    want = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    rows = lambda some: sorted(repr(tuple(float(x) if hasattr(x, "as_tuple") else x for x in r)) for r in some)
    assert sorted(found.columns) == sorted(names)
    assert rows(found.select(*names).collect()) == rows(want.fetchall())


def test_lookaround_of_pseudo_precision(spark):
    """What SQL without lookaround cannot check."""
    cases = {"已约 30 人面谈": [], "预约 30 人": [], "约 12/30 完成": ["约 1"], "费用 30多数人": [], "工期 3 成交": [], "约 30 人": ["约 30"]}
    df = spark.createDataFrame([(t, t) for t in cases], "doc_id string, text string")
    found = {r["doc_id"]: list(r["pseudo"] or []) for r in A.audit(df, LEX).sentences.collect()}
    assert found == cases


def test_long_texts_without_blanks(spark):
    """A million characters in one run take linear time."""
    texts = ["a" * 1_000_000, "1" * 1_000_000, "a.b" * 300_000 + "@", "推进" * 300_000, "王老" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).cache()
    began = time.time()
    assert V.redact_table(df).where("n_replaced > 0").count() == 0
    assert A.audit(df, LEX).metrics.count() == 5
    items = df.select("doc_id", F.lit(1).cast("long").alias("ord"), F.col("text").alias("item"))
    assert R.scored(items, items, LEX).where("doc_id = 0").first()["score"] == 1.0
    assert time.time() - began < 60


def brute_similarity(a: str, b: str) -> float:
    from collections import Counter

    def grams(s, n):
        return [s[i : i + n] for i in range(len(s) - n + 1)]

    x, y = (Counter(grams(s, 2) if len(s) != 1 else [s]) for s in (a, b))
    if not a or not b:
        return 0.0
    common = sum((x & y).values())
    run = 0.25 if set(grams(a, 5)) & set(grams(b, 5)) else 0.1 if set(grams(a, 4)) & set(grams(b, 4)) else 0.0
    return min(1.0, max(common / x.total(), 2 * common / (x.total() + y.total())) + run)


def test_similarity_against_brute_force(spark):
    words = ["", "甲", "甲乙", "aab", "abab", "甲乙丙丁戊", "甲乙丙丁", "戊丁丙乙甲乙丙", "bcdabab"]
    pairs = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = df.withColumn("s", R.similarity(R.features(F.col("a"), LEX), R.features(F.col("b"), LEX)))
    for r in df.collect():
        assert r["s"] == pytest.approx(brute_similarity(r["a"], r["b"])), (r["a"], r["b"])


def test_dedupe_is_greedy(spark):
    items = spark.createDataFrame([("d", 1, "完成资料归档"), ("d", 2, "完成资料归档了"), ("d", 3, "组织体检")], "doc_id string, ord long, item string")
    assert sorted(r["ord"] for r in R.dedupe(items, LEX).collect()) == [1, 3]


def test_lexicon_contract(tmp_path):
    with pytest.raises(lexicon.LexiconError):
        lexicon.load("nowhere")
    with pytest.raises(lexicon.LexiconError):
        lexicon.load(path=str(tmp_path / "none.json"))
    words = dict(LEX.words)
    with pytest.raises(lexicon.LexiconError, match="ACTIVITY_VERBS"):
        lexicon.validate(words | {"ACTIVITY_VERBS": []})
    with pytest.raises(lexicon.LexiconError, match="步"):
        lexicon.validate(words | {"CN_NUM_UNITS": ["步"]})
    with pytest.raises(lexicon.LexiconError):
        lexicon.merge(words, {"add": {"NO_SUCH_LIST": ["x"]}})
    file = tmp_path / "own.json"
    file.write_text(json.dumps({"base": words, "profiles": {"p": {"add": {"CLICHE": ["飞轮"]}, "add_units": ["箱"]}}}))
    own = lexicon.load("p", str(file))
    assert "飞轮" in own["CLICHE"] and "箱" in own["NUM_UNITS"]
    assert "监考" in lexicon.load("school")["ACTIVITY_VERBS"]


def test_strict_and_compatible_patterns(spark):
    df = spark.createDataFrame([("下周计划：做事", "总结一下"), ("计划：做事", "写不出")], "a string, b string")
    loose, strict = LEX, lexicon.load(strict=True)
    inline = lambda lex: [r[0] for r in df.select(F.col("a").rlike(lex.pattern("inline_plan"))).collect()]
    meta = lambda lex: [r[0] for r in df.select(F.col("b").rlike(lex.pattern("meta"))).collect()]
    assert inline(loose) == [False, False] and inline(strict) == [True, True]
    assert meta(loose) == [True, True] and meta(strict) == [False, True]


def test_precision_and_thresholds(spark):
    fired = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "case_id string, type string")
    want = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "z")], "case_id string, type string")
    assert tuple(evaluate.precision_recall(fired, want).first()[:3]) == (2, 2, 1)
    assert tuple(evaluate.precision_recall(fired, want, strict=True).first()[:3]) == (1, 2, 2)
    assert evaluate.match_summary(catalogue.match_scores(spark, "")).first()["hits"] == 3
    best = catalogue.threshold_grid(spark, "").where("chosen").first()
    assert best["floor"] <= 0.55 and best["margin"] <= 0.26


def test_reports_render(docs):
    found = A.audit(docs, LEX, word_limit=500)
    assert report.audit_markdown(found).count() == docs.count()
    assert all(json.loads(r["json"])["metrics"]["verdict"] for r in report.audit_json(found).collect())


def test_read_and_write_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.md").write_bytes("﻿联系 13812345678".encode())
    (source / "b.md").write_bytes("完成归档".encode("gbk"))
    (source / "c.md").write_bytes(b" \n")
    before = spark.conf.get(reports.LEGACY[0], None)
    docs, errors = reports.read_reports(spark, str(source))
    assert spark.conf.get(reports.LEGACY[0], None) == before
    assert sorted(r["text"] for r in docs.collect()) == ["完成归档", "联系 13812345678"]
    assert errors.count() == 1
    reports.write_redacted(docs, str(tmp_path / "out"))
    reports.write_redacted_files(docs, str(tmp_path / "files"))
    (copy,) = (tmp_path / "files" / "name=a-脱敏").glob("*.txt")
    assert copy.read_text() == "联系 138****5678\n"
    assert "138****5678" in "".join(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_stream(spark, docs, tmp_path):
    from attestra.streaming.stream import audit_stream

    docs.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    audit_stream(stream, LEX, lambda df, n: seen.extend(df.collect()), str(tmp_path / "state")).awaitTermination()
    assert len(seen) == docs.count()
