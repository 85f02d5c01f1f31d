"""Queries of the reference operators on the driver's tables and on small Chinese reports, with SQL
that computes the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..operators import audit as A
from ..operators import prioritize as P
from ..operators import privacy as V
from ..operators import reconcile as R
from . import evaluate, oracle, report
from . import fixtures as X

SENTENCE = r"[。！？!?；;\n]+"


@cache
def _lexicon() -> lexicon.Lexicon:
    return lexicon.load()


@cache
def _latin() -> lexicon.Lexicon:
    """The lexicon for the driver's prose."""
    words = {k: v.split() for k, v in X.LATIN.items()} | {"DOC_TYPE_FAMILIES": [("thonti", "inerth"), ("enan", "erea"), ("ndsh",)]}
    lexicon.validate(words)
    return lexicon.Lexicon(words, "latin")


def _reports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(X.REPORTS.items()), "doc_id string, text string")


def _sql_texts_reports() -> str:
    return oracle.values(list(X.REPORTS.items()), "doc_id, text")


def _texts(spark: SparkSession) -> DataFrame:
    """The reports and the labelled sentences, each as a document."""
    return spark.createDataFrame([*X.REPORTS.items(), *((c, t) for c, _, t, _ in X.CASES)], "doc_id string, text string")


def _pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in X.PAIRS.items()], "pair_id string, prev_text string, current_text string")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _documents(spark, sf_dir, "conversations")
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.concat(F.lit("# "), "role", F.lit("\n"), "text").alias("text"))


def _documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """An input table; one with fewer splits than cores is dealt out, which a large one never is."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.sentences_of(F.coalesce("text", F.lit("")))
    return _documents(spark, sf_dir).select(
        "doc_id", F.size(found).alias("n_sentences"), T.cn_len(F.coalesce("text", F.lit(""))).alias("word_count"), F.size(T.clauses_of(F.coalesce("text", F.lit("")))).alias("n_clauses")
    )


LIMIT = 60  # characters, short enough for some reports to be too long


def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the reports with the heading they stand under."""
    return T.lines(_reports(spark))


def turn_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations as a report of its own, its role as the heading: lines and characters."""
    rows = T.lines(_turns(spark, sf_dir)).where("heading IS NULL AND line != ''")
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reports(spark).select("doc_id", F.posexplode(T.blocks_of(T.flat(F.col("text")))).alias("nth", "b"))
    return rows.select("doc_id", "nth", "b.section", "b.block")


FLAGS = ("plan", "action", "result", "num", "followup", "acts", "results", "pending", "risk", *oracle.ISSUE_FLAGS)


def _flags(tags: DataFrame) -> DataFrame:
    lists = [F.coalesce(F.array_join(c, "/"), F.lit("")).alias(c) for c in ("vague", "pseudo")]
    return tags.select("doc_id", "sent_no", "s", "skip", *FLAGS, *lists, "praise", "unwindowed", "ratio")


def sentence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(A.audit(_texts(spark), _lexicon()).sentences)


def sentence_flags_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(A.audit(_texts(spark), _lexicon(), mode="gaps").sentences)


def document_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by document of all documents under a Latin lexicon."""
    tags = A.audit(_documents(spark, sf_dir), _latin(), style="review").sentences
    names = ("plan", "action", "result", "num", "followup", "risk", *oracle.ISSUE_FLAGS)
    return tags.groupBy("doc_id").agg(F.count("*").alias("n"), *[F.count_if(F.col(c)).alias(c) for c in names], F.sum("acts").alias("acts"), F.sum("results").alias("results"))


def _numbered(found: A.Audit) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return found.issues.select("doc_id", nth.alias("nth"), "type", "text", "detail", "ask")


STYLED = {"": 0, "weekly": LIMIT, "monthly": 0, "review": 0, "self-review": 0, "pitch": 0, "haiku": 0}


def _issues_of(style: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _numbered(A.audit(_texts(spark), _lexicon(), style=style, word_limit=STYLED[style]))

    return run


def issues_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(A.audit(_texts(spark), _lexicon(), mode="gaps"))


def issues_school(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under another profile and the strict patterns."""
    return _numbered(A.audit(_texts(spark), lexicon.load("school", strict=True), mode="gaps"))


def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit(_texts(spark), _lexicon(), word_limit=LIMIT).metrics


def report_metrics_self_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit(_texts(spark), _lexicon(), style="self-review").metrics


def report_metrics_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit(_texts(spark), _lexicon(), mode="gaps").metrics


def document_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit over all documents."""
    found = A.audit(_documents(spark, sf_dir).select("doc_id", "text"), _lexicon())
    return found.metrics.select("doc_id", "word_count", "sentence_count", "idle_rate", "density", "n_private_blocking", "n_issues", "score", "verdict")


def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of all documents under a Latin lexicon."""
    return A.audit(_documents(spark, sf_dir), _latin(), style="review").metrics


RANKED = ("doc_id", "place", "bucket", "type", "text", "weight", "also")


def report_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = P.prioritize(A.audit(_texts(spark), _lexicon(), mode="gaps").issues).withColumn("also", F.array_join("also", "/"))
    return ranked.select(*RANKED, "ask")


def document_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to ask first about each document, under a Latin lexicon."""
    ranked = P.prioritize(A.audit(_documents(spark, sf_dir), _latin(), mode="gaps").issues, top=3).withColumn("also", F.array_join("also", "/"))
    return ranked.select(*RANKED)


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.audit_markdown(A.audit(_texts(spark), _lexicon(), word_limit=LIMIT), private=V.detect(_texts(spark)))


def gaps_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.audit_markdown(A.audit(_texts(spark), _lexicon(), mode="gaps"), mode="gaps", top=3)


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values read back from the JSON reports."""
    made = report.audit_json(A.audit(_texts(spark), _lexicon(), word_limit=LIMIT), private=V.detect(_texts(spark)))
    at = lambda path, kind: F.get_json_object("json", path).cast(kind)
    size = lambda path: F.coalesce(F.json_array_length(F.get_json_object("json", path)), F.lit(0))
    return made.select(
        "doc_id", at("$.mode", "string").alias("mode"), at("$.metrics.score", "int").alias("score"), at("$.metrics.verdict", "string").alias("verdict"),
        at("$.metrics.idle_rate", "double").alias("idle_rate"), size("$.issues").alias("n_issues"), at("$.issues[0].type", "string").alias("first_issue"),
        size("$.top").alias("n_top"), size("$.pii.block").alias("n_block"), size("$.pii.warn").alias("n_warn"),
    )


def private_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every kind in every document."""
    rows = V.detect(_documents(spark, sf_dir).select("doc_id", "text"))
    counts = rows.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == kind).alias(f"n_{k}") for k, (kind, _, _) in enumerate(V.KINDS)])
    return _documents(spark, sf_dir).select("doc_id").join(counts, "doc_id", "left").na.fill(0)


def private_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _texts(spark).unionByName(_documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("seq"))
    return V.detect(every).select("doc_id", "kind", nth.alias("nth"), "fragment", "blocking")


def private_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.redact_table(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.md5("text").alias("masked"), "n_replaced")


def report_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.redact_table(_texts(spark)).select("doc_id", "text", "n_replaced")


def quality_by_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit figures by quality label."""
    counts = A.audit(_documents(spark, sf_dir), _latin(), style="review").metrics
    labels = _documents(spark, sf_dir, "labels")
    sums = [F.sum(c).alias(c) for c in ("n_issues", "n_idle", "n_vague", "n_private_blocking", "score")]
    return labels.join(counts, "doc_id").groupBy("quality").agg(F.count("*").alias("n_docs"), *sums)


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation as items."""
    return _documents(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("text").alias("item"))


def report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commitments and evidence of the pairs' reports, before near copies go."""
    prev, current = (_pairs(spark).select(F.col("pair_id").alias("doc_id"), F.col(c).alias("text")) for c in ("prev_text", "current_text"))
    some = [R.extract(d, _lexicon(), p).select("doc_id", F.lit(k).alias("pool"), "ord", "item") for k, (d, p) in {"promise": (prev, True), "evidence": (current, False), "plan": (current, True)}.items()]
    return some[0].unionByName(some[1]).unionByName(some[2])


def turn_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation without those too similar to an earlier kept one."""
    return R.dedupe(_prose(spark, sf_dir), _lexicon(), "plain").select("doc_id", "ord")


def benchmark_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every benchmark item covers every other, both ways; pairs that share nothing are left out."""
    items = _documents(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("item"))
    found = R.scored(items, items, _lexicon(), "plain", on=())
    return found.where("ord_a != ord_b").select(F.col("ord_a").alias("a"), F.col("ord_b").alias("b"), "score")


def doc_benchmark_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two benchmark items that each document covers best."""
    return R.best_of(_documents(spark, sf_dir), _documents(spark, sf_dir, "benchmark"), _lexicon(), "plain")


def reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reconcile(_pairs(spark), _lexicon())


def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts(R.reconcile(_pairs(spark), _lexicon()), _pairs(spark))


def reconcile_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.reconcile_markdown(R.reconcile(_pairs(spark), _lexicon()), _pairs(spark))


def reconcile_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as promises, held against the turn that follows it, under a Latin lexicon."""
    t = _documents(spark, sf_dir, "conversations")
    ahead = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.concat(F.lit("# "), "role", F.lit("\n"), "text").alias("current_text"))
    both = t.where("role = 'user'").join(ahead, ["conv_id", "turn"])
    pairs = both.select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), F.concat(F.lit("# user\n"), "text").alias("prev_text"), "current_text")
    return R.reconcile(pairs, _latin()).select("pair_id", "promise_no", "status", "score", "matched", "conflict", "also_planned")


def match_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near misses with their scores and why they are refused."""
    return evaluate.veto_coverage(spark.createDataFrame(list(X.NEAR), "case_id string, promise string, decoy string"), _lexicon())


def _matches(spark: SparkSession) -> DataFrame:
    return evaluate.match_scores(spark.createDataFrame(list(X.MATCHES), "case_id string, promise string, candidate string, truth int"), _lexicon())


def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark)


def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.match_summary(_matches(spark))


def match_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cases the shipped thresholds decide wrongly."""
    return evaluate.leaks(_matches(spark), match_conflicts(spark, sf_dir)).agg(F.count("*").alias("n_leaks"))


def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_grid(spark, spark.createDataFrame(list(X.SCORES), "label int, best double, second double"))


def rule_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of the rules on the labelled sentences."""
    fired = None
    for mode in ("final", "gaps"):
        cases = spark.createDataFrame([(c, t) for c, m, t, _ in X.CASES if m == mode], "doc_id string, text string")
        some = A.audit(cases, _lexicon(), mode=mode).issues.select(F.col("doc_id").alias("case_id"), "type")
        fired = some if fired is None else fired.unionByName(some)
    want = spark.createDataFrame([(c, t) for c, _, _, types in X.CASES for t in types], "case_id string, type string")
    return evaluate.precision_recall(fired, want)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        sentence_counts, line_sections, turn_sections, report_blocks, sentence_flags, sentence_flags_gaps, document_flags, issues_gaps, issues_school, report_metrics, report_metrics_self_review,
        report_metrics_gaps, document_audit, document_metrics, report_gaps, document_gaps, report_markdown, gaps_markdown, report_json, private_hits, private_rows, private_redacted, report_redacted,
        quality_by_audit, report_items, turn_dedupe, benchmark_similarity, doc_benchmark_top2, reconcile_status, reconcile_counts, reconcile_markdown, reconcile_turns, match_conflicts, match_scores,
        match_summary, match_leaks, threshold_grid, rule_precision,
    )
} | {"issues" + f"_{style}".rstrip("_").replace("-", "_"): _issues_of(style) for style in STYLED}

_STRIP = r"regexp_replace({x}, '^[\s\x1C-\x1F\x85\p{{Z}}]+|[\s\x1C-\x1F\x85\p{{Z}}]+$', '', 'g')"


def _sql_texts() -> str:
    return oracle.values([*X.REPORTS.items(), *((c, t) for c, _, t, _ in X.CASES)], "doc_id, text")


def _sql_pairs() -> str:
    return oracle.values([(k, *v) for k, v in X.PAIRS.items()], "pair_id, prev_text, current_text")


TURNS = "(SELECT conv_id || '-' || turn AS doc_id, '# ' || role || chr(10) || text AS text FROM conversations)"
TURN_PAIRS = """(SELECT x.conv_id || '-' || x.turn AS pair_id, '# user' || chr(10) || x.text AS prev_text, '# ' || y.role || chr(10) || y.text AS current_text
  FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1 WHERE x.role = 'user')"""
_ALL_TEXTS = "(SELECT doc_id, text FROM {} UNION ALL SELECT doc_id::VARCHAR, text FROM documents)"


def _sql_flags(mode: str) -> str:
    lists = ", ".join(f"array_to_string({c}, '/') AS {c}" for c in ("vague", "pseudo"))
    return f"WITH {oracle.tag_ctes(_sql_texts(), _lexicon(), mode)} SELECT doc_id, sent_no, s, skip, {', '.join(FLAGS)}, {lists}, praise, unwindowed, ratio FROM tags"


def _sql_issues(lex: lexicon.Lexicon, mode: str = "final", style: str = "", limit: int = 0) -> str:
    return f"WITH {oracle.issue_ctes(_sql_texts(), lex, mode, style, limit)} SELECT doc_id, nth, type, text, detail, {oracle.asked()} AS ask FROM issues"


def _sql_metrics(mode: str = "final", style: str = "", limit: int = 0) -> str:
    return f"WITH {oracle.metric_ctes(_sql_texts(), _lexicon(), mode, style, limit)} SELECT * FROM metrics"


def _sql_hits(source: str) -> str:
    parts = [f"SELECT doc_id, {k} AS k, {oracle.quote(V.KINDS[k][0])} AS kind, generate_subscripts({x}, 1) AS nth, {'substr(unnest(' + x + '), 1, 24)' if V.KINDS[k][2] else 'unnest(' + x + ')'} AS fragment, {str(V.KINDS[k][2]).lower()} AS blocking FROM src" for k, x in enumerate(oracle.private_lists())]
    return f"src AS (SELECT doc_id, coalesce(text, '') AS text FROM {source}), hits AS ({' UNION ALL '.join(parts)})"


def _sql_markdown() -> str:
    names = [c for c in report.METRIC_LINES]
    head = " || chr(10) || ".join(f"'- {c}: ' || {c}::VARCHAR" for c in names)
    return f"""WITH {oracle.metric_ctes(_sql_texts(), _lexicon(), 'final', '', LIMIT)},
h AS (SELECT doc_id, {head} AS head FROM metrics),
d AS (SELECT doc_id, type, text, {oracle.asked()} AS ask, min(nth) AS nth FROM issues GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS k FROM d),
f AS (SELECT doc_id, string_agg('- [' || type || '] ' || substr(text, 1, 46) || ' → ' || ask, chr(10) ORDER BY k) AS body FROM e WHERE k <= {report.ISSUES} GROUP BY doc_id),
{_sql_hits(_sql_texts()).replace('src AS', 'src2 AS').replace('FROM src)', 'FROM src2)').replace('FROM src ', 'FROM src2 ')},
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, nth) AS n FROM hits),
n AS (SELECT doc_id, string_agg('- ' || CASE WHEN blocking THEN '!' ELSE '?' END || ' ' || kind || ': ' || fragment, chr(10) ORDER BY n) AS notes FROM g WHERE n <= {report.NOTES} GROUP BY doc_id)
SELECT doc_id, concat_ws(chr(10) || chr(10), head, body, notes) AS markdown FROM h LEFT JOIN f USING (doc_id) LEFT JOIN n USING (doc_id)"""


def _sql_gaps_markdown() -> str:
    names = [c for c in report.METRIC_LINES if c not in ("score", "verdict")]
    head = " || chr(10) || ".join(f"'- {c}: ' || {c}::VARCHAR" for c in names)
    return f"""WITH {oracle.metric_ctes(_sql_texts(), _lexicon(), 'gaps')}, {oracle.ranked_cte(3)},
h AS (SELECT doc_id, {head} AS head FROM metrics),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bucket ORDER BY place) AS later FROM ranked),
f AS (SELECT doc_id, string_agg('- [' || type || '] ' || substr(text, 1, 60) || ' → ' || {oracle.asked()}, chr(10) ORDER BY place) AS body
  FROM r WHERE bucket != 'rest' OR later <= {report.REST} GROUP BY doc_id)
SELECT doc_id, concat_ws(chr(10) || chr(10), head, body) AS markdown FROM h LEFT JOIN f USING (doc_id)"""


def _sql_json() -> str:
    private = oracle.private_lists()
    size = lambda b: " + ".join(f"len({x})" for x, k in zip(private, V.KINDS, strict=True) if k[2] == b)
    return f"""WITH {oracle.metric_ctes(_sql_texts(), _lexicon(), 'final', '', LIMIT)}, {oracle.ranked_cte()},
f AS (SELECT doc_id, arg_min(type, nth) AS first_issue, count(*)::INT AS n FROM issues GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::INT AS n_top FROM ranked WHERE bucket = 'asked' GROUP BY doc_id)
SELECT doc_id, 'final' AS mode, score, verdict, idle_rate, coalesce(n, 0) AS n_issues, first_issue, coalesce(n_top, 0) AS n_top, ({size(True)})::INT AS n_block, ({size(False)})::INT AS n_warn
FROM metrics JOIN src USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _sql_recon(source: str, lex: lexicon.Lexicon, tail: str) -> str:
    return f"WITH RECURSIVE {oracle.reconcile_ctes(source, lex)} {tail}"


def _sql_matches(tail: str) -> str:
    rows = oracle.values(X.MATCHES, "case_id, promise, candidate, truth")
    return f"""WITH {oracle.similarity_ctes(f"SELECT *, promise AS ta, candidate AS tb FROM {rows}", _lexicon(), "plain", "sim")},
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, candidate DESC) AS n FROM sim),
m AS (SELECT case_id, max(truth)::INT AS label, max(score) FILTER (WHERE n = 1) AS best, coalesce(max(score) FILTER (WHERE n = 2), 0.0) AS second, (max(truth) FILTER (WHERE n = 1))::INT AS hit FROM r GROUP BY case_id),
s AS (SELECT *, best - second AS lead FROM m) {tail}"""


def _sql_near(tail: str) -> str:
    rows = oracle.values(X.NEAR, "case_id, promise, decoy")
    return f"""near AS (SELECT case_id, score, reason FROM (WITH {oracle.similarity_ctes(f"SELECT *, promise AS ta, decoy AS tb FROM {rows}", _lexicon(), "unit", "nsim")}
SELECT *, {oracle.conflict('promise', 'decoy', _lexicon())} AS reason FROM nsim)) {tail}"""


def _sql_precision() -> str:
    fired = " UNION ALL ".join(
        f"(WITH {oracle.issue_ctes(oracle.values([(c, t) for c, m, t, _ in X.CASES if m == mode], 'doc_id, text'), _lexicon(), mode)} SELECT doc_id AS case_id, type FROM issues)" for mode in ("final", "gaps")
    )
    want = oracle.values([(c, t) for c, _, _, types in X.CASES for t in types], "case_id, type")
    return f"""WITH fired AS ({fired}), g AS (SELECT case_id, type, count(*) AS got FROM fired WHERE type NOT IN {evaluate.WHOLE} GROUP BY ALL), w AS (SELECT case_id, type, count(*) AS want FROM {want} GROUP BY ALL),
b AS (SELECT coalesce(got, 0) AS got, coalesce(want, 0) AS want FROM g FULL JOIN w USING (case_id, type)),
c AS (SELECT sum(CASE WHEN got > 0 THEN want ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN want = 0 THEN got ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN got > 0 THEN 0 ELSE want END)::BIGINT AS fn FROM b)
SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM c"""


def _sql_items() -> str:
    prev, current = (f"(SELECT pair_id AS doc_id, {c} AS text FROM {_sql_pairs()})" for c in ("prev_text", "current_text"))
    ctes = [oracle.item_ctes(s, _lexicon(), p, n) for s, p, n in ((prev, True, "pr"), (current, False, "ev"), (current, True, "rl"))]
    return "WITH " + ",\n".join(ctes) + " SELECT doc_id, 'promise' AS pool, ord, item FROM pr UNION ALL SELECT doc_id, 'evidence', ord, item FROM ev UNION ALL SELECT doc_id, 'plan', ord, item FROM rl"


_FLAG_SUMS = ", ".join(f"count(*) FILTER (WHERE {c}) AS {c}" for c in ("plan", "action", "result", "num", "followup", "risk", *oracle.ISSUE_FLAGS))
_RANKED = ", ".join(RANKED)

#: Top two items by document, grams counted once for each text.
TOP2 = r"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
n AS (SELECT side, id, text, {n} AS s FROM t),
g AS (SELECT side, id, 2 AS kind, unnest(CASE WHEN length(s) = 1 THEN [s] ELSE list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) END) AS gram FROM n
  UNION ALL SELECT side, id, 4, unnest(list_transform(range(1, length(s) - 2), lambda i: substr(s, i, 4))) FROM n
  UNION ALL SELECT side, id, 5, unnest(list_transform(range(1, length(s) - 3), lambda i: substr(s, i, 5))) FROM n
  UNION ALL SELECT side, id, 0, unnest(regexp_extract_all(text, '\p{{Nd}}+(?:\.\p{{Nd}}+)?')) FROM n),
c AS (SELECT side, id, kind, gram, count(*) AS c FROM g GROUP BY ALL),
z AS (SELECT side, id, sum(c)::DOUBLE AS z FROM c WHERE kind = 2 GROUP BY ALL),
m AS (SELECT b.id AS item_id, d.id AS doc_id, coalesce(sum(least(b.c, d.c)) FILTER (WHERE d.kind = 2), 0)::DOUBLE AS common, max(d.kind) AS run, bool_or(d.kind = 0) AS number
  FROM c b JOIN c d ON b.side = 'b' AND d.side = 'd' AND b.kind = d.kind AND b.gram = d.gram GROUP BY ALL),
s AS (SELECT doc_id, item_id, least(1.0::DOUBLE, greatest(common / zb.z, 2 * common / (zb.z + zd.z)) + CASE run WHEN 5 THEN 0.25::DOUBLE WHEN 4 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN number THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM m JOIN z zb ON zb.side = 'b' AND zb.id = item_id JOIN z zd ON zd.side = 'd' AND zd.id = doc_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id))::INT AS place FROM s)
SELECT doc_id, place, item_id, score FROM r WHERE place <= 2"""

ORACLES: dict[str, str] = {
    "sentence_counts": rf"""SELECT doc_id,
  len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '{SENTENCE}'), lambda x: {_STRIP.format(x="x")}), lambda x: length(x) >= 4))::INT AS n_sentences,
  length(regexp_replace(coalesce(text, ''), '[\s\x0B\x1C-\x1F\x85\p{{Z}}]+', '', 'g'))::INT AS word_count,
  len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[，、,]'), lambda x: {_STRIP.format(x="x")}), lambda x: length(x) >= 3))::INT AS n_clauses
  FROM documents""",
    "line_sections": f"WITH {oracle.line_ctes(_sql_texts_reports())} SELECT doc_id, line_no, CASE WHEN heading IS NULL THEN line ELSE '# ' || heading END AS line, heading, section FROM ln",
    "turn_sections": f"WITH {oracle.line_ctes(TURNS)} SELECT doc_id, section, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM ln WHERE heading IS NULL AND line != '' GROUP BY ALL",
    "report_blocks": f"WITH {oracle.line_ctes(_sql_texts_reports())},\n{oracle.rating_cte(_lexicon())} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block_no) - 1)::INT AS nth, section, b AS block FROM b1",
    "sentence_flags": _sql_flags("final"),
    "sentence_flags_gaps": _sql_flags("gaps"),
    "document_flags": f"WITH {oracle.tag_ctes('documents', _latin(), 'final', 'review')} SELECT doc_id, count(*) AS n, {_FLAG_SUMS}, sum(acts)::BIGINT AS acts, sum(results)::BIGINT AS results FROM tags GROUP BY doc_id",
    "issues_gaps": _sql_issues(_lexicon(), "gaps"),
    "issues_school": _sql_issues(lexicon.load("school", strict=True), "gaps"),
    "report_metrics": _sql_metrics(limit=LIMIT),
    "report_metrics_self_review": _sql_metrics(style="self-review"),
    "report_metrics_gaps": _sql_metrics("gaps"),
    "document_audit": f"WITH {oracle.metric_ctes('documents', _lexicon())} SELECT doc_id, word_count, sentence_count, idle_rate, density, n_private_blocking, n_issues, score, verdict FROM metrics",
    "document_metrics": f"WITH {oracle.metric_ctes('documents', _latin(), 'final', 'review')} SELECT * FROM metrics",
    "report_gaps": f"WITH {oracle.issue_ctes(_sql_texts(), _lexicon(), 'gaps')}, {oracle.ranked_cte()} SELECT {_RANKED}, {oracle.asked()} AS ask FROM ranked",
    "document_gaps": f"WITH {oracle.issue_ctes('documents', _latin(), 'gaps')}, {oracle.ranked_cte(3)} SELECT {_RANKED} FROM ranked",
    "report_markdown": _sql_markdown(),
    "gaps_markdown": _sql_gaps_markdown(),
    "report_json": _sql_json(),
    "private_hits": "SELECT doc_id, " + ", ".join(f"len({x})::BIGINT AS n_{k}" for k, x in enumerate(oracle.private_lists())) + " FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "private_rows": f"WITH {_sql_hits(_ALL_TEXTS.format(_sql_texts()))} SELECT doc_id, kind, nth::INT AS nth, fragment, blocking FROM hits",
    "private_redacted": f"SELECT doc_id, md5(text) AS masked, n_replaced FROM ({oracle.redacted('documents')})",
    "report_redacted": f"SELECT doc_id, text, coalesce(n_replaced, 0) AS n_replaced FROM ({oracle.redacted(_sql_texts())})",
    "quality_by_audit": f"WITH {oracle.metric_ctes('documents', _latin(), 'final', 'review')} SELECT quality, count(*) AS n_docs, sum(n_issues)::BIGINT AS n_issues, sum(n_idle)::BIGINT AS n_idle, sum(n_vague)::BIGINT AS n_vague, sum(n_private_blocking)::BIGINT AS n_private_blocking, sum(score)::BIGINT AS score FROM labels JOIN metrics USING (doc_id) GROUP BY quality",
    "report_items": _sql_items(),
    "turn_dedupe": f"WITH RECURSIVE turns AS (SELECT conv_id AS doc_id, turn AS ord, text AS item FROM conversations),\n{oracle.dedupe_ctes('turns', _lexicon(), 'plain', 'kept')} SELECT doc_id, ord FROM kept",
    "benchmark_similarity": "WITH " + oracle.similarity_ctes("SELECT x.item_id AS a, y.item_id AS b, x.text AS ta, y.text AS tb FROM benchmark x JOIN benchmark y ON x.item_id != y.item_id", _lexicon(), "plain", "sim") + " SELECT a, b, score FROM sim WHERE score > 0",
    "doc_benchmark_top2": TOP2.format(n=oracle.normal("text")),
    "reconcile_status": _sql_recon(_sql_pairs(), _lexicon(), "SELECT * FROM recon"),
    "reconcile_counts": _sql_recon(_sql_pairs(), _lexicon(), f"SELECT p.pair_id, count(status) AS promises, {', '.join(f'count(*) FILTER (WHERE status = {oracle.quote(x)}) AS {x}' for x in report.STATUSES)}, CASE WHEN count(status) = 0 THEN 'no promise found' ELSE 'compared' END AS outcome FROM {_sql_pairs()} p LEFT JOIN recon USING (pair_id) GROUP BY p.pair_id"),
    "reconcile_markdown": _sql_recon(_sql_pairs(), _lexicon(), f""", ln2 AS (SELECT pair_id, string_agg('- ' || status || ': ' || promise || ' → ' || matched || coalesce('（' || conflict || '）', ''), chr(10) ORDER BY list_position({list(report.STATUSES)}, status), promise_no) AS body FROM recon GROUP BY pair_id),
c AS (SELECT p.pair_id, count(status) AS promises, {', '.join(f'count(*) FILTER (WHERE status = {oracle.quote(x)}) AS {x}' for x in report.STATUSES)} FROM {_sql_pairs()} p LEFT JOIN recon USING (pair_id) GROUP BY p.pair_id)
SELECT pair_id, concat_ws(chr(10) || chr(10), {" || ', ' || ".join(f"'{x} ' || {x}" for x in report.STATUSES)}, body, CASE WHEN promises = 0 THEN '上期没有可核对的承诺' WHEN missing + doubtful = 0 THEN '全部承诺有据可查' ELSE '仍有承诺待核实' END) AS markdown FROM c LEFT JOIN ln2 USING (pair_id)"""),
    "reconcile_turns": _sql_recon(TURN_PAIRS, _latin(), "SELECT pair_id, promise_no, status, score, matched, conflict, also_planned FROM recon"),
    "match_conflicts": "WITH " + _sql_near("SELECT * FROM near"),
    "match_scores": _sql_matches("SELECT case_id, label, best, second, hit, lead FROM s"),
    "match_summary": _sql_matches("SELECT count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 1 AND hit = 1) AS hits, min(best) FILTER (WHERE label = 1) AS least_score, min(lead) FILTER (WHERE label = 1) AS least_lead, max(best) FILTER (WHERE label = 0) AS most_false_score, max(lead) FILTER (WHERE label = 0) AS most_false_lead FROM s"),
    "match_leaks": _sql_matches(", " + _sql_near(f"SELECT (SELECT count(*) FROM s WHERE (best >= {R.FLOOR} AND lead >= {R.LEAD}) != (label = 1)) + (SELECT count(*) FROM near WHERE score >= {R.FLOOR} AND reason IS NULL) AS n_leaks")),
    "rule_precision": _sql_precision(),
    "threshold_grid": """
WITH s(label, best, second) AS (VALUES (1, 0.84::DOUBLE, 0.2::DOUBLE), (1, 0.55::DOUBLE, 0.3::DOUBLE), (0, 0.3::DOUBLE, 0.28::DOUBLE), (0, 0.12::DOUBLE, 0.0::DOUBLE)),
g AS (SELECT a.range / 50.0::DOUBLE AS floor, b.range / 50.0::DOUBLE AS margin FROM range(5, 31) a, range(0, 21) b),
f AS (SELECT floor, margin FROM g, s GROUP BY ALL HAVING count(*) FILTER (WHERE (best >= floor AND best - second >= margin) != (label = 1)) = 0)
SELECT floor, margin, row_number() OVER (ORDER BY floor DESC, margin DESC) = 1 AS chosen FROM f""",
} | {"issues" + f"_{style}".rstrip("_").replace("-", "_"): _sql_issues(_lexicon(), style=style, limit=STYLED[style]) for style in STYLED}
