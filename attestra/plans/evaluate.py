"""Evaluation: precision and recall of the rules, and thresholds of the matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..operators import reconcile as R

# Types that describe a whole document and are not compared with a labelled sentence.
WHOLE = ("文体缺件", "文体越界", "超篇幅", "文体未知")


def precision_recall(fired: DataFrame, expected: DataFrame, strict: bool = False) -> DataFrame:
    """Counts over cases: fired(case_id, type), expected(case_id, type), a row per occurrence.

    As the labels are read, an expected type repeated n times is n hits once it fired; ``strict``
    counts occurrences on both sides instead.
    """
    got = fired.where(~F.col("type").isin(*WHOLE)).groupBy("case_id", "type").agg(F.count("*").alias("got"))
    want = expected.groupBy("case_id", "type").agg(F.count("*").alias("want"))
    both = got.join(want, ["case_id", "type"], "full").na.fill(0)
    hit = F.least("got", "want") if strict else F.when(F.col("got") > 0, F.col("want")).otherwise(0)
    extra = F.greatest(F.col("got") - F.col("want"), F.lit(0)) if strict else F.when(F.col("want") == 0, F.col("got")).otherwise(0)
    sums = both.agg(F.sum(hit).alias("tp"), F.sum(extra).alias("fp"), F.sum(F.col("want") - hit).alias("fn"))
    sums = sums.na.fill(0)
    return sums.withColumns(
        {"precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))}
    )


def threshold_grid(spark: SparkSession, scores: DataFrame) -> DataFrame:
    """(floor, margin) on the grid [0.10, 0.60] x [0, 0.40] by 0.02 that separate
    scores(label, best, second) without error: positives reach floor and lead by margin, negatives do
    not; and whether the pair is the largest such. Grid values are integers divided by 50."""
    grid = spark.range(5, 31).select((F.col("id") / 50).alias("floor")).crossJoin(spark.range(0, 21).select((F.col("id") / 50).alias("margin")))
    accepted = (F.col("best") >= F.col("floor")) & (F.col("best") - F.col("second") >= F.col("margin"))
    wrong = F.count_if(accepted != (F.col("label") == 1))
    fit = grid.crossJoin(scores).groupBy("floor", "margin").agg(wrong.alias("errors")).where("errors = 0")
    top = fit.agg(F.max(F.struct("floor", "margin")).alias("top"))
    return fit.crossJoin(F.broadcast(top)).select("floor", "margin", (F.struct("floor", "margin") == F.col("top")).alias("chosen"))


def match_scores(cases: DataFrame, lex: Lexicon, num_match: str = "plain") -> DataFrame:
    """(case_id, label, best, second, lead, hit) of cases(case_id, promise, candidate, truth): the two best
    candidates of each promise, and whether the best is the true one. ``label`` is 1 where a case has a truth."""
    score = R.similarity(R.features(F.col("promise"), lex, num_match), R.features(F.col("candidate"), lex, num_match))
    rank = Window.partitionBy("case_id").orderBy(F.desc("score"), F.desc("candidate"))
    ranked = cases.withColumn("score", score).withColumn("nth", F.row_number().over(rank))
    out = ranked.groupBy("case_id").agg(
        F.max("truth").alias("label"),
        F.max(F.when(F.col("nth") == 1, F.col("score"))).alias("best"),
        F.coalesce(F.max(F.when(F.col("nth") == 2, F.col("score"))), F.lit(0.0)).alias("second"),
        F.max(F.when(F.col("nth") == 1, F.col("truth"))).alias("hit"),
    )
    return out.withColumn("lead", F.col("best") - F.col("second"))


def match_summary(scores: DataFrame) -> DataFrame:
    """One row: positives, how many hit, their least score and lead, the highest score and lead of negatives."""
    true, false = F.col("label") == 1, F.col("label") == 0
    return scores.agg(
        F.count_if(true).alias("positives"), F.count_if(true & (F.col("hit") == 1)).alias("hits"),
        F.min(F.when(true, F.col("best"))).alias("least_score"), F.min(F.when(true, F.col("lead"))).alias("least_lead"),
        F.max(F.when(false, F.col("best"))).alias("most_false_score"), F.max(F.when(false, F.col("lead"))).alias("most_false_lead"),
    )


def veto_coverage(near: DataFrame, lex: Lexicon) -> DataFrame:
    """(case_id, score, reason) of near misses(case_id, promise, decoy): every one should have a reason to be refused."""
    score = R.similarity(R.features(F.col("promise"), lex), R.features(F.col("decoy"), lex))
    return near.select("case_id", score.alias("score"), R.conflict(F.col("promise"), F.col("decoy"), lex).alias("reason"))


def leaks(scores: DataFrame, near: DataFrame, floor: float = R.FLOOR, lead: float = R.LEAD) -> DataFrame:
    """Cases that the shipped thresholds decide wrongly: negatives they accept, positives they refuse, and near
    misses (case_id, score, reason) that they accept without a veto."""
    accepted = (F.col("best") >= floor) & (F.col("lead") >= lead)
    wrong = scores.where(accepted != (F.col("label") == 1)).select("case_id", F.when(accepted, "accepted").otherwise("refused").alias("fault"))
    passed = near.where((F.col("score") >= floor) & F.col("reason").isNull()).select("case_id", F.lit("not vetoed").alias("fault"))
    return wrong.unionByName(passed)
