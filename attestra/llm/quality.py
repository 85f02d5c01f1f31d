"""Quality rules as weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) from counts over the whole text. The corpus is
aggregated to vote patterns (at most 3 to the number of rules), expectation-maximisation estimates
how good and bad documents vote and the share of good documents from these counts, and the posterior
probability of each pattern decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lean import small_table
from .store import read, stage
from .words import PLAIN_WORD, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
KEEP = 0.5  # posterior probability of a good document
ROUNDS = 60
WEIGHT = 20.0  # documents that each belief counts as, whatever the size of the corpus
SHARE = (9.0, 1.0)  # the same for good and bad documents
#: Beliefs before any document is seen: shares of votes bad, none and good, first among good and then
#: among bad documents. A symbol vote is strong evidence; the others bad documents mostly pass.
BELIEFS = {
    "length": ((0.06, 0.08, 0.86), (0.20, 0.10, 0.70)),
    "word_length": ((0.005, 0.02, 0.975), (0.10, 0.05, 0.85)),
    "symbols": ((0.002, 0.02, 0.978), (0.60, 0.10, 0.30)),
    "noise": ((0.0005, 0.9995, 0.0), (0.30, 0.70, 0.0)),
    "lines": ((0.02, 0.05, 0.93), (0.10, 0.05, 0.85)),
    "repeats": ((0.01, 0.04, 0.95), (0.30, 0.05, 0.65)),
    "sentences": ((0.04, 0.01, 0.95), (0.15, 0.05, 0.80)),
}
#: Good documents break these rules no more often than this. Where one rule alone marks the junk, votes
#: cannot tell a class of junk from good documents that break the rule, and the bound decides.
SELDOM = {"word_length": 0.005, "symbols": 0.002, "noise": 0.002}


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per row. A null text has no words, lines or symbols."""
    whole = F.coalesce(F.col("_text"), F.lit(""))
    with_word = F.filter(F.split(whole, "\n"), lambda s: s.rlike(PLAIN_WORD))
    frame = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    frame = frame.select(
        "_key",
        words("_text").alias("_w"),
        F.length(F.translate(whole, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        with_word.alias("_lines"),
        whole.rlike("[.!?]").alias("_ends"),
    )
    starts = F.sequence(F.lit(0), F.size("_w") - 3)
    window = F.transform(starts, lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    frame = frame.select(
        "_key",
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "_ends",
        F.when(F.size("_w") >= 3, window).otherwise(F.array().cast("array<bigint>")).alias("_win"),
    )
    # Only texts with a repeated window pay for sorting; equal hashes are neighbours then.
    order = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size("_win") > F.size(F.array_distinct("_win"))
    frame = frame.withColumn("_order", F.when(repeated, order))
    twice = F.filter(
        "_order",
        lambda s, i: (s["h"] == F.get(F.col("_order"), i - 1)["h"]) | (s["h"] == F.get(F.col("_order"), i + 1)["h"]),
    )
    at = F.sort_array(F.transform(twice, lambda s: s["i"]))
    frame = frame.select("_key", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "_ends", at.alias("_at"))
    # Positions covered by [a, a + 3) for each repeated window's start a.
    steps = F.zip_with(F.slice("_at", 1, F.greatest(F.size("_at") - 1, F.lit(0))), F.slice("_at", 2, F.size("_at")), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x) + 3
    return frame.select(
        "_key",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(F.size("_at") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        "n_lines",
        "_ends",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The labelling rules. All abstain on a text without words but the first."""
    n, some = F.col("n_words"), F.col("n_words") > 0
    mean = F.col("word_chars") / F.when(some, n)
    symbols = F.col("n_symbols") / F.when(some, n)
    lines = F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines"))
    repeats = F.col("n_repeat_words") / F.when(some, n)
    return {
        "length": _vote(n < 50, n >= 100),
        "word_length": _vote((mean < 2.5) | (mean > 14), (mean >= 3) & (mean <= 12)),
        "symbols": _vote(symbols > 0.1, symbols <= 0.02),
        "noise": _vote(symbols > 0.5, F.lit(False)),
        "lines": _vote(lines > 0.3, lines <= 0.1),
        "repeats": _vote(repeats > 0.5, repeats <= 0.25),
        "sentences": _vote(some & ~F.col("_ends"), some & F.col("_ends")),
    }


@dataclass
class Model:
    """Share of good documents and, per rule, the shares of votes bad, none and good among good and bad ones."""

    share: float
    votes: list[tuple[list[float], list[float]]]

    def posterior(self, pattern: tuple[int, ...]) -> float:
        odds = math.log1p(-self.share) - math.log(self.share)
        for vote, (good, bad) in zip(pattern, self.votes, strict=True):
            odds += math.log(bad[vote + 1]) - math.log(good[vote + 1])
        return 1 / (1 + math.exp(max(-700.0, min(700.0, odds))))


def _shares(tally: list[float], seldom: float = 1.0) -> list[float]:
    """The tally as shares above zero, the first of them ``seldom`` at most."""
    total = sum(tally) + 3e-6
    bad, *others = ((x + 1e-6) / total for x in tally)
    held = min(bad, seldom)
    return [held, *(x * (1 - held) / (1 - bad) for x in others)]


def fit(counts: dict[tuple[int, ...], int]) -> Model:
    """Expectation-maximisation over vote patterns; the beliefs keep it defined on any input."""
    seldom = [SELDOM.get(rule, 1.0) for rule in BELIEFS]
    model = Model(SHARE[0] / sum(SHARE), [(_shares(list(g), s), _shares(list(b))) for (g, b), s in zip(BELIEFS.values(), seldom, strict=True)])
    for _ in range(ROUNDS):
        share_good, total = SHARE[0], sum(SHARE)
        tally = [([WEIGHT * x for x in g], [WEIGHT * x for x in b]) for g, b in BELIEFS.values()]
        for pattern, n in counts.items():
            p = model.posterior(pattern)
            share_good += n * p
            total += n
            for k, vote in enumerate(pattern):
                tally[k][0][vote + 1] += n * p
                tally[k][1][vote + 1] += n * (1 - p)
        model = Model(share_good / total, [(_shares(g, s), _shares(b)) for (g, b), s in zip(tally, seldom, strict=True)])
    return model


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, counts, base_failed, kept, and the posterior probability ``p_good``.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged each
    and all count in the statistics; null keys are kept; other columns are ignored; an empty
    table gives an empty result.
    """
    rules = votes()
    named = [v.cast("int").alias(f"_v{k}") for k, v in enumerate(rules.values())]
    seen = stage(features(docs, key, text).select("*", *named), "votes")
    cast = [f"_v{k}" for k in range(len(rules))]
    counts = {tuple(r[c] for c in cast): r["count"] for r in seen.groupBy(*cast).count().collect()}  # at most 3 ** len(rules)
    model = fit(counts)
    table = small_table(
        docs.sparkSession, [(*pattern, model.posterior(pattern)) for pattern in counts], ", ".join(f"{c} int" for c in cast) + ", p_good double"
    )
    out = seen.join(F.broadcast(table), cast)
    return out.select(
        F.col("_key").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & (F.col("p_good") >= KEEP)).alias("kept"),
        "p_good",
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))
