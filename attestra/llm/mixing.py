"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow whose documents come in a fixed pseudo-random order, round after round
(at most three). A document's virtual finish time is the source's cumulative size up to and
including it, divided by the source's target. Ordering all copies by that time and cutting at
the total budget serves every source in proportion to its target.

Cumulative sums never put a source into one task: documents fall into buckets by hash, sums of
buckets are accumulated per source, and only then is the sum within a bucket added. The cut works
the same way: copies are summed in slices of virtual time, the slice in which the budget runs out is cut into
slices again, and only a slice of few copies is ordered copy by copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lean import small_table
from .store import read, stage
from .words import PLAIN_WORD

WEIGHTS = (1, 2, 3)
MOST = 3  # rounds through a source
ROWS_PER_BUCKET = 2_500
BUCKETS_PER_GROUP = 1 << 12  # buckets whose sums are accumulated in one task
SLICES = 1 << 12
FEW = 1_000  # copies of a slice that are ordered in one task
LEVELS = 4  # slicings at most; SLICES ** LEVELS is finer than a double's digits


def targets(sizes: dict[str | None, int], weights: Sequence[int] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Share of the total size per source, by weight, at most ``most`` times its own size.

    Sources are taken by code point, null last, and weigh ``weights`` in turn. The water level
    (size per unit of weight) is found by going through the sources from the first to hit its
    limit; all left below share what remains by weight.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, share, out = sum(sizes.values()), sum(weigh.values()), {}
    rank = {s: i for i, s in enumerate(names)}
    for s in sorted(names, key=lambda s: (most * sizes[s] / weigh[s], rank[s])):
        level = left / share
        if most * sizes[s] > level * weigh[s]:
            break
        out[s] = float(most * sizes[s])
        left -= most * sizes[s]
        share -= weigh[s]
    level = left / share if share else 0.0
    return {s: out.get(s, level * weigh[s]) for s in names}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PLAIN_WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = WEIGHTS, most: int = MOST, drawn_by: str = ""
) -> DataFrame:
    """Per row: key, size, source_size, target (of its source) and taken (size times copies in the mix).

    The order within a source is drawn from a row's key (or the column ``drawn_by``) and text, so rows with null or
    shared keys are spread like others. Null and empty texts have size 0 and take nothing; a null source is a
    source of its own; rows that are alike in key and text are interchangeable and take copies each; an empty
    table gives an empty result; other columns are ignored. The source table (one row per source) is held on the driver.
    """
    none = F.lit("")
    by = F.md5(F.concat(F.coalesce(F.col(drawn_by or key).cast("string"), none), F.lit("|"), F.md5(F.coalesce(F.col(text).cast("string"), none))))
    rows = stage(
        docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), word_count(F.col(text)).alias("size"), by.alias("_by")).withColumn(
            "_draw", F.col("_by")
        ).drop("_by"),
        "sizes",
    )
    spark = docs.sparkSession
    table = rows.groupBy("_source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sizes = {r["_source"]: r["size"] for r in table}
    aims = targets(sizes, weights, most)
    budget = sum(sizes.values())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    flows = small_table(
        spark, [(i, s, sizes[s], float(aims[s])) for i, s in enumerate(names)], "_flow int, _source string, source_size long, target double"
    )
    known = rows.join(F.broadcast(flows), rows["_source"].eqNullSafe(flows["_source"])).drop("_source")

    buckets = max(1, -(-sum(r["n"] for r in table) // ROWS_PER_BUCKET))
    drawn_at = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long")
    known = known.withColumn("_bucket", F.floor(drawn_at * buckets / F.lit(1 << 32)))
    drawn = Window.partitionBy("_flow", "_bucket").orderBy("_draw", "_key", "size")
    inside = drawn.rowsBetween(Window.unboundedPreceding, 0)
    group = F.floor(F.col("_bucket") / BUCKETS_PER_GROUP).alias("_group")
    sums = known.groupBy("_flow", "_bucket").agg(F.sum("size").alias("_sum")).select("*", group)
    earlier = Window.partitionBy("_flow").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("_flow", "_group").agg(F.sum("_sum").alias("_sum"))
    groups = groups.select("_flow", "_group", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    before = Window.partitionBy("_flow", "_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).join(groups, ["_flow", "_group"])
    sums = sums.select("_flow", "_bucket", (F.col("_before") + F.col("_earlier")).alias("_before"))
    served = (
        known.withColumn("_inside", F.sum("size").over(inside))
        .withColumn("_nth", F.row_number().over(drawn))
        .join(sums, ["_flow", "_bucket"])
        .withColumn("_upto", F.col("_before") + F.col("_inside"))
    )
    served = stage(served.select("_key", "size", "source_size", "target", "_flow", "_draw", "_upto", "_nth", "_bucket"), "served")

    copies = served.where((F.col("size") > 0) & (F.col("target") > 0)).select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("_round"))
    finish = (F.col("_round") * F.col("source_size") + F.col("_upto")) / F.col("target")
    copies = copies.withColumn("_finish", finish)
    # Every flow reaches its target at time 1, where the budget runs out; later times share a slice.
    edges: list[int] = []
    spent = 0

    def lot(time: Column) -> Column:
        """The slice of a time on the level below the edges found so far."""
        place = F.least(time, F.lit(2.0)) * SLICES
        for edge in edges:
            place = (place - edge) * SLICES
        return F.floor(place)

    def compared(time: Column, less: bool) -> Column:
        """Whether a time lies in a slice before the edge, or in the edge slice itself."""
        place, same, out = F.least(time, F.lit(2.0)) * SLICES, F.lit(True), F.lit(False)
        for edge in edges:
            out = out | (same & (F.floor(place) < edge))
            same = same & (F.floor(place) == edge)
            place = (place - edge) * SLICES
        return out if less else same

    for _ in range(LEVELS):
        here = copies.where(compared(F.col("_finish"), False)).groupBy(lot(F.col("_finish")).alias("_lot"))
        filled = here.agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("_lot").collect()  # 2 * SLICES + 1 rows at most
        edge, n = 2 * SLICES + 1, 0
        for r in filled:
            if spent + r["size"] > budget:
                edge, n = r["_lot"], r["n"]
                break
            spent += r["size"]
        edges.append(edge)
        if n <= FEW:
            break
    first = Window.partitionBy(F.lit(0)).orderBy("_finish", "_flow", "_round", "_upto", "_draw", "_key", "_nth").rowsBetween(Window.unboundedPreceding, 0)
    partly = copies.where(compared(F.col("_finish"), False)).withColumn("_sum", F.sum("size").over(first)).where(F.col("_sum") <= budget - spent)
    partly = partly.groupBy("_flow", "_bucket", "_nth").agg(F.count("*").alias("_more"))
    times = [(F.lit(i) * F.col("source_size") + F.col("_upto")) / F.col("target") for i in range(most)]
    ended = sum((F.when(compared(t, True), 1).otherwise(0) for t in times), F.lit(0))
    whole = F.when((F.col("size") > 0) & (F.col("target") > 0), ended).otherwise(0)
    out = served.join(partly, ["_flow", "_bucket", "_nth"], "left")
    return out.select(
        F.col("_key").alias(key),
        "size",
        "source_size",
        "target",
        (F.col("size") * (whole + F.coalesce(F.col("_more"), F.lit(0)))).cast("long").alias("taken"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS draw
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS ssize, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS flow FROM rows GROUP BY source
), weighed AS (
  SELECT *, 1 + flow % 3 AS w, row_number() OVER (ORDER BY 3 * ssize / (1 + flow % 3), flow) AS k FROM src
), below AS (
  SELECT *, sum(ssize) OVER () - coalesce(sum(3 * ssize) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS share FROM weighed
), stop AS (
  SELECT min(k) AS k FROM below WHERE 3 * ssize > rest::DOUBLE / share::DOUBLE * w
), level AS (
  SELECT rest::DOUBLE / share::DOUBLE AS l, below.k FROM below, stop WHERE below.k = stop.k
), flows AS (
  SELECT b.source, b.ssize, b.flow, CASE WHEN b.k < level.k THEN (3 * b.ssize)::DOUBLE ELSE level.l * b.w END AS target FROM below b, level
), upto AS (
  SELECT r.*, f.ssize, f.flow, f.target, sum(size) OVER (PARTITION BY f.flow ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows r JOIN flows f ON r.source IS NOT DISTINCT FROM f.source
), copies AS (
  SELECT doc_id, size, round, (round * ssize + upto)::DOUBLE / target AS finish, flow, upto, draw FROM upto, range(3) t(round) WHERE size > 0 AND target > 0
), cut AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, flow, round, upto, draw, doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM copies
), taken AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM cut WHERE spent <= (SELECT sum(size) FROM rows) GROUP BY doc_id
)
SELECT u.doc_id, u.size, u.ssize AS source_size, u.target, coalesce(t.taken, 0)::BIGINT AS taken FROM upto u LEFT JOIN taken t ON u.doc_id = t.doc_id
"""
