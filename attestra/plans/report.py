"""Markdown and JSON of audits and reconciliations, one row per document or pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.audit import Audit
from ..operators.prioritize import prioritize

METRIC_LINES = ("score", "verdict", "idle_rate", "density", "n_issues", "word_count", "sentence_count", "n_private_blocking", "n_private_warned")
#: Questions listed besides the asked ones, issues listed in all, and private matters listed.
REST, ISSUES, NOTES = 15, 25, 12
STATUSES = ("settled", "deferred", "doubtful", "missing", "rolled")


def _joined(rows: DataFrame, order: str, line) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["l"]), "\n").alias("body"))


def audit_markdown(audit: Audit, mode: str = "final", top: int = 5, private: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown): metrics, then the questions (gaps) or the distinct issues (final), then the private
    matters where ``private``, the result of ``privacy.detect``, is given."""
    names = [c for c in METRIC_LINES if c in audit.metrics.columns]
    head = audit.metrics.select("doc_id", F.concat_ws("\n", *[F.concat(F.lit(f"- {c}: "), F.col(c).cast("string")) for c in names]).alias("head"))
    ranked = prioritize(audit.issues, top)
    if mode == "gaps":
        later = F.row_number().over(Window.partitionBy("doc_id", "bucket").orderBy("place"))
        rest = ranked.withColumn("later", later).where(f"bucket = 'asked' OR (bucket = 'rest' AND later <= {REST}) OR bucket = 'fix'")
        body = _joined(rest, "place", F.concat(F.lit("- ["), F.col("type"), F.lit("] "), F.substring("text", 1, 60), F.lit(" → "), F.col("ask")))
    else:
        distinct = audit.issues.groupBy("doc_id", "type", "text", "ask").agg(F.min("seq").alias("seq"))
        parts = F.slice(F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("- ["), F.col("type"), F.lit("] "), F.substring("text", 1, 46), F.lit(" → "), F.col("ask")).alias("l")))), 1, 25)
        body = distinct.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["l"]), "\n").alias("body"))
    out = head.join(body, "doc_id", "left")
    if private is None:
        return out.select("doc_id", F.concat_ws("\n\n", "head", "body").alias("markdown"))
    note = F.concat(F.lit("- "), F.when(F.col("blocking"), "!").otherwise("?"), F.lit(" "), F.col("kind"), F.lit(": "), F.col("fragment"))
    notes = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("seq", note.alias("l")))), 1, NOTES), lambda p: p["l"])
    out = out.join(private.groupBy("doc_id").agg(F.array_join(notes, "\n").alias("notes")), "doc_id", "left")
    return out.select("doc_id", F.concat_ws("\n\n", "head", "body", "notes").alias("markdown"))


def audit_json(audit: Audit, mode: str = "final", style: str = "", top: int = 5, private: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): mode, style, metrics, issues in emission order, the first questions, and private matters
    that block delivery or not where ``private`` is given."""
    issues = audit.issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "text", "ask"))).alias("issues"))
    asked = prioritize(audit.issues, top).where("bucket = 'asked'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "type", "text", "ask", "weight", "also"))).alias("top"))
    both = audit.metrics.join(issues, "doc_id", "left").join(asked, "doc_id", "left")
    parts = [F.lit(mode).alias("mode"), F.lit(style).alias("style"), F.struct(*[c for c in audit.metrics.columns if c != "doc_id"]).alias("metrics"), F.col("issues"), F.col("top")]
    if private is not None:
        some = lambda blocking: F.array_sort(F.collect_list(F.when(F.col("blocking") == blocking, F.struct("seq", "kind", "fragment"))))
        both = both.join(private.groupBy("doc_id").agg(F.struct(some(True).alias("block"), some(False).alias("warn")).alias("pii")), "doc_id", "left")
        parts.append(F.col("pii"))
    return both.select("doc_id", F.to_json(F.struct(*parts)).alias("json"))


def counts(recon: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Promises by status per pair. With ``pairs`` (pair_id) also for pairs without any; ``status`` says so."""
    out = recon.groupBy("pair_id").agg(F.count("*").alias("promises"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    if pairs is None:
        return out
    out = pairs.select("pair_id").distinct().join(out, "pair_id", "left").na.fill(0)
    return out.withColumn("outcome", F.when(F.col("promises") == 0, "no promise found").otherwise("compared"))


def reconcile_markdown(recon: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(pair_id, markdown): counts, promises by status, and a conclusion that claims evidence for all
    only if none is missing or doubtful."""
    line = F.concat(F.lit("- "), F.col("status"), F.lit(": "), F.col("promise"), F.lit(" → "), F.col("matched"), F.coalesce(F.concat(F.lit("（"), F.col("conflict"), F.lit("）")), F.lit("")))
    place = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    body = _joined(recon.withColumn("o", F.struct(place, "promise_no")).withColumnRenamed("pair_id", "doc_id"), "o", line).withColumnRenamed("doc_id", "pair_id")
    c = counts(recon, pairs)
    head = F.concat_ws(", ", *[F.concat(F.lit(f"{s} "), F.col(s).cast("string")) for s in STATUSES])
    end = F.when(F.col("promises") == 0, "上期没有可核对的承诺").when(F.col("missing") + F.col("doubtful") == 0, "全部承诺有据可查").otherwise("仍有承诺待核实")
    return c.join(body, "pair_id", "left").select("pair_id", F.concat_ws("\n\n", head, "body", end).alias("markdown"))
