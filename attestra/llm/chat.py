"""Chat formatting: collapse cumulative snapshots, then render.

Logs often hold a conversation several times, each copy a few turns longer. A rolling hash over
(position, role, text) identifies every turn prefix; conversations whose whole hash is a prefix of
a longer one, or whose exact twin has a smaller id, go. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import read, stage

START, END = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns with their position in the conversation and the rolling hash of the prefix they end.

    The running xor of 2 x 64 bits over hashes that contain the position is order-sensitive and
    needs no growing buffer. Null role or text is hashed as distinct from the empty string.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    tell = [F.col("at"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return (
        turns.select("conv_id", "turn", "role", "text")
        .withColumn("at", F.row_number().over(w))
        .withColumn("h1", F.bit_xor(F.xxhash64(*tell)).over(run))
        .withColumn("h2", F.bit_xor(F.xxhash64(F.lit("second"), *tell)).over(run))
    )


def maximal(marked: DataFrame) -> DataFrame:
    """Conversations that are no prefix of a longer one, one for each group of exact copies.

    conv_id (the smallest of the copies), n_turns, copies.
    """
    last = marked.groupBy("conv_id").agg(F.max_by(F.struct("h1", "h2"), "at").alias("h"), F.max("at").alias("n_turns"))
    whole = last.groupBy("h.h1", "h.h2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = marked.join(last.select(F.col("conv_id").alias("_c"), "n_turns"), F.col("conv_id").eqNullSafe(F.col("_c")))
    inner = inner.where(F.col("at") < F.col("n_turns")).groupBy("h1", "h2", F.col("at").alias("n_turns")).agg(F.count("*").alias("_n"))
    return whole.join(inner, ["h1", "h2", "n_turns"], "left_anti").select("conv_id", "n_turns", "copies")


def render(turn: Column) -> Column:
    role, text = F.coalesce(turn["role"], F.lit("unknown")), F.coalesce(turn["text"], F.lit(""))
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, copies, chat.

    Turns are ordered by turn, then role and text, so ties have a fixed order; repeated rows
    are turns of their own; a null role renders as ``unknown`` and a null text as empty; turns
    with a null conv_id form one conversation; an empty table gives an empty result; columns
    besides conv_id, turn, role and text are ignored.
    """
    marked = stage(prefixes(turns), "prefixes")
    kept = stage(maximal(marked), "maximal")
    kept = kept.withColumnRenamed("conv_id", "_kept")
    whole = marked.join(kept, marked["conv_id"].eqNullSafe(kept["_kept"])).drop("_kept")
    lines = F.array_sort(F.collect_list(F.struct("at", render(F.struct("role", "text")).alias("line"))))
    return whole.groupBy("conv_id", "n_turns", "copies").agg(F.array_join(lines["line"], "\n").alias("chat"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, role, text FROM conversations
), c AS (
  SELECT conv_id, max(pos) AS n, list(struct_pack(r := role, t := text) ORDER BY pos) AS turns FROM t GROUP BY conv_id
), w AS (
  SELECT turns, n, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY turns, n
), p AS (
  SELECT DISTINCT c.turns[1:t.pos] AS turns FROM c JOIN t ON c.conv_id IS NOT DISTINCT FROM t.conv_id WHERE t.pos < c.n
), k AS (
  SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = w.turns)
)
SELECT k.conv_id, k.n AS n_turns, k.copies,
       string_agg('<|im_start|>' || coalesce(t.role, 'unknown') || chr(10) || coalesce(t.text, '') || '<|im_end|>', chr(10) ORDER BY t.pos) AS chat
FROM k JOIN t ON k.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY 1, 2, 3
"""
