"""Which questions to ask first: issues of a sentence merge, types have a quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import IMPACT

PER_TYPE = 2


def _impact(part: int) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in IMPACT.items() for x in (k, v[part])])
    return F.coalesce(table[F.col("type")], F.lit(("ask", 30)[part]))


def prioritize(issues: DataFrame, top: int = 5) -> DataFrame:
    """Per document: place, bucket (asked, rest or fix), type, text, ask, weight, also.

    Issues to ask about merge by sentence (blanks removed, 60 characters) under the heaviest type;
    at most two of a type and ``top`` in all are asked, the others follow in rank order, and what
    authors can fix themselves comes last in emission order.
    """
    df = issues.withColumns({"kind": _impact(0), "weight": _impact(1), "key": F.substring(F.regexp_replace("text", r"(?U)\s+", ""), 1, 60)})
    asks = df.where("kind = 'ask'")
    same = Window.partitionBy("doc_id", "key")
    asks = asks.withColumns(
        {
            "nth": F.row_number().over(same.orderBy(F.desc("weight"), "seq")),
            "also": F.sort_array(F.collect_set("type").over(same)),
            "first": F.min("seq").over(same),
        }
    ).where("nth = 1")
    asks = asks.withColumn("of_type", F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("first")))
    within = F.col("of_type") <= PER_TYPE
    asks = asks.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", within).orderBy(F.desc("weight"), "first")))
    asks = asks.withColumn("bucket", F.when(within & (F.col("nth") <= top), "asked").otherwise("rest"))
    fixes = df.where("kind = 'fix'").withColumns({"bucket": F.lit("fix"), "also": F.array("type"), "first": F.col("seq")})
    names = ["doc_id", "bucket", "type", "text", "ask", "weight", "also", "first"]
    both = asks.select(*names).unionByName(fixes.select(*names))
    order = Window.partitionBy("doc_id").orderBy(
        F.expr("case bucket when 'asked' then 0 when 'rest' then 1 else 2 end"), F.when(F.col("bucket") != "fix", -F.col("weight")), "first"
    )
    return both.withColumn("place", F.row_number().over(order)).drop("first")
