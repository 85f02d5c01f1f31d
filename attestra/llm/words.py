"""Words and word shingles as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of the contracts: a run without space, tab, line feed, VT, FF or CR.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"
#: A word for containment search: letters and digits only, so that punctuation and case
#: around a copied passage do not hide it.
LETTER_WORD = r"[\p{L}\p{N}]+"
SHINGLE = 5
SIMILARITY = 0.75


def words(text: Column | str, pattern: str = PLAIN_WORD, lower: bool = False) -> Column:
    """All words of the whole text, in order; null text has none."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(pattern), F.lit(0))


def shingle_rows(df: DataFrame, array: str, out: str, size: int = SHINGLE) -> DataFrame:
    """One row per position of a window of ``size`` words, with its 64-bit hash in ``out``.

    The explode and the hash stay in one code-generated stage; arrays with fewer words than
    ``size`` give no row.
    """
    starts = F.when(F.size(array) >= size, F.sequence(F.lit(0), F.size(array) - size))
    df = df.withColumn("_at", F.explode(starts))
    return df.withColumn(out, F.xxhash64(*[F.get(F.col(array), F.col("_at") + k) for k in range(size)])).drop("_at")


#: Rows of a table that may be broadcast (a row is a few numbers, so some 64 MB at most).
BROADCAST_ROWS = 1_000_000


def sized_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` stay within ``limit``, else as it is
    (Spark then shuffles both sides and splits skewed partitions)."""
    return F.broadcast(df) if rows <= limit else df


#: Bits of the filter that stands for more ids than may be broadcast; 64 of them make a broadcast row.
FILTER_BITS = 1 << 26


def keep_ids(docs: DataFrame, key: str, ids: DataFrame, how: str = "left_semi", limit: int | None = None) -> DataFrame:
    """The rows of ``docs`` whose key is (``left_semi``) or is not (``left_anti``) in the one column
    of ``ids``, a staged table.

    Up to ``limit`` ids (``BROADCAST_ROWS`` unless given) are broadcast. Of more, a bit per hash value is: only rows whose bit is set can
    have their key among the ids, and these alone are shuffled to find out.
    """
    ids = ids.toDF("_id")
    n = ids.count()
    same = docs[key].eqNullSafe(ids["_id"])
    if n <= (BROADCAST_ROWS if limit is None else limit):
        return docs.join(F.broadcast(ids), same, how)

    def bit(x: Column) -> Column:
        return F.pmod(F.xxhash64(x), F.lit(FILTER_BITS))

    words = ids.select(bit(F.col("_id")).alias("_bit")).groupBy(F.floor(F.col("_bit") / 64).alias("_word"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, cast(_bit % 64 as int)))").alias("_bits"))  # FILTER_BITS / 64 rows at most
    marked = docs.withColumn("_at", bit(docs[key])).withColumn("_word", F.floor(F.col("_at") / 64)).join(F.broadcast(words), "_word", "left")
    marked = marked.withColumn("_may", F.expr("coalesce(shiftrightunsigned(_bits, cast(_at % 64 as int)) & 1L, 0L) = 1"))
    some = marked.where("_may").select(*docs.columns)
    found = some.join(ids, some[key].eqNullSafe(ids["_id"]), how)
    return found if how == "left_semi" else marked.where("NOT _may").select(*docs.columns).unionByName(found)
