"""Token counts: an exact histogram of encoded lengths.

Documents are encoded whole with a public byte-level BPE vocabulary and aggregated by length
before anything is shuffled to a window, so the suffix sums run over distinct lengths, not over
documents. From the histogram follow, for every context limit, the documents and tokens above
it, the truncated total and the quantile.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import read

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenizer of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Longest piece handed to the encoder at once, in characters.
PIECE = 100_000


def pieces(text: str) -> Iterator[str]:
    """Cut a very long text so that the pieces' tokens are the whole text's.

    A cut is made before a space that stands between two letters: every alternative of the
    pattern ends there, so no token crosses it. A text without such a place stays whole.
    """
    start = 0
    while len(text) - start > PIECE:
        at = text.find(" ", start + PIECE)
        while at > 0 and not (text[at - 1].isalpha() and text[at + 1 : at + 2].isalpha()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of the whole text; null and empty texts have 0."""
    if not text:
        return 0
    encode = encoder(vocabulary).encode_ordinary
    return sum(len(encode(p)) for p in pieces(text))


def lengths(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row with its ``n_tokens``."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count_tokens(t, vocabulary))

    return docs.select(counted(F.col(text)).alias("n_tokens"))


def histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per distinct encoded length L, which also serves as the context limit L.

    n_tokens (L), n_docs, tokens; docs_at_least and tokens_at_least (lengths >= L); docs_over
    (lengths > L); truncated_total, the sum of min(length, L); quantile, the share of documents
    with length <= L; total_docs, total_tokens. Null and empty texts count as length 0. An empty
    table gives no rows.
    """
    counts = lengths(docs, text, vocabulary).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    longer = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    out = counts.select(
        "n_tokens",
        "n_docs",
        "tokens",
        F.sum("n_docs").over(longer).alias("docs_at_least"),
        F.sum("tokens").over(longer).alias("tokens_at_least"),
        F.sum("n_docs").over(whole).alias("total_docs"),
        F.sum("tokens").over(whole).alias("total_tokens"),
    )
    over = F.col("docs_at_least") - F.col("n_docs")
    return out.select(
        "n_tokens",
        "n_docs",
        "tokens",
        "docs_at_least",
        "tokens_at_least",
        over.alias("docs_over"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("tokens") + over * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("total_docs") - over) / F.col("total_docs")).alias("quantile"),
        "total_docs",
        "total_tokens",
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(read(spark, sf_dir, "documents"))
