"""Audits of arriving documents: each micro-batch is audited like a table of its own, as a document's
audit needs no other document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.lexicon import Lexicon
from ..operators.audit import audit


def audit_stream(docs: DataFrame, lex: Lexicon, sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Start auditing a stream of (doc_id, text); ``sink`` gets each batch's metrics and its number."""

    def run(batch: DataFrame, number: int) -> None:
        sink(audit(batch, lex, **options).metrics, number)

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
