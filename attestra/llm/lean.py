"""Memory of Python workers, which outlive their tasks and count beside the executor's JVM."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of text handled at once on an executor; a longer text is handled alone.
PIECE = 1 << 20


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[pa.Array]:
    """The array in slices of ``most`` bytes at most, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts.slice(at, to - at)
        at = to


def release() -> None:
    """Hand memory that is free back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """``run``, a task's work on its batches, and then ``release``."""

    def whole(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of a few rows that start no Python worker on the executors, as lists do otherwise."""
    if not rows:
        return spark.createDataFrame([], schema)
    columns = [pa.array(c) for c in zip(*rows, strict=True)]
    return spark.createDataFrame(pa.table(columns, StructType.fromDDL(schema).names), schema)
