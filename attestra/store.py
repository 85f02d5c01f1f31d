"""Shared-folder staging for multi-pass operators.

Executors can be lost at any time, so intermediate tables are cut from their lineage by
writing Parquet into the folder the cluster names in ``spark.checkpoint.dir`` and reading
it back. Where the setting is absent (tests, a laptop) a private folder is made once.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="attestra-")
    return "file://" + _OWN[app]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it reread, without its lineage.

    The folder is removed by ``unstage``, or when the driver's file system client closes. Shuffle
    files of queries that nothing refers to any more are cleaned as soon as the driver collects
    its garbage, so it is asked to.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/attestra-{uuid.uuid4().hex}/{label}"
    df.write.parquet(where)
    files, path = _files(spark, where)
    files.deleteOnExit(path.getParent())
    out = spark.read.schema(df.schema).parquet(where)
    out.staged_at = where
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def unstage(df: DataFrame) -> None:
    """Remove a staged table that is no longer read."""
    files, path = _files(df.sparkSession, df.staged_at)
    files.delete(path.getParent(), True)


def _files(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
