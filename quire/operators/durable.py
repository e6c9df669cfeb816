"""Cutting lineage through the folder that driver and executors share, by checkpoints or by tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where a local session names none (tests) one of its own, and on a cluster it is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, named, True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> str:
    """The path of ``df`` as a table in the shared folder; the shuffle files of the query that made it go."""
    spark = df.sparkSession
    path, before = f"{_shared(spark)}/stored-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove tables that nothing reads any more."""
    context = spark.sparkContext
    for path in paths:
        there = context._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(context._jsc.hadoopConfiguration()).delete(there, True)
