"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a local session names none (tests) one is made and set; on a cluster a
    folder of one machine would lose data, so there it is an error.
    """
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


#: Removes a query's shuffle files once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage: a lost executor costs the tasks in flight, not this table.  The
    shuffle files of the query that made it go once it stands; :func:`discard`
    removes the table when what was made of it stands too.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`written` made and that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """In a Python worker: let freed arrays go back to the system at once.

    Otherwise both Arrow's pool and the C library keep what a large block needed,
    beside what the JVM of the same executor holds.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


def trimmed() -> None:
    """In a Python worker, at the end of a task: give back what small freed objects held too."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """A string column as a list, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def slices(column: pa.Array, budget: int = 8 << 20):
    """(start, stop) row ranges of a string column of at most ``budget`` bytes each, one row at least.

    What a worker keeps between ranges stays small: see :func:`give_back`.
    """
    give_back()
    start, held = 0, 0
    for i in range(len(column)):
        scalar = column[i].as_buffer()
        size = scalar.size if scalar is not None else 0
        if i > start and held + size > budget:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(column):
        yield start, len(column)
