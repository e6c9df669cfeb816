"""Token ids as Parquet list columns.

A token table has one row per document, in ascending order of its key over all
files: the key, ``n_tokens`` and ``ids`` (array<int>, an end id last).  Ids are
dictionary-coded while a chunk's dictionary is small and delta-coded beyond
that; row groups and pages have set sizes and page indexes, so a reader fetches
the counts alone, or the ids of a key range, without the rest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.bpe import encode_batches
from quire.llm.common import shared_dir

#: Options of Spark's Parquet writer that set encodings, row groups and pages.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, key: str = "doc_id", text: str = "text", layout: dict[str, str] | None = None) -> None:
    """Encode every whole text, append ``end_id`` and write the token table.

    A null text is empty: its row holds the end id alone.  Rows with equal keys
    are kept, in the order of a hash of their texts; null keys come first.  An
    empty table writes an empty table.  Other columns are ignored.
    """
    picked = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = picked.repartitionByRange(key, tie).sortWithinPartitions(F.col(f"`{key}`"), tie)
    kind = picked.schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in encode_batches(vocabulary, batches, False, keep=True):
            ids = out.column(1)
            lengths = np.diff(ids.offsets.to_numpy()) + 1
            ends = np.cumsum(lengths)
            values = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.int32)
            inner = np.ones(len(values), bool)
            inner[ends - 1] = False
            values[inner] = ids.values.to_numpy()[ids.offsets[0].as_py() : ids.offsets[-1].as_py()]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([out.column(0), pa.array(lengths, pa.int64()), lists], [key, "n_tokens", "ids"])

    dealt.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids array<int>").write.options(**LAYOUT | (layout or {})).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A token table, or only some of its columns; filters on the key skip row groups and pages."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (file, row, n_tokens, ...) of a token table with ``start``, the ids of all rows before.

    The sums over files are read without the ids; one row a file is summed in
    order, and the running sum is taken within each file.
    """
    counts = rows.sparkSession.read.parquet(path).select("n_tokens", F.col("_metadata.file_name").alias("file"))
    # a name holds the number of the writing task; as text, part-100000 would stand before part-99999
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    files = counts.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = files.select("file", (F.sum("total").over(Window.orderBy(number, "file")) - F.col("total")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("within", within).join(before, "file").withColumn("start", F.col("before") + F.col("within")).drop("within", "before")


def positions(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, n_tokens and start of each row, read without the ids."""
    rows = spark.read.parquet(path).select(F.col(f"`{key}`"), "n_tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return with_starts(rows, path).select(key, "n_tokens", "start")


def checksums(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, n_tokens, file, row and the unsigned crc32 of each row's ids as little-endian unsigned 32-bit integers."""
    rows = spark.read.parquet(path).select(F.col(f"`{key}`"), "n_tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "ids")
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            offsets = ids.offsets.to_pylist()
            raw = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], [key, "n_tokens", "file", "row", "ids_crc32"])

    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens long, file string, row long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token table in the shared folder and report each row from the files: ``key``, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary, end_id, key, text)
    return with_starts(checksums(spark, path, key), path).select(key, "start", "n_tokens", "ids_crc32")
