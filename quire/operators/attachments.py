"""Files attached to documents (page 0) or to pages, as rows: doc_id, page, name, data (binary)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import safe_name

KEY = ("doc_id", "page", "name")


def attached(files: DataFrame, new: DataFrame) -> DataFrame:
    """With other files; one of the same place and name takes the old one's place."""
    return files.select(*KEY, "data").join(new.select(*KEY), list(KEY), "left_anti").unionByName(new.select(*KEY, "data"))


def removed(files: DataFrame, chosen: Column | None = None) -> DataFrame:
    """Without any files, or without those that a condition holds for."""
    return files.where(F.lit(False) if chosen is None else ~chosen)


def from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """Files of a JSON list of {"page", "name", "data" in base64}; no page is the document itself."""
    rows = texts.select("doc_id", F.explode(F.from_json(column, "array<struct<page:int,name:string,data:string>>")).alias("f"))
    return rows.select("doc_id", F.coalesce("f.page", F.lit(0)).alias("page"), "f.name", F.unbase64("f.data").alias("data"))


def as_json(files: DataFrame) -> DataFrame:
    """One JSON list a document, by page and name."""
    one = F.struct("page", "name", F.base64("data").alias("data"))
    return files.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("json"))


def dumped(files: DataFrame) -> DataFrame:
    """doc_id, path and data: every file under a safe name of its own in its document's folder; a second of one name is numbered."""
    safe = F.coalesce(F.nullif(safe_name(F.col("name")), F.lit("")), F.lit("unnamed"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "safe").orderBy("page", "name"))
    named = files.withColumn("safe", safe).withColumn("nth", nth)
    path = F.concat_ws("/", F.col("doc_id").cast("string"), F.when(F.col("nth") == 1, F.col("safe")).otherwise(F.concat_ws("-", "nth", "safe")))
    return named.select("doc_id", path.alias("path"), "data")


def saved(dump: DataFrame, folder: str) -> DataFrame:
    """Write each file of a dump (path, data) under a folder that all executors share; how many bytes each has.

    One task writes a file whole, so a task that runs again writes the same.
    """

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            sizes = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = f"{root}/{path}"
                system.create_dir(whole.rpartition("/")[0], recursive=True)
                with system.open_output_stream(whole) as out:
                    out.write(data or b"")
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "size"])

    return dump.select("path", "data").mapInArrow(run, "path string, size long")


def portfolio(files: DataFrame) -> DataFrame:
    """A portfolio's list of its document's files: place, name, size and checksum, by name."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("name", "page"))
    return files.select("doc_id", place.alias("place"), "name", F.octet_length("data").alias("size"), F.md5("data").alias("checksum"))
