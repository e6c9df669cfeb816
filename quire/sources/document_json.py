"""The interchange form of documents: a JSON list of [object number, object].

Integers are {"I": n}, reals {"F": x}, names {"N": "/X"}, strings plain, streams
{"S": [dictionary, data]}, and a bare integer is a reference to an object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(value: Column) -> Column:
    """A JSON string of a value."""
    one = F.to_json(F.struct(value.cast("string").alias("v")))
    return F.substring(one, F.lit(6), F.length(one) - 6)


def integer(value: Column) -> Column:
    return F.concat(F.lit('{"I":'), value.cast("string"), F.lit("}"))


def real(value: Column) -> Column:
    return F.concat(F.lit('{"F":'), value.cast("double").cast("string"), F.lit("}"))


def name(value: Column) -> Column:
    return F.concat(F.lit('{"N":'), _text(value), F.lit("}"))


def string(value: Column) -> Column:
    return _text(value)


def reference(value: Column) -> Column:
    return value.cast("string")


def dictionary(entries: dict[str, Column]) -> Column:
    """A dictionary of JSON values; those that are null are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in entries.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def value(column: str, key: str, tag: str | None = None) -> Column:
    """The value of a key, under its tag if it has one, as text."""
    return F.get_json_object(F.col(column), f"$['{key}']" + (f"['{tag}']" if tag else ""))


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, objnum and object (JSON text) of every document in a folder of JSON files; objects 0 and below are what the form uses for itself."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    pairs = F.explode(F.from_json("value", "array<array<string>>")).alias("pair")
    return whole.select("path", pairs).select("path", F.col("pair")[0].cast("long").alias("objnum"), F.col("pair")[1].alias("object"))


def written(objects: DataFrame, doc: str = "doc_id", number: str = "objnum", column: str = "object") -> DataFrame:
    """One JSON text a document, objects by number."""
    pair = F.struct(number, F.concat(F.lit("["), F.col(number).cast("string"), F.lit(","), F.col(column), F.lit("]")).alias("t"))
    listed = F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["t"])
    return objects.groupBy(doc).agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("json"))
