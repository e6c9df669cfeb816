"""Operators on dictionaries kept as JSON text: search, replacement, removal and insertion.

Trees of any depth are walked by one recursive function per row; flat
dictionaries use map functions and stay in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _walk(value: object, key: str) -> Iterator[object]:
    """Every value of a key, outermost first."""
    if isinstance(value, dict):
        if key in value:
            yield value[key]
        for inner in value.values():
            yield from _walk(inner, key)
    elif isinstance(value, list):
        for inner in value:
            yield from _walk(inner, key)


def _changed(value: object, change: Callable[[dict], dict]) -> object:
    if isinstance(value, dict):
        return {k: _changed(v, change) for k, v in change(value).items()}
    return [_changed(v, change) for v in value] if isinstance(value, list) else value


def _compact(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def entries(objects: DataFrame, column: str, key: str, to: str = "value") -> DataFrame:
    """One row for every value of a key at any depth, as compact JSON; texts that are no JSON have none."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            try:
                return [_compact(v) for v in _walk(json.loads(text or "null"), key)]
            except ValueError:
                return []

        return texts.map(one, na_action=None)

    return objects.withColumn(to, F.explode(found(F.col(column))))


def _rewritten(objects: DataFrame, column: str, change: Callable[[dict], dict]) -> DataFrame:
    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else _compact(_changed(json.loads(text), change))
            except ValueError:
                return text

        return texts.map(one, na_action=None)

    return objects.withColumn(column, made(F.col(column)))


def removed(objects: DataFrame, column: str, key: str, where: object = ...) -> DataFrame:
    """Without a key at any depth, or only where it has a value."""
    return _rewritten(objects, column, lambda d: {k: v for k, v in d.items() if k != key or (where is not ... and v != where)})


def replaced(objects: DataFrame, column: str, key: str, value: object, where: object = ...) -> DataFrame:
    """With another value for a key at any depth where it stands, or only where it has a value."""
    return _rewritten(objects, column, lambda d: {k: value if k == key and (where is ... or v == where) else v for k, v in d.items()})


def looked_up(column: str, path: str) -> Column:
    """The value at a path such as /Root/Pages, as text."""
    return F.get_json_object(F.col(column), "$" + "".join(f"['{p}']" for p in path.strip("/").split("/")))


def upserted(objects: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Objects with changes laid over them by key; a change with a negative key is new and numbered on from the largest."""
    largest = objects.agg(F.coalesce(F.max(key), F.lit(0)).alias("largest"))
    placed = changes.join(F.broadcast(largest), how="cross").withColumn(key, F.when(F.col(key) < 0, F.col("largest") - F.col(key)).otherwise(F.col(key))).drop("largest")
    return objects.join(placed.select(key), key, "left_anti").unionByName(placed)


def coalesced(groups: DataFrame, by: str, name: str, place: str, key: str) -> DataFrame:
    """``groups`` with survivor: of those of one name, the key of the first by place."""
    first = groups.groupBy(by, name).agg(F.min_by(key, place).alias("survivor"))
    return groups.join(first, [by, name])


def object_removed(objects: DataFrame, chosen: Column) -> DataFrame:
    """Objects that become null, without a stream; references to them then stand for nothing."""
    return objects.withColumn("object", F.when(chosen, "null").otherwise(F.col("object"))).withColumn("stream", F.when(~chosen, F.col("stream")))


def stream_replaced(objects: DataFrame, chosen: Column, data: Column) -> DataFrame:
    """Other data in chosen streams; what is no stream stays none."""
    return objects.withColumn("stream", F.when(chosen & F.col("stream").isNotNull(), data).otherwise(F.col("stream")))


def stream_emptied(objects: DataFrame, chosen: Column) -> DataFrame:
    """Chosen streams without data."""
    return stream_replaced(objects, chosen, F.lit("").cast("binary"))


def groups_of(texts: DataFrame, by: str, column: str) -> DataFrame:
    """Groups (by, name, place from 1) in the order of a JSON object's "order", which replaces what there was."""
    rows = texts.select(by, F.posexplode(F.from_json(column, "order array<string>")["order"]).alias("at", "name"))
    return rows.select(by, "name", (F.col("at") + 1).alias("place"))


def renamed(groups: DataFrame, name: str, chosen: Column, new: str) -> DataFrame:
    """Groups with another name where a condition holds."""
    return groups.withColumn(name, F.when(chosen, new).otherwise(F.col(name)))


def ordered(groups: DataFrame, by: str, key: str) -> DataFrame:
    """All groups of each document as its order: their keys in a row, as text."""
    return groups.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(key)).cast("array<string>"), " ").alias("names"))


def extracted(objects: DataFrame, chosen: Column, ending: str, by: str = "doc_id", key: str = "objnum") -> DataFrame:
    """by, path and data of the chosen objects' streams, a file each."""
    path = F.concat(F.col(by).cast("string"), F.lit("/"), F.col(key).cast("string"), F.lit(ending))
    return objects.where(chosen & F.col("stream").isNotNull()).select(by, path.alias("path"), F.col("stream").alias("data"))


def metadata_streams(objects: DataFrame, by: str = "doc_id", key: str = "objnum") -> DataFrame:
    """Every metadata stream as a file."""
    return extracted(objects, F.get_json_object("object", "$['/Type']['N']") == "/Metadata", ".xml", by, key)
