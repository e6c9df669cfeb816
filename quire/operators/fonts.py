"""Fonts as rows: doc_id, pageno, name, base (the font's own name), subtype, encoding, differences (map of code to glyph), program (binary, null if none is embedded)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import safe_name

KEY = ("doc_id", "pageno", "name")


def encodings(fonts: DataFrame, bases: DataFrame) -> DataFrame:
    """(key, code, glyph): every code that a font's encoding names; its differences go before its base encoding (bases: encoding, code, glyph)."""
    own = fonts.select(*KEY, F.explode("differences").alias("code", "glyph"))
    base = fonts.select(*KEY, "encoding").join(bases, "encoding").select(*KEY, "code", "glyph").join(own.select(*KEY, "code"), [*KEY, "code"], "left_anti")
    return own.unionByName(base)


def without_programs(fonts: DataFrame, chosen: Column) -> DataFrame:
    """Chosen fonts without their embedded programs."""
    return fonts.withColumn("program", F.when(~chosen, F.col("program")))


def copied(fonts: DataFrame, source: DataFrame, pages: DataFrame) -> DataFrame:
    """One font (a row of a font's columns) on further pages (doc_id, pageno), under its own name; a page that has the name keeps its font."""
    one = F.broadcast(source.limit(1).drop("doc_id", "pageno"))
    new = pages.select("doc_id", "pageno").distinct().join(one, how="cross").join(fonts.select(*KEY), list(KEY), "left_anti")
    return fonts.unionByName(new.select(*fonts.columns))


def embedded(fonts: DataFrame, programs: DataFrame) -> DataFrame:
    """Fonts with programs (base, program) where they lacked one; the base's subset mark (six capitals and a plus) does not count."""
    found = programs.select(F.col("base").alias("of"), F.col("program").alias("given"))
    made = fonts.join(found, F.regexp_replace("base", "^[A-Z]{6}\\+", "") == F.col("of"), "left")
    return made.withColumn("program", F.coalesce("program", "given")).drop("of", "given")


def extracted(fonts: DataFrame) -> DataFrame:
    """doc_id, path and data of every embedded program, one for each font's own name in a document."""
    held = fonts.where("program is not null").groupBy("doc_id", "base").agg(F.min("program").alias("data"))
    return held.select("doc_id", F.concat_ws("/", F.col("doc_id").cast("string"), safe_name(F.col("base"))).alias("path"), "data")
