"""Accessibility rules over markup: every rule is a table of violations, and a check is their union."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def headings(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """Headings in order: key, seq, level."""
    found = F.regexp_extract_all(F.col(markup), F.lit(r"<[hH]([1-6])[ >]"), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("seq", "digit")).select(key, "seq", F.col("digit").cast("int").alias("level"))


def _named(df: DataFrame, key: str, rule: str, message: str) -> DataFrame:
    return df.select(key, F.lit(rule).alias("rule"), F.lit(message).alias("message"))


def check(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, rule, message): one row for each rule that a document breaks."""
    h = headings(pages, key, markup)
    first = h.where("seq = 0 and level <> 1")
    before = F.coalesce(F.lag("level").over(Window.partitionBy(key).orderBy("seq")), F.lit(1))
    skipped = h.withColumn("before", before).where("level > before + 1").select(key).distinct()
    twice = h.where("level = 1").groupBy(key).count().where("count > 1")
    title = pages.where(~F.regexp_like(markup, F.lit(r"<title>[^<]")))
    language = pages.where(~F.regexp_like(markup, F.lit(r"<html[^>]* lang=\"[a-z]")))
    bare = pages.where(F.regexp_like(markup, F.lit(r"<img(?![^>]* alt=)[^>]*>")))
    ids = pages.select(key, F.explode(F.regexp_extract_all(F.col(markup), F.lit(r" id=\"([^\"]*)\""), F.lit(1))).alias("id")).groupBy(key, "id").count().where("count > 1").select(key).distinct()
    rules = [
        (first, "14-002", "first heading is not level 1"), (skipped, "14-003", "heading level skipped"), (twice, "14-006", "more than one top heading"), (title, "07-001", "no title"),
        (language, "11-001", "no language"), (bare, "13-004", "image without alternative"), (ids, "19-004", "identifier used twice"),
    ]
    return functools.reduce(DataFrame.unionByName, [_named(d, key, r, m) for d, r, m in rules])
