"""Annotations as rows: doc_id, pageno, annot (its number on the page), parent (of a popup), subtype, contents and a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry

KEY = ("doc_id", "pageno")
COLUMNS = (*KEY, "annot", "parent", "subtype", "contents", "minx", "miny", "maxx", "maxy")
_FIELDS = "struct<page:int,annot:int,parent:int,subtype:string,contents:string,rect:array<double>>"


def added(annots: DataFrame, pages: DataFrame, subtype: str, contents: Column, box: tuple[Column, Column, Column, Column]) -> DataFrame:
    """With one annotation more on each page (rows of key), numbered after the largest there."""
    largest = annots.groupBy(*KEY).agg(F.max("annot").alias("largest"))
    new = pages.join(largest, list(KEY), "left").select(
        *KEY, (F.coalesce("largest", F.lit(0)) + 1).cast("int").alias("annot"), F.lit(None).cast("int").alias("parent"), F.lit(subtype).alias("subtype"), contents.alias("contents"),
        *[c.cast("double").alias(n) for c, n in zip(box, ("minx", "miny", "maxx", "maxy"))],
    )
    return annots.select(*COLUMNS).unionByName(new)


def removed(annots: DataFrame, gone: Column) -> DataFrame:
    """Without the annotations that a condition holds for, and without the popups of those."""
    gone = F.coalesce(gone, F.lit(False))
    parents = annots.where(gone).select(*KEY, F.col("annot").alias("parent")).distinct()
    return annots.where(~gone).join(parents, [*KEY, "parent"], "left_anti").select(*annots.columns)


def redacted(annots: DataFrame, areas: DataFrame, touching: bool = True, invert: bool = False, kinds: dict[str, bool] | None = None) -> DataFrame:
    """Without the annotations that lie in redaction areas (key, a_minx, ..., of a page) and their popups.

    Touching areas takes what meets one, otherwise what one holds strictly inside;
    ``invert`` takes the others of pages that have areas.  ``kinds`` says by subtype
    whether annotations may go; subtypes not named go.
    """
    own, area = geometry.box("own"), geometry.box("a")
    renamed = annots.select(*KEY, "annot", *[F.col(s).alias(f"own_{s}") for s in ("minx", "miny", "maxx", "maxy")])
    meets = geometry.touches(own, area) if touching else geometry.encloses(area, own)
    met = renamed.join(areas, list(KEY)).groupBy(*KEY, "annot").agg(F.max(meets).alias("met"))
    flagged = annots.join(met, [*KEY, "annot"], "left")
    gone = ~F.col("met") if invert else F.col("met")
    if kinds:
        may = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
        gone = gone & F.coalesce(F.try_element_at(may, F.col("subtype")), F.lit(True))
    return removed(flagged, gone).select(*annots.columns)


def as_json(annots: DataFrame) -> DataFrame:
    """One JSON list a document, by page and number."""
    one = F.struct(F.col("pageno").alias("page"), "annot", "parent", "subtype", "contents", F.array("minx", "miny", "maxx", "maxy").alias("rect"))
    return annots.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("json"))


def from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """The inverse; a text that is no such list has no annotations."""
    rows = texts.select("doc_id", F.explode(F.from_json(column, f"array<{_FIELDS}>")).alias("a"))
    rect = [F.try_element_at("a.rect", F.lit(k + 1)).alias(n) for k, n in enumerate(("minx", "miny", "maxx", "maxy"))]
    return rows.select("doc_id", F.col("a.page").alias("pageno"), "a.annot", "a.parent", "a.subtype", "a.contents", *rect)
