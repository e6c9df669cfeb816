"""Operators that move, turn and size pages: they change the chosen pages' content and boxes and keep all others as they are.

A page table has content (its operators), rotation (degrees) and for each box it
carries four columns <name>_minx, _miny, _maxx, _maxy; media is always there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.functions.geometry import Box, Matrix
from quire.operators.content import moved

SIDES = ("minx", "miny", "maxx", "maxy")


def _put(pages: DataFrame, name: str, box: Box, chosen: Column) -> DataFrame:
    """A box set on the chosen pages; where a page had none and is not chosen it stays null."""
    old = [F.col(f"{name}_{s}") if f"{name}_{s}" in pages.columns else F.lit(None).cast("double") for s in SIDES]
    return pages.withColumns({f"{name}_{s}": F.when(chosen, new.cast("double")).otherwise(was) for s, new, was in zip(SIDES, box, old)})


def _moved(pages: DataFrame, matrix: Matrix, chosen: Column) -> DataFrame:
    return pages.withColumn("content", F.when(chosen, moved(F.col("content"), matrix)).otherwise(F.col("content")))


def _every_box(pages: DataFrame, matrix: Matrix, chosen: Column) -> DataFrame:
    """Every box of the chosen pages as the hull of its image."""
    names = [c.removesuffix("_minx") for c in pages.columns if c.endswith("_minx")]
    made = {}
    for name in names:
        box = geometry.box(name)
        made |= {f"{name}_{s}": F.when(chosen, new).otherwise(F.col(f"{name}_{s}")) for s, new in zip(SIDES, geometry.hull(matrix, box))}
    return pages.withColumns(made)


def cropped(pages: DataFrame, name: str, rectangle: str, chosen: Column) -> DataFrame:
    """A box (crop, art, bleed, trim or media) by an expression evaluated for each page."""
    return _put(pages, name, geometry.rectangle(rectangle, geometry.box("media")), chosen)


def without_box(pages: DataFrame, name: str, chosen: Column) -> DataFrame:
    return _put(pages, name, tuple(F.lit(None).cast("double") for _ in SIDES), chosen)


def copied_box(pages: DataFrame, source: str, target: str, chosen: Column) -> DataFrame:
    """One box's value in another; a page without the first takes its media box."""
    box = tuple(F.coalesce(F.col(f"{source}_{s}"), F.col(f"media_{s}")) for s in SIDES)
    return _put(pages, target, box, chosen)


def rotated(pages: DataFrame, degrees: int, chosen: Column, relative: bool = False) -> DataFrame:
    """The viewing rotation set, or added to; always 0, 90, 180 or 270."""
    if degrees % 90:
        raise ValueError("a viewing rotation is a multiple of 90 degrees")
    new = F.pmod(F.col("rotation") + degrees, F.lit(360)) if relative else F.lit(degrees % 360)
    return pages.withColumn("rotation", F.when(chosen, new.cast("int")).otherwise(F.col("rotation").cast("int")))


def _about(media: Box, matrix: Matrix) -> Matrix:
    """A matrix about a box's centre."""
    x, y = (media[0] + media[2]) / 2, (media[1] + media[3]) / 2
    return geometry.then(geometry.then(geometry.translate(-x, -y), matrix), geometry.translate(x, y))


def _quarter(degrees: Column) -> Matrix:
    """A turn by a multiple of 90 degrees, in whole numbers."""
    k = F.pmod(degrees, F.lit(360))
    cos = F.when(k == 0, 1.0).when(k == 180, -1.0).otherwise(0.0)
    sin = F.when(k == 90, 1.0).when(k == 270, -1.0).otherwise(0.0)
    return cos, sin, -sin, cos, F.lit(0.0), F.lit(0.0)


def contents_rotated(pages: DataFrame, degrees: float, chosen: Column) -> DataFrame:
    """Contents turned about the page's centre; boxes stay."""
    turn = _quarter(F.lit(int(degrees))) if degrees % 90 == 0 else geometry.rotate(degrees)
    return _moved(pages, _about(geometry.box("media"), turn), chosen)


def upright(pages: DataFrame, chosen: Column) -> DataFrame:
    """The viewing rotation folded into content and boxes, so that it is 0; a page that has none stays as it is."""
    turned = chosen & (F.pmod("rotation", F.lit(360)) != 0)
    matrix = _about(geometry.box("media"), _quarter(-F.col("rotation")))
    # the matrix as columns, or it would be worked out anew for every corner of every box
    names = [f"turn_{c}" for c in "abcdef"]
    placed = pages.withColumns(dict(zip(names, matrix)))
    matrix = tuple(map(F.col, names))
    made = _every_box(_moved(placed, matrix, turned), matrix, turned).drop(*names)
    return made.withColumn("rotation", F.when(chosen, 0).otherwise(F.col("rotation").cast("int")))


def flipped(pages: DataFrame, horizontal: bool, chosen: Column) -> DataFrame:
    """Contents mirrored within the media box; boxes stay."""
    mirror = geometry.scale(F.lit(-1.0 if horizontal else 1.0), F.lit(1.0 if horizontal else -1.0))
    return _moved(pages, _about(geometry.box("media"), mirror), chosen)


def shifted(pages: DataFrame, dx: str, dy: str, chosen: Column) -> DataFrame:
    """Contents moved by two expressions; boxes stay."""
    (x,), (y,) = (geometry.numbers(d, geometry.facts_of(geometry.box("media"))) for d in (dx, dy))
    return _moved(pages, geometry.translate(x, y), chosen)


def boxes_shifted(pages: DataFrame, dx: str, dy: str, chosen: Column) -> DataFrame:
    """Every box moved; contents stay."""
    (x,), (y,) = (geometry.numbers(d, geometry.facts_of(geometry.box("media"))) for d in (dx, dy))
    return _every_box(pages, geometry.translate(x, y), chosen)


def scaled(pages: DataFrame, sx: Column, sy: Column, chosen: Column) -> DataFrame:
    """Contents and every box scaled about the origin."""
    matrix = geometry.scale(sx, sy)
    return _every_box(_moved(pages, matrix, chosen), matrix, chosen)


def stretched(pages: DataFrame, size: str, chosen: Column) -> DataFrame:
    """Scaled to a size whatever the shape."""
    media = geometry.box("media")
    w, h = geometry.numbers(size, geometry.facts_of(media))
    return scaled(pages, w / (media[2] - media[0]), h / (media[3] - media[1]), chosen)


def fitted(pages: DataFrame, size: str, chosen: Column, share: float = 1.0) -> DataFrame:
    """Contents scaled to fit a size (or a share of it) in the middle, and the media box of that size; other boxes go along."""
    media = geometry.box("media")
    w, h = geometry.numbers(size, geometry.facts_of(media))
    s, _, _ = geometry.fitted(media[2] - media[0], media[3] - media[1], w, h)
    s = s * share
    dx, dy = (w - (media[2] - media[0]) * s) / 2 - media[0] * s, (h - (media[3] - media[1]) * s) / 2 - media[1] * s
    matrix = geometry.then(geometry.scale(s, s), geometry.translate(dx, dy))
    made = _every_box(_moved(pages, matrix, chosen), matrix, chosen)
    return _put(made, "media", (F.lit(0.0), F.lit(0.0), w, h), chosen)


def centred(pages: DataFrame, size: str, chosen: Column) -> DataFrame:
    """A media box of a size about the old one's centre; contents stay."""
    media = geometry.box("media")
    w, h = geometry.numbers(size, geometry.facts_of(media))
    x, y = (media[0] + media[2]) / 2, (media[1] + media[3]) / 2
    return _put(pages, "media", (x - w / 2, y - h / 2, x + w / 2, y + h / 2), chosen)


def contents_scaled(pages: DataFrame, s: float, chosen: Column) -> DataFrame:
    """Contents scaled about the page's centre; boxes stay."""
    return _moved(pages, _about(geometry.box("media"), geometry.scale(F.lit(float(s)), F.lit(float(s)))), chosen)


def stacked(pages: DataFrame, sheet_pages: int = 2) -> DataFrame:
    """Two-up in stack: pages of each sheet turned and scaled so that the sheet keeps the first page's shape: sheet, place and the matrix of each (m_a to m_f)."""
    media = geometry.box("media")
    w, h = media[2] - media[0], media[3] - media[1]
    place = F.pmod(F.col("pageno") - 1, F.lit(sheet_pages)).cast("int")
    # a page turned by a quarter fills a half of a sheet of its own shape
    s = F.least(w / h, h / 2 / w)
    dx, dy = (w + h * s) / 2, (1 - place) * h / 2 + (h / 2 - w * s) / 2
    turn = geometry.then(geometry.then(_quarter(F.lit(90)), geometry.scale(s, s)), geometry.translate(dx, dy))
    return pages.select("*", (F.floor((F.col("pageno") - 1) / sheet_pages) + 1).cast("int").alias("sheet"), place.alias("place"), *[m.alias(f"m_{c}") for c, m in zip("abcdef", turn)])
