"""Geometry of pages: units, boxes, affine matrices and positions, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points of a unit, and paper sizes in millimetres (width, height).
POINTS = {"pt": 1.0, "in": 72.0, "cm": 72.0 / 2.54, "mm": 7.2 / 2.54}
PAPER = {"a0": (841, 1189), "a1": (594, 841), "a2": (420, 594), "a3": (297, 420), "a4": (210, 297), "a5": (148, 210), "a6": (105, 148), "a7": (74, 105), "a8": (52, 74), "a9": (37, 52), "a10": (26, 37)}
PAPER_INCHES = {"usletter": (8.5, 11), "uslegal": (8.5, 14)}

Box = tuple[Column, Column, Column, Column]
Matrix = tuple[Column, Column, Column, Column, Column, Column]

_TOKEN = re.compile(r"(-?\d+(?:\.\d+)?|-?\.\d+)(pt|cm|mm|in)?|(add|sub|mul|div)|([A-Za-z][A-Za-z0-9]*)")


def box(name: str, page: str = "") -> Box:
    """The four columns of a box kept as <name>_minx, _miny, _maxx, _maxy."""
    return tuple(F.col(f"{page}{name}_{side}") for side in ("minx", "miny", "maxx", "maxy"))


def facts_of(media: Box, prefix: str = "P") -> dict[str, Column]:
    """What expressions may name of a box: PW, PH, PMINX, PMINY, PMAXX, PMAXY (or with another first letter)."""
    return {f"{prefix}W": media[2] - media[0], f"{prefix}H": media[3] - media[1], f"{prefix}MINX": media[0], f"{prefix}MINY": media[1], f"{prefix}MAXX": media[2], f"{prefix}MAXY": media[3]}


def numbers(text: str, known: dict[str, Column] | None = None) -> list[Column]:
    """The values of an expression such as "10mm 20mm PW 2in sub a4".

    An operator takes the value before it and the one after it; operators run
    from left to right.  A paper's name is its width and height.
    """
    values: list[Column] = []
    waiting = None
    place = 0
    for found in _TOKEN.finditer(text):
        if text[place : found.start()].strip():
            raise ValueError(f"not an expression: {text!r}")
        place = found.end()
        number, unit, operator, name = found.groups()
        if operator:
            if not values or waiting:
                raise ValueError(f"nothing to {operator} in {text!r}")
            waiting = operator
            continue
        if number:
            new = [F.lit(float(number) * POINTS[unit or "pt"])]
        elif known and name.upper() in known:
            new = [known[name.upper()]]
        elif (paper := name.lower().removesuffix("portrait").removesuffix("landscape")) in PAPER | PAPER_INCHES:
            w, h = (v * POINTS["mm"] for v in PAPER[paper]) if paper in PAPER else (v * 72 for v in PAPER_INCHES[paper])
            new = [F.lit(float(v)) for v in ((h, w) if name.lower().endswith("landscape") else (w, h))]
        else:
            raise ValueError(f"unknown name {name!r} in {text!r}")
        if waiting:
            a, b = values.pop(), new[0]
            values.append({"add": a + b, "sub": a - b, "mul": a * b, "div": a / b}[waiting])
            values += new[1:]
            waiting = None
        else:
            values += new
    if waiting or text[place:].strip():
        raise ValueError(f"not an expression: {text!r}")
    return values


def rectangle(text: str, media: Box) -> Box:
    """A rectangle per page: x y width height, or after "?" its two corners; names are the page's."""
    absolute = text.startswith("?")
    x, y, a, b = numbers(text.removeprefix("?"), facts_of(media))
    return (x, y, a, b) if absolute else (x, y, x + a, y + b)


def touches(a: Box, b: Box) -> Column:
    """Whether two boxes have an intersection that is not empty."""
    return (F.greatest(a[0], b[0]) < F.least(a[2], b[2])) & (F.greatest(a[1], b[1]) < F.least(a[3], b[3]))


def encloses(outer: Box, inner: Box) -> Column:
    """Whether one box holds another strictly inside it."""
    return (outer[0] < inner[0]) & (outer[1] < inner[1]) & (outer[2] > inner[2]) & (outer[3] > inner[3])


def translate(dx: Column, dy: Column) -> Matrix:
    one, zero = F.lit(1.0), F.lit(0.0)
    return one, zero, zero, one, dx, dy


def scale(sx: Column, sy: Column) -> Matrix:
    zero = F.lit(0.0)
    return sx, zero, zero, sy, zero, zero


def rotate(degrees: float) -> Matrix:
    angle = F.radians(F.lit(float(degrees)))
    return F.cos(angle), F.sin(angle), -F.sin(angle), F.cos(angle), F.lit(0.0), F.lit(0.0)


def then(first: Matrix, second: Matrix) -> Matrix:
    """The matrix that applies ``first`` and then ``second`` to a point."""
    a, b, c, d, e, f = first
    p, q, r, s, t, u = second
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


def applied(m: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def hull(m: Matrix, b: Box) -> Box:
    """The box around a box's image under a matrix."""
    points = [applied(m, x, y) for x in (b[0], b[2]) for y in (b[1], b[3])]
    xs, ys = zip(*points)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def position(where: str, media: Box, margin: float = 0.0) -> tuple[Column, Column]:
    """The point of an anchor: centre, left, right, top, bottom, topleft, ... ; a margin moves it inwards (both ways at corners)."""
    x0, y0, x1, y1 = media
    x, y = (x0 + x1) / 2, (y0 + y1) / 2
    if "left" in where:
        x = x0 + margin
    elif "right" in where:
        x = x1 - margin
    if "top" in where:
        y = y1 - margin
    elif "bottom" in where:
        y = y0 + margin
    return x, y


def fitted(width: Column, height: Column, to_width: Column, to_height: Column) -> tuple[Column, Column, Column]:
    """The largest scale at which a page fits a size, and the offsets that centre it."""
    s = F.least(to_width / width, to_height / height)
    return s, (to_width - width * s) / 2, (to_height - height * s) / 2
