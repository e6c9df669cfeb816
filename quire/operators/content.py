"""Content streams: tokens, operators, an interpreter for text and images, and rewrites of operators.

A stream is a text of operands and operators.  Parsing and interpreting are
ordered folds, so they run as vectorised Python per batch of pages; rewriting
rules that look at one operator at a time are filters over the parsed rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"\s*(?:(?P<comment>%[^\r\n]*)|(?P<string>\()|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<name>/[^\s\[\]<>()/%]*)"
    r"|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?![^\s\[\]<>()/%]))|(?P<open>\[|<<)|(?P<close>\]|>>)|(?P<operator>[^\s\[\]<>()/%]+))"
)
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)")
_BRACKET = re.compile(r"\\.|[()]", re.S)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def unquoted(string: str) -> str:
    """The characters of a string in brackets."""

    def one(found: re.Match[str]) -> str:
        c = found[1]
        return chr(int(c, 8) & 255) if c[0] in "01234567" else _ESCAPES.get(c, "" if c == "\n" else c)

    return re.sub(r"\\([0-7]{1,3}|.|\n)", one, string[1:-1], flags=re.S)


def quoted(text: str) -> str:
    return "(" + re.sub(r"([\\()])", r"\\\1", text) + ")"


def tokens(stream: str) -> Iterator[tuple[str, str]]:
    """(kind, token) in a row; brackets in strings nest to any depth, and a string that never ends ends the stream."""
    at = 0
    while found := _TOKEN.match(stream, at):
        kind, at = found.lastgroup, found.end()
        if kind != "string":
            yield kind, found[kind]
            continue
        depth = 1
        for one in _BRACKET.finditer(stream, at):
            depth += {"(": 1, ")": -1}.get(one[0], 0)
            if not depth:
                yield kind, stream[at - 1 : one.end()]
                at = one.end()
                break
        else:
            return


def operators(stream: str | None) -> Iterator[tuple[str, list[str]]]:
    """(operator, operand tokens) in a row; arrays and dictionaries are one operand each; what cannot be read ends the stream."""
    operands: list[str] = []
    depth, nested = 0, []
    for kind, token in tokens(stream or ""):
        if kind == "comment":
            continue
        if kind == "open":
            depth += 1
        if depth:
            nested.append(token)
            if kind == "close":
                depth -= 1
                if not depth:
                    operands.append(" ".join(nested))
                    nested = []
        elif kind == "operator":
            yield token, operands
            operands = []
        elif kind != "close":
            operands.append(token)


def multiplied(a: Matrix, b: Matrix) -> Matrix:
    """a, then b."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


@dataclass
class State:
    """The graphics and text state that reports need."""

    ctm: Matrix = IDENTITY
    width: float = 1.0
    font: str = ""
    size: float = 0.0
    leading: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 1.0
    rise: float = 0.0
    mode: int = 0
    fill: tuple[float, ...] = (0.0,)
    stroke: tuple[float, ...] = (0.0,)


@dataclass
class Interpreter:
    """Runs one page's operators; shown objects are (kind, text, x, y, size, font, depth)."""

    widths: Callable[[str, str], float] = field(default=lambda font, char: 0.5)
    forms: dict[str, str] = field(default_factory=dict)
    graphics: bool = False

    def run(self, stream: str | None) -> list[tuple]:
        self.state, self.stack, self.shown = State(), [], []
        self.text = self.line = IDENTITY
        self.points: list[tuple[float, float]] = []
        self.segments, self.clip, self.tags = 0, "", []
        self._run(stream, ())
        return self.shown

    def _run(self, stream: str | None, nested: tuple[str, ...]) -> None:
        """``nested``: the forms that are being drawn."""
        for operator, operands in operators(stream):
            self._one(operator, operands, nested)

    def _one(self, operator: str, operands: list[str], nested: tuple[str, ...]) -> None:
        numbers = [float(o) for o in operands if _NUMBER.fullmatch(o)]
        s = self.state
        match operator, len(numbers):
            case "q", _:
                self.stack.append(replace(s))
            case "Q", _ if self.stack:
                self.state = self.stack.pop()
            case "cm", 6:
                s.ctm = multiplied(tuple(numbers), s.ctm)
            case "w", 1:
                s.width = numbers[0]
            case "g" | "rg" | "k" | "sc" | "scn", _:
                s.fill = tuple(numbers)
            case "G" | "RG" | "K" | "SC" | "SCN", _:
                s.stroke = tuple(numbers)
            case "BT", _:
                self.text = self.line = IDENTITY
            case "Tf", 1:
                s.font, s.size = operands[0], numbers[0]
            case "Tc", 1:
                s.char_space = numbers[0]
            case "Tw", 1:
                s.word_space = numbers[0]
            case "Tz", 1:
                s.scale = numbers[0] / 100
            case "TL", 1:
                s.leading = numbers[0]
            case "Ts", 1:
                s.rise = numbers[0]
            case "Tr", 1:
                s.mode = int(numbers[0])
            case "Td", 2:
                self._move(*numbers)
            case "TD", 2:
                s.leading = -numbers[1]
                self._move(*numbers)
            case "Tm", 6:
                self.text = self.line = tuple(numbers)
            case "T*", _:
                self._move(0, -s.leading)
            case "Tj", _ if operands:
                self._show(operands[-1])
            case "'", _ if operands:
                self._move(0, -s.leading)
                self._show(operands[-1])
            case '"', 2 if len(operands) == 3:
                s.word_space, s.char_space = numbers
                self._move(0, -s.leading)
                self._show(operands[-1])
            case "TJ", _ if operands:
                for kind, token in tokens(operands[-1][1:-1]):
                    if kind == "number":
                        self.text = multiplied((1, 0, 0, 1, -float(token) / 1000 * s.size * s.scale, 0), self.text)
                    elif kind in ("string", "hex"):
                        self._show(token)
            case "Do", _ if operands:
                self._do(operands[-1], nested)
            case "m" | "l" | "c" | "v" | "y" | "h" | "re", _:
                self._path(operator, numbers)
            case "W" | "W*", _:
                self.clip = operator
            case "S" | "s" | "f" | "F" | "f*" | "B" | "B*" | "b" | "b*" | "n", _:
                self._paint(operator)
            case "sh", _ if operands:
                self._shading(operands[-1])
            case "BMC" | "BDC", _ if operands:
                self.tags.append(operands[0])
            case "EMC", _ if self.tags:
                self.tags.pop()

    def _move(self, x: float, y: float) -> None:
        self.text = self.line = multiplied((1, 0, 0, 1, x, y), self.line)

    def _show(self, token: str) -> None:
        s = self.state
        text = unquoted(token) if token[0] == "(" else bytes.fromhex(re.sub(r"\s", "", token[1:-1]).ljust(2, "0")).decode("latin-1")
        at = multiplied((s.size * s.scale, 0, 0, s.size, 0, s.rise), multiplied(self.text, s.ctm))
        self.shown.append(("text", text, at[4], at[5], s.size, s.font, len(self.stack)))
        width = sum((self.widths(s.font, c) * s.size + s.char_space + s.word_space * (c == " ")) * s.scale for c in text)
        self.text = multiplied((1, 0, 0, 1, width, 0), self.text)

    def _do(self, name: str, nested: tuple[str, ...]) -> None:
        if name in self.forms:
            # a form that draws itself, however far down, is passed over there
            if name not in nested:
                held = replace(self.state)
                self._run(self.forms[name], (*nested, name))
                self.state = held
        else:
            m = self.state.ctm
            self.shown.append(("image", name, m[4], m[5], (m[0] ** 2 + m[1] ** 2) ** 0.5, "", len(self.stack)))

    def _path(self, operator: str, numbers: list[float]) -> None:
        """Points of the path under construction, in page space; control points of curves count for its hull."""
        if operator == "re" and len(numbers) == 4:
            x, y, w, h = numbers
            corners = [x, y, x + w, y, x + w, y + h, x, y + h]
            self.segments += 5
        else:
            corners = numbers
            self.segments += 1
        for x, y in zip(corners[::2], corners[1::2]):
            at = multiplied((1, 0, 0, 1, x, y), self.state.ctm)
            self.points.append((at[4], at[5]))

    def _paint(self, operator: str) -> None:
        """A path object (or a clip) at the lower left of its hull, its size the larger side, its text the operator and the segments."""
        if self.graphics and self.points:
            xs, ys = zip(*self.points)
            side = max(max(xs) - min(xs), max(ys) - min(ys))
            if operator != "n":
                self.shown.append(("path", f"{operator} {self.segments}", min(xs), min(ys), side, "", len(self.stack)))
            if self.clip:
                self.shown.append(("clip", f"{self.clip} {self.segments}", min(xs), min(ys), side, "", len(self.stack)))
        self.points, self.segments, self.clip = [], 0, ""

    def _shading(self, name: str) -> None:
        if self.graphics:
            m = self.state.ctm
            self.shown.append(("shading", name, m[4], m[5], 0.0, "", len(self.stack)))


#: Rows that a task gathers before it hands them on; what one page makes is never parted.
BLOCK = 20_000

_OBJECT = {"seq": pa.int32(), "kind": pa.string(), "text": pa.string(), "x": pa.float64(), "y": pa.float64(), "size": pa.float64(), "font": pa.string(), "depth": pa.int32()}
_OBJECT_SQL = {"seq": "int", "kind": "string", "text": "string", "x": "double", "y": "double", "size": "double", "font": "string", "depth": "int"}


def _blocks(batches: Iterator[pa.RecordBatch], made: Callable[[str | None], list[tuple]]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
    """(pages without their streams, the rows that ``made`` makes of each stream, the last column), some ``BLOCK`` rows at a time."""
    for batch in batches:
        kept, streams = batch.select(range(batch.num_columns - 1)), batch.column(batch.num_columns - 1)
        start, held, n = 0, [], 0
        for i in range(len(streams)):
            held.append(made(streams[i].as_py()))
            n += len(held[-1])
            if n >= BLOCK or i + 1 == len(streams):
                yield kept.slice(start, i + 1 - start), held
                start, held, n = i + 1, [], 0


def _columns(rows: list[tuple], kinds: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(values, kind) for values, kind in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]


def _row_each(pages: DataFrame, content: str, keep: tuple[str, ...], made: Callable[[], Callable[[str | None], list[tuple]]], columns: dict[str, pa.DataType], kinds: str) -> DataFrame:
    """One row for each that ``made`` makes of a page's stream: keep and ``columns`` (``kinds`` in SQL)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, held in _blocks(batches, made()):
            places = pa.array([i for i, rows in enumerate(held) for _ in rows], pa.int64())
            values = _columns([row for rows in held for row in rows], list(columns.values()))
            yield pa.RecordBatch.from_arrays([*(c.take(places) for c in kept.columns), *values], [*keep, *columns])

    held = dict(pages.dtypes)
    return pages.select(*keep, content).mapInArrow(run, ", ".join([*(f"{k} {held[k]}" for k in keep), kinds]))


def parsed(pages: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc_id", "pageno")) -> DataFrame:
    """One row an operator: keep, seq (from 1), op, args (operands joined by a space)."""

    def made() -> Callable[[str | None], list[tuple]]:
        return lambda stream: [(i, op, " ".join(args)) for i, (op, args) in enumerate(operators(stream), 1)]

    return _row_each(pages, content, keep, made, {"seq": pa.int32(), "op": pa.string(), "args": pa.string()}, "seq int, op string, args string")


def _objects(forms: dict[str, str] | None, graphics: bool) -> Callable[[str | None], list[tuple]]:
    interpreter = Interpreter(forms=forms or {}, graphics=graphics)
    return lambda stream: [(i, *made) for i, made in enumerate(interpreter.run(stream), 1)]


def shown(pages: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc_id", "pageno"), forms: dict[str, str] | None = None, graphics: bool = False) -> DataFrame:
    """One row an object that a page shows: keep, seq, kind (text or image; with ``graphics`` path, clip and shading too), text, x, y, size, font, depth of saved states."""
    return _row_each(pages, content, keep, lambda: _objects(forms, graphics), _OBJECT, ", ".join(f"{k} {v}" for k, v in _OBJECT_SQL.items()))


def extracted(pages: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc_id", "pageno")) -> DataFrame:
    """Each page's text in the order it is shown: one row a page, made of that row alone."""

    @F.pandas_udf("string")
    def made(streams: pd.Series) -> pd.Series:
        interpreter = Interpreter()
        return streams.map(lambda stream: "".join(text for kind, text, *_ in interpreter.run(stream) if kind == "text"), na_action=None)

    return pages.select(*keep, made(F.col(content)).alias("shown"))


def rewritten(pages: DataFrame, change: Callable[[str, list[str]], tuple[str, list[str]] | None], content: str = "content") -> DataFrame:
    """``pages`` with every operator changed, or dropped where ``change`` gives None; one operator a line."""

    @F.pandas_udf("string")
    def made(streams: pd.Series) -> pd.Series:
        def one(stream: str | None) -> str | None:
            if stream is None:
                return None
            return "\n".join(" ".join([*new[1], new[0]]) for op, args in operators(stream) if (new := change(op, args)) is not None)

        return streams.map(one, na_action=None)

    return pages.withColumn(content, made(F.col(content)))


def without(*names: str) -> Callable[[str, list[str]], tuple[str, list[str]] | None]:
    """A change that drops operators: text with Tj TJ ' ", clipping with W W*, render modes with Tr."""
    return lambda op, args: None if op in names else (op, args)


TEXT_SHOWING = ("Tj", "TJ", "'", '"')


def blackened(what: str) -> Callable[[str, list[str]], tuple[str, list[str]] | None]:
    """A change that makes fills (or strokes) black."""
    names = ("g", "rg", "k", "sc", "scn") if what == "fills" else ("G", "RG", "K", "SC", "SCN")
    return lambda op, args: (names[0], ["0"]) if op in names else (op, args)


def thinned(width: float) -> Callable[[str, list[str]], tuple[str, list[str]] | None]:
    """A change that raises thinner lines to a width, or with a negative one lowers thicker lines to it."""

    def change(op: str, args: list[str]) -> tuple[str, list[str]]:
        if op != "w" or len(args) != 1:
            return op, args
        now = float(args[0])
        new = max(now, width) if width > 0 else min(now, -width)
        return op, [args[0] if new == now else f"{new:g}"]

    return change


def without_stamps(pages: DataFrame, tag: str, content: str = "content") -> DataFrame:
    """``pages`` without what stands between a marked-content tag and the end that belongs to it, nested ones included."""

    @F.pandas_udf("string")
    def made(streams: pd.Series) -> pd.Series:
        def one(stream: str | None) -> str | None:
            if stream is None:
                return None
            kept, inside = [], 0
            for op, args in operators(stream):
                if inside:
                    inside += (op in ("BMC", "BDC")) - (op == "EMC")
                elif op in ("BMC", "BDC") and args and args[0] == tag:
                    inside = 1
                else:
                    kept.append(" ".join([*args, op]))
            return "\n".join(kept)

        return streams.map(one, na_action=None)

    return pages.withColumn(content, made(F.col(content)))


def framed(content: Column, before: str = "", after: str = "", chosen: Column | None = None) -> Column:
    """Operators put before and after a page's content, which keeps its own graphics state; null content stays null."""
    made = F.concat(F.lit(before + "\n" if before else ""), F.lit("q\n"), content, F.lit("\nQ"), F.lit("\n" + after if after else ""))
    return made if chosen is None else F.when(chosen, made).otherwise(content)


def artifact(content: Column) -> Column:
    """All content marked as an artifact."""
    return F.concat(F.lit("/Artifact BMC\n"), content, F.lit("\nEMC"))


def rectangle_ops(box: tuple[Column, Column, Column, Column], colour: str = "0", width: float = 1.0) -> Column:
    """Operators that draw a box's outline."""
    return F.format_string(f"q {width:g} w {colour} G %.2f %.2f %.2f %.2f re S Q", box[0], box[1], box[2] - box[0], box[3] - box[1])


def drafted(boxes: bool) -> Callable[[str, list[str]], tuple[str, list[str]] | None]:
    """A change that takes images away, or puts a crossed box in their place."""
    cross = ["0 0 m 1 1 l 0 1 m 1 0 l 0 0 1 1 re"]
    return lambda op, args: ("S", cross) if op == "Do" and boxes else None if op == "Do" else (op, args)


def deflated(streams: Column) -> Column:
    """Streams compressed with zlib; one that would not shrink stays as it is, after a byte that tells which."""

    @F.pandas_udf("binary")
    def made(values: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> bytes | None:
            if raw is None:
                return None
            small = zlib.compress(raw)
            return b"Z" + small if len(small) < len(raw) else b"R" + raw

        return values.map(one, na_action=None)

    return made(streams)


def inflated(streams: Column) -> Column:
    """The inverse of :func:`deflated`."""

    @F.pandas_udf("binary")
    def made(values: pd.Series) -> pd.Series:
        return values.map(lambda raw: None if raw is None else zlib.decompress(raw[1:]) if raw[:1] == b"Z" else raw[1:], na_action=None)

    return made(streams)


def clipped(content: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Content that shows inside a box alone."""
    clip = F.format_string("%.2f %.2f %.2f %.2f re W n", box[0], box[1], box[2] - box[0], box[3] - box[1])
    return F.concat(F.lit("q\n"), clip, F.lit("\n"), content, F.lit("\nQ"))


def trim_marks(box: tuple[Column, Column, Column, Column], gap: float, length: float) -> Column:
    """Operators that draw two short lines outside each corner of a box."""
    x0, y0, x1, y1 = box
    lines = [
        (x - d * (gap + length), y, x - d * gap, y) for x, d in ((x0, 1), (x1, -1)) for y in (y0, y1)
    ] + [(x, y - d * (gap + length), x, y - d * gap) for y, d in ((y0, 1), (y1, -1)) for x in (x0, x1)]
    return F.concat(F.lit("q 0.25 w "), F.concat_ws(" ", *[F.format_string("%.2f %.2f m %.2f %.2f l", *line) for line in lines]), F.lit(" S Q"))


def bounds_shown(pages: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc_id", "pageno"), height: float = 1.0, width: float = 0.5) -> DataFrame:
    """keep, seq and the box of every text a page shows: from where it begins, ``width`` of its size a character."""
    made = shown(pages, content, keep).where("kind = 'text'")
    return made.select(*keep, "seq", F.col("x").alias("minx"), F.col("y").alias("miny"), (F.col("x") + F.length("text") * F.col("size") * width).alias("maxx"), (F.col("y") + F.col("size") * height).alias("maxy"))


#: Operators that set a state which a painting operator may use, by what they set.
_SETS = {"g": "fill", "rg": "fill", "k": "fill", "G": "stroke", "RG": "stroke", "K": "stroke", "w": "width", "J": "cap", "j": "join", "M": "miter", "d": "dash", "Tf": "font", "Tr": "mode", "Tc": "char", "Tw": "word", "Tz": "scale", "TL": "leading", "Ts": "rise"}


def without_noops(pages: DataFrame, content: str = "content") -> DataFrame:
    """``pages`` without operators that change nothing: those that set what is set already, and saved states in which nothing is left."""

    @F.pandas_udf("string")
    def made(streams: pd.Series) -> pd.Series:
        def one(stream: str | None) -> str | None:
            if stream is None:
                return None
            state: dict[str, tuple] = {}
            stack: list[dict[str, tuple]] = []
            kept: list[tuple[str, list[str]]] = []
            for op, args in operators(stream):
                if op == "q":
                    stack.append(dict(state))
                elif op == "Q":
                    state = stack.pop() if stack else {}
                    if kept and kept[-1][0] == "q":
                        kept.pop()
                        continue
                elif op in _SETS:
                    if state.get(_SETS[op]) == (op, *args):
                        continue
                    state[_SETS[op]] = (op, *args)
                elif op in ("gs", "Do", "BT", "ET"):
                    if op in ("gs", "Do"):
                        state = {}
                elif op in ("cs", "CS", "sc", "scn", "SC", "SCN"):
                    state.pop("stroke" if op[0] in "CS" else "fill", None)
                elif op == '"':
                    state.pop("char", None)
                    state.pop("word", None)
                elif op == "TD":
                    state.pop("leading", None)
                kept.append((op, args))
            return "\n".join(" ".join([*args, op]) for op, args in kept)

        return streams.map(one, na_action=None)

    return pages.withColumn(content, made(F.col(content)))


def moved(content: Column, matrix: tuple[Column, ...]) -> Column:
    """Content under a matrix of its own; null content stays null."""
    return F.concat(F.lit("q\n"), F.format_string("%.6f %.6f %.6f %.6f %.6f %.6f cm", *[m.cast("double") for m in matrix]), F.lit("\n"), content, F.lit("\nQ"))


def glyph_boxes(pages: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc_id", "pageno"), width: float = 0.5) -> DataFrame:
    """One row a character shown: keep, seq (of its string), place (from 0), char, and the box of its cell; all characters are ``width`` of the size wide."""
    texts = shown(pages, content, keep).where("kind = 'text'")
    each = texts.select(*keep, "seq", "x", "y", "size", F.posexplode(F.split("text", "")).alias("place", "char")).where("char <> ''")
    x = F.col("x") + F.col("place") * F.col("size") * width
    return each.select(*keep, "seq", "place", "char", x.alias("minx"), F.col("y").alias("miny"), (x + F.col("size") * width).alias("maxx"), (F.col("y") + F.col("size")).alias("maxy"))


def emptied(pages: DataFrame, chosen: Column) -> DataFrame:
    """Chosen pages without content and annotations."""
    return pages.withColumn("content", F.when(chosen, "").otherwise(F.col("content"))).withColumn("annots", F.when(chosen, 0).otherwise(F.col("annots")))


def form_drawn(pages: DataFrame, form: DataFrame, chosen: Column) -> DataFrame:
    """A form (one row, column form: its name) drawn over the chosen pages' content, which keeps its own state."""
    both = pages.join(F.broadcast(form.limit(1)), how="cross")
    made = F.concat(F.lit("q\n"), F.col("content"), F.lit("\nQ\nq 1 0 0 1 0 0 cm "), F.col("form"), F.lit(" Do Q"))
    return both.withColumn("content", F.when(chosen, made).otherwise(F.col("content"))).drop("form")


def drawn(program: Column, page: int = 1) -> Column:
    """The operators of a page of a drawing (see :mod:`quire.functions.drawing`); null for no program or page, an error for one that is wrong."""
    from quire.functions import drawing

    @F.pandas_udf("string")
    def made(programs: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            found = [] if text is None else drawing.compiled(text)
            return found[page - 1] if len(found) >= page else None

        return programs.map(one, na_action=None)

    return made(program)


class _Redactor(Interpreter):
    """Rewrites a page's operators without the glyphs whose cells meet an area; what is taken leaves its width."""

    areas: list[tuple[float, float, float, float]]

    def rewritten(self, stream: str, areas: list[tuple[float, float, float, float]]) -> str:
        self.areas, lines = areas, []
        self.state, self.stack, self.shown = State(), [], []
        self.text = self.line = IDENTITY
        self.points, self.segments, self.clip, self.tags = [], 0, "", []
        for operator, operands in operators(stream):
            if operator in TEXT_SHOWING and operands:
                lines += self._kept(operator, operands)
            else:
                lines.append(" ".join([*operands, operator]))
                self._step(operator, operands)
        return "\n".join(lines)

    def _step(self, operator: str, operands: list[str]) -> None:
        """Take one operator into account as it stands."""
        held, self.forms = self.forms, {}
        self._one(operator, operands, ())
        self.forms = held

    def _kept(self, operator: str, operands: list[str]) -> list[str]:
        lines = []
        if operator in ("'", '"'):
            if operator == '"' and len(operands) == 3:
                lines += [f"{operands[0]} Tw", f"{operands[1]} Tc"]
                self.state.word_space, self.state.char_space = float(operands[0]), float(operands[1])
            lines.append("T*")
            self._move(0, -self.state.leading)
        parts: list[str] = []
        for kind, token in tokens(operands[-1][1:-1]) if operator == "TJ" else [("string", operands[-1])]:
            if kind == "number":
                parts.append(token)
                self.text = multiplied((1, 0, 0, 1, -float(token) / 1000 * self.state.size * self.state.scale, 0), self.text)
            elif kind in ("string", "hex"):
                parts += self._glyphs(unquoted(token) if token[0] == "(" else bytes.fromhex(re.sub(r"\s", "", token[1:-1]).ljust(2, "0")).decode("latin-1"))
        if any(p[0] != "(" for p in parts) or operator == "TJ":
            return [*lines, f"[ {' '.join(parts)} ] TJ"]
        return [*lines, *(f"{p} Tj" for p in parts)]

    def _glyphs(self, text: str) -> list[str]:
        """The kept characters as strings, and numbers for the width of those taken."""
        s, parts, run = self.state, [], ""
        for c in text:
            width = self.widths(s.font, c)
            at = multiplied((s.size * s.scale, 0, 0, s.size, 0, s.rise), multiplied(self.text, s.ctm))
            xs, ys = zip(*[(x * at[0] + y * at[2] + at[4], x * at[1] + y * at[3] + at[5]) for x, y in ((0, 0), (width, 0), (0, 1), (width, 1))])
            box = min(xs), min(ys), max(xs), max(ys)
            advance = (width * s.size + s.char_space + s.word_space * (c == " ")) * s.scale
            if any(max(a[0], box[0]) < min(a[2], box[2]) and max(a[1], box[1]) < min(a[3], box[3]) for a in self.areas):
                if run:
                    parts.append(quoted(run))
                    run = ""
                parts.append(f"{-advance / (s.size * s.scale) * 1000:g}" if s.size * s.scale else "0")
            else:
                run += c
            self.text = multiplied((1, 0, 0, 1, advance, 0), self.text)
        return [*parts, quoted(run)] if run or not parts else parts


def redacted(pages: DataFrame, areas: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc_id", "pageno"), made_of: Column | None = None) -> DataFrame:
    """``pages`` without the glyphs that lie in areas (keep, minx, miny, maxx, maxy); pages without areas stay as they are.

    The text stays where it is: a glyph's width is left as spacing.  One page and
    its areas are one row.  ``made_of``, where pages have no streams yet, makes them
    of other columns; the join with the areas then shuffles only these.
    """
    boxes = areas.groupBy(*keep).agg(F.collect_list(F.array("minx", "miny", "maxx", "maxy")).alias("areas"))

    @F.pandas_udf("string")
    def made(streams: pd.Series, areas: pd.Series) -> pd.Series:
        redactor = _Redactor()

        def one(stream: str | None, area: object) -> str | None:
            return stream if stream is None or area is None else redactor.rewritten(stream, [tuple(a) for a in area])

        return pd.Series([one(s, a) for s, a in zip(streams, areas)])

    return pages.join(boxes, list(keep), "left").withColumn(content, made(F.col(content) if made_of is None else made_of, F.col("areas"))).drop("areas")


def as_json(pages: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc_id", "pageno"), kinds: tuple[str, ...] = ("text", "image", "path", "clip", "shading")) -> DataFrame:
    """Each page's objects of some kinds as one JSON list, in the order they are shown: one row a page, made of that row alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, held in _blocks(batches, _objects(None, True)):
            chosen = [[row for row in rows if row[1] in kinds] for rows in held]
            ends = pa.array([0, *accumulate(map(len, chosen))], pa.int32())
            objects = pa.StructArray.from_arrays(_columns([row for rows in chosen for row in rows], list(_OBJECT.values())), list(_OBJECT))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(ends, objects)], [*keep, "objects"])

    held = dict(pages.dtypes)
    listed = pages.select(*keep, content).mapInArrow(run, ", ".join([*(f"{k} {held[k]}" for k in keep), f"objects array<struct<{', '.join(f'{k}: {v}' for k, v in _OBJECT_SQL.items())}>>"]))
    return listed.select(*keep, F.to_json("objects").alias("json"))
