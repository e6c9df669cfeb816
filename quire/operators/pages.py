"""Operators on ordered pages: a page table has doc_id, pageno (1..n) and what a page holds.

Order is a column and never the order of rows.  Nothing here is collected;
windows are per document, so a document's page list is the largest group.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOC, PAGE = "doc_id", "pageno"


def count(pages: DataFrame) -> DataFrame:
    """The number of pages of each document."""
    return pages.groupBy(DOC).agg(F.count("*").alias("n_pages"))


def renumbered(pages: DataFrame, *order: str | Column, by: str = DOC, to: str = PAGE) -> DataFrame:
    """Pages numbered from 1 in an order."""
    return pages.withColumn(to, F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("int"))


def merged(inputs: list[DataFrame], every: int | None = None, group: str = DOC) -> DataFrame:
    """One page list for each value of ``group`` out of those of several inputs, in order (columns: group, pos, ...).

    With ``every`` the inputs take turns, that many pages each, as long as they
    last; without it each input follows the one before.
    """
    tagged = functools.reduce(DataFrame.unionByName, [d.withColumn("input_no", F.lit(i)) for i, d in enumerate(inputs)])
    turn = [F.floor((F.col("pos") - 1) / every)] if every else []
    return renumbered(tagged, *turn, "input_no", "pos", by=group)


def split_every(pages: DataFrame, n: int) -> DataFrame:
    """Chunks of n pages: adds chunk (from 1) and the page's place in it."""
    return pages.withColumn("chunk", (F.floor((F.col(PAGE) - 1) / n) + 1).cast("int")).withColumn("chunk_page", ((F.col(PAGE) - 1) % n + 1).cast("int"))


def split_at(pages: DataFrame, marked: Column) -> DataFrame:
    """A new chunk begins at each marked page; the pages before the first mark are chunk 1."""
    w = Window.partitionBy(DOC).orderBy(PAGE)
    flag = F.when(marked & (F.col(PAGE) > 1), 1).otherwise(0)
    return pages.withColumn("chunk", (F.sum(flag).over(w) + 1).cast("int"))


def split_by_size(pages: DataFrame, size: str, limit: int) -> DataFrame:
    """Greedy chunks whose sizes sum to ``limit`` at most (a page that is larger stands alone): (doc_id, pageno, chunk).

    A fold over each document's pages in order, as they stream by; no document is held whole.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk, held = None, 1, 0
        for batch in batches:
            chunks = []
            for doc, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if doc != at:
                    at, chunk, held = doc, 1, 0
                elif held + n > limit:
                    chunk, held = chunk + 1, 0
                held += n
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chunks, pa.int32())], [DOC, PAGE, "chunk"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    sorted_pages = pages.where(F.col(DOC).isNotNull()).select(DOC, PAGE, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size")).repartition(DOC).sortWithinPartitions(DOC, PAGE)
    return sorted_pages.mapInArrow(fold, f"{DOC} {kind[DOC]}, {PAGE} {kind[PAGE]}, chunk int")


def sprayed(pages: DataFrame, k: int, pos: str = PAGE) -> DataFrame:
    """Pages dealt to k outputs in turn: adds output (from 0) and the page's place in it."""
    return pages.withColumn("output", F.pmod(F.col(pos) - 1, F.lit(k)).cast("int")).withColumn("output_page", (F.floor((F.col(pos) - 1) / k) + 1).cast("int"))


def _with_blanks(pages: DataFrame, before: Column, after: Column) -> DataFrame:
    """Each page with numbers of blanks before and after it, numbered anew; ``blank`` marks those."""
    page = F.array(F.struct(F.lit(False).alias("blank")))
    blanks = lambda n: F.array_repeat(F.struct(F.lit(True).alias("blank")), n.cast("int"))
    rows = pages.select("*", F.posexplode(F.concat(blanks(before), page, blanks(after))).alias("nth", "made")).withColumn("blank", F.col("made.blank")).drop("made")
    return renumbered(rows.withColumnRenamed(PAGE, "old_page"), "old_page", "nth").drop("nth").withColumn("old_page", F.when(~F.col("blank"), F.col("old_page")))


def padded(pages: DataFrame, chosen: Column, before: bool = True) -> DataFrame:
    """A blank page before (or after) each chosen page: columns of pages with old_page (null if blank), blank, pageno."""
    one = F.when(chosen, 1).otherwise(0)
    return _with_blanks(pages, one if before else F.lit(0), F.lit(0) if before else one)


def padded_every(pages: DataFrame, n: int) -> DataFrame:
    """A blank after every n-th page, but not after the last."""
    last = F.max(PAGE).over(Window.partitionBy(DOC))
    return _with_blanks(pages.withColumn("last_page", last), F.lit(0), F.when((F.col(PAGE) % n == 0) & (F.col(PAGE) < F.col("last_page")), 1).otherwise(0)).drop("last_page")


def padded_to_multiple(pages: DataFrame, n: int, before: bool = False) -> DataFrame:
    """Blanks at the end (or the beginning), as many as it takes to a multiple of n pages."""
    last = F.max(PAGE).over(Window.partitionBy(DOC))
    lacking = F.pmod(-F.col("last_page"), F.lit(n))
    at = F.when(F.col(PAGE) == (1 if before else F.col("last_page")), lacking).otherwise(0)
    return _with_blanks(pages.withColumn("last_page", last), at if before else F.lit(0), F.lit(0) if before else at).drop("last_page")


def combined(under: DataFrame, over: DataFrame) -> DataFrame:
    """Page i of one table with page i of the other laid over it, as columns over_*; the first decides how many pages there are."""
    renamed = over.select(DOC, PAGE, *[F.col(c).alias(f"over_{c}") for c in over.columns if c not in (DOC, PAGE)])
    return under.join(renamed, [DOC, PAGE], "left")


def stamped(pages: DataFrame, stamp: DataFrame, chosen: Column, under: bool = False) -> DataFrame:
    """One stamp row (column stamp) over, or under, every chosen page's content."""
    both = pages.join(F.broadcast(stamp.limit(1).select(F.col("stamp"))), how="cross")
    joined = F.concat("stamp", "content") if under else F.concat("content", "stamp")
    return both.withColumn("content", F.when(chosen, joined).otherwise(F.col("content"))).drop("stamp")


def imposed(pages: DataFrame, across: int, down: int, columns: bool = False, right_to_left: bool = False, bottom_to_top: bool = False) -> DataFrame:
    """n-up: adds sheet (from 1), and the cell's col and row (from 0, top left) of each page."""
    per = across * down
    cell = (F.col(PAGE) - 1) % per
    col, row = (F.floor(cell / down), cell % down) if columns else (cell % across, F.floor(cell / across))
    col, row = (across - 1 - col if right_to_left else col), (down - 1 - row if bottom_to_top else row)
    return pages.select("*", (F.floor((F.col(PAGE) - 1) / per) + 1).cast("int").alias("sheet"), col.cast("int").alias("col"), row.cast("int").alias("row"))


def chopped(pages: DataFrame, across: int, down: int, width: str, height: str) -> DataFrame:
    """Each page as a grid of pages by rows from the top, with the box of each; numbered anew, old_page kept."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(across * down - 1)))
    rows = pages.withColumnRenamed(PAGE, "old_page").select("*", cells.alias("cell"))
    col, row = F.col("cell") % across, F.floor(F.col("cell") / across)
    w, h = F.col(width) / across, F.col(height) / down
    boxed = rows.select("*", (col * w).alias("minx"), (F.col(height) - (row + 1) * h).alias("miny"), ((col + 1) * w).alias("maxx"), (F.col(height) - row * h).alias("maxy"))
    return renumbered(boxed, "old_page", "cell")


def chopped_at(pages: DataFrame, line: float, vertical: bool, width: str, height: str) -> DataFrame:
    """Each page cut in two at a line: left then right, or lower then upper part."""
    zero = F.lit(0.0)
    w, h = F.col(width).cast("double"), F.col(height).cast("double")
    if vertical:
        parts = [(zero, zero, F.lit(line), h), (F.lit(line), zero, w, h)]
    else:
        parts = [(zero, zero, w, F.lit(line)), (zero, F.lit(line), w, h)]
    boxes = F.array(*[F.struct(*[c.alias(n) for c, n in zip(p, ("minx", "miny", "maxx", "maxy"))]) for p in parts])
    rows = pages.withColumnRenamed(PAGE, "old_page").select("*", F.posexplode(boxes).alias("part", "made")).select("*", "made.*").drop("made")
    return renumbered(rows, "old_page", "part")


def blank(docs: DataFrame, n: Column | int, width: float, height: float) -> DataFrame:
    """n blank pages of a size for each document."""
    n = F.lit(n) if isinstance(n, int) else n
    return docs.select(DOC, F.explode(F.sequence(F.lit(1), n.cast("int"))).alias(PAGE)).select(DOC, PAGE, F.lit(width).alias("w"), F.lit(height).alias("h"))


def current_mark(pages: DataFrame, marks: DataFrame, level: int) -> DataFrame:
    """For each page the text of its bookmark of a level, as an as-of join with reset.

    ``marks``: doc_id, seq, level, target, text.  Marks are read in the order of
    seq up to the first that stands beyond the page.  It is the first of that
    level on the page itself, else the last before it that no mark of a higher
    level (a smaller number) follows.
    """
    ordered = Window.partitionBy(DOC).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    # upto: the least page from which this mark is read
    reached = marks.where((F.col("level") <= level) & F.col("target").isNotNull()).withColumn("upto", F.max("target").over(ordered))
    here = reached.where((F.col("level") == level) & (F.col("upto") == F.col("target"))).groupBy(DOC, F.col("target").alias(PAGE)).agg(F.min(F.struct("seq", "text")).alias("here"))
    # marks and pages in one order; without a mark on the page itself those before it decide
    both = reached.select(DOC, F.col("upto").alias(PAGE), "seq", "level", "text", F.lit(False).alias("is_page")).unionByName(pages.select(DOC, PAGE).distinct().withColumn("is_page", F.lit(True)), True)
    so_far = Window.partitionBy(DOC).orderBy(PAGE, "is_page", "seq").rowsBetween(Window.unboundedPreceding, 0)
    earlier = F.last(F.when(F.col("level") == level, F.struct("seq", "text")), True).over(so_far)
    reset = F.max(F.when(F.col("level") < level, F.col("seq"))).over(so_far)
    before = both.select(DOC, PAGE, "is_page", earlier.alias("earlier"), reset.alias("reset")).where("is_page")
    found = before.join(here, [DOC, PAGE], "left").select(DOC, PAGE, F.when(F.col("here").isNotNull(), F.col("here.text")).when(F.col("reset").isNull() | (F.col("earlier.seq") > F.col("reset")), F.col("earlier.text")).alias("mark"))
    return pages.join(found, [DOC, PAGE], "left")


def labelled(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Page labels: the range (style, prefix, startpage, startvalue) that begins at or before each page last; without one a page's label is its number."""
    from quire.functions.text import label

    both = ranges.select(DOC, F.col("startpage").alias(PAGE), F.struct("startpage", "style", "prefix", "startvalue").alias("r"), F.lit(False).alias("is_page"))
    both = both.unionByName(pages.select(DOC, PAGE).distinct().withColumn("is_page", F.lit(True)), True)
    so_far = Window.partitionBy(DOC).orderBy(PAGE, "is_page", "r").rowsBetween(Window.unboundedPreceding, 0)
    latest = both.select(DOC, PAGE, "is_page", F.last("r", True).over(so_far).alias("r")).where("is_page").drop("is_page")
    number = F.col("r.startvalue") + F.col(PAGE) - F.col("r.startpage")
    text = F.when(F.col("r").isNull(), F.col(PAGE).cast("string")).otherwise(label(F.col("r.style"), F.col("r.prefix"), number))
    return pages.join(latest, [DOC, PAGE], "left").withColumn("label", text).drop("r")


def label_ranges(chosen: DataFrame, style: str, prefix: str, start: int, progressive: bool) -> DataFrame:
    """One label range for each run of chosen pages (doc_id, pageno); progressive ones count on over runs."""
    w = Window.partitionBy(DOC).orderBy(PAGE)
    runs = chosen.select(DOC, PAGE).distinct().withColumn("island", F.col(PAGE) - F.row_number().over(w)).groupBy(DOC, "island").agg(F.min(PAGE).alias("startpage"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(DOC).orderBy("startpage").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    value = (F.lit(start) + before if progressive else F.lit(start)).cast("int")
    made = runs.select(DOC, "startpage", F.lit(style).alias("style"), F.lit(prefix).alias("prefix"), value.alias("startvalue"))
    plain = made.groupBy(DOC).agg(F.min("startpage").alias("m")).where("m > 1").select(DOC, F.lit(1).alias("startpage"), F.lit("D").alias("style"), F.lit("").alias("prefix"), F.lit(1).alias("startvalue"))
    return made.unionByName(plain)


def bad_marks(marks: DataFrame, counts: DataFrame) -> DataFrame:
    """Bookmarks that break the outline's rules: the first has level 0, none is more than one deeper than the one before, targets are pages (0 goes nowhere)."""
    before = F.lag("level").over(Window.partitionBy(DOC).orderBy("seq"))
    checked = marks.withColumn("before", before).join(counts, DOC, "left")
    reason = (
        F.when(F.col("before").isNull() & (F.col("level") != 0), "first level").when(F.col("level") >= F.col("before") + 2, "level")
        .when((F.col("target") < 0) | (F.col("target") > F.coalesce("n_pages", F.lit(0))), "target")
    )
    return checked.withColumn("reason", reason).where("reason is not null").drop("before", "n_pages")


def pages_fitted(lines: DataFrame, text: str, width: int, per_page: int) -> DataFrame:
    """Text set in lines of at most ``width`` characters, filled greedily, and pages of ``per_page`` lines: (doc_id, pageno, line, text).

    A word longer than a line stands alone and is cut.  A fold over each text.
    """

    def fold(batches):
        for pdf in batches:
            rows = []
            for doc, body in zip(pdf[DOC], pdf["body"]):
                made = []
                for paragraph in (body or "").split("\n"):
                    line = ""
                    for word in paragraph.split():
                        while len(word) > width:
                            if line:
                                made.append(line)
                                line = ""
                            made.append(word[:width])
                            word = word[width:]
                        if line and len(line) + 1 + len(word) > width:
                            made.append(line)
                            line = word
                        else:
                            line = f"{line} {word}" if line else word
                    made.append(line)
                rows += [(doc, i // per_page + 1, i % per_page + 1, t) for i, t in enumerate(made)]
            yield pd.DataFrame(rows, columns=[DOC, PAGE, "line", "text"])

    kind = dict(lines.dtypes)[DOC]
    return lines.select(DOC, F.col(text).alias("body")).mapInPandas(fold, f"{DOC} {kind}, {PAGE} int, line int, text string")


def contents_list(marks: DataFrame, per_page: int, width: int) -> DataFrame:
    """A table of contents: doc_id, pageno (of the list), line and text, the target at the right end after dots.

    A title that does not fit is cut.
    """
    number = F.row_number().over(Window.partitionBy(DOC).orderBy("seq")) - 1
    title = F.concat(F.repeat(F.lit("  "), F.col("level").cast("int")), F.col("text"))
    target = F.col("target").cast("string")
    line = F.concat(F.rpad(title, (width - F.length(target)).cast("int"), F.lit(".")), target)
    return marks.select(DOC, (F.floor(number / per_page) + 1).cast("int").alias(PAGE), (number % per_page + 1).cast("int").alias("line"), line.alias("text"))


def only_page(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """The one page of each document that a range holds (doc_id, pageno); fails where it holds another number."""
    counted = chosen.groupBy(DOC).agg(F.count("*").alias("n"), F.min(PAGE).alias(PAGE))
    checked = pages.select(DOC).distinct().join(counted, DOC, "left")
    return checked.select(DOC, F.when(F.col("n") == 1, F.col(PAGE)).otherwise(F.raise_error(F.lit("the range must be one page")).cast("int")).alias(PAGE))


def outline_text(marks: DataFrame) -> DataFrame:
    """Each document's marks as lines of level, quoted text, target and "open"."""
    from quire.functions.text import escaped

    line = F.concat_ws(" ", F.col("level"), F.concat(F.lit('"'), escaped(F.col("text")), F.lit('"')), F.col("target"), F.when(F.col("is_open"), F.lit("open")))
    listed = F.array_sort(F.collect_list(F.struct("seq", line.alias("t"))))
    return marks.groupBy(DOC).agg(F.array_join(F.transform(listed, lambda s: s["t"]), "\n").alias("outline"))


def outline_marks(outlines: DataFrame) -> DataFrame:
    """The inverse: doc_id, seq (from 1), level, text, target, is_open; lines of another form are left out."""
    from quire.functions.text import unescaped

    pattern = r'^(\d+) "((?:[^"\\]|\\.)*)" (\d+)( open)?$'
    lines = outlines.select(DOC, F.posexplode(F.split("outline", "\n")).alias("seq", "l")).where(F.regexp_like("l", F.lit(pattern)))
    part = lambda k: F.regexp_extract("l", pattern, k)
    return lines.select(DOC, (F.col("seq") + 1).alias("seq"), part(1).cast("int").alias("level"), unescaped(part(2)).alias("text"), part(3).cast("int").alias("target"), (part(4) != "").alias("is_open"))


def label_ranges_of(texts: DataFrame, column: str = "json") -> DataFrame:
    """Label ranges of a JSON list of {"startpage", "style", "prefix", "startvalue"}; a style, prefix or value that is missing is D, empty or 1."""
    rows = texts.select(DOC, F.explode(F.from_json(column, "array<struct<startpage:int,style:string,prefix:string,startvalue:int>>")).alias("r"))
    return rows.select(DOC, "r.startpage", F.coalesce("r.style", F.lit("D")).alias("style"), F.coalesce("r.prefix", F.lit("")).alias("prefix"), F.coalesce("r.startvalue", F.lit(1)).alias("startvalue"))


def opened_to(marks: DataFrame, level: int) -> DataFrame:
    """Marks with is_open: those above a level are open, the others closed."""
    return marks.withColumn("is_open", F.col("level") < level)


def with_contents(pages: DataFrame, marks: DataFrame, per_page: int, width: int, content: str = "content") -> DataFrame:
    """Pages with those of a table of contents in front: doc_id, pageno, content, old_page (null on these); targets are the new numbers."""
    sheets = marks.groupBy(DOC).agg(F.ceil(F.count("*") / per_page).cast("int").alias("sheets"))
    moved = marks.join(sheets, DOC).withColumn("target", F.col("target") + F.col("sheets"))
    lines = contents_list(moved, per_page, width)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"])
    front = lines.groupBy(DOC, PAGE).agg(F.array_join(listed, "\n").alias(content)).withColumn("old_page", F.lit(None).cast("int"))
    rest = pages.join(sheets, DOC, "left").select(DOC, (F.col(PAGE) + F.coalesce("sheets", F.lit(0))).cast("int").alias(PAGE), F.col(content), F.col(PAGE).cast("int").alias("old_page"))
    return front.unionByName(rest)


_MARK = "struct<level:int,text:string,page:int,open:boolean,italic:boolean,bold:boolean,colour:array<double>>"


def outline_json(marks: DataFrame) -> DataFrame:
    """Each document's marks (seq, level, text, target, is_open, flags: bit 0 italic, bit 1 bold, colour) as a JSON list."""
    one = F.struct("seq", "level", "text", F.col("target").alias("page"), F.col("is_open").alias("open"), (F.col("flags").bitwiseAND(1) != 0).alias("italic"), (F.col("flags").bitwiseAND(2) != 0).alias("bold"), "colour")
    return marks.groupBy(DOC).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("json"))


def outline_of_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """The inverse: doc_id, seq (from 1), level, text, target, is_open, flags, colour (black where it is missing)."""
    rows = texts.select(DOC, F.posexplode(F.from_json(column, f"array<{_MARK}>")).alias("at", "m"))
    flags = F.when(F.col("m.italic"), 1).otherwise(0) + F.when(F.col("m.bold"), 2).otherwise(0)
    black = F.array(*[F.lit(0.0)] * 3)
    return rows.select(DOC, (F.col("at") + 1).alias("seq"), "m.level", "m.text", F.col("m.page").alias("target"), F.coalesce("m.open", F.lit(False)).alias("is_open"), flags.alias("flags"), F.coalesce("m.colour", black).alias("colour"))
