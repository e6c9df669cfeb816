"""Page ranges: a small language of sequences of pages, compiled to array columns.

A range is parsed once on the driver; evaluation is a column over one row of
facts per document (see :func:`facts`), so it stays in the JVM.  Used as a
sequence a range keeps its order and its duplicates; used as a set it is asked
only whether it holds a page.

    n           page n                      ~n        the n-th page from the end
    a-b         ascending or descending     end       the last page
    r,s         one after the other         all  reverse  empty
    odd  even  portrait  landscape          as a word, or after a list for all of it
    annotated   pages with annotations      [label]   the first page of that label
    NOT r       the other pages, ascending  kDUP r    each page k times
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RangeError(ValueError):
    """The text is not a page range."""


_SUFFIXES = ("portrait", "landscape", "even", "odd")
_PART = re.compile(r"(?:\[((?:\\.|[^\\\]])*)\]|([^,\[\]]+))(?:,|$)")
_TERM = re.compile(r"~?\d+|end")


@dataclass(frozen=True)
class Facts:
    """Columns of one document: page count, and arrays of pages with a property; labels map a label to its first page."""

    last: Column
    portrait: Column | None = None
    landscape: Column | None = None
    annotated: Column | None = None
    labels: Column | None = None

    def held(self, name: str) -> Column:
        found = getattr(self, name)
        if found is None:
            raise RangeError(f"no {name} pages are known here")
        return found


def facts(pages: DataFrame, doc: str = "doc_id", page: str = "pageno", width: str | None = None, height: str | None = None, annotations: str | None = None, label: str | None = None) -> DataFrame:
    """One row a document: ``doc``, last_page and what the given columns allow (portrait_pages, landscape_pages, annotated_pages, label_pages).

    A square page is neither portrait nor landscape.
    """
    made = [F.max(page).cast("int").alias("last_page")]

    def pages_where(condition: Column, name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, F.col(page).cast("int")))).alias(name)

    if width and height:
        made += [pages_where(F.col(width) < F.col(height), "portrait_pages"), pages_where(F.col(width) > F.col(height), "landscape_pages")]
    if annotations:
        made.append(pages_where(F.col(annotations) > 0, "annotated_pages"))
    if label is None:
        return pages.groupBy(doc).agg(*made)
    first = pages.groupBy(doc, label).agg(F.min(page).cast("int").alias("first_page")).where(F.col(label).isNotNull())
    labels = first.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct(label, "first_page"))).alias("label_pages"))
    return pages.groupBy(doc).agg(*made).join(labels, doc, "left")


def columns_of(facts_row: DataFrame) -> Facts:
    """The :class:`Facts` whose columns a table made by :func:`facts` has."""
    has = {c: F.col(c) for c in facts_row.columns}
    return Facts(has["last_page"], has.get("portrait_pages"), has.get("landscape_pages"), has.get("annotated_pages"), has.get("label_pages"))


def _ints(*values: Column) -> Column:
    return F.array(*[v.cast("int") for v in values])


def _term(text: str, at: Facts) -> Column:
    if not _TERM.fullmatch(text):
        raise RangeError(f"not a page: {text!r}")
    if text == "end":
        return at.last
    return at.last + 1 - int(text[1:]) if text[0] == "~" else F.lit(int(text))


def _span(text: str, at: Facts) -> Column:
    first, dash, second = text.partition("-")
    a = _term(first, at)
    if not dash:
        return _ints(a)
    b = _term(second, at)
    span = F.sequence(a.cast("int"), b.cast("int"))
    # a range to or from the end never starts beyond it
    if second == "end":
        span = F.when(a > at.last, _ints(at.last)).otherwise(span)
    elif first == "end":
        span = F.when(b > at.last, _ints(at.last)).otherwise(span)
    return span


def _word(text: str, at: Facts) -> Column | None:
    everything = F.when(at.last >= 1, F.sequence(F.lit(1), at.last.cast("int"))).otherwise(_ints())
    match text:
        case "all":
            return everything
        case "reverse":
            return F.reverse(everything)
        case "empty":
            return _ints()
        case "annotated":
            return at.held("annotated")
        case "odd" | "even" | "portrait" | "landscape":
            return _kept(text, everything, at)
    return None


def _kept(quality: str, pages: Column, at: Facts) -> Column:
    if quality in ("odd", "even"):
        return F.filter(pages, lambda p: p % 2 == int(quality == "odd"))
    return F.filter(pages, lambda p: F.array_contains(at.held(quality), p))


def _list(text: str, at: Facts) -> Column:
    parts, place = [], 0
    while place < len(text):
        found = _PART.match(text, place)
        if not found:
            raise RangeError(f"not a page range: {text!r}")
        label, plain = found.groups()
        if label is not None:
            page = F.element_at(at.held("labels"), re.sub(r"\\(.)", r"\1", label))
            parts.append(F.when(page.isNull(), _ints()).otherwise(_ints(page)))
        else:
            word = _word(plain, at)
            parts.append(_span(plain, at) if word is None else word)
        place = found.end()
    if not parts or text.endswith(","):
        raise RangeError(f"not a page range: {text!r}")
    return functools.reduce(lambda a, b: F.concat(a, b), parts)


def _parsed(text: str, at: Facts) -> Column:
    if text.startswith("NOT"):
        return F.array_except(_word("all", at), _parsed(text[3:], at))
    if found := re.match(r"(\d{1,6})DUP", text):
        return F.flatten(F.transform(_parsed(text[found.end() :], at), lambda p: F.array_repeat(p, int(found[1]))))
    for suffix in _SUFFIXES:
        if text.endswith(suffix) and text != suffix and not text.endswith(f",{suffix}"):
            return _kept(suffix, _list(text[: -len(suffix)], at), at)
    return _list(text, at)


def sequence_of(text: str, at: Facts) -> Column:
    """The range as an array of pages, in order, duplicates kept; pages the document has not are dropped.

    Raises RangeError before anything is planned if the text is not a range.
    """
    plain = re.sub(r"\s+", "", text) if "[" not in text else text.strip()
    pages = _parsed(plain or "all", at)
    return F.filter(pages, lambda p: (p >= 1) & (p <= at.last))


def selected(pages: DataFrame, text: str, known: DataFrame | None = None, doc: str = "doc_id", page: str = "pageno") -> DataFrame:
    """The pages of a range in its order: all columns of ``pages`` and ``pos`` from 1 (sequence semantics)."""
    known = facts(pages, doc, page) if known is None else known
    chosen = known.select(doc, F.posexplode(sequence_of(text, columns_of(known))).alias("pos", page))
    return pages.join(chosen.withColumn("pos", F.col("pos") + 1), [doc, page])


def member(pages: DataFrame, text: str, known: DataFrame | None = None, doc: str = "doc_id", page: str = "pageno", to: str = "in_range") -> DataFrame:
    """``pages`` with a boolean: whether the range holds the page (set semantics)."""
    known = facts(pages, doc, page) if known is None else known
    chosen = known.select(doc, sequence_of(text, columns_of(known)).alias("range_pages"))
    return pages.join(chosen, doc).withColumn(to, F.array_contains("range_pages", F.col(page).cast("int"))).drop("range_pages")


def compacted(pages: DataFrame, doc: str = "doc_id", page: str = "pageno") -> DataFrame:
    """The inverse: each document's set of pages as a range text (``range_text``), given all its pages' count in last_page.

    Every even page of more than three pages is "even", every odd one of more
    than two "odd", all are "all"; else runs a-b, comma-joined.
    """
    held = pages.groupBy(doc).agg(F.array_sort(F.collect_set(F.col(page).cast("int"))).alias("p"), F.max("last_page").alias("last"))
    every = F.sequence(F.lit(1), F.col("last"))
    starts = F.filter("p", lambda x: ~F.array_contains(F.col("p"), x - 1))
    ends = F.filter("p", lambda x: ~F.array_contains(F.col("p"), x + 1))
    runs = F.array_join(F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b))), ",")
    text = (
        F.when((F.col("last") > 3) & (F.col("p") == F.filter(every, lambda x: x % 2 == 0)), "even")
        .when((F.col("last") > 2) & (F.col("p") == F.filter(every, lambda x: x % 2 == 1)), "odd")
        .when(F.col("p") == every, "all")
        .otherwise(runs)
    )
    return held.select(doc, text.alias("range_text"))
