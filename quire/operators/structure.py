"""Accessibility rules over a structure tree and over facts of documents, each a table of violations.

The tree is rows doc_id, node, parent (null at the top), ord, kind (a name such as
/H1 or /Table), and has_alt, scope, ident for what attributes say.  Facts are one
row a document; annotations are rows as :mod:`quire.operators.annotations` has them.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The kinds a role may end at.
STANDARD = (
    "/Document", "/Part", "/Art", "/Sect", "/Div", "/BlockQuote", "/Caption", "/TOC", "/TOCI", "/Index", "/NonStruct", "/Private", "/P", "/H", "/H1", "/H2", "/H3", "/H4", "/H5", "/H6", "/L", "/LI", "/Lbl", "/LBody",
    "/Table", "/TR", "/TH", "/TD", "/THead", "/TBody", "/TFoot", "/Span", "/Quote", "/Note", "/Reference", "/BibEntry", "/Code", "/Link", "/Annot", "/Ruby", "/RB", "/RT", "/RP", "/Warichu", "/WT", "/WP", "/Figure", "/Formula", "/Form",
)


def _broken(rows: DataFrame, rule: str) -> DataFrame:
    return rows.select("doc_id", F.lit(rule).alias("rule")).distinct()


def with_parents(tree: DataFrame) -> DataFrame:
    """Nodes with parent_kind, null at the top."""
    above = tree.select("doc_id", F.col("node").alias("parent"), F.col("kind").alias("parent_kind"))
    return tree.join(above, ["doc_id", "parent"], "left")


def children_rules(tree: DataFrame) -> list[DataFrame]:
    """What may stand under tables, rows, lists, contents, ruby and warichu."""
    t = with_parents(tree)
    kind, above = F.col("kind"), F.col("parent_kind")
    row_parents = ("/THead", "/TBody", "/TFoot")
    table = (above == "/Table") & ~kind.isin("/Caption", "/TR", *row_parents) | above.isin(*row_parents) & (kind != "/TR") | (above == "/TR") & ~kind.isin("/TH", "/TD")
    listed = (above == "/L") & ~kind.isin("/Caption", "/LI", "/L") | (above == "/LI") & ~kind.isin("/Lbl", "/LBody")
    used = tree.select("doc_id", F.col("parent").alias("node")).distinct()
    empty = tree.where(kind.isin("/L", "/LI")).join(used, ["doc_id", "node"], "left_anti")
    contents = (above == "/TOC") & ~kind.isin("/TOC", "/TOCI") | (above == "/TOCI") & ~kind.isin("/TOC", "/Lbl", "/Reference", "/P", "/NonStruct") | (kind == "/TOCI") & ~F.coalesce(above, F.lit("")).isin("/TOC")
    ruby = (above == "/Ruby") & ~kind.isin("/RB", "/RT", "/RP")
    warichu = (above == "/Warichu") & ~kind.isin("/WT", "/WP")
    return [_broken(t.where(table), "09-004"), _broken(t.where(listed).select("doc_id").union(empty.select("doc_id")), "09-005"), _broken(t.where(contents), "09-006"), _broken(t.where(ruby), "09-007"), _broken(t.where(warichu), "09-008")]


def heading_rules(tree: DataFrame) -> list[DataFrame]:
    """The first numbered heading is level 1, none skips a level, a node has one /H, and /H is not mixed with numbered ones; in the order of ``ord``."""
    numbered = tree.where(F.regexp_like("kind", F.lit("^/H[0-9]+$"))).withColumn("level", F.substring("kind", 3, 9).cast("int"))
    before = F.lag("level").over(Window.partitionBy("doc_id").orderBy("ord"))
    heads = numbered.withColumn("before", before)
    plain = tree.where("kind = '/H'")
    twice = plain.groupBy("doc_id", "parent").count().where("count > 1")
    return [
        _broken(heads.where("before is null and level <> 1"), "14-002"), _broken(heads.where("level > coalesce(before, 1) + 1"), "14-003"), _broken(twice, "14-006"),
        _broken(plain.join(numbered.select("doc_id").distinct(), "doc_id", "left_semi"), "14-007"),
    ]


def attribute_rules(tree: DataFrame) -> list[DataFrame]:
    """Figures and formulas have alternatives, headers of tables a scope, notes an identifier of their own."""
    notes = tree.where("kind = '/Note'")
    same = notes.where("ident is not null").groupBy("doc_id", "ident").count().where("count > 1")
    return [
        _broken(tree.where("kind = '/Figure' and not has_alt"), "13-004"), _broken(tree.where("kind = '/TH' and scope is null"), "15-003"), _broken(tree.where("kind = '/Formula' and not has_alt"), "17-002"),
        _broken(notes.where("ident is null"), "19-003"), _broken(same, "19-004"),
    ]


def role_rules(roles: DataFrame, most: int = 64) -> list[DataFrame]:
    """Role maps (doc_id, role, target): every chain ends at a standard kind, none goes in a circle, and standard kinds are not mapped.

    A chain is followed ``most`` steps; a map has fewer roles than that or is circular.
    """
    steps = roles.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "target"))).alias("map"))
    follow = lambda c: F.when(c.isNull(), c).otherwise(F.try_element_at("map", c))
    chain = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.struct(F.col("role").alias("at"), F.col("role").alias("last")), lambda a, _: F.struct(follow(a["at"]).alias("at"), F.coalesce(follow(a["at"]), a["last"]).alias("last")))
    ends = roles.join(steps, "doc_id").withColumn("end", chain)
    standard = F.col("end.last").isin(*STANDARD)
    return [
        _broken(ends.where(F.col("end.at").isNull() & ~standard), "02-001"), _broken(ends.where(F.col("end.at").isNotNull() & ~F.col("role").isin(*STANDARD)), "02-003"),
        _broken(roles.where(F.col("role").isin(*STANDARD)), "02-004"),
    ]


def fact_rules(facts: DataFrame) -> list[DataFrame]:
    """Rules on one row a document: suspects, xmp, display_title, language, encrypted, permissions, dynamic_render."""
    has = lambda c: F.col("xmp").isNotNull() & ~F.contains("xmp", F.lit(c))
    conditions: dict[str, Column] = {
        "01-007": F.col("suspects"), "06-001": F.col("xmp").isNull(), "06-002": has("pdfuaid:part"), "06-003": has("<dc:title"), "07-001": F.col("display_title").isNull(), "07-002": ~F.col("display_title"),
        "11-001": F.coalesce("language", F.lit("")) == "", "25-001": F.col("dynamic_render"), "26-002": F.col("permissions").bitwiseAND(1 << 9) == 0,
    }
    return [_broken(facts.where(c), rule) for rule, c in conditions.items()]


def annotation_rules(annots: DataFrame, pages: DataFrame) -> list[DataFrame]:
    """Rules on annotations (subtype, contents, enclosing: the kind of the structure element around, null if none) and on the tab order of their pages (doc_id, pageno, tabs)."""
    kind, around = F.col("subtype"), F.coalesce("enclosing", F.lit(""))
    bare = F.coalesce("contents", F.lit("")) == ""
    used = pages.join(annots.select("doc_id", "pageno").distinct(), ["doc_id", "pageno"], "left_semi")
    return [
        _broken(annots.where(~kind.isin("Widget", "Link", "PrinterMark", "Popup") & (around != "/Annot")), "28-002"), _broken(annots.where(~kind.isin("Widget", "Popup") & bare), "28-004"),
        _broken(annots.where(kind == "TrapNet"), "28-007"), _broken(used.where("tabs is null"), "28-008"), _broken(used.where("tabs <> 'S'"), "28-009"),
        _broken(annots.where((kind == "Widget") & (around != "/Form")), "28-010"), _broken(annots.where((kind == "Link") & (around != "/Link")), "28-011"), _broken(annots.where((kind == "Link") & bare), "28-012"),
        _broken(annots.where((kind == "PrinterMark") & (around != "")), "28-017"),
    ]


def font_rules(fonts: DataFrame) -> list[DataFrame]:
    """Rules on fonts: subtype, embedded, encoding, base_encoding, symbolic, to_unicode, cid_map."""
    truetype = (F.col("subtype") == "TrueType") & ~F.col("symbolic")
    named = F.coalesce("encoding", "base_encoding")
    simple = F.coalesce("encoding", F.lit("")).isin("MacRomanEncoding", "MacExpertEncoding", "WinAnsiEncoding")
    return [
        _broken(fonts.where((F.col("subtype") == "CIDFontType2") & F.col("cid_map").isNull()), "31-005"), _broken(fonts.where(~F.col("embedded") & (F.col("subtype") != "Type3")), "31-009"),
        _broken(fonts.where(truetype & named.isNull()), "31-019"), _broken(fonts.where(truetype & named.isNotNull() & ~named.isin("MacRomanEncoding", "WinAnsiEncoding")), "31-021"),
        _broken(fonts.where((F.col("subtype") == "TrueType") & F.col("symbolic") & F.col("encoding").isNotNull()), "31-024"), _broken(fonts.where(~F.col("to_unicode") & ~simple & (F.col("subtype") != "Type0")), "31-027"),
    ]


def group_rules(configurations: DataFrame) -> list[DataFrame]:
    """Rules on the configurations of optional content: is_default, name, has_as."""
    unnamed = F.coalesce("name", F.lit("")) == ""
    return [_broken(configurations.where(unnamed & ~F.col("is_default")), "20-001"), _broken(configurations.where(unnamed & F.col("is_default")), "20-002"), _broken(configurations.where("has_as"), "20-003")]


def check(*rules: list[DataFrame]) -> DataFrame:
    """(doc_id, rule): one row for each rule that a document breaks."""
    return functools.reduce(DataFrame.unionByName, [r for some in rules for r in some])
