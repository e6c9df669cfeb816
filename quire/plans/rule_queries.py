"""Queries of accessibility rules over structure trees, document facts, annotations and fonts made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import reports, structure
from quire.plans.edit_queries import _ANNOT, annots
from quire.plans.proxies import table
from quire.plans.registry import query

#: Kinds of nodes; a part's is chosen by its key and size.
KINDS = ("/Table", "/TR", "/TH", "/TD", "/L", "/LI", "/Lbl", "/H1", "/H3", "/H", "/Figure", "/Note")

_TREE = f"""tree AS (SELECT p_partkey // 12 AS doc_id, p_partkey AS node, CASE WHEN p_partkey % 12 > 0 THEN p_partkey // 12 * 12 + (p_partkey % 12 - 1) // 2 END AS parent, p_partkey AS ord,
    [{", ".join(f"'{k}'" for k in KINDS)}][CAST((p_partkey * 7 + p_size) % 12 + 1 AS INTEGER)] AS kind, p_size % 2 = 0 AS has_alt, CASE WHEN p_size % 3 = 0 THEN 'Row' END AS scope, CASE WHEN p_size % 4 > 0 THEN p_brand END AS ident FROM part),
up AS (SELECT t.*, p.kind AS above FROM tree t LEFT JOIN tree p ON p.node = t.parent)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    first = F.floor(k / 12).cast("long")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), ((k * 7 + size) % 12 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        first.alias("doc_id"), k.alias("node"), F.when(k % 12 > 0, first * 12 + F.floor((k % 12 - 1) / 2)).cast("long").alias("parent"), k.alias("ord"), kind.alias("kind"),
        (size % 2 == 0).alias("has_alt"), F.when(size % 3 == 0, "Row").alias("scope"), F.when(size % 4 > 0, F.col("p_brand")).alias("ident"), "p_name",
    )


def _union(rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{rule}' AS rule FROM {rows}" for rule, rows in rules.items())


@query("verify_children", f"WITH {_TREE} " + _union({
    "09-004": "up WHERE (above = '/Table' AND kind NOT IN ('/Caption', '/TR', '/THead', '/TBody', '/TFoot')) OR (above = '/TR' AND kind NOT IN ('/TH', '/TD'))",
    "09-005": "up WHERE (above = '/L' AND kind NOT IN ('/Caption', '/LI', '/L')) OR (above = '/LI' AND kind NOT IN ('/Lbl', '/LBody')) OR (kind IN ('/L', '/LI') AND node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL))",
}))
def verify_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands under tables, rows and lists."""
    return structure.check(structure.children_rules(tree(spark, sf_dir)))


@query("verify_headings", f"WITH {_TREE}, n AS (SELECT *, CAST(substr(kind, 3) AS INTEGER) AS level, lag(CAST(substr(kind, 3) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM tree WHERE regexp_matches(kind, '^/H[0-9]$')) " + _union({
    "14-002": "n WHERE before IS NULL AND level <> 1", "14-003": "n WHERE level > coalesce(before, 1) + 1",
    "14-006": "(SELECT doc_id FROM tree WHERE kind = '/H' GROUP BY doc_id, parent HAVING count(*) > 1)", "14-007": "tree WHERE kind = '/H' AND doc_id IN (SELECT doc_id FROM n)",
}))
def verify_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.check(structure.heading_rules(tree(spark, sf_dir)))


@query("verify_attributes", f"WITH {_TREE} " + _union({
    "13-004": "tree WHERE kind = '/Figure' AND NOT has_alt", "15-003": "tree WHERE kind = '/TH' AND scope IS NULL", "19-003": "tree WHERE kind = '/Note' AND ident IS NULL",
    "19-004": "(SELECT doc_id FROM tree WHERE kind = '/Note' AND ident IS NOT NULL GROUP BY doc_id, ident HAVING count(*) > 1)",
}))
def verify_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.check(structure.attribute_rules(tree(spark, sf_dir)))


@query("verify_roles", """WITH r AS (SELECT s_suppkey // 4 AS doc_id, s_suppkey % 4 AS k, s_nationkey % 3 AS m FROM supplier),
    map AS (SELECT doc_id, CASE k WHEN 0 THEN '/A' WHEN 1 THEN '/B' WHEN 2 THEN '/C' ELSE '/H1' END AS role, CASE k WHEN 0 THEN '/B' WHEN 1 THEN '/C' WHEN 2 THEN ['/P', '/A', '/Unknown'][CAST(m + 1 AS INTEGER)] ELSE '/P' END AS target FROM r),
    last AS (SELECT doc_id, max(CASE WHEN role = '/C' THEN target END) AS t, max(CASE WHEN role = '/A' THEN 1 END) AS a, max(CASE WHEN role = '/B' THEN 1 END) AS b FROM map GROUP BY doc_id)
    SELECT DISTINCT doc_id, '02-004' AS rule FROM map WHERE role = '/H1' UNION ALL SELECT doc_id, '02-003' FROM last WHERE t = '/A' AND a = 1 AND b = 1
    UNION ALL SELECT doc_id, '02-001' FROM last WHERE t = '/Unknown' OR (t IS NULL AND (a = 1 OR b = 1)) OR (t = '/A' AND (a IS NULL OR b IS NULL)) OR (a = 1 AND b IS NULL)""")
def verify_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role maps that end at no standard kind, go in a circle, or map a standard kind."""
    k, m = F.col("s_suppkey") % 4, F.col("s_nationkey") % 3
    role = F.when(k == 0, "/A").when(k == 1, "/B").when(k == 2, "/C").otherwise("/H1")
    target = F.when(k == 0, "/B").when(k == 1, "/C").when(k == 2, F.element_at(F.array(F.lit("/P"), F.lit("/A"), F.lit("/Unknown")), (m + 1).cast("int"))).otherwise("/P")
    return structure.check(structure.role_rules(table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 4).cast("long").alias("doc_id"), role.alias("role"), target.alias("target"))))


_FACTS = """fact AS (SELECT o_orderkey AS doc_id, o_orderstatus = 'F' AS suspects, CASE WHEN o_orderkey % 3 > 0 THEN '<x>' || CASE WHEN o_orderkey % 2 = 0 THEN '<pdfuaid:part>1</pdfuaid:part>' ELSE '<dc:title>t</dc:title>' END || '</x>' END AS xmp,
    CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 > 2 END AS title, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'en' END AS language, o_orderkey % 7 = 0 AS dynamic, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN -1 - 512 ELSE -1 END END AS word FROM orders)"""


@query("verify_facts", f"WITH {_FACTS} " + _union({
    "01-007": "fact WHERE suspects", "06-001": "fact WHERE xmp IS NULL", "06-002": "fact WHERE xmp NOT LIKE '%pdfuaid:part%'", "06-003": "fact WHERE xmp NOT LIKE '%<dc:title%'", "07-001": "fact WHERE title IS NULL",
    "07-002": "fact WHERE NOT title", "11-001": "fact WHERE coalesce(language, '') = ''", "25-001": "fact WHERE dynamic", "26-002": "fact WHERE (word & 512) = 0",
}))
def verify_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on what documents say of themselves."""
    k = F.col("o_orderkey")
    xmp = F.when(k % 3 > 0, F.concat(F.lit("<x>"), F.when(k % 2 == 0, "<pdfuaid:part>1</pdfuaid:part>").otherwise("<dc:title>t</dc:title>"), F.lit("</x>")))
    word = F.when(k % 2 == 0, F.when(k % 8 == 0, -513).otherwise(-1))
    facts = table(spark, sf_dir, "orders").select(
        k.alias("doc_id"), (F.col("o_orderstatus") == "F").alias("suspects"), xmp.alias("xmp"), F.when(k % 5 > 0, k % 5 > 2).alias("display_title"), F.when(k % 4 == 0, "").when(k % 4 == 1, "en").alias("language"),
        (k % 7 == 0).alias("dynamic_render"), word.alias("permissions"),
    )
    return structure.check(structure.fact_rules(facts))


@query("verify_annotations", f"""WITH {_ANNOT}, a AS (SELECT *, CASE WHEN minx > 30 THEN NULL ELSE contents END AS said, CASE CAST(miny AS INTEGER) % 3 WHEN 0 THEN '/Link' WHEN 1 THEN '/Annot' END AS enclosing FROM annot),
    p AS (SELECT DISTINCT doc_id, pageno, CASE doc_id % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'R' END AS tabs FROM annot) """ + _union({
    "28-002": "a WHERE subtype = 'Highlight' AND coalesce(enclosing, '') <> '/Annot'", "28-004": "a WHERE subtype <> 'Popup' AND said IS NULL", "28-008": "p WHERE tabs IS NULL", "28-009": "p WHERE tabs <> 'S'",
    "28-011": "a WHERE subtype = 'Link' AND coalesce(enclosing, '') <> '/Link'", "28-012": "a WHERE subtype = 'Link' AND said IS NULL",
}))
def verify_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annots(spark, sf_dir)
    k = F.col("miny").cast("int") % 3
    said = a.withColumn("contents", F.when(F.col("minx") <= 30, F.col("contents"))).withColumn("enclosing", F.when(k == 0, "/Link").when(k == 1, "/Annot"))
    tabs = a.select("doc_id", "pageno").distinct().withColumn("tabs", F.when(F.col("doc_id") % 3 == 0, "S").when(F.col("doc_id") % 3 == 1, "R"))
    return structure.check(structure.annotation_rules(said, tabs))


_FONTS = """font AS (SELECT p_partkey AS doc_id, ['TrueType', 'Type1', 'Type0', 'Type3', 'CIDFontType2'][CAST(p_size % 5 + 1 AS INTEGER)] AS subtype, p_partkey % 2 = 0 AS embedded, [NULL, 'WinAnsiEncoding', 'Custom'][CAST(p_partkey % 3 + 1 AS INTEGER)] AS encoding,
    p_partkey % 4 = 0 AS symbolic, p_partkey % 5 = 0 AS to_unicode, CASE WHEN p_partkey % 7 = 0 THEN 'Identity' END AS cid_map FROM part)"""


@query("verify_fonts", f"WITH {_FONTS} " + _union({
    "31-005": "font WHERE subtype = 'CIDFontType2' AND cid_map IS NULL", "31-009": "font WHERE NOT embedded AND subtype <> 'Type3'", "31-019": "font WHERE subtype = 'TrueType' AND NOT symbolic AND encoding IS NULL",
    "31-021": "font WHERE subtype = 'TrueType' AND NOT symbolic AND encoding = 'Custom'", "31-024": "font WHERE subtype = 'TrueType' AND symbolic AND encoding IS NOT NULL", "31-027": "font WHERE NOT to_unicode AND coalesce(encoding, '') <> 'WinAnsiEncoding' AND subtype <> 'Type0'",
}))
def verify_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("TrueType", "Type1", "Type0", "Type3", "CIDFontType2"))), (F.col("p_size") % 5 + 1).cast("int"))
    fonts = table(spark, sf_dir, "part").select(
        k.alias("doc_id"), kind.alias("subtype"), (k % 2 == 0).alias("embedded"), F.when(k % 3 == 1, "WinAnsiEncoding").when(k % 3 == 2, "Custom").alias("encoding"), F.lit(None).cast("string").alias("base_encoding"),
        (k % 4 == 0).alias("symbolic"), (k % 5 == 0).alias("to_unicode"), F.when(k % 7 == 0, "Identity").alias("cid_map"),
    )
    return structure.check(structure.font_rules(fonts))


@query("verify_groups", "WITH g AS (SELECT c_custkey AS doc_id, c_nationkey % 2 = 0 AS d, CASE c_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_name END AS name, c_nationkey % 5 = 0 AS has_as FROM customer) " + _union({
    "20-001": "g WHERE coalesce(name, '') = '' AND NOT d", "20-002": "g WHERE coalesce(name, '') = '' AND d", "20-003": "g WHERE has_as",
}))
def verify_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey")
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (k % 2 == 0).alias("is_default"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("c_name")).alias("name"), (k % 5 == 0).alias("has_as"))
    return structure.check(structure.group_rules(made))


@query("draw_tree", f"""WITH RECURSIVE {_TREE}, s AS (SELECT *, lead(node) OVER (PARTITION BY parent ORDER BY ord) IS NULL AS last FROM tree WHERE parent IS NOT NULL),
    r AS (SELECT node, '' AS lead, kind AS line FROM tree WHERE parent IS NULL
        UNION ALL SELECT s.node, r.lead || CASE WHEN s.last THEN '    ' ELSE chr(9474) || '   ' END, r.lead || CASE WHEN s.last THEN chr(9492) ELSE chr(9500) END || chr(9472) || chr(9472) || ' ' || s.kind FROM r JOIN s ON s.parent = r.node)
    SELECT node, line FROM r""")
def draw_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure trees as listings with lines between the nodes."""
    return reports.drawn_tree(tree(spark, sf_dir), "kind").select("node", "line")
