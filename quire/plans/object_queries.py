"""Queries on dictionaries, document properties and accessibility rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import metadata, objects, rules
from quire.plans.proxies import table
from quire.plans.registry import query
from quire.sources import document_json


@query("dict_entries", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def dict_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of a key, at any depth."""
    return objects.entries(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k").select("event_id", "value")


@query("remove_dict_entry", "SELECT event_id, CASE WHEN json_extract_string(props, '$.k') = '1' THEN 'none' ELSE coalesce(json_extract_string(props, '$.k'), 'none') END AS value FROM events")
def remove_dict_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key removed where it has a value."""
    made = objects.removed(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k", 1)
    return made.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("value"))


@query("replace_dict_entry", "SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NOT NULL THEN '77' ELSE 'none' END AS value FROM events")
def replace_dict_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = objects.replaced(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k", 77)
    return made.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("value"))


@query("look_up_object", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS value FROM events")
def look_up_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(objects.looked_up("props", "/k"), F.lit("")).alias("value"))


@query("upsert_objects", "SELECT p_partkey, p_name FROM part WHERE p_partkey >= 50 UNION ALL SELECT p_partkey, 'changed' FROM part WHERE p_partkey < 50 UNION ALL SELECT (SELECT max(p_partkey) FROM part) + s_suppkey + 1, s_name FROM supplier")
def upsert_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with some changed, and suppliers as new objects."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    changes = part.where("p_partkey < 50").withColumn("p_name", F.lit("changed")).unionByName(table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("p_partkey"), F.col("s_name").alias("p_name")))
    return objects.upserted(part, changes, "p_partkey")


@query("coalesce_groups", "SELECT p_partkey, p_brand, p_type, min(p_partkey) OVER (PARTITION BY p_type, p_brand) AS survivor FROM part")
def coalesce_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one name merged into the first."""
    return objects.coalesced(table(spark, sf_dir, "part"), "p_type", "p_brand", "p_partkey", "p_partkey").select("p_partkey", "p_brand", "p_type", "survivor")


@query("rename_groups", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'one' ELSE p_brand END AS name FROM part")
def rename_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.renamed(table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_brand").alias("name")), "name", F.col("p_size") == 1, "one").select("p_partkey", "name")


@query("group_order", "SELECT p_type, string_agg(CAST(p_partkey AS VARCHAR), ' ' ORDER BY p_partkey) AS names FROM part GROUP BY p_type")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.ordered(table(spark, sf_dir, "part"), "p_type", "p_partkey")


@query("set_info", "SELECT c_custkey, 'Author=me;Title=' || c_name AS info FROM customer")
def set_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information fields set, replaced and removed."""
    info = F.create_map(F.lit("Title"), F.col("c_name"), F.lit("Subject"), F.col("c_mktsegment"))
    made = metadata.set_field(metadata.set_field(info, "Subject", F.lit(None).cast("string")), "Author", F.lit("me"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(made), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return table(spark, sf_dir, "customer").select("c_custkey", shown.alias("info"))


@query("viewer_preferences", "SELECT c_custkey, true AS toolbar, c_nationkey > 5 AS fit, 2 AS n FROM customer")
def viewer_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.create_map(F.lit("HideToolbar"), F.lit(False), F.lit("FitWindow"), F.col("c_nationkey") > 5)
    made = table(spark, sf_dir, "customer").withColumn("p", metadata.set_preference(held, "HideToolbar", True))
    return made.select("c_custkey", F.col("p")["HideToolbar"].alias("toolbar"), F.col("p")["FitWindow"].alias("fit"), F.size("p").alias("n"))


@query("set_version", "SELECT p_partkey, CASE WHEN p_size >= 10 THEN '2.' || (p_size - 10) ELSE '1.' || p_size END AS version FROM part")
def set_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", metadata.version(F.col("p_size")).alias("version"))


@query("metadata_packet", """SELECT o_orderkey, '<x:xmpmeta><rdf:RDF><dc:title>' || o_orderpriority || '</dc:title><dc:creator>' || o_orderstatus || '</dc:creator><xmp:MetadataDate>2020-01-02T00:00:00Z</xmp:MetadataDate></rdf:RDF></x:xmpmeta>' AS xmp,
    o_orderpriority AS title FROM orders""")
def metadata_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata made of fields, its date set, and a field read back."""
    packet = metadata.set_xmp_date(metadata.xmp(F.col("o_orderpriority"), F.col("o_orderstatus"), text.xmp_date(text.pdf_date(F.col("o_orderdate")))), "2020-01-02T00:00:00Z")
    return table(spark, sf_dir, "orders").select("o_orderkey", packet.alias("xmp"), F.regexp_extract(packet, "<dc:title>([^<]*)", 1).alias("title"))


@query("verify", r"""WITH pages AS (SELECT page_id, replace(CASE WHEN page_id % 4 = 0 THEN replace(html, '<h1', '<h3') ELSE html END, ' lang="', CASE WHEN page_id % 6 = 1 THEN ' xlang="' ELSE ' lang="' END) || CASE WHEN page_id % 9 = 2 THEN '<h1 id="a">x</h1><h4 id="a"><img src=x>' ELSE '' END AS html FROM main.pages),
    t AS (SELECT page_id, html, list_transform(regexp_extract_all(html, '<[hH]([1-6])[ >]', 1), lambda x: CAST(x AS INTEGER)) AS h FROM pages),
    s AS (SELECT page_id, unnest(regexp_extract_all(html, ' id="([^"]*)"', 1)) AS id FROM pages),
    i AS (SELECT *, unnest(generate_series(1, len(h))) AS k FROM t)
    SELECT page_id, '14-002' AS rule, 'first heading is not level 1' AS message FROM t WHERE len(h) > 0 AND h[1] <> 1
    UNION ALL SELECT DISTINCT page_id, '14-003', 'heading level skipped' FROM i WHERE h[k] > (CASE WHEN k = 1 THEN 1 ELSE h[k - 1] END) + 1
    UNION ALL SELECT page_id, '14-006', 'more than one top heading' FROM t WHERE len(list_filter(h, lambda x: x = 1)) > 1
    UNION ALL SELECT page_id, '07-001', 'no title' FROM t WHERE NOT regexp_matches(html, '<title>[^<]')
    UNION ALL SELECT page_id, '11-001', 'no language' FROM t WHERE NOT regexp_matches(html, '<html[^>]* lang="[a-z]')
    UNION ALL SELECT page_id, '13-004', 'image without alternative' FROM t WHERE len(list_filter(regexp_extract_all(html, '<img[^>]*>'), lambda x: NOT contains(x, ' alt='))) > 0
    UNION ALL SELECT DISTINCT page_id, '19-004', 'identifier used twice' FROM (SELECT page_id, id FROM s GROUP BY ALL HAVING count(*) > 1)""")
def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessibility rules over markup that is disturbed for some pages."""
    p = F.col("page_id")
    html = F.when(p % 4 == 0, F.replace("html", F.lit("<h1"), F.lit("<h3"))).otherwise(F.col("html"))
    html = F.when(p % 6 == 1, F.replace(html, F.lit(' lang="'), F.lit(' xlang="'))).otherwise(html)
    html = F.concat(html, F.when(p % 9 == 2, '<h1 id="a">x</h1><h4 id="a"><img src=x>').otherwise(""))
    return rules.check(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "page_id", "html")


@query("json_round_trip", "SELECT p_partkey AS objnum, CAST(p_partkey AS VARCHAR) AS parent, p_name AS name, p_size AS size FROM part")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects written as the JSON of the interchange format and read again."""
    part = table(spark, sf_dir, "part")
    made = part.select(F.col("p_partkey").alias("objnum"), document_json.dictionary({"/Parent": document_json.reference(F.col("p_partkey")), "/Name": document_json.name(F.col("p_name")), "/Size": document_json.integer(F.col("p_size"))}).alias("object"))
    return made.select("objnum", document_json.value("object", "/Parent").alias("parent"), document_json.value("object", "/Name", "N").alias("name"), document_json.value("object", "/Size", "I").cast("int").alias("size"))


@query("mark_conformance", "SELECT o_orderkey, '<rdf:RDF><pdfuaid:part>2</pdfuaid:part></rdf:RDF>' AS marked, '<rdf:RDF></rdf:RDF>' AS unmarked FROM orders")
def mark_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standard's name in metadata, replaced and removed."""
    marked = metadata.mark_conformance(metadata.mark_conformance(F.lit("<rdf:RDF></rdf:RDF>"), 1), 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", marked.alias("marked"), metadata.unmark_conformance(marked).alias("unmarked"))
