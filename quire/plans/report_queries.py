"""Queries of reports over documents, objects and uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import reports as ops
from quire.plans.proxies import EDGES, PAGES, edges, pages, table
from quire.plans.registry import query


@query("doc_info", """SELECT source, count(*) AS pages, CASE WHEN count(DISTINCT coalesce(lang, '<none>')) = 1 THEN min(lang) ELSE 'various' END AS language, min(n_chars) AS shortest, max(n_chars) AS longest,
    CASE WHEN count(DISTINCT coalesce(CAST(n_chars % 1 AS VARCHAR), '<none>')) = 1 THEN CAST(min(n_chars % 1) AS VARCHAR) ELSE 'various' END AS box FROM documents GROUP BY source""")
def doc_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row for each source; what its rows do not share is various."""
    docs = table(spark, sf_dir, "documents").withColumn("unit", F.col("n_chars") % 1)
    return docs.groupBy("source").agg(F.count("*").alias("pages"), ops.agreed("lang").alias("language"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), ops.agreed("unit").alias("box"))


@query("composition", """WITH c AS (SELECT source, lang AS category, sum(n_chars) AS bytes FROM documents WHERE lang IN ('en', 'de', 'fr') GROUP BY ALL), t AS (SELECT source, sum(n_chars) + 1000 AS file_size FROM documents GROUP BY source),
    g AS (SELECT source, file_size, unnest([{'place': 0, 'category': 'en'}, {'place': 1, 'category': 'de'}, {'place': 2, 'category': 'fr'}, {'place': 3, 'category': 'Unclassified'}]) AS c FROM t),
    f AS (SELECT g.source, file_size, g.c.place AS place, g.c.category AS category, coalesce(c.bytes, 0) AS bytes FROM g LEFT JOIN c ON c.source = g.source AND c.category = g.c.category),
    u AS (SELECT *, CASE WHEN category = 'Unclassified' THEN file_size - sum(bytes) OVER (PARTITION BY source) ELSE bytes END AS b FROM f)
    SELECT source, place, category, CAST(b AS BIGINT) AS bytes, round(100.0::DOUBLE * b / file_size, 3) AS percent FROM u""")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters by category and what none claims."""
    docs = table(spark, sf_dir, "documents")
    total = docs.groupBy("source").agg((F.sum("n_chars") + 1000).alias("file_size"))
    return ops.composition(docs.where("lang in ('en', 'de', 'fr')"), F.col("lang"), F.col("n_chars"), total, "source", ["en", "de", "fr"])


@query("list_images", """SELECT l_partkey, string_agg(CAST(o AS VARCHAR), ' ' ORDER BY o) AS pages, min(o) AS first_page FROM (SELECT DISTINCT l_partkey, l_orderkey AS o FROM lineitem) GROUP BY l_partkey""")
def list_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images, with the sorted set of orders as the pages that use them."""
    return ops.usage(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey")


@query("image_resolution", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * 72 / 900, 4) AS xdpi, round(l_quantity * 72 / 10, 4) AS ydpi FROM lineitem WHERE l_extendedprice * 72 / 900 < 300 OR l_quantity * 72 / 10 < 20""")
def image_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses whose resolution is low in either direction."""
    found = ops.low_resolution(table(spark, sf_dir, "lineitem").withColumn("w", F.lit(900.0)).withColumn("h", F.lit(10.0)), F.col("l_extendedprice"), F.col("l_quantity"), F.col("w"), F.col("h"), 20.0)
    wide = ops.low_resolution(table(spark, sf_dir, "lineitem").withColumn("w", F.lit(900.0)).withColumn("h", F.lit(10.0)), F.col("l_extendedprice"), F.lit(1e9), F.col("w"), F.col("h"), 300.0).withColumn("ydpi", F.col("l_quantity") * 72 / 10)
    return found.unionByName(wide).select("l_orderkey", "l_linenumber", F.round("xdpi", 4).alias("xdpi"), F.round("ydpi", 4).alias("ydpi")).distinct()


@query("missing_fonts", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, as fonts without a program."""
    return ops.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@query("duplicate_objects", "SELECT min(doc_id) AS kept, count(*) AS copies, (count(*) - 1) * strlen(text) AS saved FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("remapped_references", "WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept FROM documents) SELECT l.quality, k.kept AS doc_id, count(*) AS n FROM labels l JOIN k USING (doc_id) GROUP BY ALL")
def remapped_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of equal texts, turned to the first of each."""
    return ops.remapped(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id", "text", "doc_id").groupBy("quality", "doc_id").agg(F.count("*").alias("n"))


@query("reachable_objects", f"WITH RECURSIVE {EDGES}, r AS (SELECT 3::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN edge ON src = node WHERE via <> '/Parent' AND depth < 40) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node")
def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an object reaches without its parents, and in how many steps."""
    e = edges(spark, sf_dir)
    return ops.closure(e, spark.createDataFrame([(3,)], "node long"), F.col("via") == "/Parent")


@query("dead_objects", f"WITH RECURSIVE {EDGES}, r AS (SELECT 1::BIGINT AS node UNION SELECT dst FROM r JOIN edge ON src = node WHERE NOT (via = '/Kids' AND dst % 2 = 1)) SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT node FROM r)")
def dead_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that nothing reaches from the root, through cycles."""
    found = ops.closure(edges(spark, sf_dir), spark.createDataFrame([(1,)], "node long"), (F.col("via") == "/Kids") & (F.col("dst") % 2 == 1))
    return table(spark, sf_dir, "part").select("p_partkey").join(found.hint("merge"), F.col("p_partkey") == F.col("node"), "left_anti")


@query("text_width", "SELECT conv_id, turn, round((length(text) * 500 + (length(text) - length(replace(text, 'i', ''))) * -278 + (length(text) - length(replace(text, 'w', ''))) * 222) * 12.0::DOUBLE / 1000, 3) AS width FROM conversations WHERE length(text) > 0")
def text_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width of every turn's text at 12 points by a table of widths."""
    widths = spark.createDataFrame([("i", 222), ("w", 722)], "char string, width int")
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    return ops.text_width(turns, "id", "text", widths, 12.0, 500).select("id.conv_id", "id.turn", "width")


@query("list_annotations", f"WITH {PAGES} SELECT doc_id, pageno, CAST(unnest(generate_series(1, greatest(annots, 0))) AS INTEGER) AS annot, role FROM page")
def list_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).where("annots > 0").select("doc_id", "pageno", F.explode(F.sequence(F.lit(1), F.col("annots").cast("int"))).alias("annot"), "role")


@query("list_attachments", f"WITH {PAGES} SELECT doc_id, 0 AS page, 'whole' AS name FROM last UNION ALL SELECT doc_id, pageno, role FROM page WHERE annots = 2")
def list_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of documents (page 0) and of pages."""
    p = pages(spark, sf_dir)
    whole = p.select("doc_id").distinct().select("doc_id", F.lit(0).alias("page"), F.lit("whole").alias("name"))
    return whole.unionByName(p.where("annots = 2").select("doc_id", F.col("pageno").alias("page"), F.col("role").alias("name")))


@query("javascript", "SELECT page_id, contains(html, '<script') OR contains(html, 'javascript:') AS has_script FROM pages")
def javascript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ops.with_scripts("html").alias("has_script"))


@query("signatures", "SELECT o_orderkey, c_name AS name, o_orderpriority AS filter FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed fields with who their value refers to."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    orders = table(spark, sf_dir, "orders").withColumn("filter", F.col("o_orderpriority"))
    return ops.signed(orders, F.col("o_orderstatus") == "F", c, "o_custkey", "o_orderkey", "name", "filter")


@query("spot_colours", "SELECT DISTINCT p_brand AS name FROM part WHERE p_size > 25")
def spot_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct_names(table(spark, sf_dir, "part"), "p_brand", F.col("p_size") > 25)


@query("revisions", "SELECT user_id, count(DISTINCT event_type) AS revisions FROM events GROUP BY user_id")
def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("revisions"))


@query("nested_fonts", f"""WITH RECURSIVE {EDGES}, r AS (SELECT p_partkey AS root, p_partkey AS node FROM part UNION SELECT root, dst FROM r JOIN edge ON src = node WHERE via = '/Kids')
    SELECT DISTINCT root, p_brand AS font FROM r JOIN part ON p_partkey = node""")
def nested_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts (brands) of the forms (parts) that each page (every part) reaches."""
    fonts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("value"))
    return ops.closure_values(edges(spark, sf_dir).where("via = '/Kids'"), fonts).withColumnRenamed("value", "font")


_STEP = "lpad(CAST(p_partkey AS VARCHAR), CAST((SELECT greatest(6, max(length(CAST(p_partkey AS VARCHAR)))) FROM part) AS INTEGER), '0')"


@query("structure_tree", f"""WITH RECURSIVE t AS (SELECT p_partkey AS node, 0 AS depth, {_STEP} AS path FROM part WHERE p_partkey < 3
    UNION ALL SELECT p_partkey, depth + 1, path || '/' || {_STEP} FROM t JOIN part ON p_partkey // 3 = node AND p_partkey > 2)
    SELECT node, depth, path, repeat('  ', depth) || p_name AS line FROM t JOIN part ON p_partkey = node""")
def structure_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of all parts as an indented listing, in the order of path."""
    part = table(spark, sf_dir, "part")
    nodes = part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 2, F.floor(F.col("p_partkey") / 3).cast("long")).alias("parent"), F.col("p_partkey").alias("ord"))
    return ops.tree_paths(nodes).join(part.select(F.col("p_partkey").alias("node"), "p_name"), "node").select("node", "depth", "path", F.concat(F.repeat(F.lit("  "), F.col("depth")), "p_name").alias("line"))


@query("copy_annotations", f"WITH {PAGES}, m AS (SELECT max(doc_id) AS top FROM page) SELECT a.doc_id, a.pageno, b.role, b.annots, top + a.doc_id AS new_id FROM page a JOIN page b ON b.doc_id = a.doc_id + 1 AND b.pageno = a.pageno, m WHERE b.annots > 0")
def copy_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of the next document on this one's pages, numbered beyond the largest."""
    p = pages(spark, sf_dir)
    other = p.where("annots > 0").select((F.col("doc_id") - 1).alias("doc_id"), "pageno", "role", "annots")
    top = p.agg(F.max("doc_id").alias("top"))
    return p.select("doc_id", "pageno").join(other, ["doc_id", "pageno"]).join(F.broadcast(top), how="cross").select("doc_id", "pageno", "role", "annots", (F.col("top") + F.col("doc_id")).alias("new_id"))


@query("remove_annotations", f"WITH {PAGES} SELECT doc_id, pageno, annots FROM page WHERE NOT pageno <= 2 AND annots > 0")
def remove_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions import ranges

    return ranges.member(pages(spark, sf_dir), "1-2").where("not in_range and annots > 0").select("doc_id", "pageno", "annots")


@query("document_ids", "SELECT doc_id, sha256(text) AS id FROM documents")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made of contents, so that a new run gives the same."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("id"))


@query("objects_as_json", """SELECT l_orderkey AS doc_id, '[' || string_agg('[' || l_linenumber || ',{"/Part":' || l_partkey || '}]', ',' ORDER BY l_linenumber) || ']' AS json FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_partkey FROM lineitem) GROUP BY l_orderkey""")
def objects_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as the objects of one document."""
    from quire.sources import document_json

    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("objnum")).agg(F.min("l_partkey").alias("part"))
    return document_json.written(lines.withColumn("object", document_json.dictionary({"/Part": document_json.reference(F.col("part"))})))
