"""Queries of fonts, images, streams, redaction of content, contents lists in front, outlines as JSON and stamps' text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import content, fonts, objects
from quire.operators import pages as page_ops
from quire.plans.content_queries import _SHOWN, _stream_sql, stream, streams
from quire.plans.proxies import MARKS, PAGES, marks, pages, table
from quire.plans.registry import query
from quire.sources import images

# Fonts: parts, ten a document, each with two differences; two of three have a program.

_FONT = """font AS (SELECT p_partkey // 10 AS doc_id, CAST(p_partkey % 2 + 1 AS INTEGER) AS pageno, '/F' || p_partkey AS name, CASE WHEN p_partkey % 4 = 0 THEN 'ABCDEF+' ELSE '' END || p_brand AS base,
    CASE WHEN p_partkey % 2 = 0 THEN 'Win' ELSE 'Mac' END AS encoding, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS program, p_size FROM part)"""


def font_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 10).cast("long").alias("doc_id"), (k % 2 + 1).cast("int").alias("pageno"), F.concat(F.lit("/F"), k.cast("string")).alias("name"), F.concat(F.when(k % 4 == 0, "ABCDEF+").otherwise(""), "p_brand").alias("base"),
        F.when(k % 2 == 0, "Win").otherwise("Mac").alias("encoding"), F.create_map(F.lit(65), F.lit("/Alpha"), F.lit(200), F.concat(F.lit("/g"), F.col("p_size").cast("string"))).alias("differences"),
        F.when(k % 3 > 0, F.col("p_name").cast("binary")).alias("program"),
    )


def _program(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "pageno", "name", F.col("program").cast("string").alias("program"))


@query("font_encodings", f"""WITH {_FONT} SELECT doc_id, pageno, name, 65 AS code, '/Alpha' AS glyph FROM font UNION ALL SELECT doc_id, pageno, name, 200, '/g' || p_size FROM font
    UNION ALL SELECT doc_id, pageno, name, 66, '/B' FROM font WHERE encoding = 'Win' UNION ALL SELECT doc_id, pageno, name, 67, '/C' FROM font WHERE encoding = 'Mac'""")
def font_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every code of a font stands for: differences before the base encoding."""
    bases = spark.createDataFrame([("Win", 65, "/A"), ("Win", 66, "/B"), ("Mac", 65, "/A"), ("Mac", 67, "/C")], "encoding string, code int, glyph string")
    return fonts.encodings(font_table(spark, sf_dir), bases)


@query("remove_fonts", f"WITH {_FONT} SELECT doc_id, pageno, name, CASE WHEN pageno = 2 THEN program END AS program FROM font")
def remove_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _program(fonts.without_programs(font_table(spark, sf_dir), F.col("pageno") == 1))


@query("embed_fonts", f"WITH {_FONT} SELECT doc_id, pageno, name, coalesce(program, CASE WHEN replace(base, 'ABCDEF+', '') IN (SELECT min(p_brand) FROM part UNION ALL SELECT max(p_brand) FROM part) THEN 'given' END) AS program FROM font")
def embed_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs for the fonts that lack one, by name."""
    some = table(spark, sf_dir, "part").agg(F.min("p_brand").alias("a"), F.max("p_brand").alias("b")).select(F.explode(F.array_distinct(F.array("a", "b"))).alias("base"))
    return _program(fonts.embedded(font_table(spark, sf_dir), some.withColumn("program", F.lit("given").cast("binary"))))


@query("copy_font", f"WITH {_FONT} SELECT doc_id, pageno, name, program FROM font UNION ALL SELECT DISTINCT doc_id, pageno, '/New', 'given' FROM font WHERE pageno = 1")
def copy_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A font put on further pages."""
    f = font_table(spark, sf_dir)
    source = f.limit(1).withColumn("name", F.lit("/New")).withColumn("program", F.lit("given").cast("binary"))
    return _program(fonts.copied(f, source, f.where("pageno = 1")))


@query("extract_fonts", f"WITH {_FONT} SELECT doc_id, doc_id || '/' || regexp_replace(base, '[/?<>\\\\:*|\"^+=]', '', 'g') AS path, min(program) AS data FROM font WHERE program IS NOT NULL GROUP BY doc_id, base")
def extract_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.extracted(font_table(spark, sf_dir)).withColumn("data", F.col("data").cast("string"))


@query("extract_streams", "SELECT doc_id // 3 AS doc_id, (doc_id // 3) || '/' || doc_id || '.xml' AS path, text AS data FROM documents WHERE doc_id % 3 = 1 AND text IS NOT NULL")
def extract_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metadata stream as a file."""
    k = F.col("doc_id")
    made = F.concat(F.lit('{"/Type":{"N":"'), F.when(k % 3 == 1, "/Metadata").otherwise("/XObject"), F.lit('"}}'))
    held = table(spark, sf_dir, "documents").select(F.floor(k / 3).cast("long").alias("doc_id"), k.alias("objnum"), made.alias("object"), F.col("text").cast("binary").alias("stream"))
    return objects.metadata_streams(held).withColumn("data", F.col("data").cast("string"))


@query("process_images", "SELECT doc_id, CASE WHEN strlen(text) >= 400 THEN CAST(greatest(1, round_even(strlen(text) / 2, 0)) AS INTEGER) ELSE CAST(strlen(text) AS INTEGER) END AS width, 1 AS height FROM documents WHERE strlen(text) > 0")
def process_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as grey images of one row: large ones at half their size."""
    d = table(spark, sf_dir, "documents").where(F.octet_length("text") > 0).select("doc_id", F.octet_length("text").alias("width"), F.lit(1).alias("height"), F.lit(1).alias("samples"), F.col("text").cast("binary").alias("pixels"))
    made = images.processed({c: c for c in ("width", "height", "samples", "pixels")}, 50.0, 400)
    return d.select("doc_id", made.alias("i")).where(F.octet_length("i.pixels") == F.col("i.width")).select("doc_id", "i.width", "i.height")


@query("extract_images", "SELECT doc_id, doc_id || '/0.png' AS path, 'png' AS format, strlen(text) AS width FROM documents WHERE strlen(text) > 0")
def extract_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as PNG files."""
    k = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").where(F.octet_length("text") > 0).select("doc_id", F.octet_length("text").alias("w"), F.lit(1).alias("one"), F.col("text").cast("binary").alias("pixels"))
    held = raw.select("doc_id", F.lit(0).alias("objnum"), F.lit("null").alias("object"), images.as_png("w", "one", "one", "pixels").alias("stream"))
    saved = objects.extracted(held, k >= 0, ".png")
    return saved.select("doc_id", "path", images.probe("data").alias("p")).select("doc_id", "path", "p.format", "p.width")


#: Words whose cells lie in the area 0 to 1000 across and from 0 to 30 up: their lines' baselines stand between -12 and 30.
_HIT = "20 + pageno - 28 * (i - 1) < 30 AND 20 + pageno - 28 * (i - 1) + 24 > 0"


@query("redact_content", f"""{_SHOWN}, t AS (SELECT doc_id, pageno, coalesce(string_agg(text, '' ORDER BY seq) FILTER (kind = 'text' AND NOT (y < 30 AND y + CASE WHEN text = 'stamp' AND size = 0 THEN 0 ELSE 24 END > 0)), '') AS left_text FROM s GROUP BY doc_id, pageno)
    SELECT doc_id, pageno, left_text FROM t""")
def redact_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What text is left when all glyphs that touch a strip of the page are taken."""
    p = pages(spark, sf_dir).select("doc_id", "pageno", "text")
    sides = [F.lit(v).alias(n) for n, v in (("minx", 0.0), ("miny", 0.0), ("maxx", 1e6), ("maxy", 30.0))]
    return content.extracted(content.redacted(p, p.select("doc_id", "pageno", *sides), made_of=stream())).withColumnRenamed("shown", "left_text")


@query("redact_nothing", _stream_sql())
def redact_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An area that no glyph touches changes no stream."""
    p = streams(spark, sf_dir)
    sides = [F.lit(v).alias(n) for n, v in (("minx", -90.0), ("miny", -9e6), ("maxx", -80.0), ("maxy", -8e6))]
    return content.redacted(p, p.select("doc_id", "pageno", *sides))


@query("page_json", f"""{_SHOWN}, l AS (SELECT doc_id, pageno, count(*) AS n, min(seq) FILTER (kind = 'image') AS image FROM s GROUP BY doc_id, pageno) SELECT doc_id, pageno, CAST(n + 2 AS INTEGER) AS objects, 'clip' AS first, '/Im1' AS image FROM l""")
def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's objects as JSON, read again: how many, the first one's kind, and the image."""
    j = content.as_json(streams(spark, sf_dir)).withColumn("o", F.from_json("json", "array<struct<kind:string,text:string>>"))
    image = F.filter("o", lambda x: x["kind"] == "image")[0]["text"]
    return j.select("doc_id", "pageno", F.size("o").alias("objects"), F.col("o")[0]["kind"].alias("first"), image.alias("image"))


@query("contents_in_front", f"""WITH {PAGES}, {MARKS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS k, (count(*) OVER (PARTITION BY doc_id) + 2) // 3 AS sheets FROM mark),
    l AS (SELECT doc_id, k, sheets, rpad(repeat('  ', CAST(level AS INTEGER)) || text, CAST(30 - length(CAST(target + sheets AS VARCHAR)) AS INTEGER), '.') || (target + sheets) AS line FROM r),
    n AS (SELECT doc_id, max(sheets) AS sheets FROM r GROUP BY doc_id)
    SELECT doc_id, CAST(k // 3 + 1 AS INTEGER) AS pageno, string_agg(line, chr(10) ORDER BY k) AS content, CAST(NULL AS INTEGER) AS old_page FROM l GROUP BY doc_id, k // 3
    UNION ALL SELECT doc_id, CAST(pageno + coalesce(sheets, 0) AS INTEGER), role, pageno FROM page LEFT JOIN n USING (doc_id)""")
def contents_in_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of contents on pages of its own before the others."""
    p = pages(spark, sf_dir).select("doc_id", "pageno", F.col("role").alias("content"))
    return page_ops.with_contents(p, marks(spark, sf_dir), 3, 30)


@query("outline_json_round_trip", f"WITH {PAGES}, {MARKS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS INTEGER) AS seq, CAST(level AS INTEGER) AS level, text, CAST(target AS INTEGER) AS target, level = 0 AS is_open, CAST(seq % 4 AS INTEGER) AS flags, 0.5::DOUBLE AS red FROM mark")
def outline_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks with flags and colours written as JSON and read again."""
    m = marks(spark, sf_dir).withColumn("is_open", F.col("level") == 0).withColumn("flags", (F.col("seq") % 4).cast("int")).withColumn("colour", F.array(F.lit(0.5), F.lit(0.0), F.lit(1.0)))
    back = page_ops.outline_of_json(page_ops.outline_json(m))
    return back.select("doc_id", "seq", "level", "text", "target", "is_open", "flags", F.col("colour")[0].alias("red"))


def _stamped() -> Column:
    return F.concat(F.lit("a %URL["), F.col("role"), F.lit("|http://x/"), F.col("pageno").cast("string"), F.lit("] b\\nc 100%%"))


@query("stamp_texts", f"WITH {PAGES} SELECT doc_id, pageno, ['a ' || role || ' b', 'c 100%'] AS lines, 'http://x/' || pageno AS address, role AS words FROM page")
def stamp_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stamp's lines with links as text, and where they lead."""
    links = text.stamp_addresses(_stamped())
    lines = F.transform(text.stamp_lines(text.stamp_links(_stamped())), text.stamp_unescaped)
    return pages(spark, sf_dir).select("doc_id", "pageno", lines.alias("lines"), links[0]["address"].alias("address"), links[0]["text"].alias("words"))


@query("octal_escapes", "SELECT p_partkey, p_name || 'A(' || chr(233) || '\\9' AS shown FROM part")
def octal_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.octal_unescaped(F.concat("p_name", F.lit("\\101\\050\\351\\9"))).alias("shown"))


@query("stamp_bookmarks", f"""WITH {PAGES}, {MARKS}, j AS (
    SELECT p.doc_id, p.pageno, max(CASE WHEN m.target = p.pageno THEN m.text END) AS here, arg_max(m.text, m.seq) AS earlier FROM page p LEFT JOIN mark m ON m.doc_id = p.doc_id AND m.target <= p.pageno AND m.level = 0 GROUP BY p.doc_id, p.pageno)
    SELECT doc_id, pageno, 'under ' || coalesce(here, earlier, '') AS stamp FROM j""")
def stamp_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stamp that names the bookmark of a level that the page stands under."""
    p = page_ops.current_mark(pages(spark, sf_dir), marks(spark, sf_dir), 0)
    return p.select("doc_id", "pageno", text.stamp("under %Bookmark0", F.col("pageno"), F.lit(1), bookmarks={0: F.col("mark")}).alias("stamp"))
