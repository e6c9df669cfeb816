"""Queries on text functions: labels, templates, escapes, names, dates and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry, text
from quire.operators import pages as ops
from quire.plans.proxies import PAGES, pages, table
from quire.plans.registry import query

_ROMAN = "repeat('M', {n} // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][{n} // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][{n} // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][{n} % 10 + 1]"


@query("roman_labels", f"SELECT p_partkey, {_ROMAN.format(n='p_partkey')} AS upper, lower({_ROMAN.format(n='p_partkey')}) AS lower FROM part")
def roman_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", text.roman(n).alias("upper"), text.roman(n, False).alias("lower"))


@query("letter_labels", "SELECT p_partkey, CASE WHEN p_partkey < 1 THEN '' ELSE repeat(chr(CAST(97 + (p_partkey - 1) % 26 AS INTEGER)), CAST((p_partkey - 1) // 26 + 1 AS INTEGER)) END AS label FROM part")
def letter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.letters(F.col("p_partkey"), False).alias("label"))


@query("strip_ascii", r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS stripped FROM documents")
def strip_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without code points above 127."""
    return table(spark, sf_dir, "documents").select("doc_id", text.ascii_only(F.col("text")).alias("stripped"))


@query("escape_text", r"""SELECT doc_id, replace(replace(replace(text, '\', '\\'), chr(10), '\n'), '"', '\"') AS escaped, true AS same FROM documents""")
def escape_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes, and whether undoing them gives the text again."""
    escaped = text.escaped(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", escaped.alias("escaped"), (text.unescaped(escaped) == F.col("text")).alias("same"))


@query("safe_names", r"""SELECT page_id, regexp_replace(url, '[/?<>\\:*|"^+=\x00-\x1f\x7f]', '', 'g') AS name FROM pages""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query("output_names", f"""WITH {PAGES}, c AS (SELECT doc_id, (pageno - 1) // 2 + 1 AS chunk, min(pageno) AS a, max(pageno) AS b FROM page GROUP BY ALL)
    SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, 'out-' || right('000' || chunk, 3) || '_p' || right('00' || a, 2) || '-' || b || '.pdf' AS name FROM c""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the outputs of a split, by a template."""
    chunks = ops.split_every(pages(spark, sf_dir), 2).groupBy("doc_id", "chunk").agg(F.min("pageno").alias("a"), F.max("pageno").alias("b"))
    return chunks.select("doc_id", "chunk", text.file_name("@F-%%%_p@S@@-@E.pdf", F.col("chunk"), F.col("a"), F.col("b"), stem="out").alias("name"))


@query("output_names_of_bookmarks", f"""WITH {PAGES}, m AS (SELECT doc_id, pageno, 'é€' || role || '/' || pageno AS mark FROM page), c AS (SELECT *, replace(mark, '/', '') AS name FROM m)
    SELECT doc_id, pageno, name || '_' || substr(name, 1, list_max(list_filter(range(0, 8), lambda n: strlen(substr(name, 1, n)) <= 7))) || '.pdf' AS output FROM c""")
def output_names_of_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of bookmarks, whole and cut to seven bytes."""
    mark = F.concat(F.lit("é€"), F.col("role"), F.lit("/"), F.col("pageno").cast("string"))
    return pages(spark, sf_dir).select("doc_id", "pageno", text.file_name("@B_@b7@.pdf", F.col("pageno"), bookmark=mark).alias("output"))


@query("stamp_text", f"""WITH {PAGES} SELECT doc_id, pageno, (pageno + 1) // 2 || ': page ' || pageno || ' (' || {_ROMAN.format(n='pageno')} || ') of ' || last || ' in a.pdf, no ' || lpad(CAST(pageno + 99 AS VARCHAR), 6, '0') AS stamp
    FROM page JOIN last USING (doc_id)""")
def stamp_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stamp's text on every page."""
    p = pages(spark, sf_dir)
    p = p.join(ops.count(p), "doc_id")
    return p.select("doc_id", "pageno", text.stamp("%PageDiv2: page %Page (%Roman) of %EndPage in %filename, no %Bates", F.col("pageno"), F.col("n_pages"), "a.pdf", bates=100, bates_width=6).alias("stamp"))


@query("strftime", """SELECT event_id, strftime(ts, '%a %A %b %B') || ' ' || strftime(ts, '%d') || ' ' || strftime(ts, '%H:%M') || ' ' || lpad(CAST(hour(ts) % 12 AS VARCHAR), 2, '0') || ' '
    || CASE WHEN hour(ts) < 12 THEN 'a.m' ELSE 'p.m' END || ' ' || lpad(CAST(dayofyear(ts) - 1 AS VARCHAR), 3, '0') || ' ' || (dayofweek(ts) + 1) || dayofweek(ts) || ' ' || strftime(ts, '%Y-%m %H:%M:%S') || '%' AS shown FROM events""")
def strftime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subset of strftime codes."""
    return table(spark, sf_dir, "events").select("event_id", text.strftime("%a %A %b %B %d %H:%M %I %p %j %u%w %Y-%m %T%%", F.col("ts")).alias("shown"))


@query("pdf_dates", """SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || 'Z' AS date, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS xmp, strftime(o_orderdate, '%Y-%m') || '-01T00:00:00Z' AS partial,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:30' AS zoned FROM orders""")
def pdf_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as documents write them and as metadata does, whole, partial and with an offset."""
    date = text.pdf_date(F.col("o_orderdate"))
    zoned = F.concat(F.substring(date, 1, 16), F.lit("+02'30'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", date.alias("date"), text.xmp_date(date).alias("xmp"), text.xmp_date(F.substring(date, 1, 8)).alias("partial"), text.xmp_date(zoned).alias("zoned"))


@query("units", "SELECT p_partkey, round(p_size * 72 / 2.54, 6) AS cm, round(p_size * 7.2 / 2.54, 6) AS mm, p_size * 72.0::DOUBLE AS inches, round((p_size + 72) * 2 - 7.2 / 2.54, 6) AS mixed FROM part")
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and an expression from left to right."""
    size = F.col("p_size").cast("double")
    mixed = geometry.numbers("SIZE add 1in mul 2 sub 1mm", {"SIZE": size})[0]
    return table(spark, sf_dir, "part").select("p_partkey", F.round(size * geometry.POINTS["cm"], 6).alias("cm"), F.round(size * geometry.POINTS["mm"], 6).alias("mm"), (size * geometry.POINTS["in"]).alias("inches"), F.round(mixed, 6).alias("mixed"))


@query("bates_width", "SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(4, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS whole, right('0000' || o_orderkey, 4) AS cut FROM orders")
def bates_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.padded(n, 4).alias("whole"), text.padded_right(n, 4).alias("cut"))


@query("trim_utf8", "SELECT doc_id, substr(text, 1, list_max(list_filter(range(0, 41), lambda n: strlen(substr(text, 1, n)) <= 40))) AS trimmed FROM documents")
def trim_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest beginning of a text in 40 bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", text.utf8_trimmed(F.col("text"), 40).alias("trimmed"))


@query("typeset")
def typeset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in lines of 72 characters on pages of 50 lines."""
    return ops.pages_fitted(table(spark, sf_dir, "documents"), "text", 72, 50)
