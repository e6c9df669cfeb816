"""Document tables made from the test tables, each with the SQL that makes the same rows.

There are no documents of pages among the test tables; conversations stand for
them (a turn is a page), and other tables for objects, marks and uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages: doc_id, pageno, role, text, n (characters), w and h, annots, rotation."""
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("pageno"), "role", "text", n.alias("n"),
        (400.0 + n % 5 * 100).alias("w"), (500.0 + n % 3 * 100).alias("h"), (n % 4 - 1).alias("annots"), (n % 4 * 90).alias("rotation"),
    )


PAGES = """page AS (
    SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS pageno, role, text, length(text) AS n, 400.0::DOUBLE + length(text) % 5 * 100 AS w, 500.0::DOUBLE + length(text) % 3 * 100 AS h,
        length(text) % 4 - 1 AS annots, length(text) % 4 * 90 AS rotation FROM conversations),
last AS (SELECT doc_id, max(pageno) AS last FROM page GROUP BY doc_id)"""


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are level-0 or deeper bookmarks of their own: doc_id, seq, level, target, text."""
    p = pages(spark, sf_dir).where("pageno = 1 or n % 3 <> 0")
    return p.select("doc_id", F.col("pageno").alias("seq"), F.when(F.col("pageno") == 1, 0).otherwise(F.col("n") % 3 - 1).alias("level"), F.col("pageno").alias("target"), F.concat(F.col("role"), F.lit(" "), F.col("pageno")).alias("text"))


MARKS = """mark AS (
    SELECT doc_id, pageno AS seq, CASE WHEN pageno = 1 THEN 0 ELSE n % 3 - 1 END AS level, pageno AS target, role || ' ' || pageno AS text FROM page WHERE pageno = 1 OR n % 3 <> 0)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference graph over parts: each refers to two others further on, and back to one (key /Parent), in cycles."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    every = p.select("src", F.explode(F.array(F.struct((2 * F.col("src")).alias("dst"), F.lit("/Kids").alias("via")), F.struct((2 * F.col("src") + 1).alias("dst"), F.lit("/Kids").alias("via")), F.struct(F.floor(F.col("src") / 3).cast("long").alias("dst"), F.lit("/Parent").alias("via")))).alias("e")).select("src", "e.dst", "e.via")
    return every.join(p.select(F.col("src").alias("dst")).hint("merge"), "dst", "left_semi").select("src", "dst", "via")


EDGES = """edge AS (
    SELECT * FROM (SELECT p_partkey AS src, 2 * p_partkey AS dst, '/Kids' AS via FROM part UNION ALL SELECT p_partkey, 2 * p_partkey + 1, '/Kids' FROM part
        UNION ALL SELECT p_partkey, p_partkey // 3, '/Parent' FROM part) WHERE dst IN (SELECT p_partkey FROM part))"""
