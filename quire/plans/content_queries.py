"""Queries on content streams, which a template makes of every turn's whole text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import content as ops
from quire.plans.proxies import PAGES, pages
from quire.plans.registry import query


#: A page's stream, one operator a line; ``{y}`` stands for 20 + the page's number, and all words of the turn for the line of one.
TEMPLATE = (
    "q", "2 0 0 2 10 {y} cm", "0 0 5 5 re", "W", "n", "BT", "/F1 12 Tf", "0.5 g", "3 Tr", "{words}", "[ (x) -250 (y) ] TJ", "ET", "0.25 w", "100 0 0 50 1 1 cm", "/Im1 Do", "Q",
    "/Stamp BMC", "q", "BT", "(stamp) Tj", "/In BMC", "EMC", "ET", "Q", "EMC", "1 G", "2 w", "0 0 m", "9 9 l", "S",
)


def stream() -> Column:
    """The stream of a page's number and text."""
    words = F.transform(F.split("text", " "), lambda w, i: F.concat(F.when(i == 0, "(").otherwise("( "), F.regexp_replace(w, r"([\\()])", r"\\$1"), F.lit(") Tj")))
    before, after = "\n".join(TEMPLATE).split("{words}")
    head, tail = before.split("{y}")
    return F.concat(F.lit(head), (F.col("pageno") + 20).cast("string"), F.lit(tail), F.array_join(words, "\n0 -14 Td\n"), F.lit(after))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pageno and content: for each turn all its words (but for the first with the space before), each on a line of its own from (10, 20 + page) down, an image, a clip and a stamp."""
    return pages(spark, sf_dir).select("doc_id", "pageno", stream().alias("content"))


_WORDS = f"{PAGES}, w AS (SELECT *, list_transform(string_split(text, ' '), lambda x, i: CASE WHEN i = 1 THEN x ELSE ' ' || x END) AS words FROM page), each AS (SELECT doc_id, pageno, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i, len(words) AS last FROM w)"


def _stream_sql(change: Callable[[str], str | None] = lambda line: line, word: str = "'(' || regexp_replace(x, '([\\\\()])', '\\\\\\1', 'g') || ') Tj'", between: str = "0 -14 Td", before: str = "", after: str = "", lines: Sequence[str | None] = TEMPLATE) -> str:
    """SQL for every page's stream with lines of the template changed (None: dropped); ``word`` the SQL of a word's line, empty without it."""
    made = []
    for line in lines:
        if line == "{words}":
            made.append(f"array_to_string(list_transform(words, lambda x: {word}), chr(10) || '{between}' || chr(10)) || chr(10)" if word else f"repeat('{between}' || chr(10), len(words) - 1)")
        elif line is not None and (new := change(line)) is not None:
            made.append("'" + new.replace("{y}", "' || (20 + pageno) || '") + "' || chr(10)")
    return f"WITH {_WORDS} SELECT doc_id, pageno, {before}{' || '.join(made).removesuffix(' || chr(10)')}{after} AS content FROM w"


def _dropping(*ops: str):
    return lambda line: None if line.split(" ")[-1] in ops else line


@query("extract_text", f"WITH {_WORDS} SELECT doc_id, pageno, array_to_string(words, '') || 'xystamp' AS shown FROM w")
def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.extracted(streams(spark, sf_dir))


_SHOWN = f"""WITH {_WORDS}, lastly AS (SELECT doc_id, pageno, last, 20.0::DOUBLE + pageno - 28 * (last - 1) AS y, 10 + 12.0::DOUBLE * length(word) AS x FROM each WHERE i = last),
    s AS (SELECT doc_id, pageno, CAST(i AS INTEGER) AS seq, 'text' AS kind, word AS text, 10.0::DOUBLE AS x, 20.0::DOUBLE + pageno - 28 * (i - 1) AS y, 12.0::DOUBLE AS size, 1 AS depth FROM each
    UNION ALL SELECT doc_id, pageno, last + 1, 'text', 'x', x, y, 12.0, 1 FROM lastly
    UNION ALL SELECT doc_id, pageno, last + 2, 'text', 'y', x + 18, y, 12.0, 1 FROM lastly
    UNION ALL SELECT doc_id, pageno, last + 3, 'image', '/Im1', 12.0, 20.0 + pageno + 2, 200.0, 1 FROM lastly
    UNION ALL SELECT doc_id, pageno, last + 4, 'text', 'stamp', 0.0, 0.0, 0.0, 1 FROM lastly)"""


@query("page_content", f"{_SHOWN} SELECT * FROM s")
def page_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every page shows, and where."""
    return ops.shown(streams(spark, sf_dir)).select("doc_id", "pageno", "seq", "kind", "text", "x", "y", "size", "depth")


@query("page_graphics", f"""WITH {_WORDS} SELECT doc_id, pageno, 'clip' AS kind, 'W 5' AS text, 10.0::DOUBLE AS x, 20.0::DOUBLE + pageno AS y, 10.0::DOUBLE AS size FROM w
    UNION ALL SELECT doc_id, pageno, 'path', 'S 2', 0.0, 0.0, 9.0 FROM w""")
def page_graphics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and clips of every page, in page space."""
    return ops.shown(streams(spark, sf_dir), graphics=True).where("kind in ('path', 'clip', 'shading')").select("doc_id", "pageno", "kind", "text", "x", "y", "size")


@query("content_operators", f"""WITH {_WORDS}, o AS (SELECT unnest([{", ".join("'" + t.split(" ")[-1] + "'" for t in TEMPLATE if t != "{words}")}]) AS op)
    SELECT op, sum(n)::BIGINT AS n FROM (SELECT op, count(*) AS n FROM page, o GROUP BY op UNION ALL SELECT 'Tj', sum(len(words)) FROM w UNION ALL SELECT 'Td', sum(len(words) - 1) FROM w) GROUP BY op""")
def content_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.parsed(streams(spark, sf_dir)).groupBy("op").agg(F.count("*").alias("n"))


@query("remove_all_text", _stream_sql(_dropping("Tj", "TJ"), word=""))
def remove_all_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rewritten(streams(spark, sf_dir), ops.without(*ops.TEXT_SHOWING))


@query("remove_clipping", _stream_sql(_dropping("W")))
def remove_clipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rewritten(streams(spark, sf_dir), ops.without("W", "W*"))


@query("reveal_text", _stream_sql(_dropping("Tr")))
def reveal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rewritten(streams(spark, sf_dir), ops.without("Tr"))


def _unstamped() -> list[str | None]:
    first = TEMPLATE.index("/Stamp BMC")
    return [None if first <= k < first + 9 else line for k, line in enumerate(TEMPLATE)]


@query("remove_stamps", _stream_sql(lines=_unstamped()))
def remove_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams without what stands between the stamp's tag and its end, inner tags included."""
    return ops.without_stamps(streams(spark, sf_dir), "/Stamp")


@query("thin_lines", _stream_sql(lambda line: "1 w" if line == "0.25 w" else line))
def thin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line widths raised to 1."""
    return ops.rewritten(streams(spark, sf_dir), ops.thinned(1.0))


@query("black_fills", _stream_sql(lambda line: "0 g" if line == "0.5 g" else line))
def black_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rewritten(streams(spark, sf_dir), ops.blackened("fills"))


@query("black_lines", _stream_sql(lambda line: "0 G" if line == "1 G" else line))
def black_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rewritten(streams(spark, sf_dir), ops.blackened("strokes"))


@query("frame_content", _stream_sql(before="'1 w' || chr(10) || 'q' || chr(10) || ", after=" || chr(10) || 'Q' || chr(10) || '2 w'"))
def frame_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators before and after every page's own."""
    p = streams(spark, sf_dir)
    return p.withColumn("content", ops.framed(F.col("content"), "1 w", "2 w"))


@query("mark_artifact", _stream_sql(before="'/Artifact BMC' || chr(10) || ", after=" || chr(10) || 'EMC'"))
def mark_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = streams(spark, sf_dir)
    return p.withColumn("content", ops.artifact(F.col("content")))


@query("remove_noops", _stream_sql(lambda line: None if line == "0.5 g" else line, before="'0.5 g' || chr(10) || "))
def remove_noops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams without operators that change nothing: empty saved states, and a colour that is set already."""
    p = streams(spark, sf_dir)
    return ops.without_noops(p.withColumn("content", F.concat(F.lit("q Q 0.5 g q 0.5 g Q\n"), "content")))


@query("move_content", _stream_sql(before="'q' || chr(10) || printf('2.000000 0.000000 0.000000 0.500000 %.6f 0.000000 cm', w) || chr(10) || ", after=" || chr(10) || 'Q'"))
def move_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content under a matrix of each page's own size."""
    p = streams(spark, sf_dir).join(pages(spark, sf_dir).select("doc_id", "pageno", "w"), ["doc_id", "pageno"])
    zero = F.lit(0.0)
    return p.select("doc_id", "pageno", ops.moved(F.col("content"), (F.lit(2.0), zero, zero, F.lit(0.5), F.col("w"), zero)).alias("content"))


@query("show_boxes", f"WITH {PAGES} SELECT doc_id, pageno, printf('q 1 w 0 G 0.00 0.00 %.2f %.2f re S Q', w, h) AS ops FROM page")
def show_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    return pages(spark, sf_dir).select("doc_id", "pageno", ops.rectangle_ops((zero, zero, F.col("w"), F.col("h"))).alias("ops"))


@query("draft", _stream_sql(lambda line: "0 0 m 1 1 l 0 1 m 1 0 l 0 0 1 1 re S" if line == "/Im1 Do" else line))
def draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images replaced by crossed boxes."""
    return ops.rewritten(streams(spark, sf_dir), ops.drafted(True))


@query("compress_streams", "SELECT doc_id, text AS restored, CAST(CASE WHEN text IS NULL THEN NULL ELSE true END AS BOOLEAN) AS bounded FROM documents")
def compress_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text compressed and restored, and that it is never longer than its bytes and a mark."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("raw"))
    packed = d.withColumn("packed", ops.deflated(F.col("raw")))
    return packed.select("doc_id", ops.inflated(F.col("packed")).cast("string").alias("restored"), (F.octet_length("packed") <= F.octet_length("raw") + 1).alias("bounded"))


@query("remove_javascript", r"SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), 'javascript:[^\"]*', '', 'g') AS html FROM pages")
def remove_javascript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup without scripts."""
    html = F.regexp_replace(F.regexp_replace("html", r"(?is)<script\b.*?</script>", ""), r'javascript:[^"]*', "")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html.alias("html"))


def _media() -> tuple:
    return F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h")


@query("hard_box", f"WITH {PAGES} SELECT doc_id, pageno, 'q' || chr(10) || printf('0.00 0.00 %.2f %.2f re W n', w, h) || chr(10) || role || chr(10) || 'Q' AS content FROM page")
def hard_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content clipped to a box."""
    return pages(spark, sf_dir).select("doc_id", "pageno", ops.clipped(F.col("role"), _media()).alias("content"))


@query("trim_marks", f"""WITH {PAGES} SELECT doc_id, pageno, 'q 0.25 w ' || printf('-25.00 0.00 m -5.00 0.00 l -25.00 %.2f m -5.00 %.2f l %.2f 0.00 m %.2f 0.00 l %.2f %.2f m %.2f %.2f l', h, h, w + 25, w + 5, w + 25, h, w + 5, h)
    || printf(' 0.00 -25.00 m 0.00 -5.00 l %.2f -25.00 m %.2f -5.00 l 0.00 %.2f m 0.00 %.2f l %.2f %.2f m %.2f %.2f l S Q', w, w, h + 25, h + 5, w, h + 25, w, h + 5) AS ops FROM page""")
def trim_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", "pageno", ops.trim_marks(_media(), 5.0, 20.0).alias("ops"))


@query("bounding_boxes", f"{_SHOWN} SELECT doc_id, pageno, seq, x AS minx, y AS miny, x + length(text) * size * 0.5 AS maxx, y + size AS maxy FROM s WHERE kind = 'text'")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each text that a page shows lies."""
    return ops.bounds_shown(streams(spark, sf_dir))


@query("glyph_boxes", f"""{_SHOWN}, c AS (SELECT *, unnest(generate_series(1, length(text))) AS k FROM s WHERE kind = 'text' AND length(text) > 0)
    SELECT doc_id, pageno, seq, CAST(k - 1 AS INTEGER) AS place, substr(text, k, 1) AS char, x + (k - 1) * size * 0.5 AS minx, y AS miny, x + k * size * 0.5 AS maxx, y + size AS maxy FROM c""")
def glyph_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of every character that a page shows."""
    return ops.glyph_boxes(streams(spark, sf_dir))
