"""Queries on page ranges and page sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry, ranges, text
from quire.operators import pages as ops
from quire.plans.proxies import MARKS, PAGES, marks, pages
from quire.plans.registry import query


@query("page_count", f"WITH {PAGES} SELECT doc_id, count(*) AS n_pages FROM page GROUP BY doc_id")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.count(pages(spark, sf_dir))


@query("page_info_range", f"""WITH {PAGES}, r AS (
    SELECT doc_id, unnest(CASE WHEN last < 2 THEN [last] ELSE generate_series(2, last) END) AS pageno FROM last),
    o AS (SELECT doc_id, pageno, row_number() OVER (PARTITION BY doc_id ORDER BY pageno) AS pos FROM r WHERE pageno % 2 = 1)
    SELECT o.doc_id, CAST(o.pos AS INTEGER) AS pos, o.pageno, ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x', 'xi', 'xii'][CAST(o.pageno + 1 AS BIGINT)] AS label, p.role, p.n
    FROM o JOIN page p ON p.doc_id = o.doc_id AND p.pageno = o.pageno""")
def page_info_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page information of "2-endodd" in range order, with lower-case roman labels."""
    chosen = ranges.selected(pages(spark, sf_dir), "2-endodd")
    return chosen.select("doc_id", F.col("pos").cast("int").alias("pos"), "pageno", text.roman(F.col("pageno"), False).alias("label"), "role", "n")


#: Ranges and the SQL list of each, over ``last``.
RANGES = {
    "all": ("", "generate_series(1, last)"),
    "reverse": ("reverse", "list_reverse(generate_series(1, last))"),
    "odd": ("odd", "list_filter(generate_series(1, last), lambda x: x % 2 = 1)"),
    "even_suffix": ("end-1,2even", "list_filter(list_reverse(generate_series(1, last)) || [2], lambda x: x % 2 = 0 AND x <= last)"),
    "descending": ("4-2", "list_filter([4, 3, 2], lambda x: x <= last)"),
    "from_end": ("~2-end,1", "list_filter(generate_series(last - 1, last) || [1], lambda x: x >= 1)"),
    "beyond_end": ("7-end", "CASE WHEN last < 7 THEN [last] ELSE generate_series(7, last) END"),
    "dup": ("2DUP1-3", "list_filter([1, 1, 2, 2, 3, 3], lambda x: x <= last)"),
    "not": ("NOT2-3", "list_filter(generate_series(1, last), lambda x: x NOT IN (2, 3))"),
    "dropped": ("3,1,3,99", "list_filter([3, 1, 3], lambda x: x <= last)"),
}
for _name, (_range, _sql) in RANGES.items():

    @query(f"range_{_name}", f"WITH {PAGES}, l AS (SELECT doc_id, {_sql} AS p FROM last) SELECT doc_id, CAST(i AS INTEGER) AS pos, CAST(p[i] AS INTEGER) AS pageno FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM l)")
    def range_query(spark: SparkSession, sf_dir: str, text: str = _range) -> DataFrame:
        return ranges.selected(pages(spark, sf_dir).select("doc_id", "pageno"), text).select("doc_id", F.col("pos").cast("int").alias("pos"), "pageno")


@query("range_qualities", f"""WITH {PAGES}
    SELECT doc_id, pageno, w < h AS portrait, w > h AS landscape, annots > 0 AS annotated, pageno % 2 = 0 AND w < h AS even_portrait FROM page""")
def range_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set membership of ranges by what pages are."""
    p = pages(spark, sf_dir)
    known = ranges.facts(p, width="w", height="h", annotations="annots")
    for name, spec in (("portrait", "portrait"), ("landscape", "landscape"), ("annotated", "annotated"), ("even_portrait", "2,4,6,8,10,12,14,16,18,20portrait")):
        p = ranges.member(p, spec, known, to=name)
    return p.select("doc_id", "pageno", "portrait", "landscape", "annotated", "even_portrait")


@query("range_label", f"WITH {PAGES} SELECT doc_id, min(pageno) AS pageno FROM page WHERE role = 'assistant' GROUP BY doc_id")
def range_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a label."""
    p = pages(spark, sf_dir)
    return ranges.selected(p, "[assistant]", ranges.facts(p, label="role")).select("doc_id", "pageno")


@query("range_compact", f"""WITH {PAGES}, c AS (SELECT page.doc_id, pageno, last FROM page JOIN last USING (doc_id) WHERE n % 3 <> 1),
    i AS (SELECT doc_id, last, pageno, pageno - row_number() OVER (PARTITION BY doc_id ORDER BY pageno) AS island FROM c),
    r AS (SELECT doc_id, last, min(pageno) AS a, max(pageno) AS b FROM i GROUP BY doc_id, last, island),
    t AS (SELECT doc_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS runs FROM r GROUP BY doc_id),
    l AS (SELECT doc_id, any_value(last) AS last, list(pageno ORDER BY pageno) AS p FROM c GROUP BY doc_id)
    SELECT doc_id, CASE WHEN last > 3 AND p = generate_series(2, last, 2) THEN 'even' WHEN last > 2 AND p = generate_series(1, last, 2) THEN 'odd' WHEN p = generate_series(1, last) THEN 'all' ELSE runs END AS range_text
    FROM l JOIN t USING (doc_id)""")
def range_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of pages as a range text."""
    p = pages(spark, sf_dir)
    return ranges.compacted(p.join(ranges.facts(p), "doc_id").where("n % 3 <> 1"))


_HALVES = "a AS (SELECT doc_id // 2 AS file, doc_id % 2 AS input_no, pageno AS pos, n FROM page)"


def _inputs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    p = pages(spark, sf_dir)
    return [p.where(F.col("doc_id") % 2 == k).select(F.floor(F.col("doc_id") / 2).cast("long").alias("file"), F.col("pageno").alias("pos"), "n") for k in (0, 1)]


@query("merge", f"WITH {PAGES}, {_HALVES} SELECT file, input_no, pos, n, CAST(row_number() OVER (PARTITION BY file ORDER BY input_no, pos) AS INTEGER) AS pageno FROM a")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring conversations as the inputs of one file."""
    return ops.merged(_inputs(spark, sf_dir), group="file").select("file", F.col("input_no").cast("long").alias("input_no"), "pos", "n", "pageno")


@query("merge_collate", f"WITH {PAGES}, {_HALVES} SELECT file, input_no, pos, n, CAST(row_number() OVER (PARTITION BY file ORDER BY (pos - 1) // 2, input_no, pos) AS INTEGER) AS pageno FROM a")
def merge_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that take turns, two pages each."""
    return ops.merged(_inputs(spark, sf_dir), 2, "file").select("file", F.col("input_no").cast("long").alias("input_no"), "pos", "n", "pageno")


@query("split", f"WITH {PAGES} SELECT doc_id, pageno, CAST((pageno - 1) // 3 + 1 AS INTEGER) AS chunk, CAST((pageno - 1) % 3 + 1 AS INTEGER) AS chunk_page FROM page")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.split_every(pages(spark, sf_dir), 3).select("doc_id", "pageno", "chunk", "chunk_page")


@query("split_bookmarks", f"WITH {PAGES}, {MARKS}, m AS (SELECT DISTINCT doc_id, target FROM mark WHERE level = 1) SELECT p.doc_id, p.pageno, CAST(sum(CASE WHEN m.target IS NOT NULL AND p.pageno > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.pageno) + 1 AS INTEGER) AS chunk FROM page p LEFT JOIN m ON m.doc_id = p.doc_id AND m.target = p.pageno")
def split_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk from every page that is the target of a level-1 mark."""
    targets = marks(spark, sf_dir).where("level = 1").select("doc_id", F.col("target").alias("pageno"), F.lit(True).alias("is_mark")).distinct()
    return ops.split_at(pages(spark, sf_dir).join(targets, ["doc_id", "pageno"], "left"), F.coalesce("is_mark", F.lit(False))).select("doc_id", "pageno", "chunk")


@query("split_max", f"""WITH RECURSIVE {PAGES}, f AS (
    SELECT doc_id, pageno, n AS held, 1 AS chunk FROM page WHERE pageno = 1
    UNION ALL SELECT p.doc_id, p.pageno, CASE WHEN f.held + p.n > 2000 THEN p.n ELSE f.held + p.n END, CASE WHEN f.held + p.n > 2000 THEN f.chunk + 1 ELSE f.chunk END
    FROM f JOIN page p ON p.doc_id = f.doc_id AND p.pageno = f.pageno + 1) SELECT doc_id, pageno, CAST(chunk AS INTEGER) AS chunk FROM f""")
def split_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy chunks of 2000 characters at most."""
    return ops.split_by_size(pages(spark, sf_dir), "n", 2000)


@query("spray", f"WITH {PAGES} SELECT doc_id, pageno, CAST((pageno - 1) % 3 AS INTEGER) AS output, CAST((pageno - 1) // 3 + 1 AS INTEGER) AS output_page FROM page")
def spray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sprayed(pages(spark, sf_dir), 3).select("doc_id", "pageno", "output", "output_page")


def _padded_sql(rows: str) -> str:
    """``rows``: doc_id, old (page it stands by), nth (order there), blank."""
    return f"WITH {PAGES}, r AS ({rows}) SELECT doc_id, CASE WHEN blank THEN 0 ELSE CAST(old AS INTEGER) END AS old_page, blank, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY old, nth) AS INTEGER) AS pageno FROM r"


_PLAIN = "SELECT doc_id, pageno AS old, 50 AS nth, false AS blank FROM page"


@query("pad_before", _padded_sql(f"{_PLAIN} UNION ALL SELECT doc_id, pageno, 0, true FROM page WHERE pageno % 2 = 0"))
def pad_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.padded(pages(spark, sf_dir), F.col("pageno") % 2 == 0).select("doc_id", F.coalesce("old_page", F.lit(0)).alias("old_page"), "blank", "pageno")


@query("pad_after", _padded_sql(f"{_PLAIN} UNION ALL SELECT doc_id, pageno, 99, true FROM page WHERE pageno <= 2"))
def pad_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.padded(pages(spark, sf_dir), F.col("pageno") <= 2, False).select("doc_id", F.coalesce("old_page", F.lit(0)).alias("old_page"), "blank", "pageno")


@query("pad_every", _padded_sql(f"{_PLAIN} UNION ALL SELECT doc_id, pageno, 99, true FROM page JOIN last USING (doc_id) WHERE pageno % 2 = 0 AND pageno < last"))
def pad_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.padded_every(pages(spark, sf_dir), 2).select("doc_id", F.coalesce("old_page", F.lit(0)).alias("old_page"), "blank", "pageno")


@query("pad_multiple", _padded_sql(f"{_PLAIN} UNION ALL SELECT doc_id, last, 50 + unnest(generate_series(1, (4 - last % 4) % 4)), true FROM last"))
def pad_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.padded_to_multiple(pages(spark, sf_dir), 4).select("doc_id", F.coalesce("old_page", F.lit(0)).alias("old_page"), "blank", "pageno")


@query("pad_multiple_before", _padded_sql(f"{_PLAIN} UNION ALL SELECT doc_id, 1, unnest(generate_series(1, (4 - last % 4) % 4)), true FROM last"))
def pad_multiple_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.padded_to_multiple(pages(spark, sf_dir), 4, True).select("doc_id", F.coalesce("old_page", F.lit(0)).alias("old_page"), "blank", "pageno")


@query("combine_pages", f"WITH {PAGES} SELECT a.doc_id, a.pageno, a.n, coalesce(b.n, -1) AS over_n FROM page a LEFT JOIN page b ON b.doc_id = a.doc_id + 1 AND b.pageno = a.pageno")
def combine_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with the next laid over it."""
    p = pages(spark, sf_dir).select("doc_id", "pageno", "n")
    return ops.combined(p, p.withColumn("doc_id", F.col("doc_id") - 1)).withColumn("over_n", F.coalesce("over_n", F.lit(-1)))


@query("stamp_on", f"WITH {PAGES} SELECT doc_id, pageno, CASE WHEN pageno % 2 = 1 THEN role || (SELECT min(n_name) FROM nation) ELSE role END AS content FROM page")
def stamp_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stamp over every odd page."""
    stamp = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.min("n_name").alias("stamp"))
    return ops.stamped(pages(spark, sf_dir).select("doc_id", "pageno", F.col("role").alias("content")), stamp, F.col("pageno") % 2 == 1)


@query("stamp_under", f"WITH {PAGES} SELECT doc_id, pageno, CASE WHEN pageno > 1 THEN (SELECT min(n_name) FROM nation) || role ELSE role END AS content FROM page")
def stamp_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.min("n_name").alias("stamp"))
    return ops.stamped(pages(spark, sf_dir).select("doc_id", "pageno", F.col("role").alias("content")), stamp, F.col("pageno") > 1, True)


@query("impose", f"WITH {PAGES} SELECT doc_id, pageno, CAST((pageno - 1) // 6 + 1 AS INTEGER) AS sheet, CAST(2 - (pageno - 1) % 6 % 3 AS INTEGER) AS col, CAST((pageno - 1) % 6 // 3 AS INTEGER) AS row FROM page")
def impose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six pages a sheet from right to left."""
    return ops.imposed(pages(spark, sf_dir), 3, 2, right_to_left=True).select("doc_id", "pageno", "sheet", "col", "row")


@query("impose_columns", f"WITH {PAGES} SELECT doc_id, pageno, CAST((pageno - 1) // 6 + 1 AS INTEGER) AS sheet, CAST((pageno - 1) % 6 // 2 AS INTEGER) AS col, CAST(1 - (pageno - 1) % 6 % 2 AS INTEGER) AS row FROM page")
def impose_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.imposed(pages(spark, sf_dir), 3, 2, columns=True, bottom_to_top=True).select("doc_id", "pageno", "sheet", "col", "row")


@query("two_up", f"WITH {PAGES} SELECT doc_id, pageno, CAST((pageno - 1) // 2 + 1 AS INTEGER) AS sheet, CAST((pageno - 1) % 2 AS INTEGER) AS col, CAST(0 AS INTEGER) AS row FROM page")
def two_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.imposed(pages(spark, sf_dir), 2, 1).select("doc_id", "pageno", "sheet", "col", "row")


@query("chop", f"""WITH {PAGES}, c AS (SELECT doc_id, pageno AS old_page, w, h, unnest([0, 1, 2, 3]) AS cell FROM page)
    SELECT doc_id, old_page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY old_page, cell) AS INTEGER) AS pageno, cell % 2 * (w / 2) AS minx, h - (cell // 2 + 1) * (h / 2) AS miny, (cell % 2 + 1) * (w / 2) AS maxx, h - cell // 2 * (h / 2) AS maxy FROM c""")
def chop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.chopped(pages(spark, sf_dir), 2, 2, "w", "h").select("doc_id", "old_page", "pageno", "minx", "miny", "maxx", "maxy")


@query("chop_line", f"""WITH {PAGES} SELECT doc_id, pageno AS old_page, CAST(2 * pageno - 1 AS INTEGER) AS pageno, 0.0::DOUBLE AS minx, 0.0::DOUBLE AS miny, 150.0::DOUBLE AS maxx, h AS maxy FROM page
    UNION ALL SELECT doc_id, pageno, CAST(2 * pageno AS INTEGER), 150.0::DOUBLE, 0.0::DOUBLE, w, h FROM page""")
def chop_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.chopped_at(pages(spark, sf_dir), 150.0, True, "w", "h").select("doc_id", "old_page", "pageno", "minx", "miny", "maxx", "maxy")


@query("create_pages", f"WITH {PAGES} SELECT doc_id, CAST(unnest(generate_series(1, last)) AS INTEGER) AS pageno, 595.0::DOUBLE AS w, 842.0::DOUBLE AS h FROM last")
def create_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ops.count(pages(spark, sf_dir))
    return ops.blank(p, F.col("n_pages"), 595.0, 842.0)


@query("list_bookmarks", f"WITH {PAGES}, {MARKS} SELECT doc_id, seq, level, target, text FROM mark WHERE target BETWEEN 2 AND 4")
def list_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks whose target is in a range."""
    m = marks(spark, sf_dir)
    known = ranges.facts(pages(spark, sf_dir))
    return ranges.member(m.withColumn("pageno", F.col("target")), "2-4", known).where("in_range").select("doc_id", "seq", "level", "target", "text")


@query("bad_bookmarks", f"""WITH {PAGES}, {MARKS}, b AS (
    SELECT mark.doc_id, seq, level + n % 4 AS level, target, mark.text, lag(level + n % 4) OVER (PARTITION BY mark.doc_id ORDER BY seq) AS before FROM mark JOIN page ON page.doc_id = mark.doc_id AND pageno = target)
    SELECT doc_id, seq, level, target, CASE WHEN before IS NULL AND level <> 0 THEN 'first level' ELSE 'level' END AS reason FROM b WHERE (before IS NULL AND level <> 0) OR level >= before + 2""")
def bad_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules broken by bookmarks of disturbed levels."""
    p = pages(spark, sf_dir)
    m = marks(spark, sf_dir).join(p.select("doc_id", F.col("pageno").alias("target"), "n"), ["doc_id", "target"]).withColumn("level", F.col("level") + F.col("n") % 4)
    return ops.bad_marks(m, ops.count(p)).select("doc_id", "seq", "level", "target", "reason")


@query("bookmarks_open", f"WITH {PAGES}, {MARKS} SELECT doc_id, seq, level < 1 AS is_open FROM mark")
def bookmarks_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.opened_to(marks(spark, sf_dir), 1).select("doc_id", "seq", "is_open")


@query("current_bookmark", f"""WITH {PAGES}, {MARKS}, j AS (
    SELECT p.doc_id, p.pageno, max(CASE WHEN m.level = 1 AND m.target = p.pageno THEN m.text END) AS here, max(CASE WHEN m.level = 1 AND m.target < p.pageno THEN m.seq END) AS seq, max(CASE WHEN m.level < 1 AND m.target <= p.pageno THEN m.seq END) AS reset
    FROM page p LEFT JOIN mark m ON m.doc_id = p.doc_id AND m.target <= p.pageno GROUP BY p.doc_id, p.pageno)
    SELECT j.doc_id, j.pageno, coalesce(here, CASE WHEN reset IS NULL OR j.seq > reset THEN m.text END) AS mark FROM j LEFT JOIN mark m ON m.doc_id = j.doc_id AND m.seq = j.seq""")
def current_bookmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level-1 bookmark that each page stands under."""
    return ops.current_mark(pages(spark, sf_dir), marks(spark, sf_dir), 1).select("doc_id", "pageno", "mark")


@query("page_labels", f"""WITH {PAGES}, s AS (SELECT doc_id, pageno, row_number() OVER (PARTITION BY doc_id ORDER BY pageno) AS k FROM page WHERE pageno >= 3)
    SELECT p.doc_id, p.pageno, CASE WHEN k IS NULL THEN CAST(p.pageno AS VARCHAR) ELSE 'A-' || ['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x'][k + 4] END AS label FROM page p LEFT JOIN s ON s.doc_id = p.doc_id AND s.pageno = p.pageno""")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from a range on: A-v, A-vi, ..."""
    p = pages(spark, sf_dir)
    made = ops.label_ranges(p.where("pageno >= 3"), "r", "A-", 5, False)
    return ops.labelled(p, made).select("doc_id", "pageno", "label")


@query("add_page_labels", f"""WITH {PAGES}, i AS (SELECT doc_id, pageno, pageno - row_number() OVER (PARTITION BY doc_id ORDER BY pageno) AS island FROM page WHERE n % 3 <> 0),
    r AS (SELECT doc_id, min(pageno) AS startpage, count(*) AS c FROM i GROUP BY doc_id, island)
    SELECT doc_id, startpage, 'D' AS style, 'p' AS prefix, CAST(1 + coalesce(sum(c) OVER (PARTITION BY doc_id ORDER BY startpage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS startvalue FROM r
    UNION ALL SELECT doc_id, 1, 'D', '', 1 FROM r GROUP BY doc_id HAVING min(startpage) > 1""")
def add_page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progressive label ranges of the runs of a set of pages."""
    return ops.label_ranges(pages(spark, sf_dir).where("n % 3 <> 0"), "D", "p", 1, True)


def _boxes(p: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return p.select("*", zero.alias("media_minx"), zero.alias("media_miny"), F.col("w").alias("media_maxx"), F.col("h").alias("media_maxy"))


_SHOW = "doc_id", "pageno"


@query("scale_to_fit", f"""WITH {PAGES}, s AS (SELECT *, least(210 * 7.2 / 2.54 / w, 297 * 7.2 / 2.54 / h) AS s FROM page)
    SELECT doc_id, pageno, round(s, 6) AS scale, round((210 * 7.2 / 2.54 - w * s) / 2, 4) AS dx, round((297 * 7.2 / 2.54 - h * s) / 2, 4) AS dy FROM s""")
def scale_to_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale and offsets that fit each page to A4."""
    to = geometry.numbers("a4")
    s, dx, dy = geometry.fitted(F.col("w"), F.col("h"), *to)
    return pages(spark, sf_dir).select(*_SHOW, F.round(s, 6).alias("scale"), F.round(dx, 4).alias("dx"), F.round(dy, 4).alias("dy"))


@query("anchor_position", f"WITH {PAGES} SELECT doc_id, pageno, w - 36 AS x, h - 36 AS y, w / 2 AS cx, 36.0::DOUBLE AS cy FROM page")
def anchor_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _boxes(pages(spark, sf_dir))
    (x, y), (cx, cy) = geometry.position("topright", geometry.box("media"), 36.0), geometry.position("bottom", geometry.box("media"), 36.0)
    return p.select(*_SHOW, x.alias("x"), y.alias("y"), cx.alias("cx"), cy.alias("cy"))


ANCHORS = ("centre", "left", "right", "top", "bottom", "topleft", "topright", "bottomleft", "bottomright")


@query("anchors", f"""WITH {PAGES}, a AS (SELECT *, unnest([{", ".join(f"'{a}'" for a in ANCHORS)}]) AS anchor FROM page)
    SELECT doc_id, pageno, anchor, CASE WHEN contains(anchor, 'left') THEN 20.0::DOUBLE WHEN contains(anchor, 'right') THEN w - 20 ELSE w / 2 END AS x, CASE WHEN contains(anchor, 'top') THEN h - 20 WHEN contains(anchor, 'bottom') THEN 20.0 ELSE h / 2 END AS y FROM a""")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor of every page."""
    p = _boxes(pages(spark, sf_dir))
    points = [F.struct(F.lit(a).alias("anchor"), *[c.alias(n) for n, c in zip("xy", geometry.position(a, geometry.box("media"), 20.0))]) for a in ANCHORS]
    return p.select(*_SHOW, F.explode(F.array(*points)).alias("p")).select(*_SHOW, "p.anchor", "p.x", "p.y")


@query("redact_touching", """WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS pageno, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem)
    SELECT a.doc_id, a.pageno AS a, b.pageno AS b FROM b a JOIN b ON b.doc_id = a.doc_id AND b.pageno > a.pageno
    WHERE greatest(a.x, b.x) < least(a.x + 10, b.x + 10) AND greatest(a.y, b.y) < least(a.y + a.z, b.y + b.z)""")
def redact_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one order that touch: a spatial join on the order and two intervals."""
    b = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("no"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))
    one, two = b.select("doc_id", *[F.col(c).alias(f"a_{c}") for c in ("no", "x", "y", "z")]), b.select("doc_id", *[F.col(c).alias(f"b_{c}") for c in ("no", "x", "y", "z")])
    box = lambda k: (F.col(f"{k}_x"), F.col(f"{k}_y"), F.col(f"{k}_x") + 10, F.col(f"{k}_y") + F.col(f"{k}_z"))
    return one.join(two, "doc_id").where((F.col("b_no") > F.col("a_no")) & geometry.touches(box("a"), box("b"))).select("doc_id", F.col("a_no").alias("a"), F.col("b_no").alias("b"))


@query("contents_list", f"""WITH {PAGES}, {MARKS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS k FROM mark)
    SELECT doc_id, CAST(k // 3 + 1 AS INTEGER) AS pageno, CAST(k % 3 + 1 AS INTEGER) AS line, rpad(repeat('  ', CAST(level AS INTEGER)) || text, CAST(30 - length(CAST(target AS VARCHAR)) AS INTEGER), '.') || target AS text FROM r""")
def contents_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.contents_list(marks(spark, sf_dir), 3, 30)


@query("open_at_page", f"WITH {PAGES} SELECT doc_id, last AS pageno FROM last")
def open_at_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return ops.only_page(p, ranges.selected(p.select("doc_id", "pageno"), "end"))


@query("outline_text", f"""WITH {PAGES}, {MARKS} SELECT doc_id, string_agg(level || ' "' || text || '" ' || target || CASE WHEN level = 0 THEN ' open' ELSE '' END, chr(10) ORDER BY seq) AS outline FROM mark GROUP BY doc_id""")
def outline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.outline_text(marks(spark, sf_dir).withColumn("is_open", F.col("level") == 0))


@query("outline_marks", f"WITH {PAGES}, {MARKS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS INTEGER) AS seq, level, text, target, level = 0 AS is_open FROM mark")
def outline_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks written as text and read again."""
    return ops.outline_marks(ops.outline_text(marks(spark, sf_dir).withColumn("is_open", F.col("level") == 0)))


@query("presentation", f"WITH {PAGES} SELECT doc_id, pageno, CASE WHEN pageno % 2 = 0 THEN 'Wipe' ELSE 'none' END AS style, CASE WHEN pageno % 2 = 0 THEN 2.5::DOUBLE ELSE 0.0 END AS seconds FROM page")
def presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of the pages of a range."""
    p = ranges.member(pages(spark, sf_dir), "even")
    return p.select("doc_id", "pageno", F.when(F.col("in_range"), "Wipe").otherwise("none").alias("style"), F.when(F.col("in_range"), 2.5).otherwise(0.0).alias("seconds"))
