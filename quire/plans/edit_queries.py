"""Queries of operators that edit pages, annotations, attachments and properties, and of the binary form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ranges
from quire.operators import access, annotations, attachments, boxes, content, metadata, objects
from quire.plans.proxies import PAGES, pages, table
from quire.plans.registry import query
from quire.sources import binary, images

# Pages with boxes: a media box on each, a crop box where there are annotations; the role stands for content.

_BOXED = f"""{PAGES}, boxed AS (SELECT doc_id, pageno, CAST(rotation AS INTEGER) AS rotation, role AS content, 0.0::DOUBLE AS media_minx, 0.0::DOUBLE AS media_miny, w AS media_maxx, h AS media_maxy,
    CASE WHEN annots > 0 THEN 10.0::DOUBLE END AS crop_minx, CASE WHEN annots > 0 THEN 20.0::DOUBLE END AS crop_miny, CASE WHEN annots > 0 THEN w / 2 END AS crop_maxx, CASE WHEN annots > 0 THEN h / 2 END AS crop_maxy FROM page)"""


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = lambda c: F.when(F.col("annots") > 0, c)
    zero = F.lit(0.0)
    return pages(spark, sf_dir).select(
        "doc_id", "pageno", F.col("rotation").cast("int").alias("rotation"), F.col("role").alias("content"), zero.alias("media_minx"), zero.alias("media_miny"), F.col("w").alias("media_maxx"), F.col("h").alias("media_maxy"),
        crop(F.lit(10.0)).alias("crop_minx"), crop(F.lit(20.0)).alias("crop_miny"), crop(F.col("w") / 2).alias("crop_maxx"), crop(F.col("h") / 2).alias("crop_maxy"),
    )


_ALL = ("doc_id", "pageno", "rotation", "content", *(f"{b}_{s}" for b in ("media", "crop") for s in boxes.SIDES))


def _odd() -> Column:
    return F.col("pageno") % 2 == 1


def _shown(df: DataFrame) -> DataFrame:
    """All columns, numbers to 4 places."""
    return df.select(*[F.round(c, 4).alias(c) if "_m" in c else F.col(c) for c in _ALL])


def _boxes_sql(changed: dict[str, str], chosen: str = "pageno % 2 = 1") -> str:
    """SQL: all pages, some columns changed on the chosen ones."""
    columns = [f"CASE WHEN {chosen} THEN {changed[c]} ELSE {c} END" if c in changed else c for c in _ALL]
    rounded = [f"round({e}, 4) AS {c}" if "_m" in c else f"{e} AS {c}" for c, e in zip(_ALL, columns)]
    return f"WITH {_BOXED} SELECT {', '.join(rounded)} FROM boxed"


def _matrix_sql(a: str, b: str, c: str, d: str, e: str, f: str) -> str:
    return f"'q' || chr(10) || printf('%.6f %.6f %.6f %.6f %.6f %.6f cm', ({a})::DOUBLE, ({b})::DOUBLE, ({c})::DOUBLE, ({d})::DOUBLE, ({e})::DOUBLE, ({f})::DOUBLE) || chr(10) || content || chr(10) || 'Q'"


@query("crop_pages", _boxes_sql({"crop_minx": "media_maxx / 4", "crop_miny": "10 / 2.54 * 7.2", "crop_maxx": "media_maxx / 4 + media_maxx / 2", "crop_maxy": "10 / 2.54 * 7.2 + (media_maxy - 72)"}))
def crop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crop box by an expression on odd pages; the others keep what they have."""
    return _shown(boxes.cropped(boxed(spark, sf_dir), "crop", "PW div 4 10mm PW div 2 PH sub 1in", _odd()))


@query("remove_crop", _boxes_sql({f"crop_{s}": "NULL" for s in boxes.SIDES}))
def remove_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boxes.without_box(boxed(spark, sf_dir), "crop", _odd()))


@query("copy_crop", _boxes_sql({f"media_{s}": f"coalesce(crop_{s}, media_{s})" for s in boxes.SIDES}))
def copy_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crop box, where there is one, as the media box."""
    return _shown(boxes.copied_box(boxed(spark, sf_dir), "crop", "media", _odd()))


@query("rotate_pages", _boxes_sql({"rotation": "180"}))
def rotate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boxes.rotated(boxed(spark, sf_dir), 180, _odd()))


@query("rotate_pages_by", _boxes_sql({"rotation": "(rotation + 270) % 360"}))
def rotate_pages_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boxes.rotated(boxed(spark, sf_dir), -90, _odd(), relative=True))


@query("turn_contents", _boxes_sql({"content": _matrix_sql("0", "1", "-1", "0", "media_maxx / 2 + media_maxy / 2", "media_maxy / 2 - media_maxx / 2")}))
def turn_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boxes.contents_rotated(boxed(spark, sf_dir), 90, _odd()))


@query("flip_across", _boxes_sql({"content": _matrix_sql("-1", "0", "0", "1", "media_maxx", "0")}))
def flip_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boxes.flipped(boxed(spark, sf_dir), True, _odd()))


@query("flip_down", _boxes_sql({"content": _matrix_sql("1", "0", "0", "-1", "0", "media_maxy")}))
def flip_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boxes.flipped(boxed(spark, sf_dir), False, _odd()))


@query("shift_contents", _boxes_sql({"content": _matrix_sql("1", "0", "0", "1", "media_maxx / 2", "72")}))
def shift_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boxes.shifted(boxed(spark, sf_dir), "PW div 2", "1in", _odd()))


@query("shift_all_boxes", _boxes_sql({f"{b}_{s}": f"{b}_{s} + {36 if s.endswith('x') else -10}" for b in ("media", "crop") for s in boxes.SIDES}))
def shift_all_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boxes.boxes_shifted(boxed(spark, sf_dir), "36", "-10", _odd()))


@query("scale_pages", _boxes_sql({"content": _matrix_sql("2", "0", "0", "0.5", "0", "0")} | {f"{b}_{s}": f"{b}_{s} * {2 if s.endswith('x') else 0.5}" for b in ("media", "crop") for s in boxes.SIDES}))
def scale_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boxes.scaled(boxed(spark, sf_dir), F.lit(2.0), F.lit(0.5), _odd()))


@query("stretch_pages", _boxes_sql({"content": _matrix_sql("200 / media_maxx", "0", "0", "300 / media_maxy", "0", "0")} | {f"{b}_{s}": f"{b}_{s} * {200 if s.endswith('x') else 300} / media_max{s[-1]}" for b in ("media", "crop") for s in boxes.SIDES}))
def stretch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boxes.stretched(boxed(spark, sf_dir), "200 300", _odd()))


_FIT = "least(200 / media_maxx, 800 / media_maxy)"


@query("fit_pages", _boxes_sql({"content": _matrix_sql(_FIT, "0", "0", _FIT, f"(200 - media_maxx * {_FIT}) / 2", f"(800 - media_maxy * {_FIT}) / 2"), "media_maxx": "200", "media_maxy": "800"}
    | {f"crop_{s}": f"crop_{s} * {_FIT} + ({'200' if s.endswith('x') else '800'} - media_max{s[-1]} * {_FIT}) / 2" for s in boxes.SIDES}))
def fit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents and boxes scaled to fit a size, in its middle."""
    return _shown(boxes.fitted(boxed(spark, sf_dir), "200 800", _odd()))


@query("centre_pages", _boxes_sql({"media_minx": "media_maxx / 2 - 300", "media_miny": "media_maxy / 2 - 400", "media_maxx": "media_maxx / 2 + 300", "media_maxy": "media_maxy / 2 + 400"}))
def centre_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boxes.centred(boxed(spark, sf_dir), "600 800", _odd()))


@query("scale_contents", _boxes_sql({"content": _matrix_sql("0.5", "0", "0", "0.5", "media_maxx / 4", "media_maxy / 4")}))
def scale_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boxes.contents_scaled(boxed(spark, sf_dir), 0.5, _odd()))


def _upright_sql() -> str:
    """The rotation folded in: content about the centre, boxes as hulls of their image."""
    x, y = "(media_maxx / 2)", "(media_maxy / 2)"
    content = f"CASE rotation WHEN 90 THEN {_matrix_sql('0', '-1', '1', '0', f'{x} - {y}', f'{y} + {x}')} WHEN 180 THEN {_matrix_sql('-1', '0', '0', '-1', 'media_maxx', 'media_maxy')} WHEN 270 THEN {_matrix_sql('0', '1', '-1', '0', f'{x} + {y}', f'{y} - {x}')} ELSE content END"
    changed = {"content": content, "rotation": "0"}
    for b in ("media", "crop"):
        lo, hi = {a: f"{b}_min{a}" for a in "xy"}, {a: f"{b}_max{a}" for a in "xy"}
        changed[f"{b}_minx"] = f"CASE rotation WHEN 90 THEN {x} - {y} + {lo['y']} WHEN 180 THEN media_maxx - {hi['x']} WHEN 270 THEN {x} + {y} - {hi['y']} ELSE {lo['x']} END"
        changed[f"{b}_maxx"] = f"CASE rotation WHEN 90 THEN {x} - {y} + {hi['y']} WHEN 180 THEN media_maxx - {lo['x']} WHEN 270 THEN {x} + {y} - {lo['y']} ELSE {hi['x']} END"
        changed[f"{b}_miny"] = f"CASE rotation WHEN 90 THEN {y} + {x} - {hi['x']} WHEN 180 THEN media_maxy - {hi['y']} WHEN 270 THEN {y} - {x} + {lo['x']} ELSE {lo['y']} END"
        changed[f"{b}_maxy"] = f"CASE rotation WHEN 90 THEN {y} + {x} - {lo['x']} WHEN 180 THEN media_maxy - {lo['y']} WHEN 270 THEN {y} - {x} + {hi['x']} ELSE {hi['y']} END"
    return _boxes_sql(changed)


@query("upright_pages", _upright_sql())
def upright_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(boxes.upright(boxed(spark, sf_dir), _odd()))


@query("two_up_stack", f"""WITH {_BOXED}, s AS (SELECT *, media_maxx AS w, media_maxy AS h, least(media_maxx / media_maxy, media_maxy / 2 / media_maxx) AS s, (pageno - 1) % 2 AS k FROM boxed)
    SELECT doc_id, pageno, CAST((pageno - 1) // 2 + 1 AS INTEGER) AS sheet, round(s, 6) AS scale, round((w + h * s) / 2, 4) AS dx, round((1 - k) * h / 2 + (h / 2 - w * s) / 2, 4) AS dy FROM s""")
def two_up_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages a sheet, each turned by a quarter."""
    made = boxes.stacked(boxed(spark, sf_dir))
    return made.select("doc_id", "pageno", "sheet", F.round("m_b", 6).alias("scale"), F.round("m_e", 4).alias("dx"), F.round("m_f", 4).alias("dy"))


@query("stamp_as_form", f"WITH {PAGES} SELECT doc_id, pageno, CASE WHEN pageno % 2 = 1 THEN 'q' || chr(10) || role || chr(10) || 'Q' || chr(10) || 'q 1 0 0 1 0 0 cm /St' || (SELECT count(*) FROM nation) || ' Do Q' ELSE role END AS content FROM page")
def stamp_as_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stamp as a form that chosen pages draw by name."""
    name = table(spark, sf_dir, "nation").agg(F.concat(F.lit("/St"), F.count("*").cast("string")).alias("form"))
    return content.form_drawn(pages(spark, sf_dir).select("doc_id", "pageno", F.col("role").alias("content")), name, _odd())


# Annotations: parts, six a document on two pages; the second of a page is the popup of the first.

_ANNOT = """annot AS (SELECT p_partkey // 6 AS doc_id, CAST(1 + p_partkey % 6 // 3 AS INTEGER) AS pageno, CAST(p_partkey % 3 + 1 AS INTEGER) AS annot, CASE WHEN p_partkey % 3 = 1 THEN 1 END AS parent,
    CASE p_partkey % 3 WHEN 0 THEN 'Highlight' WHEN 1 THEN 'Popup' ELSE 'Link' END AS subtype, p_name AS contents, p_size::DOUBLE AS minx, (p_partkey % 50)::DOUBLE AS miny, p_size + 10.0::DOUBLE AS maxx, p_partkey % 50 + 5.0::DOUBLE AS maxy FROM part)"""


def annots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = F.col("p_size").cast("double"), (k % 50).cast("double")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 6).cast("long").alias("doc_id"), (F.floor(k % 6 / 3) + 1).cast("int").alias("pageno"), (k % 3 + 1).cast("int").alias("annot"), F.when(k % 3 == 1, 1).alias("parent"),
        F.when(k % 3 == 0, "Highlight").when(k % 3 == 1, "Popup").otherwise("Link").alias("subtype"), F.col("p_name").alias("contents"), x.alias("minx"), y.alias("miny"), (x + 10).alias("maxx"), (y + 5).alias("maxy"),
    )


@query("add_annotation", f"""WITH {_ANNOT} SELECT * FROM annot
    UNION ALL SELECT doc_id, pageno, CAST(max(annot) + 1 AS INTEGER), NULL, 'Text', 'note ' || pageno, 1.0, 2.0, 3.0, 4.0 FROM annot WHERE pageno = 2 GROUP BY doc_id, pageno""")
def add_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotation more on every second page."""
    a = annots(spark, sf_dir)
    chosen = a.where("pageno = 2").select("doc_id", "pageno").distinct()
    return annotations.added(a, chosen, "Text", F.concat(F.lit("note "), F.col("pageno").cast("string")), tuple(F.lit(float(k)) for k in (1, 2, 3, 4)))


@query("remove_annotations_with_popups", f"WITH {_ANNOT}, gone AS (SELECT * FROM annot WHERE subtype = 'Highlight' AND minx > 25) SELECT * FROM annot a WHERE NOT (subtype = 'Highlight' AND minx > 25) AND NOT EXISTS (FROM gone g WHERE g.doc_id = a.doc_id AND g.pageno = a.pageno AND g.annot = a.parent)")
def remove_annotations_with_popups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations taken away, their popups with them."""
    return annotations.removed(annots(spark, sf_dir), (F.col("subtype") == "Highlight") & (F.col("minx") > 25))


def _areas() -> tuple[Column, ...]:
    return F.lit(15.0).alias("a_minx"), F.lit(10.0).alias("a_miny"), F.lit(30.0).alias("a_maxx"), F.lit(30.0).alias("a_maxy")


def _redacted_sql(meets: str) -> str:
    return f"WITH {_ANNOT}, gone AS (SELECT * FROM annot WHERE subtype <> 'Link' AND {meets}) SELECT * FROM annot a WHERE NOT EXISTS (FROM gone g WHERE g.doc_id = a.doc_id AND g.pageno = a.pageno AND (g.annot = a.annot OR g.annot = a.parent))"


_TOUCH = "greatest(minx, 15) < least(maxx, 30) AND greatest(miny, 10) < least(maxy, 30)"


@query("redact_annotations", _redacted_sql(_TOUCH))
def redact_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations that touch an area go, links excepted, popups with their parents."""
    a = annots(spark, sf_dir)
    return annotations.redacted(a, a.select("doc_id", "pageno").distinct().select("*", *_areas()), kinds={"Link": False})


@query("redact_annotations_outside", _redacted_sql("NOT (15 < minx AND 10 < miny AND 30 > maxx AND 30 > maxy)"))
def redact_annotations_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that no area holds inside go."""
    a = annots(spark, sf_dir)
    return annotations.redacted(a, a.select("doc_id", "pageno").distinct().select("*", *_areas()), touching=False, invert=True, kinds={"Link": False})


@query("annotations_round_trip", f"WITH {_ANNOT} SELECT * FROM annot")
def annotations_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations written as JSON and set from it."""
    return annotations.from_json(annotations.as_json(annots(spark, sf_dir)))


# Attachments: documents' texts, four a document, the first of them of the document itself.

_FILES = "file AS (SELECT doc_id // 4 AS doc_id, CAST(doc_id % 4 AS INTEGER) AS page, coalesce(source, '') || '*' || coalesce(lang, '') AS name, text FROM documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("*"), F.coalesce("lang", F.lit("")))
    return table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 4).cast("long").alias("doc_id"), (F.col("doc_id") % 4).cast("int").alias("page"), name.alias("name"), F.col("text").cast("binary").alias("data"))


def _read(df: DataFrame) -> DataFrame:
    return df.withColumn("data", F.col("data").cast("string"))


@query("attach_files", f"WITH {_FILES} SELECT doc_id, page, name, CASE WHEN page = 1 THEN 'new' ELSE text END AS data FROM file UNION ALL SELECT DISTINCT doc_id, 0, 'added', 'new' FROM file")
def attach_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files attached anew: one of a place and name that is taken replaces what is there."""
    f = files(spark, sf_dir)
    data = F.lit("new").cast("binary").alias("data")
    new = f.where("page = 1").select("doc_id", "page", "name", data).unionByName(f.select("doc_id").distinct().select("doc_id", F.lit(0).alias("page"), F.lit("added").alias("name"), data))
    return _read(attachments.attached(f, new))


@query("attachments_round_trip", f"WITH {_FILES} SELECT doc_id, page, name, text AS data FROM file")
def attachments_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments written as JSON and attached from it."""
    return _read(attachments.from_json(attachments.as_json(files(spark, sf_dir))))


@query("remove_attachments", f"WITH {_FILES} SELECT doc_id, page, name FROM file WHERE page = 0")
def remove_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' own attachments, those of pages taken away."""
    return attachments.removed(files(spark, sf_dir), F.col("page") > 0).select("doc_id", "page", "name")


@query("dump_attachments", f"""WITH {_FILES}, s AS (SELECT *, coalesce(nullif(replace(name, '*', ''), ''), 'unnamed') AS safe FROM file), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, safe ORDER BY page, name) AS k FROM s)
    SELECT doc_id, doc_id || '/' || CASE WHEN k > 1 THEN k || '-' ELSE '' END || safe AS path, text AS data FROM n""")
def dump_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(attachments.dumped(files(spark, sf_dir)))


@query("portfolio", f"WITH {_FILES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY name, page) AS INTEGER) AS place, name, strlen(text) AS size, md5(text) AS checksum FROM file")
def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attachments.portfolio(files(spark, sf_dir))


_ACCESS = """d AS (SELECT n_nationkey, n_nationkey % 7 = 0 AS owner, n_nationkey % 4 <> 0 AS encrypted, n_nationkey % 2 = 1 AS no_edit, n_nationkey % 3 = 1 AS no_assemble,
    ['Merge', 'Crop', 'Decrypt', 'CountPages', 'SplitMax'][n_regionkey + 1] AS operation FROM nation)"""


def protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    word = F.when(k % 4 != 0, F.lit(-1) - F.when(k % 2 == 1, 8).otherwise(0) - F.when(k % 3 == 1, 1024).otherwise(0))
    return access.banned(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", (k % 7 == 0).alias("owner"), word.cast("int").alias("permissions")))


@query("operations_allowed", f"""WITH {_ACCESS} SELECT n_nationkey, operation, owner OR NOT CASE operation WHEN 'Decrypt' THEN encrypted WHEN 'Crop' THEN encrypted AND no_edit WHEN 'CountPages' THEN false ELSE encrypted AND no_assemble END AS allowed FROM d""")
def operations_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an operation may run on a document by its permissions and who asks."""
    d = protected(spark, sf_dir)
    wanted = F.array(*[F.lit(o) for o in ("Merge", "Crop", "Decrypt", "CountPages", "SplitMax")])
    return access.allowed(d, d.select("n_nationkey", F.element_at(wanted, (F.col("n_regionkey") + 1).cast("int")).alias("operation")), "n_nationkey")


@query("merges_allowed", "SELECT n_regionkey AS output, bool_and(n_nationkey % 7 = 0 OR n_nationkey % 4 = 0 OR n_nationkey % 3 <> 1) AS allowed FROM nation GROUP BY n_regionkey")
def merges_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.merge_allowed(protected(spark, sf_dir).withColumnRenamed("n_regionkey", "output"))


# The binary form: conversations as files, written and read again.

_FILE_PAGES = f"WITH {PAGES} SELECT doc_id, pageno, CAST(1 + 2 * pageno AS BIGINT) AS objnum, 0.0::DOUBLE AS media_minx, 0.0::DOUBLE AS media_miny, w AS media_maxx, h AS media_maxy, CAST(rotation AS INTEGER) AS rotation, 0 AS annots, text AS content FROM page"


def _as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", "pageno", "w", "h", F.col("rotation").cast("int").alias("rotation"), F.col("text").alias("content"))


@query("file_round_trip", _FILE_PAGES)
def file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation written as a file, and its pages read from that."""
    return binary.pages_of(binary.assembled_pages(_as_pages(spark, sf_dir)), "doc_id")


@query("encrypted_round_trip", _FILE_PAGES)
def encrypted_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through encryption, opened with the owner's password."""
    return binary.pages_of(binary.assembled_pages(_as_pages(spark, sf_dir), user="reader", owner="keeper"), "doc_id", password="keeper")


@query("file_objects", f"""WITH {PAGES} SELECT doc_id, 1::BIGINT AS objnum, '/Catalog' AS kind, -1 AS bytes FROM last UNION ALL SELECT doc_id, 2, '/Pages', -1 FROM last
    UNION ALL SELECT doc_id, 1 + 2 * pageno, '/Page', -1 FROM page UNION ALL SELECT doc_id, 2 + 2 * pageno, 'none', strlen(text) FROM page""")
def file_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of files that were read, put together again and read once more."""
    once = binary.objects_of(binary.assembled_pages(_as_pages(spark, sf_dir)), "doc_id")
    again = binary.objects_of(binary.assembled_objects(once, "doc_id"), "doc_id").where("objnum > 0")
    kind = F.coalesce(F.get_json_object("object", "$['/Type']['N']"), F.lit("none"))
    return again.select("doc_id", "objnum", kind.alias("kind"), F.coalesce(F.octet_length("stream"), F.lit(-1)).alias("bytes"))


@query("png_round_trip", "SELECT doc_id, 'png' AS format, strlen(text) AS probed, CAST(strlen(text) AS INTEGER) AS width, 1 AS height, 1 AS samples, text AS pixels FROM documents WHERE text IS NOT NULL")
def png_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a grey image of one row, written as PNG, its header probed, and read again."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.octet_length("text").alias("w"), F.lit(1).alias("one"), F.col("text").cast("binary").alias("pixels"))
    png = d.select("doc_id", images.as_png("w", "one", "one", "pixels").alias("png"))
    read = png.select("doc_id", images.probe("png").alias("p"), images.from_png("png").alias("i"))
    return read.select("doc_id", "p.format", F.col("p.width").alias("probed"), "i.width", "i.height", "i.samples", F.col("i.pixels").cast("string").alias("pixels"))


@query("draw_pages", f"""WITH {PAGES} SELECT doc_id, pageno, array_to_string(['q', '1 0 0 rg', '0 0 ' || CAST(w AS INTEGER) || ' ' || CAST(h AS INTEGER) || ' re', 'f', 'Q', '10 5 m', '10 7.761424 7.761424 10 5 10 c', '2.238576 10 0 7.761424 0 5 c', '0 2.238576 2.238576 0 5 0 c', '7.761424 0 10 2.238576 10 5 c',
    'BT', '/F1 12 Tf', '(' || regexp_replace(role, '([\\\\()])', '\\\\\\1', 'g') || ') Tj', 'ET', '/P BMC', '0 1 -1 0 ' || CAST(w AS INTEGER) || ' 0 cm', 'EMC'], chr(10)) AS content FROM page""")
def draw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing of each page's own size and words, compiled to operators."""
    w, h = (F.col(c).cast("int").cast("string") for c in "wh")
    program = F.concat(F.lit("push\nfillcol red\nrect 0 0 "), w, F.lit(" "), h, F.lit("\nfill\npop\ncircle 5 5 5\nbt\nfont F1 12\ntext "), F.col("role"), F.lit("\net\ntag P\nmatrix 0 1 -1 0 "), w, F.lit(" 0\nendtag"))
    return pages(spark, sf_dir).select("doc_id", "pageno", content.drawn(program).alias("content"))


# Properties and objects.

_DOCUMENT = "SELECT doc_id, {} FROM documents"


@query("remove_properties", _DOCUMENT.format("CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END AS xmp, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE lang END AS id, n_chars AS pages"))
def remove_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and ids taken from some documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("xmp"), F.col("lang").alias("id"), F.col("n_chars").alias("pages"))
    return metadata.cleared(d, ("xmp", "id"), F.col("doc_id") % 2 == 0)


@query("set_view", _DOCUMENT.format("'TwoPageLeft' AS layout, 'UseOutlines' AS mode, 'UseThumbs' AS after_full_screen, 'de' AS language, '[' || (doc_id % 9 + 1) || ' /Fit]' AS opens_at, '[' || (doc_id % 9 + 1) || ' /XYZ 10 20 null]' AS opens_there"))
def set_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout, modes, language, and where documents open."""
    page = (F.col("doc_id") % 9 + 1).cast("int")
    return table(spark, sf_dir, "documents").select(
        "doc_id", metadata.checked("TwoPageLeft", metadata.PAGE_LAYOUTS).alias("layout"), metadata.checked("UseOutlines", metadata.PAGE_MODES).alias("mode"),
        metadata.checked("UseThumbs", metadata.NON_FULL_SCREEN).alias("after_full_screen"), F.lit("de").alias("language"), metadata.opening(page).alias("opens_at"), metadata.opening(page, "/XYZ 10 20 null").alias("opens_there"),
    )


@query("subformats", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'PDF/A-2b' WHEN doc_id % 3 = 1 THEN 'PDF/UA-1' END AS subformats FROM documents")
def subformats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standards that metadata names."""
    packet = F.when(F.col("doc_id") % 3 == 0, '<x:xmpmeta xmlns:x="x"><a:part xmlns:a="http://www.aiim.org/pdfa/ns/id/">2</a:part><a:conformance xmlns:a="http://www.aiim.org/pdfa/ns/id/">B</a:conformance></x:xmpmeta>').when(
        F.col("doc_id") % 3 == 1, '<x:xmpmeta xmlns:x="x" xmlns:pdfuaid="http://www.aiim.org/pdfua/ns/id/"><pdfuaid:part>1</pdfuaid:part></x:xmpmeta>'
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.array_join(metadata.subformats(packet), ","), F.lit("")).alias("subformats"))


@query("edit_objects", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'null' ELSE '{\"/K\":' || doc_id || '}' END AS object, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'replaced' ELSE text END AS stream FROM documents")
def edit_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects removed, streams emptied and replaced."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('{"/K":'), k.cast("string"), F.lit("}")).alias("object"), F.col("text").cast("binary").alias("stream"))
    made = objects.stream_replaced(objects.stream_emptied(d, k % 3 == 0), k % 3 == 1, F.lit("replaced").cast("binary"))
    return objects.object_removed(made, k % 5 == 0).withColumn("stream", F.col("stream").cast("string"))


@query("replace_groups", "SELECT p_type, p_brand AS name, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_brand) AS INTEGER) AS place FROM (SELECT DISTINCT p_type, p_brand FROM part)")
def replace_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional content groups and their order set from JSON."""
    given = table(spark, sf_dir, "part").groupBy("p_type").agg(F.to_json(F.struct(F.array_sort(F.collect_set("p_brand")).alias("order"))).alias("json"))
    return objects.groups_of(given, "p_type", "json").select("p_type", "name", "place")


@query("labels_of_json", f"""WITH {PAGES} SELECT doc_id, pageno, CASE WHEN pageno >= 3 THEN 'B-' || (pageno + 5) ELSE CAST(pageno AS VARCHAR) END AS label FROM page""")
def labels_of_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page labels set from a JSON list of ranges."""
    from quire.operators import pages as page_ops

    p = pages(spark, sf_dir)
    given = p.select("doc_id").distinct().withColumn("json", F.lit('[{"startpage":3,"style":"D","prefix":"B-","startvalue":8}]'))
    return page_ops.labelled(p, page_ops.label_ranges_of(given, "json")).select("doc_id", "pageno", "label")


@query("redact_range", f"WITH {PAGES} SELECT doc_id, pageno, CASE WHEN pageno BETWEEN 2 AND 3 THEN '' ELSE text END AS content, CASE WHEN pageno BETWEEN 2 AND 3 THEN 0 ELSE annots END AS annots FROM page")
def redact_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a range emptied."""
    p = ranges.member(pages(spark, sf_dir).withColumn("content", F.col("text")), "2-3")
    return content.emptied(p, F.col("in_range")).select("doc_id", "pageno", "content", "annots")
