"""Reports over documents and their objects: aggregates, shares, usage and what is missing."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.durable import cut, discard, stored

#: Rows that a join broadcasts at most (some 16 MB); more are shuffled.
FEW = 250_000

#: Tables of rounds that are read side by side; more are put together.
PARTS = 24


def agreed(column: str) -> Column:
    """An aggregate: the value all rows share, or "various"; a missing value counts as one."""
    shown = F.coalesce(F.col(column).cast("string"), F.lit("<none>"))
    return F.when(F.min(shown) == F.max(shown), F.min(F.col(column).cast("string"))).otherwise("various")


def composition(objects: DataFrame, category: Column, size: Column, total: DataFrame, by: str, categories: list[str]) -> DataFrame:
    """Bytes and share of each category of a file, every category in its place, and what no category claims.

    ``total``: by, file_size.  Percentages are of the file's size, null where that is 0.
    """
    claimed = objects.select(by, category.alias("category"), size.alias("size")).groupBy(by, "category").agg(F.sum("size").alias("bytes"))
    order = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("category")) for i, c in enumerate([*categories, "Unclassified"])])).alias("c")
    grid = total.select(by, "file_size", order).select(by, "file_size", "c.place", "c.category")
    filled = grid.join(claimed, [by, "category"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    rest = F.col("file_size") - F.sum("bytes").over(Window.partitionBy(by))
    final = filled.withColumn("bytes", F.when(F.col("category") == "Unclassified", rest).otherwise(F.col("bytes")))
    return final.select(by, "place", "category", "bytes", F.round(100.0 * F.col("bytes") / F.nullif("file_size", F.lit(0)), 3).alias("percent"))


def usage(uses: DataFrame, thing: str, page: str, *firsts: str) -> DataFrame:
    """One row a thing, with the sorted set of pages that use it (as text) and other columns of its first use."""
    pages = F.array_sort(F.collect_set(page))
    return uses.groupBy(thing).agg(F.array_join(pages.cast("array<string>"), " ").alias("pages"), F.min(page).alias("first_page"), *[F.min_by(c, page).alias(c) for c in firsts])


def low_resolution(images: DataFrame, pixels_x: Column, pixels_y: Column, width: Column, height: Column, threshold: float) -> DataFrame:
    """Image uses whose resolution, pixels over inches as placed, is below a threshold either way."""
    rated = images.withColumn("xdpi", pixels_x * 72 / F.nullif(width, F.lit(0))).withColumn("ydpi", pixels_y * 72 / F.nullif(height, F.lit(0)))
    return rated.where((F.col("xdpi") < threshold) | (F.col("ydpi") < threshold))


def missing(things: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Things without a counterpart, such as fonts without an embedded program."""
    return things.join(present.select(key).distinct(), key, "left_anti")


def _few(df: DataFrame, n: int) -> DataFrame:
    """One side of a join, of n rows at most.  Many are merged: Spark goes by the bytes of compressed files, and a driver can't hold the rows that fit in a few MB of those."""
    return F.broadcast(df) if n <= FEW else df.hint("merge")


def _unseen(reached: DataFrame, n: int, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``reached`` (n of them, distinct) whose keys ``found`` lacks; null keys are equal.  Where they are few, ``found`` is read but not shuffled."""

    def equal(a: DataFrame, b: DataFrame) -> Column:
        return functools.reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys])

    if n <= FEW:
        sought = reached.select(*keys)
        found = found.join(F.broadcast(sought), equal(found, sought), "left_semi").select(*keys)
    found = _few(found, n)
    return reached.join(found, equal(reached, found), "left_anti")


def _until_empty(first: DataFrame, step: Callable[[DataFrame, int, int], DataFrame], keys: list[str] | None = None) -> DataFrame:
    """``first`` and what ``step`` (of the newest rows, how many they are at most, and the round) adds, until it adds nothing.

    With ``keys`` those rows of a step are passed over that are equal to earlier
    ones in them.  What a round adds is a table in the shared folder, so joins know
    its size; no round leaves shuffle files or partitions, and the driver keeps the
    paths of ``PARTS`` tables at most.  The last tables stay, as the result reads them.
    """
    spark, columns = first.sparkSession, first.columns

    def table(*paths: str) -> DataFrame:
        return spark.read.schema(first.schema).parquet(*paths)

    parts, n = [stored(first)], 0
    size = table(*parts).count()
    while size:
        n += 1
        made = stored(step(table(parts[-1]), size, n).select(*columns))
        size = table(made).count()
        if keys and size:
            made, reached = stored(_unseen(table(made), size, table(*parts), keys)), made
            discard(spark, reached)
            size = 0 if table(made).isEmpty() else size
        if size and len(parts) == PARTS:
            whole = stored(table(*parts))
            discard(spark, *parts)
            parts = [whole]
        if size:
            parts.append(made)
        else:
            discard(spark, made)
    return table(*parts)


def closure(edges: DataFrame, roots: DataFrame, skip: Column | None = None) -> DataFrame:
    """(node, depth): what is reachable from roots (node) over edges (src, dst), and in how many steps.

    Edges that ``skip`` holds for are not followed.  Each round joins only what
    the last one found; cycles end because a node is found once.
    """
    spark, chosen = edges.sparkSession, (edges.where(~skip) if skip is not None else edges).select("src", "dst")
    at = stored(chosen)
    followed = spark.read.schema(chosen.schema).parquet(at)

    def step(newest: DataFrame, size: int, _: int) -> DataFrame:
        deeper = (F.col("depth") + 1).alias("depth")  # the round's number would be compiled anew each round, and the driver keeps compiled code
        return followed.join(_few(newest, size), followed["src"] == newest["node"]).select(F.col("dst").alias("node"), deeper).distinct()

    first = roots.select(F.col("node").cast(chosen.schema["dst"].dataType)).distinct().withColumn("depth", F.lit(0))
    found = _until_empty(first, step, ["node"])
    discard(spark, at)
    return found


def closure_values(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(root, value): the distinct values of all nodes that a node with values reaches over edges (src, dst), its own included.

    ``values``: node, value; null is a value.  Values go from each node to those
    that refer to it and are kept once, so there are never as many rows as pairs of
    nodes that reach each other.  A node without values passes on those of others
    and is a root too if some reach it.
    """
    spark, chosen = edges.sparkSession, edges.select("src", "dst").distinct()
    at = stored(chosen)
    followed = spark.read.schema(chosen.schema).parquet(at)

    def step(newest: DataFrame, size: int, _: int) -> DataFrame:
        return followed.join(_few(newest, size), followed["dst"] == newest["root"]).select(F.col("src").alias("root"), "value").distinct()

    first = values.select(F.col("node").cast(chosen.schema["src"].dataType).alias("root"), "value").distinct()
    found = _until_empty(first, step, ["root", "value"])
    discard(spark, at)
    return found


def duplicates(objects: DataFrame, key: str, content: str) -> DataFrame:
    """Groups of equal contents, told by their SHA-256: the first key, how many there are, and the bytes that keeping one saves."""
    digested = objects.select(F.col(key), F.sha2(content, 256).alias("digest"), F.octet_length(content).alias("size"))
    groups = digested.groupBy("digest").agg(F.min(key).alias("kept"), F.count("*").alias("copies"), F.max("size").alias("size"))
    return groups.where("copies > 1").select("kept", "copies", ((F.col("copies") - 1) * F.col("size")).alias("saved"))


def remapped(refs: DataFrame, objects: DataFrame, key: str, content: str, column: str) -> DataFrame:
    """``refs`` with references to equal contents turned to the first of each."""
    digested = objects.select(F.col(key), F.sha2(content, 256).alias("digest"))
    kept = digested.groupBy("digest").agg(F.min(key).alias("kept"))
    mapping = digested.join(kept, "digest").where(F.col(key) != F.col("kept")).select(F.col(key).alias(column), "kept")
    return refs.join(mapping, column, "left").withColumn(column, F.coalesce("kept", column)).drop("kept")


def text_width(texts: DataFrame, key: str, text: str, widths: DataFrame, size: float, default: int) -> DataFrame:
    """Each text's width at a font size, from a table (char, width) of thousandths; characters not in it have the default.

    The table is that of one font: one row to join, so no text is shuffled.  An
    empty or null text has no row.
    """
    table = widths.agg(F.map_from_entries(F.collect_list(F.struct("char", "width"))).alias("table"))
    units = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda a, c: a + F.when(c == "", 0).otherwise(F.coalesce(F.try_element_at("table", c), F.lit(default))))
    wide = texts.where(F.length(text) > 0).join(F.broadcast(table), how="cross")
    return wide.select(key, F.round(units * size / 1000, 3).alias("width"))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(node, depth, path) of a forest (node, parent, ord); path orders nodes as a listing does, roots have a null parent."""
    width = max(6, nodes.agg(F.max(F.length(F.col("ord").cast("string")))).first()[0] or 0)  # of the longest, as lpad cuts
    steps = cut(nodes.select("node", "parent", F.lpad(F.col("ord").cast("string"), width, "0").alias("step")))

    def below(newest: DataFrame, _: int, n: int) -> DataFrame:
        above = newest.select(F.col("node").alias("parent"), F.col("path").alias("above"))
        return above.join(steps, "parent").select("node", F.lit(n).alias("depth"), F.concat("above", F.lit("/"), "step").alias("path"))

    return _until_empty(steps.where("parent is null").select("node", F.lit(0).alias("depth"), F.col("step").alias("path")), below)


def drawn_tree(nodes: DataFrame, label: str) -> DataFrame:
    """(node, path, line): a forest (node, parent, ord, label) as a listing with lines between parents and children, in the order of path.

    A node's line has for each ancestor a bar if that one has later brothers, then its own corner.
    """
    paths = tree_paths(nodes)
    last = F.lead("node").over(Window.partitionBy("parent").orderBy("ord")).isNull()
    placed = cut(nodes.select("node", "parent", F.when(F.col("parent").isNull(), F.lit(None)).otherwise(last).alias("last"), F.col(label).alias("label")))
    roots = placed.where("parent is null").select("node", F.lit("").alias("lead"), F.col("label").alias("line"))

    def below(newest: DataFrame, _: int, n: int) -> DataFrame:
        above = newest.select(F.col("node").alias("parent"), F.col("lead").alias("above"))
        made = above.join(placed, "parent")
        corner, lead = F.when(F.col("last"), "\u2514\u2500\u2500 ").otherwise("\u251c\u2500\u2500 "), F.when(F.col("last"), "    ").otherwise("\u2502   ")
        return made.select("node", F.concat("above", lead).alias("lead"), F.concat("above", corner, "label").alias("line"))

    return _until_empty(roots, below).select("node", "line").join(paths.select("node", "path"), "node")


def with_scripts(markup: str) -> Column:
    """Whether markup holds a script, as an element or as an address."""
    return F.contains(F.col(markup), F.lit("<script")) | F.contains(F.col(markup), F.lit("javascript:"))


def distinct_names(things: DataFrame, name: str, chosen: Column) -> DataFrame:
    """The names that some things have, such as those of separation colours, each once."""
    return things.where(chosen).select(F.col(name).alias("name")).distinct()


def signed(fields: DataFrame, chosen: Column, signers: DataFrame, key: str, *shown: str) -> DataFrame:
    """The fields that are signed, with who (key, name) each value refers to."""
    return fields.where(chosen).join(signers, key).select(*shown)
