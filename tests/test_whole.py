"""Queries over hard tables, and operators at sizes that the test tables do not have."""

import zlib

from pyspark.sql import functions as F

from quire.operators import content, reports
from quire.plans import content_queries, registry


def test_letter_labels_of_every_part(spark, tmp_path):
    spark.range(0, 1001).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_partkey: r.label for r in registry.QUERIES["letter_labels"](spark, str(tmp_path)).collect()}
    assert got == {n: "abcdefghijklmnopqrstuvwxyz"[(n - 1) % 26] * ((n - 1) // 26 + 1) for n in range(1, 1001)} | {0: ""}


def test_streams_of_hard_turns(spark, tmp_path):
    texts = ["a (b) c", "(((", ")x( y\\", "back\\slash \\101 \\\n end", "é€ 漢字 😀", "1 0 0 1 cm BT % [x] << /A >> Q", " lead", "one", "", "long (\\) " * 20_000]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.doc_id: r.shown for r in registry.QUERIES["extract_text"](spark, str(tmp_path)).collect()}
    assert got == {i: t + "xystamp" for i, t in enumerate(texts)}
    framed = registry.QUERIES["frame_content"](spark, str(tmp_path))
    assert {r.doc_id: r.n for r in content.parsed(framed).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {i: len(content_queries.TEMPLATE) + 4 + 2 * t.count(" ") for i, t in enumerate(texts)}


def test_compress_streams_of_every_text(spark, tmp_path):
    texts = {1: None, 2: "", 3: "a", 4: "(é)\\\n" * 3, 5: "short text", 6: "ab" * 2000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.restored, r.bounded) for r in registry.QUERIES["compress_streams"](spark, str(tmp_path)).collect()}
    assert got == {k: (t, None if t is None else True) for k, t in texts.items()}
    raw = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select("doc_id", content.deflated(F.col("text").cast("binary")).alias("packed"))
    sizes = {k: None if t is None else min(len(zlib.compress(t.encode())), len(t.encode())) + 1 for k, t in texts.items()}
    assert {r.doc_id: None if r.packed is None else len(r.packed) for r in raw.collect()} == sizes


def test_tree_paths_keep_long_steps(spark):
    rows = [(1, None, 1), (2, None, 200_000), (10, 1, 999_999), (11, 1, 3_000_000), (12, 1, 3_000_001), (13, 1, 3_000_002)]
    got = {r.node: r.path for r in reports.tree_paths(spark.createDataFrame(rows, "node long, parent long, ord long")).collect()}
    assert len(set(got.values())) == len(rows) and sorted(got, key=got.get) == [1, 10, 11, 12, 13, 2]


def test_closures_beyond_two_hundred_steps(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(230)] + [(230, 5)], "src long, dst long")
    got = {r.node: r.depth for r in reports.closure(chain, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {i: i for i in range(231)}


def test_brackets_and_forms_nest_to_any_depth():
    assert [a for _, a in content.operators("((a(b(c(d)))e)) Tj (never")] == [["((a(b(c(d)))e))"]]
    forms = {f"/F{i}": f"/F{i + 1} Do" for i in range(40)} | {"/F40": "(deep) Tj /F3 Do"}
    assert [x[1] for x in content.Interpreter(forms=forms).run("/F0 Do")] == ["deep"]


def test_drawn_tree(spark):
    rows = [(1, None, 1, "a"), (2, 1, 1, "b"), (3, 1, 2, "c"), (4, 2, 1, "d"), (5, 3, 1, "e"), (6, None, 2, "f")]
    made = reports.drawn_tree(spark.createDataFrame(rows, "node long, parent long, ord long, name string"), "name").orderBy("path").collect()
    assert [r.line for r in made] == ["a", "\u251c\u2500\u2500 b", "\u2502   \u2514\u2500\u2500 d", "\u2514\u2500\u2500 c", "    \u2514\u2500\u2500 e", "f"]


def test_closures_leave_few_partitions(spark, monkeypatch):
    monkeypatch.setattr(reports, "PARTS", 3)
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(9, 5), (4, None), (None, 3)], "src long, dst long")
    for few in (0, 250_000):  # by a shuffle and by a broadcast
        monkeypatch.setattr(reports, "FEW", few)
        found = reports.closure(chain, spark.createDataFrame([(0,)], "node int"))
        assert {r.node: r.depth for r in found.collect()} == {i: i for i in range(10)} | {None: 5}
        assert len(found.inputFiles()) <= 3 * 4 + 4  # no table of its own for every round


def test_pages_are_interpreted_in_blocks(spark, monkeypatch):
    blocks = []

    def batch(n):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "content": ["(a) Tj (b) Tj /Im Do"] * n})

    made = content._objects(None, False)
    for kept, held in content._blocks(iter([batch(50_000), batch(1)]), made):
        assert kept.num_rows == len(held)
        blocks.append(sum(map(len, held)))
    assert sum(blocks) == 150_003 and max(blocks) < content.BLOCK + 3


def test_pages_with_one_key_stay_apart(spark):
    pages = spark.createDataFrame([(1, 1, "(a) Tj"), (1, 1, "(b) Tj /Im Do"), (2, 1, None), (3, 1, "")], "doc_id long, pageno int, content string")
    assert sorted((r.doc_id, r.shown) for r in content.extracted(pages).collect()) == [(1, "a"), (1, "b"), (2, ""), (3, "")]
    first = '{"seq":1,"kind":"text","text":"b","x":0.0,"y":0.0,"size":0.0,"font":"","depth":0}'
    got = sorted((r.doc_id, r.json) for r in content.as_json(pages.where("content <> '(a) Tj'"), kinds=("text",)).collect())
    assert got == [(1, f"[{first}]"), (3, "[]")]
    assert "Exchange" not in content.extracted(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in content.as_json(pages)._jdf.queryExecution().executedPlan().toString()


def test_redacted_streams_made_after_the_join(spark):
    pages = spark.createDataFrame([(1, 1, "ab"), (2, 1, "cd")], "doc_id long, pageno int, text string")
    areas = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 9.0)], "doc_id long, pageno int, minx double, miny double, maxx double, maxy double")
    stream = F.concat(F.lit("/F 10 Tf ("), "text", F.lit(") Tj"))
    late = content.redacted(pages, areas, made_of=stream)
    early = content.redacted(pages.withColumn("content", stream), areas)
    assert {r.doc_id: r.content for r in late.collect()} == {r.doc_id: r.content for r in early.collect()} == {1: "/F 10 Tf\n[ -500 (b) ] TJ", 2: "/F 10 Tf (cd) Tj"}


def test_values_of_all_that_is_reached(spark, monkeypatch):
    edges = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (2, 1), (2, 3), (1, 2), (8, 9)], "src long, dst long")
    values = spark.createDataFrame([(0, "a"), (1, "a"), (2, None), (3, "b"), (3, "c"), (4, "a"), (9, "z")], "node long, value string")
    below = {"a", None, "b", "c"}
    for few in (0, 250_000):
        monkeypatch.setattr(reports, "FEW", few)
        got = [tuple(r) for r in reports.closure_values(edges, values).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(n, v) for n in (0, 1, 2) for v in below} | {(3, "b"), (3, "c"), (4, "a"), (8, "z"), (9, "z")}


def test_closures_of_many_rows_broadcast_nothing(spark, tmp_path, monkeypatch):
    """Spark would broadcast these files for their size; at 6 GB they pass for 8 MB, but the driver can't hold their 7 million rows."""
    spark.range(0, 12).select(F.col("id").alias("p_partkey"), F.concat(F.lit("b"), F.col("id") % 7).alias("p_brand")).write.parquet(str(tmp_path / "part.parquet"))
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    stored = reports.stored
    monkeypatch.setattr(reports, "stored", noted)
    monkeypatch.setattr(reports, "FEW", 0)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) == 10 << 20
    for name in ("nested_fonts", "dead_objects"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
