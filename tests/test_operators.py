import pytest
from pyspark.sql import functions as F

from quire.functions import geometry, text
from quire.operators import content, metadata, objects, pages, reports
from quire.sources import document_json
from quire.streaming import windows


def test_operators_read_tokens():
    stream = "q 1 0 0 1 5 5 cm % a comment\n/F1 12 Tf (a\\)b(c)) Tj [(x) -250 <41>] TJ << /A 1 >> BDC Q"
    assert list(content.operators(stream)) == [
        ("q", []), ("cm", ["1", "0", "0", "1", "5", "5"]), ("Tf", ["/F1", "12"]), ("Tj", ["(a\\)b(c))"]), ("TJ", ["[ (x) -250 <41> ]"]), ("BDC", ["<< /A 1 >>"]), ("Q", []),
    ]
    assert list(content.operators(None)) == [] and list(content.operators("")) == []


def test_strings_round_trip():
    for s in ("", "a(b)c", "back\\slash", "((("):
        assert content.unquoted(content.quoted(s)) == s
    assert content.unquoted("(\\101\\n\\\n)") == "A\n"


def test_interpreter_nests_forms_and_states():
    forms = {"/Fm": "1 0 0 1 100 0 cm BT (in) Tj ET /Inner Do", "/Inner": "1 0 0 1 100 0 cm BT (more) Tj ET /Fm Do /Inner Do"}
    shown = content.Interpreter(forms=forms).run("q 2 0 0 2 0 0 cm /Fm Do Q BT 1 0 0 1 7 8 Tm (out) Tj ET Q Q /Fm Do")
    assert [s[1] for s in shown] == ["in", "more", "out", "in", "more"]  # a form that is being drawn does not begin again
    assert shown[0][2] == 200 and shown[1][2] == 400 and shown[2][2:4] == (7, 8) and shown[4][2] == 200


def test_rewrites_keep_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "1 w 0.2 w /S BMC q BMC EMC Q EMC 3 w")], "doc_id long, content string")
    thin = {r[0]: r[1] for r in content.rewritten(df, content.thinned(1)).collect()}
    assert thin == {1: None, 2: "", 3: "1 w\n1 w\n/S BMC\nq\nBMC\nEMC\nQ\nEMC\n3 w"}
    assert {r[0]: r[1] for r in content.without_stamps(df, "/S").collect()}[3] == "1 w\n0.2 w\n3 w"


def test_dictionaries(spark):
    df = spark.createDataFrame([(1, '{"a":{"k":1},"k":[{"k":2}]}'), (2, None), (3, "not json"), (4, '{"b":1}')], "id long, o string")
    assert sorted(r["value"] for r in objects.entries(df, "o", "k").collect()) == ["1", "2", '[{"k":2}]']
    assert {r[0]: r[1] for r in objects.removed(df, "o", "k", 1).collect()} == {1: '{"a":{},"k":[{"k":2}]}', 2: None, 3: "not json", 4: '{"b":1}'}
    assert {r[0]: r[1] for r in objects.replaced(df, "o", "k", 9, 2).collect()}[1] == '{"a":{"k":1},"k":[{"k":9}]}'


def test_typesetting_holds_words(spark):
    df = spark.createDataFrame([(1, "aa bb cc\nlongerthanten x"), (2, None)], "doc_id long, t string")
    got = [(r.doc_id, r.pageno, r.line, r.text) for r in pages.pages_fitted(df, "t", 5, 2).orderBy("doc_id", "pageno", "line").collect()]
    assert got == [(1, 1, 1, "aa bb"), (1, 1, 2, "cc"), (1, 2, 1, "longe"), (1, 2, 2, "rthan"), (1, 3, 1, "ten x"), (2, 1, 1, "")]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2, "k"), (2, 3, "k"), (3, 1, "k"), (3, 9, "p"), (7, 8, "k")], "src long, dst long, via string")
    got = reports.closure(edges, spark.createDataFrame([(1,)], "node long"), F.col("via") == "p")
    assert {(r.node, r.depth) for r in got.collect()} == {(1, 0), (2, 1), (3, 2)}


def test_agreed_counts_the_missing(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, None), (3, None)], "g int, v string")
    assert {r[0]: r[1] for r in df.groupBy("g").agg(reports.agreed("v")).collect()} == {1: "a", 2: "various", 3: None}


def test_expressions():
    for bad in ("1 add", "add 1", "nonsense", "1 ; 2"):
        with pytest.raises(ValueError):
            geometry.numbers(bad)
    with pytest.raises(ValueError):
        metadata.checked("Sideways", metadata.PAGE_MODES)
    with pytest.raises(ValueError):
        metadata.set_preference(F.lit(None), "Dance", True)


def test_trims_whole_characters(spark):
    df = spark.createDataFrame([("aé€z",), ("",)], "t string")
    for width, expected in ((1, "a"), (2, "a"), (3, "aé"), (5, "aé"), (6, "aé€"), (9, "aé€z")):
        assert df.select(text.utf8_trimmed(F.col("t"), width)).first()[0] == expected


def test_documents_as_json(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, '{"/N":{"N":"/a"}}'), (1, 1, "7")], "doc_id long, objnum long, object string")
    whole = document_json.written(df).first()["json"]
    assert whole == '[[1,7],[2,{"/N":{"N":"/a"}}]]'
    (tmp_path / "d.json").write_text(whole)
    back = document_json.read(spark, str(tmp_path))
    assert {(r.objnum, r.object) for r in back.collect()} == {(1, "7"), (2, '{"/N":{"N":"/a"}}')}


def test_stream_counts_as_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.counted(stream, late="1000 days").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    order = lambda df: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert order(spark.table("counted")) == order(windows.counted(events))
