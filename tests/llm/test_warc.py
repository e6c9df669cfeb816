import pytest
from pyspark.sql import functions as F

from quire.llm import warc
from tests.llm.helpers import compare_sql

SCHEMA = "record_id long, url string, date long, type string, etag string, last_modified string, headers map<string,string>, canonical_url string, outcome int"


@pytest.mark.parametrize(("url", "expected"), [
    ("http://WWW.A.com:80/x/index.html?b=2&utm_source=z&a=1#f", "a.com/x?a=1&b=2"), ("https://a.com/", "a.com"), ("a.com?ref=1", "a.com"), ("", None), (None, None), ("https://m.a.com/x/?q=", "m.a.com/x?q="),
])
def test_canonical(spark, url, expected):
    assert spark.createDataFrame([(url,)], "url string").select(warc.canonical()).first()[0] == expected


def run(spark, rows, stretch=10):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {r.record_id: (r.response_id, r.outcome, r.headers) for r in warc.resolve(table, stretch).collect()}


def test_latest_earlier_response(spark):
    h = {"content-length": "9", "etag": "a", "old": "1"}
    rows = [
        (1, "http://a.com/x", 5, "response", "a", "m", h), (2, "http://a.com/x/", 25, "response", "b", None, None), (3, "https://a.com/x", 7, "revisit", "a", None, {"content-length": "0", "new": "2", "old": "3"}),
        (4, "http://a.com/x", 25, "revisit", "a", None, None), (5, "http://a.com/x", 26, "revisit", "a", None, None), (6, "http://a.com/x", 30, "revisit", None, None, None), (7, "http://b.com", 30, "revisit", "a", None, None),
        (8, "http://a.com/x", 9, "revisit", None, "m", None), (9, None, 9, "revisit", "a", None, None), (10, "http://a.com/x", None, "revisit", "a", None, None), (11, "http://a.com/x", 5, "revisit", "a", None, None), (12, "http://a.com/x", 50, "metadata", "a", None, None),
    ]
    got = run(spark, rows)
    assert got[3] == (1, "resolved", {"content-length": "9", "etag": "a", "new": "2", "old": "3"})
    assert got[4][:2] == (1, "resolved") and got[5][:2] == (2, "mismatch") and got[6][:2] == (2, "unvalidated") and got[7][:2] == (None, "missing")
    assert got[8][:2] == (1, "resolved") and got[9][1] == got[10][1] == got[11][1] == "missing" and 12 not in got


def test_one_hot_url_over_stretches(spark):
    rows = [(i, "http://hot.com", 3 * i, "response" if i % 17 == 0 else "revisit", f"e{i // 17 * 17}", None, None) for i in range(400)]
    rows += [(1000, "http://hot.com", 6, "response", "tie", None, None), (1001, "http://hot.com", 6, "response", "tie", None, None)]
    got = run(spark, rows, 20)
    for i in range(1, 400):
        if i % 17:
            before = [(d, n) for n, _, d, kind, *_ in rows if kind == "response" and d < 3 * i]
            assert got[i][0] == max(before)[1]


def test_empty_and_repeated(spark):
    assert run(spark, []) == {}
    table = spark.createDataFrame([(1, "http://a.b", 5, "revisit", "a", None, None, "x", 1)] * 2, SCHEMA)
    assert warc.resolve(table).count() == 2


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.com/x", None), (3, "http://a.com/x", "y" * 100_000)], "page_id long, url string, html string")
    rows = warc.resolve(warc.records_of(pages)).select("record_id", "outcome", F.col("headers")["content-length"].alias("n")).collect()
    # by then the third page is the latest at that address, for both
    assert {r.record_id: (r.outcome, r.n) for r in rows} == {3: ("missing", None), 5: ("mismatch", None), 7: ("resolved", "100000")}


def test_op5_query(spark, sf_dir):
    compare_sql(spark, sf_dir, "op5_warc_revisits")
