"""Every query with SQL against DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from quire.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return Counter(tuple(show(row[i]) for i in order) for row in values)


def compare(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    expected = connected(sf_dir).sql(sql)
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, sf_dir, name):
    compare(spark, sf_dir, registry.QUERIES[name], registry.SQL[name])


def test_entry_is_stable(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "pos", "pageno", "label", "role", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
