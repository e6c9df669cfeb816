from quire.llm import queries
from tests.test_queries import compare


def compare_sql(spark, sf_dir, name):
    compare(spark, sf_dir, queries.QUERIES[name], queries.SQL[name])
