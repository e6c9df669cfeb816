import time

import duckdb
import numpy as np

from quire.llm import decontaminate, maxscore, queries
from quire.llm.decontaminate import Index, words_of
from tests.llm.helpers import compare_sql


def test_top_k_like_sorting(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 0.3, (300, 12))
    base[50:60] = base[49]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(300, None), (301, [float("nan")] * 12), (302, [None] * 12), (None, [1.0] * 12), (303, [float("inf")] * 12), (304, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    vectors = maxscore.quantised(table, "vec_id", "embedding")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in maxscore.top_k(vectors.where("key % 7 = 0"), vectors, 5, shard=64, block=16).collect())
    q = np.floor(256 * base).astype(np.int64)
    expected = []
    for i in range(0, 300, 7):
        scores = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:5]
        expected += [(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    assert got == expected


def test_few_or_no_candidates(spark):
    table = spark.createDataFrame([(0, [1.0]), (7, [2.0])], "vec_id long, embedding array<double>")
    v = maxscore.quantised(table, "vec_id", "embedding")
    assert [(r.query_id, r.rank, r.vec_id) for r in maxscore.top_k(v.where("key = 0"), v, 5).collect()] == [(0, 1, 7)]
    assert maxscore.top_k(v.where("key = 0"), v.where("key = 0"), 5).collect() == []
    assert maxscore.top_k(v.where("key = 1"), v, 5).collect() == []


def test_shard_is_exact_with_large_values():
    rng = np.random.default_rng(5)
    vectors, queries_ = rng.integers(-(2**30), 2**30, (200, 6)), rng.integers(-(2**30), 2**30, (5, 6))
    q, r, s = maxscore.search_shard(np.arange(200), vectors, queries_, 3, probe=2)
    for k in range(5):
        full = [int(sum(int(a) * int(b) for a, b in zip(queries_[k], v))) for v in vectors]
        assert s[q == k].tolist() == sorted(full, reverse=True)[:3]


def test_repeated_ids_and_empty_vectors(spark, tmp_path):
    """Each row is a query and a candidate of its own, whatever its id; against the SQL too."""
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, -1.0]), (50, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [5.0, 5.0]), (100, []), (7, []), (100, []), (150, None), (200, [float("nan"), 1.0]), (3, [0.5]), (250, [2.0])] + [(9, [0.25, 0.25])] * 4
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = maxscore.quantised(table, "vec_id", "embedding")
    usable = [(k, np.floor(256 * np.array(v)).astype(int)) for k, v in rows if v is not None and np.isfinite(v).all()]
    expected = []
    for i, (k, v) in enumerate(usable):
        if k % 50 == 0:
            scores = sorted((-int(v @ w), j) for n, (j, w) in enumerate(usable) if n != i and len(w) == len(v))[:5]
            expected += [(k, n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    for block, together in ((16, 1 << 20), (2, 1)):
        got = maxscore.top_k(vectors.where("key % 50 = 0"), vectors, 5, shard=4, block=block, together=together)
        assert sorted(map(tuple, got.collect())) == sorted(expected)
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    sql = queries.SQL["op9_maxscore"].replace("embeddings", f"read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert sorted(duckdb.sql(sql).fetchall()) == sorted(expected)


def test_floors_are_carried():
    rng = np.random.default_rng(7)
    vectors, queries_ = rng.integers(-300, 300, (90, 5)), rng.integers(-300, 300, (4, 5))
    floors, kept = maxscore.Floors(4, 3, None), 0
    for cut in (0, 30, 60):
        q, r, s = maxscore.search_shard(np.arange(cut, cut + 30), vectors[cut : cut + 30], queries_, 3, floors(), probe=2)
        floors.raised(q, s)
        kept += len(q)
    assert (floors.best == -np.sort(-(queries_ @ vectors.T), axis=1)[:, :3]).all() and kept < 36


def test_op9_query(spark, sf_dir):
    compare_sql(spark, sf_dir, "op9_maxscore")


ITEMS = [(1, "Who wrote the first long book about rivers and boats? It was written by old captain Arno Veld."), (2, "Question: what is two plus two times seven minus one?\nAnswer: it is the number fifteen"), (3, ""), (4, None), (None, "nothing here at all"), (5, "short one")]


def test_what_documents_hold(docs, spark):
    items = spark.createDataFrame([(*i, 3) for i in ITEMS], "item_id long, text string, doc_id int")
    filler = " ".join(f"word{i}" for i in range(400))
    texts = [
        None, "", filler, f"{filler} {ITEMS[0][1]} {filler}", f"{ITEMS[0][1].upper()} {filler}", f"{filler} {ITEMS[1][1]}", "short one", "Who wrote the first long book about rivers and boats?",
        f"{filler} short {filler} one", f"{ITEMS[0][1]} {ITEMS[1][1]}", (filler + " ") * 40 + ITEMS[0][1],
    ]
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(list(enumerate(texts))), items).collect())
    assert got == [(3, 1), (4, 1), (5, 2), (6, 5), (9, 1), (9, 2), (10, 1)]
    kept = decontaminate.clean(docs(list(enumerate(texts))), items)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 7, 8] and "tag" in kept.columns
    whole = sorted(map(tuple, decontaminate.contaminated(docs(list(enumerate(texts))), items).collect()))
    small = sorted(map(tuple, decontaminate.contaminated(docs(list(enumerate(texts))), items, index_bytes=60).collect()))
    assert [r[:2] for r in small] == got
    assert np.allclose(np.array(small)[:, 2:], np.array(whole)[:, 2:])  # scores do not hang on how many indexes there are
    assert sorted(r.doc_id for r in decontaminate.clean(docs(list(enumerate(texts))), items, index_bytes=60).collect()) == [0, 1, 2, 7, 8]


def test_long_runs_of_signs(docs, spark):
    began = time.time()
    assert decontaminate.normal("a" + "#" * 1_000_000 + "b##") == "a" + "#" * 1_000_000 + "b" and decontaminate.normal("#" * 1_000_000) == ""
    assert time.time() - began < 1
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [r.item_id for r in decontaminate.contaminated(docs([(1, "x" + "#" * 1_000_000 + "y " + ITEMS[0][1])]), items).collect()] == [1]


def test_empty_tables(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs([(1, "a b c")]), none).collect() == []
    assert decontaminate.clean(docs([(1, "a b c")]), none).count() == 1
    assert decontaminate.contaminated(docs([]), spark.createDataFrame(ITEMS[:2], "item_id long, text string")).collect() == []


def test_wand_retrieves_all_above(monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    rng = np.random.default_rng(6)
    items = [(i, " ".join(f"t{int(x)}" for x in rng.zipf(1.5, 12) % 60) + ". a b") for i in range(80)]
    index = Index(items)
    for _ in range(60):
        terms = rng.choice(len(index.terms), 15, replace=False).tolist()
        full = {}
        for t in terms:
            for item, x in zip(index.items[t], index.impacts[t]):
                full[item] = full.get(item, 0) + x
        for least in (0.1, 0.3, 0.6):
            got = index.retrieve(terms, least)
            assert sorted(i for i, _ in got) == sorted(i for i, s in full.items() if s >= least - 1e-12)


def test_op3_query(spark, sf_dir):
    """Against all pairs of documents and items by their word 5-grams."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [(r.item_id, decontaminate.grams(words_of(r.text))) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    expected = set()
    for d in docs:
        words = words_of(d.text)
        held = {n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} for n in range(1, 6)}
        expected |= {(d.doc_id, i) for i, g in items if g and len(g & held[len(next(iter(g)))]) >= 0.8 * len(g)}
    got = queries.op3_decontaminate(spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected)
