import random
import time

import numpy as np
import pytest

from quire.llm import minhash, queries
from quire.llm.graph import components


def brute(rows, words, percent=80):
    """(n_shingles, component_id) of (id, text) rows by comparing all pairs."""
    sets = [set(minhash.shingle_set(t, words).tolist()) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                parent[y] = x
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets))


def got(df):
    return sorted((r[0], r[1], r[2]) for r in df.collect())


def test_shingles_are_as_agreed():
    one = lambda t, w=2: len(minhash.shingle_set(t, w))
    assert [one(t) for t in (None, "", " \n", "a", "a b", "A b a B", "a\x0bb\x0cc", "a\xa0b")] == [0, 0, 0, 1, 1, 2, 2, 1]
    assert one("a b c", 5) == 1
    assert (minhash.shingle_set("ÀB c", 2) != minhash.shingle_set("àb c", 2)).all()  # only A-Z are lowered
    assert (minhash.shingle_set("AB c", 2) == minhash.shingle_set("ab C", 2)).all()


def family(seed, copies, words=120, changed=3):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(words)]
    made = []
    for _ in range(copies):
        text = list(base)
        for _ in range(r.randint(0, changed)):
            text[r.randrange(words)] = f"x{r.randint(0, 10**6)}"
        made.append(" ".join(text))
    return made


EDGES = [None, "", "   ", "one", "ONE", "one two", "two one", "a " * 30_000, "a " * 29_000, "b"]


def test_whole_job_on_a_hard_table(docs):
    texts = EDGES + [t for k in range(6) for t in family(k, 8)] + family(99, 60, 60, 4)
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    for words in (2, 5):
        assert got(minhash.near_duplicates(docs(rows), words=words)) == brute(rows, words)


def test_hot_groups_in_small_regions_and_blocks(docs):
    rows = list(enumerate(family(5, 70, 60, 5) + family(6, 30, 60, 5)))
    assert got(minhash.near_duplicates(docs(rows), words=2, region=16, block=600)) == brute(rows, 2)


def templated(n):
    """Pages of one template (Jaccard similarity 0.6 to each other) in pairs of 0.802."""
    base = " ".join(f"t{i}" for i in range(150))
    page = lambda p, k: " ".join([base, *(f"p{p}s{i}" for i in range(28)), *(f"p{p}k{k}u{i}" for i in range(22))])
    return [(2 * p + k, page(p, k)) for p in range(n // 2) for k in (0, 1)]


@pytest.mark.parametrize(("n", "region"), [(5_000, 64), (20_000, minhash.REGION)])
def test_pairs_in_a_dense_region(spark, n, region):
    """Thousands of distinct sets share regions that are cut; pairs just above the threshold are found, in linear time."""
    began = time.time()
    table = spark.createDataFrame(templated(n), "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(table, words=1, region=region).collect()}
    assert sum(found[i] == i - i % 2 for i in range(n)) >= 0.999 * n
    assert time.time() - began < 150


def test_exact_links_like_all_pairs():
    rng = np.random.default_rng(5)
    for trial in range(60):
        base = [rng.choice(60, rng.integers(1, 30), replace=False) for _ in range(4)]
        sets = [np.unique(np.concatenate((b[rng.random(len(b)) < 0.95], rng.choice(60, rng.integers(0, 3), replace=False), b[:1]))).astype(np.uint64) for b in base for _ in range(6)]
        left = rng.random(len(sets)) < 0.5 if trial % 2 else np.ones(len(sets), bool)
        parent = list(range(len(sets)))
        find = lambda x: x if parent[x] == x else find(parent[x])  # noqa: E731, B023
        for a in range(len(sets)):
            for b in range(a):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if (left[a] or left[b]) and 100 * len(x & y) >= 80 * len(x | y):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
        ids = np.arange(len(sets)) * 10
        got_links = dict(minhash.exact_links(ids, sets, 80, left))
        assert [got_links.get(int(i), int(i)) for i in ids] == [10 * find(k) for k in range(len(sets))]


def test_regions_cut_by_partitions(spark):
    """Large and small regions over many partitions: what shares a deep region is one candidate component."""
    rows = [(0, k1, k2, *[i * 37 % 251 - 125, i, -i, i * i], i) for i, (k1, k2) in enumerate([(5, 5)] * 400 + [(5, 6)] * 3 + [(7, 1)] * 2)]
    table = spark.createDataFrame(rows, minhash._ROW_TYPES)
    for parts in (1, 7, 60):
        sorted_rows = table.repartitionByRange(parts, "tree", "k1", "k2", "id").sortWithinPartitions("tree", "k1", "k2", "id")
        found = minhash._linked_regions(sorted_rows, 64, 8, True).cache()
        found = found.union(minhash._linked_edges(found, 64, 8, True))
        links = found.where("kind = 0").selectExpr("id as a", "other as b").distinct()
        assert {r.component for r in components(links).where("node < 400").collect()} == {0}
        dense = minhash._linked_regions(sorted_rows, 64, 8, False).cache()
        dense = dense.union(minhash._linked_edges(dense, 64, 8, False))
        assert {r.id for r in dense.where("kind = 2").collect()} == set(range(403))


def test_null_and_repeated_ids(docs):
    rows = [(None, "a b c"), (3, "a b c"), (3, "a b c"), (2, "z y x"), (3, "z y x"), (9, "q")]
    result = minhash.near_duplicates(docs(rows), words=2)
    assert sorted(map(tuple, result.collect())) == [(2, 2, 2), (3, 2, 2), (3, 2, 2), (3, 2, 2), (9, 1, 9)]


def test_empty_table(docs):
    assert minhash.near_duplicates(docs([])).collect() == []


def test_op1_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    result = queries.op1_minhash(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in result) == brute(rows, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in result)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 100), (7, 7)]
    for block in (500_000, 12, 3):  # one block; several contracted blocks; alternating stars
        result = components(spark.createDataFrame(edges, "a long, b long").repartition(3), block).collect()
        assert {r.node: r.component for r in result} == {i: 1 for i in range(1, 41)} | {90: 90, 100: 90} and len(result) == 42


def test_components_like_union_find(spark):
    rng = np.random.default_rng(9)
    pairs = rng.integers(0, 400, (260, 2))
    expected = dict(zip(range(400), range(400)))
    for _ in range(400):
        for x, y in pairs.tolist():
            expected[x] = expected[y] = min(expected[x], expected[y])
    table = spark.createDataFrame(pairs.tolist(), "a long, b long")
    for block in (500_000, 40):
        found = {r.node: r.component for r in components(table, block).collect()}
        assert found == {n: expected[n] for n in set(pairs[pairs[:, 0] != pairs[:, 1]].ravel().tolist())}
    assert components(table.limit(0)).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
    b = np.concatenate((a[:1600], np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert (minhash.signature(a) == minhash.signature(b)).mean() == pytest.approx(true, abs=0.12)
