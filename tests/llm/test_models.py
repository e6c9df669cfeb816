import random
import time
import zlib

import numpy as np
import pytest

from quire.llm import learn, quality, queries, toxicity


def held_out(doc_id, modulus, r):
    return zlib.crc32(str(doc_id).encode()) % modulus == r


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    ones = label == 1
    n1, n0 = ones.sum(), (~ones).sum()
    return (order[ones].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


# of some 270 labelled rows the toxicity model is cautious; README has its figures on larger tables
@pytest.mark.parametrize(("name", "label", "modulus", "r", "cut", "recall"), [("op4_toxicity", "toxic", 3, 1, 0.7, 0.6), ("op6_quality", "quality", 5, 0, 0.3, 0.95)])
def test_queries_learn(spark, name, label, modulus, r, cut, recall):
    sf_dir = "/root/testdata/sf0.01"
    got = {x.doc_id: x for x in queries.QUERIES[name](spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = [(got[x.doc_id], x[label]) for x in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    assert all(g.held_out == held_out(g.doc_id, modulus, r) and 0 <= g.score <= 1 and g.predicted == int(g.score >= cut) for g, _ in rows)
    score, truth = (np.array([v for (g, t) in rows if g.held_out for v in [f(g, t)]]) for f in (lambda g, t: g.score, lambda g, t: t))
    assert auc(score, truth) > 0.85
    predicted, truth = score >= cut, truth == 1
    assert (predicted & truth).sum() >= 0.95 * predicted.sum() and (predicted & truth).sum() >= recall * truth.sum()


LABELS = "doc_id long, toxic int, quality int"


def corpus(n=400):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{r.randint(0, 300)}" for _ in range(r.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            words[2:2] = ["you", "dreadful", "grunkel"]
        text = " ".join(words)
        rows.append((i, text if i % 3 else text.upper() + "!!!"))
        labels.append((i, int(bad), int(i % 3 != 0)))
    return rows, labels


HARD = [(1000, None), (1001, ""), (1002, "  \n"), (1003, "grunkel " * 20_000), (1004, "you grunkel dreadful w1"), (1004, "you grunkel dreadful w1"), (None, "w1 w2 w3")]


def test_toxicity_of_hard_texts(spark, docs):
    rows, labels = corpus()
    table = spark.createDataFrame([*labels, (0, None, None), (None, 1, 1), (4, 1, 1)], LABELS)
    sample = learn.sample_of(table, "doc_id", "toxic", 3, 1, 10_000)
    assert all(not held_out(r.key, 3, 1) for r in sample.collect())
    all_docs = docs(rows + HARD)
    model = toxicity.fit(all_docs, sample)
    got = toxicity.score(all_docs, model).collect()
    assert len(got) == len(rows) + len(HARD) and {"tag", "spans", "component"} <= set(toxicity.score(all_docs, model).columns)
    by = {r.doc_id: r.score for r in got}
    assert by[1004] > 0.7 > 0.3 > by[1] and by[1000] == by[1001] == by[1002]
    assert all(0 <= r.score <= 1 for r in got)


def test_lexicon_keeps_every_labelled_row(spark):
    passage = " ".join(f"p{i}" for i in range(400))
    toxic = [(i, f"{passage} {' '.join(f't{i}x{j}' for j in range(400))} grunkel", 1, i % 5) for i in range(60)]
    clean = [(100 + i, f"{passage} {' '.join(f'c{i}x{j}' for j in range(400))}", 0, i % 5) for i in range(60)]
    copies = [(200 + i, f"{passage} copied zzbad", 1, i % 5) for i in range(20)] + [(300, f"{passage} copied zzbad", 0, 1)]
    hidden = [(400, None, 0, 1), (401, "", 0, 2), (401, "", 0, 2)]
    sample = spark.createDataFrame(toxic + clean + copies + hidden, "key long, text string, label int, fold int")
    rows = toxicity.weighed(sample).collect()
    assert sorted((r.text or "", r.label) for r in rows) == sorted((t or "", x) for _, t, x, _ in toxic + clean + copies + hidden)
    assert sorted((r.label, r.fold, r.copies) for r in rows if "zzbad" in (r.text or "")) == [(0, 0, 1)] + [(1, 0, 20)] * 20
    assert {r.copies for r in rows if not r.text} == {3} and all(r.copies == 1 for r in rows if r.text and "zzbad" not in r.text)
    lexicon = toxicity.learn_lexicons(toxicity.weighed(sample))[toxicity.FOLDS]
    assert "=grunkel" in lexicon and "=zzbad" not in lexicon  # sixty texts of one passage; one text of twenty copies


def test_quality_of_hard_texts(spark, docs):
    rows, labels = corpus()
    sample = learn.sample_of(spark.createDataFrame(labels, LABELS), "doc_id", "quality", 5, 0, 10_000)
    all_docs = docs(rows + HARD)
    model = quality.fit(all_docs, sample)
    assert model.rules and len(model.explained()) == len(model.rules)
    got = quality.score(all_docs, model).collect()
    assert len(got) == len(rows) + len(HARD)
    by = {r.doc_id: r.score for r in got}
    assert by[1] > 0.7 and by[3] < 0.3 and by[1000] == by[1001] == by[1002]


def test_long_runs_of_signs():
    began = time.time()
    found = quality.statistics("#" * 1_000_000 + "x ok !! ?!? a##b## ##")
    assert time.time() - began < 1 and found[quality.STATISTICS.index("tail_rate")] == 3 / 6


def test_column_is_the_model(spark):
    """The compiled column against the rules in numpy, row by row, on values at the thresholds too."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, len(quality.STATISTICS))), 1)
    rules = tuple((tuple((int(f), bool(g), float(np.round(t, 1))) for f, g, t in zip(rng.integers(0, x.shape[1], 2), rng.integers(0, 2, 2), rng.normal(size=2))), float(w)) for w in rng.normal(size=30))
    model = quality.Model(0.3, rules)
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *(f"q_{s}" for s in quality.STATISTICS)])
    got = np.array([r.s for r in table.select("i", model.column().alias("s")).orderBy("i").collect()])
    total = 0.3 + quality._holding([r for r, _ in rules], x) @ np.array([w for _, w in rules])
    assert np.allclose(got, 1 / (1 + np.exp(-total)))


def test_one_row_of_a_key_is_learnt_from(spark):
    rows = spark.createDataFrame([(1, f"t{i % 7}", 1) for i in range(500)] + [(2, None, 0), (2, "x", 0)], "key long, text string, label int").repartition(5)
    once, again = (sorted(map(tuple, learn.one_a_key(d).collect()), key=str) for d in (rows, rows.orderBy("text")))
    assert once == again and [r[0] for r in once] == [1, 2]


def test_without_labels_and_rows(spark, docs):
    none = learn.sample_of(spark.createDataFrame([], LABELS), "doc_id", "toxic", 3, 1, 10)
    one_kind = learn.sample_of(spark.createDataFrame([(i, 0, 1) for i in range(50)], LABELS), "doc_id", "toxic", 3, 1, 10)
    assert one_kind.count() == 10
    table = docs([(i, f"a b {i}") for i in range(50)])
    for sample in (none, one_kind):
        for module in (toxicity, quality):
            model = module.fit(table, sample)
            assert module.score(docs([]), model).count() == 0
            assert len({round(r.score, 9) for r in module.score(table, model).collect()}) == 1


def test_isotonic_never_falls():
    rng = np.random.default_rng(1)
    score = rng.normal(size=500)
    label = (rng.random(500) < 1 / (1 + np.exp(-2 * score))).astype(float)
    curve = learn.isotonic(score, label)
    made = learn.calibrated(curve, np.linspace(-4, 4, 200))
    assert (np.diff(made) >= 0).all() and 0 <= made.min() and made.max() <= 1


def test_rules_are_the_trees_paths():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) & (x[:, 2] < 0.5)).astype(float)
    model = learn.boosted(x, y, rounds=20, depth=2)
    assert ((learn.raw_scores(model, x) > 0) == (y == 1)).mean() > 0.97
    intercept, weights = learn.lasso_logistic(quality._holding([p for t in model[1] for p in t.paths()], x), y, 0.002)
    assert 0 < (weights != 0).sum() < len(weights)
