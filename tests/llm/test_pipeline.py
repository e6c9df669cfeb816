"""Every stage on its own input, against plain versions."""

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import decontaminate, learn, minhash, toxicity
from tests.llm.test_minhash import brute as components
from tests.llm.test_pii import brute as spans

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """The smallest tables with nulls, empty and long texts, repeated rows and more columns among the documents."""
    d = str(tmp_path_factory.mktemp("tables"))
    small = "/root/testdata/sf0.001"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    more = [
        (9001, None, "en", None, None), (9002, "", None, "s", 0), (9003, " \n ", "en", "s", 3), (9004, "word " * 30_000, "en", "s", 150_000), (9005, f"before that {item} after it", "en", "s", 1), (9006, first.text, "en", "s", 1),
        (9007, "mail me@here.org now", "en", "s", 20), (9007, "mail me@here.org now", "en", "s", 20), (None, "no key but words", "en", "s", 16),
    ]
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(f"{d}/documents.parquet")
    return d


def docs_of(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def shown(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_toxicity(spark, hard):
    docs = docs_of(spark, hard)
    model = toxicity.fit(docs, learn.sample_of(spark.read.parquet(f"{hard}/labels.parquet"), "doc_id", "toxic", 3, 1, toxicity.SAMPLE))
    rows = docs.collect()
    scores = model([r.text or "" for r in rows])
    kept = STAGES["toxicity"](spark, docs, hard)
    assert kept.columns == docs.columns
    assert shown(kept) == sorted((tuple(r) for r, s in zip(rows, scores) if s < corpus_pipeline.TOXIC), key=repr)


def test_near_dedup(spark, hard):
    docs = docs_of(spark, hard)
    kept = STAGES["near_dedup"](spark, docs, hard)
    rows = docs.collect()
    dropped = {i for i, _, c in components([(r.doc_id, r.text) for r in rows if r.doc_id is not None], 5) if c != i}
    assert 9006 in dropped and kept.columns == docs.columns
    assert shown(kept) == sorted((tuple(r) for r in rows if r.doc_id not in dropped), key=repr)


def test_decontamination(spark, hard):
    docs = docs_of(spark, hard)
    items = [g for r in spark.read.parquet(f"{hard}/benchmark.parquet").collect() if (g := decontaminate.grams(decontaminate.words_of(r.text)))]
    expected = []
    for r in docs.collect():
        words = decontaminate.words_of(r.text)
        held = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        if not any(len(g & held) >= 0.8 * len(g) for g in items):
            expected.append(tuple(r))
    kept = STAGES["decontamination"](spark, docs, hard)
    assert kept.columns == docs.columns and shown(kept) == sorted(expected, key=repr)
    assert 9005 not in {r.doc_id for r in kept.collect()}


def test_pii(spark, hard):
    docs = docs_of(spark, hard)
    made = STAGES["pii"](spark, docs, hard)
    assert made.columns == docs.columns and made.count() == docs.count()
    before = {(r.doc_id, r.text) for r in docs.collect()}
    by_id = {i: t for i, t in before}
    for r in made.collect():
        found = spans(by_id[r.doc_id])
        assert (r.text == by_id[r.doc_id]) == (found == "") and r.n_chars == (None if r.text is None else len(r.text))
        assert spans(r.text) == ""


def test_bpe(spark, hard):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = docs_of(spark, hard)
    made = STAGES["bpe"](spark, docs, hard).collect()
    assert len(made) == docs.count()
    by_id = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in made:
        ids = library.encode(by_id[r.doc_id], add_special_tokens=False).ids
        assert (list(r.ids), r.n_tokens, r.decoded) == (ids, len(ids), library.decode(ids, skip_special_tokens=False))


def test_run_is_the_stages_in_a_row(spark, hard):
    docs = docs_of(spark, hard)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, hard)
    assert sorted((repr(r.doc_id), r.n_tokens) for r in corpus_pipeline.run(spark, hard).collect()) == sorted((repr(r.doc_id), r.n_tokens) for r in docs.collect())


def test_empty_documents(spark, hard, tmp_path):
    docs = docs_of(spark, hard).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, hard)
        assert docs.count() == 0
