"""A corpus pipeline of training-data operators: documents in, token ids out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
that its predecessor kept, and its decisions take effect.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, learn, minhash, pii, toxicity
from quire.llm.common import written
from quire.llm.queries import WORD_BPE, table

#: Score from which a document is rejected as toxic.
TOXIC = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below :data:`TOXIC`, by a model of the labelled ones."""
    sample = learn.sample_of(table(spark, sf_dir, "labels"), "doc_id", "toxic", 3, 1, toxicity.SAMPLE)
    scored = toxicity.score(docs, toxicity.fit(docs, sample), to="toxicity_score")
    return scored.where(F.col("toxicity_score") < TOXIC).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate component over 5-word shingles at 0.8.

    Rows that share a doc_id are one node: all of them stay or all go.  Rows without one stay.
    """
    found = minhash.near_duplicates(docs, words=5, percent=80)
    dropped = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars counts what is left."""
    redacted = pii.find(docs, spans="pii_spans").withColumn("text", pii.redacted(spans="pii_spans"))
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number and the decoded text of every document."""
    coded = bpe.encode(docs, WORD_BPE, ["doc_id", "lang", "source", "n_chars"], decode=True)
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
