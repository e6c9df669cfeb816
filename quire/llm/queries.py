"""The training-data operators bound to the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, learn, maxscore, minhash, pii, quality, substring, token_table, toxicity, warc

#: The vocabulary file of the queries; the operators take any path.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over 2-word shingles at 0.8."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as counts and digests."""
    coded = bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE, ["doc_id"], decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), F.round("question_overlap", 6).alias("question_overlap"), F.round("answer_overlap", 6).alias("answer_overlap"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; labels of the documents with remainder 1 are never learnt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = learn.sample_of(table(spark, sf_dir, "labels"), "doc_id", "toxic", 3, 1, toxicity.SAMPLE)
    scored = toxicity.score(docs, toxicity.fit(docs, sample))
    return scored.select("doc_id", F.coalesce(learn.remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every revisit of the archive of all pages stood for."""
    resolved = warc.resolve(warc.records_of(table(spark, sf_dir, "pages")))
    shown = F.expr("array_join(array_sort(transform(map_entries(headers), e -> concat(e.key, ': ', e.value))), '; ')")
    return resolved.select("record_id", "canonical_url", "response_id", "outcome", shown.alias("headers"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; labels of the documents with remainder 0 are never learnt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = learn.sample_of(table(spark, sf_dir, "labels"), "doc_id", "quality", 5, 0, quality.SAMPLE)
    scored = quality.score(docs, quality.fit(docs, sample))
    return scored.select("doc_id", F.coalesce(learn.remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token table of every document, written and read back."""
    return token_table.round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans of every document."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[pii.count(kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.as_text(kinds=pii.BASE), 256).alias("base_sha256"),
        pii.as_text().alias("spans"),
    )


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for each vector whose id is divisible by 50."""
    vectors = maxscore.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return maxscore.top_k(vectors.where(F.col("key") % 50 == 0), vectors, 5)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that stand earlier."""
    kept = substring.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_bpe": op2_bpe,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_quality": op6_quality,
    "op7_token_table": op7_token_table,
    "op8_pii": op8_pii,
    "op9_maxscore": op9_maxscore,
    "op10_substring": op10_substring,
}

SQL: dict[str, str] = {
    "op1_minhash": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
        c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op5_warc_revisits": r"""
        WITH page AS (
            SELECT page_id, url, md5(coalesce(html, '')) AS h, length(coalesce(html, '')) AS size, regexp_replace(url, '#.*$', '') AS bare FROM pages),
        record AS (
            SELECT 2 * page_id AS record_id, url, 60 * page_id AS date, true AS f, '"' || h[1:16] || '"' AS etag, 'day ' || h[17:18] AS modified, CAST(size AS VARCHAR) AS size, page_id FROM page
            UNION ALL
            SELECT 2 * page_id + 1, bare || CASE WHEN contains(bare, '?') THEN '&utm_medium=crawl' ELSE '?utm_medium=crawl' END, 60 * page_id + 3600, false,
                CASE WHEN page_id % 7 = 0 THEN '"other"' WHEN page_id % 5 <> 0 THEN '"' || h[1:16] || '"' END, 'day ' || h[17:18], '0', page_id FROM page),
        cut AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM record),
        canon AS (
            SELECT *, nullif(
                regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
                || regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/index\.(html|htm|php)$', '/'), '/+$', '')
                || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'),
                    lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|ref|fbclid|gclid|sessionid|sid)(=|$)'))), '&'), ''), ''), '') AS canonical_url FROM cut),
        latest AS (
            SELECT v.record_id, v.canonical_url, v.etag, v.modified, v.page_id,
                (SELECT max({'date': r.date, 'id': r.record_id}) FROM canon r WHERE r.f AND r.canonical_url = v.canonical_url AND r.date < v.date).id AS response_id
            FROM canon v WHERE NOT v.f),
        joined AS (
            SELECT l.*, r.etag AS r_etag, r.size,
                CASE WHEN l.response_id IS NULL THEN 'missing'
                     WHEN l.etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN l.etag = r.etag THEN 'resolved' ELSE 'mismatch' END
                     WHEN l.modified IS NOT NULL AND r.modified IS NOT NULL THEN CASE WHEN l.modified = r.modified THEN 'resolved' ELSE 'mismatch' END
                     ELSE 'unvalidated' END AS outcome
            FROM latest l LEFT JOIN canon r ON r.f AND r.record_id = l.response_id)
        SELECT record_id, canonical_url, response_id, outcome,
            CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=120; content-length: ' || size || '; content-type: text/html; etag: ' || r_etag || '; x-served-by: cache-' || (page_id % 9) END AS headers
        FROM joined""",
    "op10_substring": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        v AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d)),
        f AS (SELECT k, min({'d': doc_id, 'i': i}) AS m FROM v GROUP BY k),
        g AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS p FROM v JOIN f USING (k) WHERE m.d <> doc_id OR m.i <> i),
        t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS body, count(*) AS n FROM t ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_maxscore": """
        WITH v AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.row AS query, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_dot_product(q.v, c.v), 0) AS BIGINT) AS score
            FROM v q JOIN v c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
}
