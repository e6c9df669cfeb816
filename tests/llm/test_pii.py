import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from quire.llm import pii, queries

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


HARD = [
    None, "", "4111 1111 1111 1111 x é 4111-1111-1111-1111", "a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8 0001.0255.00.9 256.1.1.1 99999999999999999999.1.1.1", "9" * 30_000, "a" * 40_000,
    "1 " * 15_000, "x@" * 3_000, "+1 (456) 555-2186 +12345678901234567 +1 2", "😀😀 me@x.yz 😀 10.0.0.1", "0" * 14, "00000000000000 +0 000000000",
]


def test_base_spans_like_brute_force(docs):
    r = random.Random(5)
    texts = HARD + ["".join(r.choice("ab@.@..+-_% 0123456789()  é😀\n") for _ in range(r.randint(0, 90))) for _ in range(800)] + ["".join(r.choice("0123456789 - ..+14") for _ in range(r.randint(0, 60))) for _ in range(800)]
    rows = pii.find(docs(list(enumerate(texts)))).select("doc_id", pii.as_text(kinds=pii.BASE).alias("b"), "tag", "score").collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.b == brute(texts[row.doc_id]), texts[row.doc_id]
        assert (row.tag, row.score) == ("x", 0.5)


def test_many_matches_in_one_text(docs):
    """50,000 matches of base kinds and 20,000 others; work must not grow with their square."""
    r = random.Random(6)
    one = lambda i: r.choice([f"user{i}@mail{i}.example.org ", f"10.{i % 256}.0.{i % 250} ", "4111 1111 1111 1111, ", f"+1 555 {1000000 + i} "])
    text = "".join(one(i) for i in range(50_000)) + "my ssn 123-45-6789; " * 20_000
    began = time.time()
    row = pii.find(docs([(0, text), (1, "x@y.zz")])).select("doc_id", pii.as_text(kinds=pii.BASE).alias("b"), F.size("spans").alias("n"), F.length(pii.redacted()).alias("left")).where("doc_id = 0").first()
    assert time.time() - began < 60
    assert row.b == brute(text) and row.n == 20_000 + row.b.count(",") + 1 and row.left < len(text)


def test_others_never_overlap_base_spans(docs):
    texts = ["ssn 123-45-6789@x.org", "ssn a@b.c-123-45-6789", "ssn 123-45-6789 a@b.cd", "iban DE89370400440532013000@x.org 4111111111111111", "é" * 300 + " ssn 123-45-6789 " + "é" * 300 + " a@b.cd"]
    rows = {r.doc_id: r.s for r in pii.find(docs(list(enumerate(texts)))).select("doc_id", pii.as_text().alias("s")).collect()}
    assert rows == {0: "email:4:21", 1: "email:4:21", 2: "ssn:4:15,email:16:22", 3: "email:5:33,card:34:50", 4: "ssn:305:316,email:618:624"}


def test_checksums_and_context(docs):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "IBAN DE88 3704 0044 0532 0130 00 ok", "GB82WEST12345698765432", "my ssn 123-45-6789.", "it is 123-45-6789.", "my ssn 000-45-6789"]
    rows = {r.doc_id: (r.s, r.t) for r in pii.find(docs(list(enumerate(texts)))).select("doc_id", pii.as_text().alias("s"), pii.redacted().alias("t")).collect()}
    assert rows[0] == ("iban:5:32", "IBAN [IBAN] ok")
    assert rows[1][0] == "" and rows[2][0] == "iban:0:22"
    assert rows[3] == ("ssn:7:18", "my ssn [SSN].") and rows[4] == ("", texts[4]) and rows[5][0] == ""


def test_context_raises_scores(docs):
    rows = pii.find(docs([(0, "card 4111111111111111"), (1, "4111111111111111")])).select("doc_id", F.col("spans")[0]["score"].alias("s")).collect()
    assert {r.doc_id: round(r.s, 6) for r in rows} == {0: 1.0, 1: 0.7}


def test_redaction(docs):
    rows = {r.doc_id: r.t for r in pii.find(docs([(0, "é a@b.c, 1.2.3.4"), (1, None), (2, ""), (3, "+1.2.3.4567890 x")])).select("doc_id", pii.redacted().alias("t")).collect()}
    assert rows == {0: "é [EMAIL], [IP]", 1: None, 2: "", 3: "[PHONE] x"}


def test_empty_table_and_plan(docs):
    assert pii.find(docs([])).collect() == []
    plan = pii.find(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_op8_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op8_pii(spark, sf_dir).collect():
        expected = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
        assert set(filter(None, expected.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(rf"\b{k}:", expected)) for k in pii.BASE]
