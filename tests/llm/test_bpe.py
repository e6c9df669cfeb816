import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quire.llm import bpe, queries, token_table

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    None, "", "  \n\t", "aaaa aaa aaaaaaaaaaa hehehe ananan", "Hello<|endoftext|>World <|startoftext|>", "ΟΔΟΣ İstanbul ǅ ﬁ Å é", "a\x1cb\x1fc \x85x\xa0y　z w",
    "don't I'M we'll 123 ½ x2y", "日本語 emoji 😀😀 !!!???", "<|endoftext", "ß ẞ K Ω Σ", "x" * 30_000, "﻿abc ​ zz", "word " * 20_000, "\x00\x01 \x02",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_like_the_library(docs, library):
    random.seed(3)
    noise = ["".join(random.choice("abehnrstTHE '.,<|>!é你́ \n") for _ in range(random.randint(0, 200))) for _ in range(300)]
    texts = [*HARD, *noise, noise[0], noise[0]]
    got = {r.doc_id: r for r in bpe.encode(docs(list(enumerate(texts))), PATH, ["doc_id", "tag"], decode=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].tag == "x", t
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_small_memory_gives_the_same(docs, library, monkeypatch):
    monkeypatch.setattr(bpe, "GENERATION", 3)
    monkeypatch.setattr(bpe, "LEARNT", 2)
    memory = bpe.Remembered(bpe.vocabulary(PATH))
    for words in (["the", "of", "a"], ["b", "the", "zzzz"], ["the", "q", "of", "b"]):
        for word, raw in zip(words, memory.coded(words)):
            ids = np.frombuffer(raw, "<u4").tolist()
            shown = memory.bpe.decode_lists(pa.array([ids], pa.list_(pa.int32()))).to_pylist()
            assert ids == library.encode(word, add_special_tokens=False).ids and shown == [library.decode(ids, skip_special_tokens=False)]


def test_decode(spark, library):
    df = spark.createDataFrame([(1, [320, 49407, 70000]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, PATH, ["doc_id"]).collect()}
    assert got == {1: library.decode([320, 49407], skip_special_tokens=False), 2: "", 3: ""}


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.WordBpe(public_tokenizers.path("byte_bpe_50k.json"))


def test_empty_table(docs):
    assert bpe.encode(docs([]), PATH, ["doc_id"]).count() == 0
    assert token_table.round_trip(docs([]), PATH).count() == 0


def test_every_code_point(library):
    """Alone, doubled, within letters, before and after marks."""
    spaces = set("\t\n\x0b\x0c\r ")
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and chr(c) not in spaces]
    word = bpe.vocabulary(PATH)
    for form in (lambda c: f"{c}{c}", lambda c: f"a{c}b", lambda c: f"a{c}\u0301", lambda c: f"1\u0334\u0301{c}\u0316"):
        for k in range(0, len(points), 200_000):
            texts = list(map(form, points[k : k + 200_000]))
            for t, ids, e in zip(texts, word.encode_pieces(texts), library.encode_batch(texts, add_special_tokens=False)):
                assert np.frombuffer(ids, "<u4").tolist() == e.ids, ascii(t)


def test_blocks_without_words(docs, library):
    for texts in ([""], [None, " \n"], ["<|endoftext|>"], ["", "<|endoftext|><|endoftext|>"]):
        got = {r.doc_id: list(r.ids) for r in bpe.encode(docs(list(enumerate(texts))).coalesce(1), PATH, ["doc_id"], decode=True).collect()}
        assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_memory_is_bounded_in_bytes(library, monkeypatch):
    monkeypatch.setattr(bpe, "GENERATION", 50)
    memory = bpe.Remembered(bpe.vocabulary(PATH))
    for k in range(8):
        pieces = [f"p{k}x{i}" for i in range(40)] + ["long" * 100_000, "é" * 60, "w1"]
        for p, ids in zip(pieces, memory.coded(pieces)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(p, add_special_tokens=False).ids
        assert len(memory.ids) <= 50 and len(memory.older) <= 50
        assert all(len(p) <= bpe.LONGEST for p in [*memory.ids, *memory.older])


def test_memory_of_a_block_of_new_pieces(library):
    numbers = np.random.default_rng(5).integers(0, 26**7, 1_000_000)
    letters = (numbers[:, None] // 26 ** np.arange(7) % 26 + 97).astype(np.uint8)
    raw = np.concatenate((letters, np.full((len(letters), 1), 32, np.uint8)), axis=1).tobytes().decode()
    texts = [raw[k : k + 8000] for k in range(0, len(raw), 8000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    bpe.vocabulary(PATH)
    tracemalloc.start()
    try:
        some = [out.column(1)[0].as_py() for out in bpe.encode_batches(PATH, [batch], True)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert some[0] == library.encode(texts[0], add_special_tokens=False).ids
    assert peak < 200 << 20


def test_late_characters_are_found():
    every = [c for ranges in (bpe.LATE_MARKS, bpe.LATE_LETTERS, bpe.LATE_CAPITALS) for a, b, *_ in ranges for c in range(a, b + 1)]
    assert all(bpe._holds_late("é" + chr(c) + "z") for c in every)
    assert not any(bpe._holds_late(t) for t in ("", "plain", "é ß Ω 日本 😀"))


def test_words_with_signs(library):
    texts = ["word. word, \"word\" word\" a. .a ,. ... é. 日本! x'. it's. ’. 1. ½. aé\u0301. ǅ, \u00a0. a\u00a0. \u0588. \u0558, a\u058b. <|endoftext|>. z<|.", "don't! we'll? 's. a's, s'."]
    for text in texts:
        pieces = text.split(" ")
        for p, ids in zip(pieces, bpe.vocabulary(PATH).encode_pieces(pieces)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(p, add_special_tokens=False).ids, p


def test_files_are_taken_by_number(spark, tmp_path):
    rows = spark.createDataFrame([(f"part-{n}-x.parquet", 0, 10) for n in (99999, 100000)], "file string, row long, n_tokens long")
    parts = [str(tmp_path / "t" / f"part-{n}-x.parquet") for n in (99999, 100000)]
    (tmp_path / "t").mkdir()
    for p in parts:
        pq.write_table(pa.table({"n_tokens": [10]}), p)
    assert sorted((r.file, r.start) for r in token_table.with_starts(rows, str(tmp_path / "t")).collect()) == [("part-100000-x.parquet", 10), ("part-99999-x.parquet", 0)]


def test_op2_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op2_bpe(spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_tokens(library, rows, got):
    start = 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op7_query(spark, sf_dir, library):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    check_tokens(library, rows, {r.doc_id: r for r in queries.op7_token_table(spark, sf_dir).collect()})


def test_token_table_of_hard_texts(docs, library, tmp_path, spark):
    rows = list(enumerate(HARD))
    check_tokens(library, rows, {r.doc_id: r for r in token_table.round_trip(docs(rows).repartition(3), PATH).collect()})
    token_table.write_tokens(docs(rows), str(tmp_path / "t"), PATH)
    back = token_table.read_tokens(spark, str(tmp_path / "t"), ["doc_id", "n_tokens"])
    assert back.count() == len(rows) and back.columns == ["doc_id", "n_tokens"]


def test_repeated_keys_keep_their_rows(docs):
    got = token_table.round_trip(docs([(1, "a"), (1, "b b"), (1, "a"), (None, "c")]), PATH).collect()
    assert len(got) == 4 and sorted(r.start for r in got) == [0, *np.cumsum([r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1].tolist()]
