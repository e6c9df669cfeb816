import hashlib
import random

import numpy as np

from quire.llm import fm_index, queries, substring
from quire.llm.fm_index import FmIndex, WaveletMatrix


def brute(rows, window=20):
    """(id, n_words, n_removed, kept) for rows in order."""
    seen, out = set(), []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out.append((i, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return out


def got(df):
    return sorted(map(tuple, df.collect()))


def texts(seed, n, alphabet, longest):
    r = random.Random(seed)
    passages = [" ".join(f"p{k}_{i}" for i in range(r.randint(18, 45))) for k in range(4)]
    made = []
    for _ in range(n):
        words = [f"v{r.randint(0, alphabet)}" for _ in range(r.randint(0, longest))]
        for _ in range(r.randint(0, 2)):
            words.insert(r.randint(0, len(words)), r.choice(passages))
        made.append(" ".join(words))
    return made


def test_repeats_across_and_within(docs):
    rows = list(enumerate([None, "", "a " * 19, "a " * 20, "a " * 21, "a\tb\n" * 30, "a b " * 30, *texts(1, 60, 10**6, 80), *texts(1, 5, 10**6, 80)]))
    assert got(substring.deduplicated(docs(rows).repartition(3))) == brute(rows)


def test_common_words_and_hot_anchors(docs):
    rows = list(enumerate(texts(2, 40, 2, 120)))
    for hot in (0, 3, 5000):
        assert got(substring.deduplicated(docs(rows).repartition(4), hot=hot, batch_words=300)) == brute(rows)


def test_null_and_repeated_keys(docs):
    text = " ".join(map(str, range(25)))
    rows = [(None, text), (1, text), (1, text), (2, text), (2, "z " + text)]
    result = got(substring.deduplicated(docs([r for r in rows if r[0] is not None])))
    assert [r[:3] for r in result if r[0] == 1] == [(1, 25, 0)] * 2  # equal rows are one text
    assert [r[:3] for r in result if r[0] == 2] == [(2, 25, 25), (2, 26, 25)]
    assert [tuple(r) for r in substring.deduplicated(docs([rows[0], rows[0]])).collect()] == [(None, 25, 0, text)] * 2


def test_empty_table(docs):
    assert substring.deduplicated(docs([])).collect() == []


def test_op10_query(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    expected = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows)]
    assert got(queries.op10_substring(spark, sf_dir)) == expected


def test_ranks():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 37, 500)
    matrix = WaveletMatrix(values, 6)
    places, symbols = rng.integers(0, 501, 300), rng.integers(0, 37, 300)
    assert matrix.rank(symbols, places).tolist() == [int((values[:p] == s).sum()) for p, s in zip(places, symbols)]


def test_matching_statistics():
    rng = np.random.default_rng(2)
    shard = [rng.integers(0, 4, n).astype(np.uint64) for n in (30, 1, 55, 20)]
    index = FmIndex(np.concatenate(shard), np.array([len(s) for s in shard]), 6)
    query = rng.integers(0, 5, 80).astype(np.uint64)
    held = {tuple(s[i : i + n].tolist()) for s in shard for n in range(1, 7) for i in range(len(s) - n + 1)}
    expected = [max(n for n in range(7) if n == 0 or (n <= e + 1 and tuple(query[e - n + 1 : e + 1].tolist()) in held)) for e in range(80)]
    assert index.matching(query).tolist() == expected


def test_first_places():
    rng = np.random.default_rng(3)
    shard = [rng.integers(0, 3, n).astype(np.uint64) for n in (40, 3, 60)]
    words, lengths = np.concatenate(shard), np.array([len(s) for s in shard])
    index = FmIndex(words, lengths, 5)
    seen, expected, at = {}, np.full(len(words), -1), 0
    for s in shard:
        for i in range(len(s) - 4):
            expected[at + i] = seen.setdefault(tuple(s[i : i + 5].tolist()), at + i)
        at += len(s)
    assert index.first_places(words, lengths).tolist() == expected.tolist()
    assert index.first_places(shard[2], lengths[2:]).tolist() == expected[43:].tolist()  # one text alone
    kept = sum(x.nbytes for x in (index.group_start, index.group_first, index.groups.words, index.groups.before))
    assert kept <= 12 * index.size and not hasattr(index, "text")


def test_tables_go_and_one_window_everywhere(docs, spark):
    from quire.llm.common import shared_dir

    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(i, f"a{i} {passage} b{i}") for i in range(300)]
    result = substring.deduplicated(docs(rows).repartition(6), hot=10, batch_words=50)
    assert got(result) == brute(rows)
    left = spark.sparkContext._jvm.java.io.File(shared_dir(spark).removeprefix("file://")).list()
    assert not any(x.startswith(("anchors", "counts", "flagged", "segments", "runs")) for x in left)


def test_one_place_a_level_is_looked_up(monkeypatch):
    """The beginning of a symbol is kept, not followed through the levels again for each place."""
    rng = np.random.default_rng(7)
    lengths = np.full(300, 27)
    words = rng.integers(0, 1000, lengths.sum()).astype(np.uint64)
    index = fm_index.FmIndex(words, lengths, 20)
    looked, rank = [], fm_index.PackedBits.rank
    monkeypatch.setattr(fm_index.PackedBits, "rank", lambda self, places: (looked.append(len(places)), rank(self, places))[1])
    assert (index.first_places(words, lengths) >= 0).sum() == 300 * 8
    assert sum(looked) <= 300 * 50 * index.transform.bits


def test_symbols_that_do_not_occur():
    matrix = fm_index.WaveletMatrix(np.array([5, 0, 5, 2]), 3)
    for symbol in range(8):
        for place in range(5):
            assert matrix.rank(np.array([symbol]), np.array([place]))[0] == [5, 0, 5, 2][:place].count(symbol)


def test_least_of_each_window():
    values = np.random.default_rng(3).integers(0, 6, 500).astype(np.uint64)
    for span in (1, 2, 3, 8, 13, 500):
        view = np.lib.stride_tricks.sliding_window_view(values, span)
        assert substring._least(values, span).tolist() == (view.argmin(axis=1) + np.arange(len(view))).tolist()
