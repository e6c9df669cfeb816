"""Benchmark decontamination by BM25 retrieval with block-max WAND, verified on question and answer.

The benchmark's items are the indexed side and every passage of every training
text is a query.  An item's BM25 impacts are divided by the score it gives to
itself, so one threshold serves all items.  Bounds from the rarer terms pass over
most passages at once, vectorised over a block of texts; the rest run block-max
WAND.  Retrieved pairs are verified on
word n-grams of the item's question and answer near the passage.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, slices, trimmed, written

#: Share of an item's own score from which it is retrieved, and share of n-grams from which it is verified.
RETRIEVE, VERIFY = 0.6, 0.8
#: Words of an n-gram; shorter questions and answers are one n-gram.
GRAM = 5
#: Bytes of benchmark text that one index holds, at most; more text makes more indexes, each met by all passages in a pass of its own.
INDEX_BYTES = 16 << 20
#: Bytes of texts that bounds are worked out for at once.
BLOCK_BYTES = 2 << 20
#: Postings of a block.
BLOCK = 32
#: Share of any item's score that words may give which no bound looks at.
COMMON = 0.25
K1, B = 1.2, 0.75
#: Pieces whose terms a task remembers, at most, and the letters of the longest.
REMEMBERED, LONGEST = 100_000, 64

_INSIDE = re.compile(r"\w")
_ANSWER = re.compile(r"^\s*(?:A|Answer|answer|ANSWER)\s*[:.]\s*", re.M)


def normal(piece: str) -> str:
    """A word in lower case without signs at its ends; may be empty."""
    low = piece.lower()
    if low.isalnum() or not (first := _INSIDE.search(low)):
        return low if low.isalnum() else ""
    return low[first.start() : len(low) - _INSIDE.search(low[::-1]).start()]


def words_of(text: str | None) -> list[str]:
    return [w for p in (text or "").split() if (w := normal(p))]


def parts_of(text: str | None) -> tuple[list[str], list[str]]:
    """An item's question and answer: at a line "A:" or "Answer:" if there is one, else the last sentence answers (the last quarter of the words, if there is one sentence)."""
    text = text or ""
    if found := list(_ANSWER.finditer(text)):
        return words_of(text[: found[-1].start()]), words_of(text[found[-1].end() :])
    sentences = [w for s in re.split(r"(?<=[.!?])\s+|\n", text) if (w := words_of(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def grams(words: list[str]) -> set[tuple[str, ...]]:
    span = min(GRAM, len(words))
    return {tuple(words[i : i + span]) for i in range(len(words) - span + 1)} if span else set()


def weight(holding: int, items: int) -> float:
    """The inverse document frequency of a term that some of the items hold."""
    return math.log(1 + (items - holding + 0.5) / (holding + 0.5))


class Index:
    """Impact-normalised BM25 postings of items, in blocks with their largest impacts.

    ``idf`` and ``mean`` (words of an item) are those of all items, of which an
    index may hold a part; without them they are taken from the items given.
    """

    def __init__(self, items: list[tuple[int, str]], idf: dict[str, float] | None = None, mean: float | None = None):
        split = [(i, *parts_of(t)) for i, t in sorted(items, key=lambda x: x[0])]
        split = [(i, q, a) for i, q, a in split if q or a]
        self.ids = [i for i, _, _ in split]
        self.grams = [(grams(q), grams(a), grams(q + a)) for _, q, a in split]
        bags = [Counter(q + a) for _, q, a in split]
        self.sizes = [sum(b.values()) for b in bags]
        self.longest = max(self.sizes, default=0)
        if mean is None:
            mean = sum(self.sizes) / max(1, len(self.sizes))
        if idf is None:
            idf = {t: weight(n, len(bags)) for t, n in Counter(t for b in bags for t in b).items()}
        postings: dict[str, list[tuple[int, float]]] = {}
        for item, (bag, size) in enumerate(zip(bags, self.sizes)):
            impact = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean)) for t, n in bag.items()}
            own = sum(impact.values())
            for t, x in impact.items():
                postings.setdefault(t, []).append((item, x / own))
        self.terms = {t: k for k, t in enumerate(postings)}
        self.items = [[i for i, _ in p] for p in postings.values()]
        self.impacts = [[x for _, x in p] for p in postings.values()]
        self.block_most = [[max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in self.impacts]
        self.block_last = [[p[min(k + BLOCK, len(p)) - 1] for k in range(0, len(p), BLOCK)] for p in self.items]
        self.most = [max(x) for x in self.impacts]
        self._bounds()

    def _bounds(self) -> None:
        """Split the terms for bounds: the commonest, which give every item :data:`COMMON` of its score at most and that no bound looks at, and the others."""
        self.common = np.zeros(len(self.ids))
        self.rare = np.zeros(len(self.terms) + 1, bool)  # the last stands for words of no item
        self.rare[:-1] = True
        for t in sorted(range(len(self.items)), key=lambda t: (-len(self.items[t]), t)):
            with_it = self.common[self.items[t]] + self.impacts[t]
            if len(self.items[t]) < 2 or with_it.max() > COMMON:
                break
            self.common[self.items[t]] = with_it
            self.rare[t] = False
        self.counts = np.array([len(x) for x in self.items] + [0]) * self.rare
        self.starts = np.cumsum(self.counts) - self.counts
        rare = np.flatnonzero(self.rare[:-1]).tolist()
        self.rare_items = np.array([i for t in rare for i in self.items[t]], np.int64)
        self.rare_impacts = np.array([x for t in rare for x in self.impacts[t]], float)

    def reachable(self, terms: np.ndarray, stretches: np.ndarray, least: float) -> np.ndarray:
        """Of words (terms, stretches of half a passage), the stretches s for which the passage of s and s+1 may give an item ``least``."""
        rare = self.rare[terms]
        if not rare.any():
            return np.zeros(0, np.int64)
        width, n = len(self.rare), len(self.ids)
        held = np.unique(stretches[rare] * width + terms[rare])
        stretch, term = held // width, held % width
        counts = self.counts[term]
        at = np.repeat(self.starts[term] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        key, impact = np.repeat(stretch, counts) * n + self.rare_items[at], self.rare_impacts[at]
        # a stretch adds to the passage that it begins and to the one that it ends
        keys, of = np.unique(np.concatenate((key, key - n)), return_inverse=True)
        bound = np.bincount(of, np.concatenate((impact, impact))) + self.common[keys % n]
        return np.unique(keys[bound >= least - 1e-9] // n)

    def retrieve(self, terms: Iterable[int], least: float) -> list[tuple[int, float]]:
        """Every (item, score) of at least ``least`` for a set of terms, by block-max WAND."""
        lists = [[t, 0] for t in set(terms)]
        found = []
        while lists:
            lists.sort(key=lambda x: self.items[x[0]][x[1]])
            total, pivot = 0.0, None
            for k, (t, _) in enumerate(lists):
                total += self.most[t]
                if total >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = self.items[lists[pivot][0]][lists[pivot][1]]
            while pivot + 1 < len(lists) and self.items[lists[pivot + 1][0]][lists[pivot + 1][1]] == item:
                pivot += 1
            bound, beyond = 0.0, None
            for t, at in lists[: pivot + 1]:
                block = at // BLOCK
                while block < len(self.block_last[t]) and self.block_last[t][block] < item:
                    block += 1
                if block < len(self.block_last[t]):
                    bound += self.block_most[t][block]
                    last = self.block_last[t][block]
                    beyond = last if beyond is None else min(beyond, last)
            if bound >= least:
                if self.items[lists[0][0]][lists[0][1]] == item:
                    score = sum(self.impacts[t][at] for t, at in lists[: pivot + 1])
                    if score >= least:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:
                # no item up to the end of these blocks can reach the threshold
                following = self.items[lists[pivot + 1][0]][lists[pivot + 1][1]] if pivot + 1 < len(lists) else None
                target = max(item + 1, min(beyond + 1, following) if following is not None and beyond is not None else (beyond + 1 if beyond is not None else item + 1))
            moved = []
            for k, (t, at) in enumerate(lists):
                if k <= pivot:
                    posting = self.items[t]
                    while at < len(posting) and posting[at] < target:
                        at += 1
                    if at == len(posting):
                        continue
                moved.append([t, at])
            lists = moved
        return found


def matches(texts: pa.Array, index: Index, known: dict[str, int], retrieve: float = RETRIEVE, verify: float = VERIFY) -> list[tuple[int, int, float, float, float]]:
    """(row, item, score, question overlap, answer overlap) of the items that texts hold; ``known`` remembers words' terms."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = split.flatten().dictionary_encode()
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    pieces = coded.dictionary.to_pylist()
    none = len(index.terms)
    terms = np.empty(len(pieces), np.int64)
    for k, p in enumerate(pieces):
        if (t := known.get(p)) is None:
            t = index.terms.get(normal(p), none)
            if len(known) < REMEMBERED and len(p) <= LONGEST:
                known[p] = t
        terms[k] = t
    at = coded.indices.to_numpy()
    of = terms[at]
    size = max(64, 2 * index.longest)
    stride = size // 2
    # stretches of ``stride`` words; a passage is a stretch and the next, if that is of the same text
    n = np.diff(bounds)
    counts = -(-n // stride) + 1  # an empty stretch ends each text, so no passage reaches into the next
    first = np.cumsum(counts) - counts
    rows = np.repeat(np.arange(len(n)), counts)
    places = np.arange(len(of)) - np.repeat(bounds[:-1], n)
    stretches = np.repeat(first, n) + places // stride
    candidates = index.reachable(of, stretches + 1, retrieve) - 1  # one more, so that no number is below 0
    candidates = candidates[candidates >= 0]
    begins = bounds[:-1][rows[candidates]] + stride * (candidates - first[rows[candidates]])
    ends = np.minimum(begins + size, bounds[1:][rows[candidates]])
    best: dict[tuple[int, int], tuple[float, list[tuple[int, int]]]] = {}
    for row, begin, end in zip(rows[candidates].tolist(), begins.tolist(), ends.tolist()):
        here = of[begin:end]
        for item, score in index.retrieve(np.unique(here[here < none]).tolist(), retrieve):
            held, spans = best.get((row, item), (0.0, []))
            best[row, item] = max(held, score), [*spans, (begin, end)]
    found = []
    for (row, item), (score, spans) in best.items():
        shares = (0.0, 0.0, 0.0)
        for begin, end in spans:
            reach = index.sizes[item]
            near = [w for k in at[max(int(bounds[row]), begin - reach) : min(int(bounds[row + 1]), end + reach)].tolist() if (w := normal(pieces[k]))]
            each = []
            for wanted in index.grams[item]:
                span = len(next(iter(wanted))) if wanted else 0
                held = sum(g in wanted for g in {tuple(near[i : i + span]) for i in range(len(near) - span + 1)}) if span else 0
                each.append(held / len(wanted) if wanted else 1.0)
            shares = max(shares, tuple(each), key=lambda s: (s[2], s[0], s[1]))
        question, answer, whole = shares
        if whole >= verify or (question >= verify and answer >= verify):
            found.append((row, item, score, question, answer))
    return found


def _terms(known: DataFrame) -> DataFrame:
    """(shard, term, n) for the terms of each item (shard, text), and as the term "" the item itself with its words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                question, answer = parts_of(text)
                if words := question + answer:
                    terms = ["", *set(words)]
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(terms), pa.int64()), pa.array(terms, pa.string()), pa.array([len(words)] + [1] * (len(terms) - 1), pa.int64())], ["shard", "term", "n"])

    return known.select("shard", "text").mapInArrow(run, "shard long, term string, n long")


def indexes(items: DataFrame, item_key: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> Iterator[tuple[Index, bool]]:
    """Indexes of all items, each of about ``index_bytes`` of text at most, one at a time, and whether there are several; items with a null key are left out.

    Frequencies and the mean length are counted over all items, so scores do not
    hang on how many indexes there are.  An index takes its own terms' to the
    driver, which are bounded as its text is.
    """
    known = items.select(F.col(f"`{item_key}`").cast("long").alias("item"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("text")).where("item is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // index_bytes))
    known = known.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards)))
    terms = written(_terms(known), "terms")
    counted, words = terms.where("term = ''").agg(F.count("*"), F.sum("n")).first()
    holding = written(terms.where("term <> ''").groupBy("term").agg(F.count("*").alias("holding")), "holding")
    for shard in range(shards):
        own = terms.where((F.col("shard") == shard) & (F.col("term") != "")).select("term").distinct()
        idf = {r.term: weight(r.holding, counted) for r in own.join(holding, "term").collect()}
        yield Index([(r.item, r.text) for r in known.where(F.col("shard") == shard).collect()], idf, (words or 0) / max(1, counted)), shards > 1
    discard(terms, holding)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", retrieve: float = RETRIEVE, verify: float = VERIFY, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(key, item, score, question_overlap, answer_overlap): one row for each benchmark item that a text holds.

    An item is found if passages of the text score at least ``retrieve`` of its
    own BM25 score and if, near such a passage, at least ``verify`` of its
    n-grams stand, or of its question's and of its answer's.  Items with a null
    key or without words, and null or empty texts, match nothing; repeated items
    and repeated rows each give their rows.  Weights come from all items.  Other
    columns are ignored.  With several indexes each one's pass is a table, and
    only one of them is in memory at a time.
    """
    picked = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = picked.schema[0].dataType.simpleString()
    found = []
    for index, several in indexes(items, item_key, item_text, index_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, known = shared.value, {}
            for batch in batches:
                for start, stop in slices(batch.column(1), BLOCK_BYTES):
                    got = matches(batch.column(1)[start:stop], index, known, retrieve, verify)
                    if got:
                        rows, of, score, question, answer = zip(*got)
                        keys = batch.column(0)[start:stop].take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([keys, pa.array([index.ids[i] for i in of], pa.int64()), *(pa.array(x, pa.float64()) for x in (score, question, answer))], [key, item_key, "score", "question_overlap", "answer_overlap"])

        made = picked.mapInArrow(run, f"`{key}` {kind}, `{item_key}` long, score double, question_overlap double, answer_overlap double")
        found.append(_passed(made, shared) if several else made)
    return functools.reduce(DataFrame.union, found)


def _passed(made: DataFrame, shared: Broadcast) -> DataFrame:
    """A pass as a table, after which its index goes."""
    table = written(made, "pass")
    shared.destroy()
    return table


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", retrieve: float = RETRIEVE, verify: float = VERIFY, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no item as :func:`contaminated` finds it; in one pass for each index, without a shuffle."""
    place = docs.columns.index(text)
    for index, several in indexes(items, item_key, item_text, index_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, known = shared.value, {}
            for batch in batches:
                for start, stop in slices(batch.column(place), BLOCK_BYTES):
                    kept = np.ones(stop - start, bool)
                    kept[[m[0] for m in matches(batch.column(place)[start:stop], index, known, retrieve, verify)]] = False
                    yield batch.slice(start, stop - start).filter(pa.array(kept))
            known.clear()
            trimmed()

        docs = docs.mapInArrow(run, docs.schema)
        docs = _passed(docs, shared) if several else docs
    return docs
