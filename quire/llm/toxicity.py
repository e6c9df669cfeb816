"""Toxicity by boosted trees over dense features, with isotonic calibration.

The lexicon is learnt: words and word beginnings that stand in more of the
toxic than of the other rows of a bounded labelled sample.  The sample is cut in
:data:`FOLDS`: a row's features come from the lexicon of the other folds, and
the calibration from scores of trees of the other folds, so neither sees the
label that it is fitted to.  A piece of text between white space is classed once
a task; a document's features are then counts over those classes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import learn
from quire.llm.common import slices, texts_of, trimmed, written
from quire.llm.minhash import near_duplicates

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 12_000
#: Entries of the lexicon, at most.
ENTRIES = 1_000
#: Parts of the sample that are left out in turn.
FOLDS = 5
#: Lengths of word beginnings that may be entries.
STEMS = (4, 5, 6, 7, 8)
#: Parts that a row is counted in; whole numbers, so that sums do not hang on the order of rows.
PARTS = 1 << 40
#: Pieces that a task remembers, at most, and the letters of the longest.
REMEMBERED, LONGEST = 100_000, 64
#: Words from a second-person word within which a lexicon word counts as aimed at someone.
NEAR = 5

# Second-person words of five languages.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros voi tuo".split()
)
#: What digits and signs stand for inside a word.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})

_LETTERS = regex.compile(r"\p{L}+")
_INNER = regex.compile(r"\p{L}[\d@$*!._-]+\p{L}")
#: Bits of a piece's class above its weight (0-15, half a unit of log odds each).
_YOU, _CAPS, _HIDDEN, _EXCLAIM, _SINGLE = 16, 32, 64, 128, 256

FEATURES = (
    "log_words", "lexicon_density", "weight_density", "strong_density", "strong_count", "heaviest", "distinct_hits",
    "near_you", "you_density", "capitals", "exclamation", "hidden", "single_letters", "longest_gap", "hits_log",
)


def lexicon_keys(text: str) -> set[str]:
    """What a text counts for in the lexicon: its words ("=word") and their beginnings ("^begi")."""
    words = set(_LETTERS.findall(text.lower()))
    return {f"={w}" for w in words if len(w) > 2} | {f"^{w[:k]}" for w in words for k in STEMS if len(w) >= k}


def weighed(sample: DataFrame) -> DataFrame:
    """Rows (key, text, label, fold) as a table (text, label, fold, copies), every row kept.

    A component of rows that share 80 % of their 3-word shingles, or of rows without
    words, is of one fold, that of its least key.  ``copies`` counts the rows of the
    same label in it; else the words of one text with many copies would fill the lexicon.
    """
    rows = written(sample.select("key", "text", "label", "fold").withColumn("id", F.monotonically_increasing_id()), "labelled")
    near = near_duplicates(rows, "id", "text", words=3).select("id", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"))
    fold = F.min_by("fold", "key").over(Window.partitionBy("component")).alias("fold")
    copies = F.count("*").over(Window.partitionBy("component", "label")).alias("copies")
    placed = rows.select("id", "key", "label", "fold").join(near, "id").select("id", fold, copies)
    return written(rows.select("id", "text", "label").join(placed, "id").select("text", "label", "fold", "copies"), "weighed")


def learn_lexicons(sample: DataFrame, entries: int = ENTRIES, least: int = 6) -> list[dict[str, float]]:
    """From rows (text, label, fold, copies): the entries and log odds, the surest first, without each fold and, last, of all rows.

    Every row counts, as one part in ``copies``: see :func:`weighed`.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, folds, copies = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for start, stop in slices(batch.column(0), 4 << 20):
                counts: dict[tuple[int, int], Counter[str]] = {}
                for text, label, fold, n in zip(texts_of(batch.column(0)[start:stop]), labels[start:stop], folds[start:stop], copies[start:stop]):
                    counted = counts.setdefault((fold, label), Counter())
                    part = round(PARTS / n)
                    for word in lexicon_keys(text):
                        counted[word] += part
                    counted[""] += part  # the empty key counts the rows themselves
                for (fold, label), counted in counts.items():
                    n = len(counted)
                    yield pa.RecordBatch.from_arrays([pa.array(counted.keys(), pa.string()), pa.array([fold] * n, pa.int32()), pa.array([label] * n, pa.int32()), pa.array(counted.values(), pa.int64())], ["key", "fold", "label", "n"])

    counted = sample.select("text", "label", "fold", "copies").mapInArrow(run, "key string, fold int, label int, n long")

    def total(label: int, fold: int) -> Column:
        """Rows of a label outside a fold."""
        return F.round(F.coalesce(F.sum(F.when((F.col("label") == label) & (F.col("fold") != fold), F.col("n"))), F.lit(0)) / PARTS, 6)

    sums = counted.groupBy("key").agg(*[total(c, f).alias(f"n{c}_{f}") for f in range(FOLDS + 1) for c in (0, 1)])
    frequent = written(sums.where((F.col("key") == "") | (F.col(f"n1_{FOLDS}") >= least)), "lexicon")
    rows = frequent.where("key = ''").first()
    found = []
    for f in range(FOLDS + 1):
        others, toxic = (rows[f"n{c}_{f}"] for c in (0, 1)) if rows else (0, 0)
        if not others or not toxic:
            found.append({})
            continue
        odds = F.log((F.col(f"n1_{f}") + 0.5) / (toxic + 1)) - F.log((F.col(f"n0_{f}") + 0.5) / (others + 1))
        error = F.sqrt(1 / (F.col(f"n1_{f}") + 0.5) + 1 / (F.col(f"n0_{f}") + 0.5))
        rated = frequent.where((F.col("key") != "") & (F.col(f"n1_{f}") >= least)).select("key", odds.alias("odds"), (odds / error).alias("z"))
        best = rated.where("odds > 1 and z > 3").orderBy(F.desc("z"), "key").limit(entries).collect()
        found.append({r["key"]: r["odds"] for r in best})
    return found


class Classes(dict):
    """A piece's class, worked out at first sight."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = {k: max(1, min(15, round(2 * v))) for k, v in lexicon.items()}
        self.lengths = sorted({len(k) - 1 for k in lexicon if k[0] == "^"})

    def weight(self, word: str) -> int:
        get = self.lexicon.get
        return max(get(f"={word}", 0), max((get(f"^{word[:k]}", 0) for k in self.lengths), default=0))

    def __missing__(self, piece: str) -> int:
        low = piece.lower()
        words = _LETTERS.findall(low)
        found = max(map(self.weight, words), default=0)
        hidden = bool(_INNER.search(low))
        if hidden:
            plain = "".join(_LETTERS.findall(low.translate(SIGNS)))
            found = max(found, self.weight(plain))
        code = found | _YOU * any(w in SECOND_PERSON for w in words) | _CAPS * (len(piece) > 2 and piece.isupper()) | _HIDDEN * hidden | _EXCLAIM * ("!" in piece) | _SINGLE * (len(piece) == 1 and piece.isalpha())
        if len(self) < REMEMBERED and len(piece) <= LONGEST:
            self[piece] = code
        return code


def features(text: str, classes: Classes) -> list[float]:
    """The dense features of a whole text; all 0 for one without words."""
    pieces = text.split()
    n = len(pieces)
    if not n:
        return [0.0] * len(FEATURES)
    codes = np.fromiter(map(classes.__getitem__, pieces), np.int16, n)
    weight = codes & 15
    hits = np.flatnonzero(weight)
    strong = np.flatnonzero(weight >= 6)
    you = np.flatnonzero(codes & _YOU)
    near = 0
    if len(hits) and len(you):
        after = np.searchsorted(you, hits)
        ahead = np.abs(you[np.minimum(after, len(you) - 1)] - hits)
        behind = np.abs(hits - you[np.maximum(after - 1, 0)])
        near = int((np.minimum(ahead, behind) <= NEAR).sum())
    flags = [float(np.count_nonzero(codes & bit)) / n for bit in (_YOU, _CAPS, _EXCLAIM, _HIDDEN, _SINGLE)]
    gaps = np.diff(np.concatenate(([-1], hits, [n]))).max() / n
    return [
        math.log1p(n), len(hits) / n, float(weight.sum()) / n, len(strong) / n, float(len(strong)), float(weight.max()), float(len({pieces[i].lower() for i in hits.tolist()})),
        near / n, flags[0], flags[1], flags[2], flags[3], flags[4], float(gaps), math.log1p(len(hits)),
    ]


class Model:
    """A lexicon, trees and a calibration curve; small, and the same for every row."""

    def __init__(self, lexicon: dict[str, float], trees: tuple[float, list[learn.Tree]], curve: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.trees, self.curve = tuple(lexicon.items()), trees, curve

    def classes(self) -> Classes:
        """An empty memory of pieces; a task has one for all its texts."""
        return Classes(dict(self.lexicon))

    def __call__(self, texts: list[str], classes: Classes | None = None) -> np.ndarray:
        classes = self.classes() if classes is None else classes
        x = np.array([features(t, classes) for t in texts]).reshape(-1, len(FEATURES))
        return learn.calibrated(self.curve, learn.raw_scores(self.trees, x))


def fit(docs: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """A model from :func:`learn.sample_of` rows and the texts of their documents.

    Of rows that share a key one is learnt from (:func:`learn.one_a_key`), so the
    rows are bounded as the labels are.  Only the lexicons and the sample's
    features come to the driver; both are bounded by :data:`ENTRIES` and
    :data:`SAMPLE`.  Without labels of both kinds every text scores the mean.
    """
    small = F.broadcast(sample.select("key", "label", (F.col("part") % FOLDS).alias("fold")))
    labelled = weighed(learn.one_a_key(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).join(small, "key")))
    lexicons = [tuple(x.items()) for x in learn_lexicons(labelled)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = [Classes(dict(x)) for x in lexicons]
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                folds = batch.column(2)[start:stop]
                rows = [features(t, classes[f]) for t, f in zip(texts_of(batch.column(0)[start:stop]), folds.to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)[start:stop], folds], ["x", "label", "fold"])

    got = labelled.mapInArrow(run, "x array<double>, label int, fold int").toPandas()
    got = got.sort_values(["fold", "label", "x"], key=lambda c: c.map(tuple) if c.name == "x" else c, ignore_index=True)  # the same model whatever the order of rows
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    y, fold = got["label"].to_numpy(float), got["fold"].to_numpy()
    unseen = np.zeros(len(y))
    for f in np.unique(fold):
        others = fold != f
        unseen[~others] = learn.raw_scores(learn.boosted(x[others], y[others]), x[~others])
    return Model(dict(lexicons[FOLDS]), learn.boosted(x, y), learn.isotonic(unseen, y))


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Add the score (0 to 1) of every whole text; null and empty texts score as texts without words.

    Every column of the input is kept but an earlier one of that name; rows are independent.
    """
    kept = [f for f in docs.schema.fields if f.name != to]
    place = [f.name for f in kept].index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{to}` double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = model.classes()
        for batch in batches:
            for start, stop in slices(batch.column(place)):
                scores = model(texts_of(batch.column(place)[start:stop]), classes)
                yield pa.RecordBatch.from_arrays([*(c[start:stop] for c in batch.columns), pa.array(scores, pa.float64())], [*batch.schema.names, to])
        classes.clear()
        trimmed()

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
