"""Document quality by a sparse rule ensemble.

Shallow boosted trees over text statistics propose rules: the conjunctions on
the way to their nodes.  A lasso logistic model weights them, most weights
become 0, and what is left is compiled into one Spark column over the
statistics columns, so that scoring a table of statistics stays in the JVM and
every score can be read as a sum of named rules.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import learn
from quire.llm.common import slices, texts_of

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 12_000
#: Rules that the lasso chooses from, at most.
RULES = 400

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SIGNS = b"#$%&*+/<=>@\\^_`{}~"
_HIGH = bytes(range(128, 256))
#: A run of signs at the end of a word; only where a run begins, so that a long one is read once.
_TAIL = re.compile(r"""(?<![^\w\s.,;:?'")\]])[^\w\s.,;:?'")\]]{2,}+(?=\s|$)""")

STATISTICS = (
    "log_words", "word_length", "upper_share", "digit_share", "sign_share", "bar_rate", "exclamation_rate", "tail_rate", "distinct_share",
    "repeat_share", "repeat_run", "top_share", "distinct_lines", "line_words", "stop_rate", "phrase_share", "comma_rate",
)


def statistics(text: str) -> list[float]:
    """The statistics of a whole text; all 0 for one without words."""
    pieces = text.split()
    n = len(pieces)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = text.encode()

    def count(some: bytes) -> int:
        return len(raw) - len(raw.translate(None, some))

    upper, lower, high = count(_UPPER), count(_LOWER), count(_HIGH)
    letters = max(1, upper + lower + high // 2)
    same = np.fromiter(map(operator.eq, pieces, pieces[1:]), bool, n - 1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same, [0]))))
    longest = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
    kinds = Counter(pieces)
    lines = [x for x in text.split("\n") if x.strip()]
    phrases = [x for x in re.split(r"[.\n]", text) if x.strip()]
    return [
        math.log1p(n), (len(text) - n) / n, upper / letters, count(_DIGITS) / len(raw), count(_SIGNS) / len(raw), count(b"|") / n, count(b"!") / n, len(_TAIL.findall(text)) / n,
        len(kinds) / n, float(same.mean()) if n > 1 else 0.0, math.log1p(longest), max(kinds.values()) / n, len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
        count(b".") / n, len(set(phrases)) / max(1, len(phrases)), count(b",") / n,
    ]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add a column q_<name> for each statistic of the whole text; null texts count as empty.

    Every column of the input is kept but earlier ones of those names; rows are independent.
    """
    added = [f"q_{s}" for s in STATISTICS]
    kept = [f for f in docs.schema.fields if f.name not in added]
    place = [f.name for f in kept].index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{a} double" for a in added])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(place)):
                rows = np.array([statistics(t) for t in texts_of(batch.column(place)[start:stop])]).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([*(c[start:stop] for c in batch.columns), *(pa.array(c) for c in rows.T)], [*batch.schema.names, *added])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]


def _simplified(path: Rule) -> Rule:
    """A path without conditions that a later one on the same side of the same statistic implies."""
    tightest: dict[tuple[int, bool], float] = {}
    for f, greater, t in path:
        held = tightest.get((f, greater))
        tightest[f, greater] = t if held is None else (max if greater else min)(held, t)
    return tuple(sorted((f, greater, t) for (f, greater), t in tightest.items()))


@dataclass(frozen=True)
class Model:
    """An intercept and weighted conjunctions over the statistics."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score as one Spark column over the q_ columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = None
            for f, greater, t in rule:
                statistic = F.col(f"q_{STATISTICS[f]}")
                one = statistic > t if greater else statistic <= t
                holds = one if holds is None else holds & one
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def explained(self) -> list[str]:
        """The rules as text, the weightiest first."""
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[f]} {'>' if g else '<='} {t:.4g}" for f, g, t in rule) for rule, w in sorted(self.rules, key=lambda r: -abs(r[1]))]


def _holding(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    held = [np.all([(x[:, f] > t) == greater for f, greater, t in rule], axis=0) for rule in rules]
    return np.array(held, float).T if held else np.zeros((len(x), 0))


def fit(docs: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text", penalty: float = 0.001) -> Model:
    """A model from :func:`learn.sample_of` rows and the texts of their documents.

    Of rows that share a key one is learnt from (:func:`learn.one_a_key`).  Only the
    sample's statistics come to the driver, at most :data:`SAMPLE` rows.
    Without labels of both kinds every text scores the mean.
    """
    labelled = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(sample), "key")
    got = measured(learn.one_a_key(labelled).select("text", "label")).drop("text").toPandas()
    names = [f"q_{s}" for s in STATISTICS]
    got = got.sort_values([*names, "label"], ignore_index=True)  # the same model whatever the order of rows
    x, y = got[names].to_numpy(float).reshape(-1, len(names)), got["label"].to_numpy(float)
    _, trees = learn.boosted(x, y, rounds=60, depth=2)
    rules = list(dict.fromkeys(_simplified(p) for t in trees for p in t.paths()))[:RULES]
    holding = _holding(rules, x)
    # rules that hold for the same rows are one rule; the shortest stays
    shapes: dict[bytes, int] = {}
    for i in sorted(range(len(rules)), key=lambda i: len(rules[i])):
        shapes.setdefault(np.packbits(holding[:, i] > 0).tobytes(), i)
    kept = sorted(shapes.values())
    intercept, weights = learn.lasso_logistic(holding[:, kept], y, penalty)
    return Model(intercept, tuple((rules[i], float(w)) for i, w in zip(kept, weights) if w))


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Add the score (0 to 1) of every whole text; null and empty texts score as texts without words.

    Every column of the input is kept but an earlier one of that name; rows are independent.
    """
    kept = [c for c in docs.columns if c != to]
    return measured(docs.select(*[F.col(f"`{c}`") for c in kept]), text).select(*[F.col(f"`{c}`") for c in kept], model.column().alias(to))
