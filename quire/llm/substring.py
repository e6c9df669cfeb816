"""Removal of repeated word windows, by FM-indexes over content-routed shards.

A window of :data:`WINDOW` words is dealt by its anchor, the least hash of the
:data:`GRAM`-word sequences in it, so equal windows meet in one shard wherever
they stand.  Neighbouring windows mostly share an anchor and travel as one
segment.

1. Anchors of all documents are counted; only those met more than once matter.
2. Documents with such anchors give their segments.  Equal segments of one block
   of documents are combined before the shuffle: all but the first are repeats.
   An anchor met more than :data:`HOT` times deals its windows singly, by a hash
   of all their words, so no shard gathers a common phrase.
3. Each shard indexes its segments a bounded batch at a time and streams them
   against the index; the interval of every window tells its first occurrence.
   Windows of hot anchors are dealt over :data:`SALT` shards first, and only the
   first of each shard goes on to the one that compares those.
4. Words covered by windows that are not the first go.

:data:`HOT` only decides how windows are dealt; the result does not hang on it.
Tables in the shared folder go as soon as what is made of them stands.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, slices, trimmed, written
from quire.llm.fm_index import FmIndex

WINDOW, GRAM = 20, 8
#: Occurrences from which an anchor's windows are dealt singly, and shards over which equal ones are dealt.
HOT, SALT = 5_000, 64
#: Words that one index holds; a shard's batch ends with the group of an anchor that reaches it.
BATCH = 100_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed_words(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a whole text, cut at ASCII white space."""
    pieces = (text or "").encode().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces))


def _rolled(hashes: np.ndarray, span: int) -> np.ndarray:
    """A hash of each ``span`` words in a row."""
    total = np.zeros(len(hashes) - span + 1, np.uint64)
    for k in range(span):
        total = (total + hashes[k : len(hashes) - span + 1 + k]) * _MIX
        total ^= total >> np.uint64(31)
    return total


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Where the first of the least of each ``span`` values in a row stands; by doubling."""
    place, width = np.arange(len(values)), 1
    while width < span:
        shift = min(width, span - width)
        later = values[shift:] < values[:-shift]
        place = np.where(later, place[shift:], place[:-shift])
        values = np.where(later, values[shift:], values[:-shift])
        width += shift
    return place


def segments(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows with one anchor: anchor, first window, number of windows."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = _rolled(hashes, gram)
    place = _least(grams, window - gram + 1)
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return grams[place[starts]], starts, np.diff(np.append(starts, len(place)))


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, id, n): how often each anchor stands in each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                anchors, counts, sizes = [], [], []
                for text in batch.column(1)[start:stop].to_pylist():
                    each, n = np.unique(segments(hashed_words(text), window, gram)[0], return_counts=True)
                    anchors.append(each)
                    counts.append(n)
                    sizes.append(len(each))
                ids = np.repeat(batch.column(0)[start:stop].to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors).view(np.int64)), pa.array(ids), pa.array(np.concatenate(counts).astype(np.int32))], ["anchor", "id", "n"])

    return docs.select("id", "text").mapInArrow(run, "anchor long, id long, n int")


def _pieces(docs: DataFrame, flagged: DataFrame, window: int, gram: int) -> DataFrame:
    """Segments (key, salt, id, tag, start, words) with repeated anchors, salt -1 for those dealt by key alone, and as rows without words the repeats (id, tag, start, n windows in key) that a block shows by itself."""
    names = ["key", "salt", "id", "tag", "start", "words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                first: dict[bytes, tuple[int, int, int, int, int]] = {}
                repeats: list[tuple[int, int, int, int]] = []
                columns = [c[start:stop] for c in batch.columns]
                for id_, text, common, hot in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3]):
                    tag = xxhash.xxh3_64_intdigest((text or "").encode()) - 2**63
                    hashes = hashed_words(text)
                    raw = hashes.tobytes()
                    anchors, begins, counts = segments(hashes, window, gram)
                    singly = np.isin(anchors.view(np.int64), hot.values.to_numpy())
                    met = np.isin(anchors.view(np.int64), common.values.to_numpy()) & ~singly
                    pieces = [(*p, -1) for p in zip(anchors[met].view(np.int64).tolist(), begins[met].tolist(), counts[met].tolist())]
                    if singly.any():
                        alone = np.repeat(begins[singly] - np.cumsum(counts[singly]) + counts[singly], counts[singly]) + np.arange(counts[singly].sum())
                        pieces += [(k, w, 1, tag % SALT) for k, w in zip(_rolled(hashes, window)[alone].view(np.int64).tolist(), alone.tolist())]
                    for key, begin, n, salt in pieces:
                        words = raw[8 * begin : 8 * (begin + n + window - 1)]
                        mine = (id_, tag, begin, key, salt)
                        held = first.setdefault(words, mine)
                        if held != mine:
                            if mine[:3] < held[:3]:
                                first[words] = mine
                                mine = held
                            repeats.append((mine[0], mine[1], mine[2], n))
                rows = [(v[3], v[4], v[0], v[1], v[2], w) for w, v in first.items()] + [(n, -1, i, t, b, None) for i, t, b, n in repeats]
                if rows:
                    key, salts, ids, tags, begins, words = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(salts, pa.int32()), *(pa.array(x, pa.int64()) for x in (ids, tags, begins)), pa.array(words, pa.binary())], names)

    joined = docs.join(flagged, "id").select("id", "text", "common", "hot")
    return joined.mapInArrow(run, "key long, salt int, id long, tag long, start long, words binary")


def _repeats(pieces: DataFrame, window: int, batch_words: int, dealt_by: tuple[str, ...]) -> DataFrame:
    """(id, tag, start, n): runs of windows that stand earlier, of segments dealt by some columns; and of salted segments those that stand first, as rows (key, id, tag, start, words) with n 0."""
    names = ["key", "id", "tag", "start", "salt", "words"]
    given = ["id", "tag", "start", "n", "key", "words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple[int, int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(r[5]) // 8 for r in rows])
            words = np.frombuffer(b"".join([r[5] for r in rows]), np.uint64)
            first = FmIndex(words, lengths, window).first_places(words, lengths)
            repeated = (first >= 0) & (first < np.arange(len(first)))
            edges = np.diff(np.concatenate(([0], repeated.view(np.int8), [0])))
            begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            starts = np.cumsum(lengths) - lengths
            if len(begins):
                text = np.searchsorted(starts, begins, side="right") - 1
                own = np.array([r[1:4] for r in rows], np.int64)[text]
                n = len(begins)
                yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(own[:, 2] + begins - starts[text]), pa.array(ends - begins), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], given)
            lone = [r for r, gone in zip(rows, repeated[starts].tolist()) if r[4] >= 0 and not gone]
            if lone:
                key, ids, tags, begins, _, words = zip(*lone)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (ids, tags, begins, [0] * len(lone), key)), pa.array(words, pa.binary())], given)

        held, words, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:5] == last:
                    continue  # a repeated row of the input is one occurrence
                if words >= batch_words and row[0] != last[0]:
                    yield from found(held)
                    held, words = [], 0
                held.append(row)
                words += len(row[5]) // 8
                last = row[:5]
        if held:
            yield from found(held)
        trimmed()

    dealt = pieces.select(*names).repartition(*dealt_by).sortWithinPartitions(*names[:4])
    return dealt.mapInArrow(run, "id long, tag long, start long, n long, key long, words binary")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, batch_words: int = BATCH) -> DataFrame:
    """(key, n_words, n_removed, kept): every row's words without those that a repeated window covers.

    A window repeats if its words also begin earlier: in a row of a smaller key,
    or in the same row.  Rows that share a key are taken in the order of a hash
    of their texts; rows equal in both are one text and all get its result.  A
    null text has no words; a row with a null key keeps all of its words and
    takes no part.  Other columns are ignored.
    """
    picked = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    whole = picked.where("id is not null and text is not null")
    anchors = written(_anchors(whole, window, gram), "anchors")
    # both sides of the join are tables, so that the partition of an anchor in every document is split
    counts = written(anchors.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1"), "counts")
    flagged = written(
        anchors.join(counts, "anchor").groupBy("id").agg(F.collect_list(F.when(F.col("total") <= hot, F.col("anchor"))).alias("common"), F.collect_list(F.when(F.col("total") > hot, F.col("anchor"))).alias("hot")), "flagged"
    )
    discard(anchors, counts)
    pieces = written(_pieces(whole, flagged, window, gram), "segments")
    discard(flagged)
    found = written(_repeats(pieces.where("words is not null"), window, batch_words, ("key", "salt")), "runs")
    firsts = found.where("words is not null").withColumn("salt", F.lit(-1))
    runs = ["id", "tag", "start", "n"]
    repeats = found.where("words is null").select(*runs).union(_repeats(firsts, window, batch_words, ("key",)).select(*runs)).union(pieces.where("words is null").select("id", "tag", "start", F.col("key").alias("n")))
    covered = written(repeats.groupBy("id").agg(F.collect_list(F.struct("tag", "start", "n")).alias("repeats")), "covered")
    discard(pieces, found)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                n_words, n_removed, kept = [], [], []
                for body, found in zip(batch.column(1)[start:stop].to_pylist(), batch.column(2)[start:stop]):
                    raw = (body or "").encode()
                    words = raw.split()
                    n_words.append(len(words))
                    removed = 0
                    if found.is_valid:
                        tag = xxhash.xxh3_64_intdigest(raw) - 2**63
                        tags, begins, runs = (found.values.field(c).to_numpy() for c in range(3))
                        mine = tags == tag
                        ends = np.zeros(len(words) + 1, np.int64)
                        np.add.at(ends, begins[mine], 1)
                        np.add.at(ends, begins[mine] + runs[mine] + window - 1, -1)
                        gone = np.cumsum(ends[:-1]) > 0
                        removed = int(gone.sum())
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    n_removed.append(removed)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [key, "n_words", "n_removed", "kept"])

    return picked.join(covered, "id", "left").select("id", "text", "repeats").mapInArrow(run, f"`{key}` long, n_words long, n_removed long, kept string")
