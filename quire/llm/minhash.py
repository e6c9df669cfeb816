"""Near-duplicate components by an LSH forest of MinHash signatures, confirmed on full shingle sets.

1. Each document becomes a set of hashed word shingles and a signature of
   :data:`TREES` x :data:`DEPTH` minima.  Equal sets are one class from here on;
   its least id stands for it.
2. Each tree sorts the classes by its signature order.  Rows whose longest
   common prefix reaches :data:`LEAST_DEPTH` form a region, in which packed
   sketches are compared and a spanning forest of what may be similar enough
   becomes candidate links.  Depth adapts to the region: one of more than
   :data:`REGION` rows whose forest takes more than that many steps is cut at
   greater depths, and its rows go on to a second forest of :data:`DEEP_TREES`
   further orders whose regions share all :data:`DEPTH` minima.  What is too
   large even there is one candidate component as a whole, so no region is cut
   in chunks.  Orders are range-partitioned; regions at the edges of partitions
   are put together again, large ones by a marker.
3. Components of candidate links bring together every pair that may be linked.
   In each, links are decided on full sets, by an index of every set's rarest
   shingles, one of which two sets of that similarity must share.  A component
   of more than a few hundred rows is first compared with its least member, and
   only rows that do not link to it meet the others, in blocks.
4. Components of confirmed links are the answer.

A pair at the threshold of 0.8 is missed with a probability of at most
(1 - 0.8**4)**24, about 3 in a million, where its regions are not cut; where
they are, of (1 - 0.8**8)**(24 + 64), about 1 in 10 million, and 8 in a million
if partition edges cut all of the first forest's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, give_back, slices, written
from quire.llm.graph import components

TREES, DEPTH, LEAST_DEPTH = 24, 8, 4
#: Further orders for the rows of dense regions.
DEEP_TREES = 64
#: Rows of a region that is compared as it is, and steps that the forest of a larger one may take.
REGION = 1024
#: Signature values whose low nibbles make the sketch, and equal nibbles from which a pair is a candidate at the threshold of 0.8 (5 standard deviations below the mean).
SKETCH = 64
#: Shingles whose sets one task holds, at most, and rows of a component from which it is spread over tasks.
BLOCK, SPREAD = 1_500_000, 256
#: Tasks over which the rows of one large component are spread when they meet its least member, and blocks of its rows and of those not linked to it, at least, when these meet.
SALT, PARTS, RESTS = 64, 8, 4

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_A, _DEEP_A = (_rng.integers(1, 2**32, n * DEPTH, dtype=np.uint32) | np.uint32(1) for n in (TREES, DEEP_TREES))
_B, _DEEP_B = (_rng.integers(0, 2**32, n * DEPTH, dtype=np.uint32) for n in (TREES, DEEP_TREES))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashed shingles of a whole text, sorted; A-Z in lower case, words cut at ASCII white space."""
    pieces = (text or "").encode().lower().split()
    if not pieces:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces))
    span = min(words, len(pieces))
    total = np.full(len(pieces) - span + 1, span, np.uint64)
    for k in range(span):
        total = (total + hashed[k : len(hashed) - span + 1 + k]) * _MIX
        total ^= total >> np.uint64(29)
    return np.unique(total)


def signature(shingles: np.ndarray, deep: bool = False) -> np.ndarray:
    """The low 16 bits of each minimum of a non-empty set, over the orders of the first or of the deep forest."""
    a, b = (_DEEP_A, _DEEP_B) if deep else (_A, _B)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 2048):
        part = low[start : start + 2048, None] * a
        part += b
        np.minimum(least, part.min(axis=0), out=least)
    return least.astype(np.uint16)


def _signed(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, n, high, low, sig): set size, 128-bit digest of the set, signature (null for an empty set)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                n, high, low, sig = [], [], [], []
                for t in batch.column(1)[start:stop].to_pylist():
                    s = shingle_set(t, words)
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    n.append(len(s))
                    high.append(int.from_bytes(digest[:8], "little", signed=True))
                    low.append(int.from_bytes(digest[8:], "little", signed=True))
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sig, pa.binary())], ["id", "n", "high", "low", "sig"])

    picked = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("id is not null")
    return picked.mapInArrow(run, "id long, n long, high long, low long, sig binary")


_ROW = ("tree", "k1", "k2", "s0", "s1", "s2", "s3", "id")
_ROW_TYPES = "tree int, k1 long, k2 long, s0 long, s1 long, s2 long, s3 long, id long"
#: Kinds of rows that regions give: links, rows of a region at an edge of a partition, rows of dense regions, marks of large regions at an edge; and of those at an edge whose rows are one group there: a mark, the rows, and marks of those that are no group over all partitions.
_LINK, _EDGE, _DENSE, _LARGE, _GROUP, _PENDING, _BROKEN = range(7)
#: Rows of a region at an edge that go on themselves, at most.
EDGE_ROWS = 256


def _deep_signed(docs: DataFrame, rows: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, sig) over the orders of the deep forest for some rows (id)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                made = [signature(shingle_set(t, words), True).tobytes() for t in batch.column(1)[start:stop].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], pa.array(made, pa.binary())], ["id", "sig"])

    picked = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    signed = picked.where("text is not null").join(rows, "id").mapInArrow(run, "id long, sig binary")
    return signed.dropDuplicates(["id", "sig"])


def _planted(reps: DataFrame) -> DataFrame:
    """One row for each class and tree: tree, k1 and k2 (the signature order), the sketch in four longs, id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, -1)
            trees = sig.shape[1] // DEPTH
            order = sig.reshape(n, trees, 2, 4).astype(">u2").view(">u8").reshape(n, trees, 2).astype(np.uint64)
            nibbles = (sig[:, :: sig.shape[1] // SKETCH][:, :SKETCH] >> 4) & 15
            packed = (nibbles[:, ::2] | (nibbles[:, 1::2] << 4)).astype(np.uint8)
            sketch = np.ascontiguousarray(packed).view("<i8")
            columns = [np.tile(np.arange(trees), n), order[:, :, 0].ravel().view(np.int64), order[:, :, 1].ravel().view(np.int64), *(np.repeat(sketch[:, c], trees) for c in range(4)), np.repeat(batch.column(0).to_numpy(), trees)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *map(pa.array, columns[1:])], list(_ROW))

    return reps.select("id", "sig").mapInArrow(run, _ROW_TYPES)


def _forest(sketches: np.ndarray, ids: np.ndarray, equal: int, most: int | None = None) -> list[tuple[int, int]] | None:
    """Spanning links (to the least id of each group) over pairs of rows with at least ``equal`` equal nibbles; None if that takes more than ``most`` steps of one row against the rest."""
    n = len(ids)
    raw = np.ascontiguousarray(sketches).view(np.uint8)
    halves = np.concatenate((raw & 15, raw >> 4), axis=1)
    waiting = np.ones(n, bool)
    links, steps = [], 0
    for first in range(n):
        if not waiting[first]:
            continue
        waiting[first] = False
        group, ahead = [first], [first]
        while ahead and waiting.any():
            steps += 1
            if most is not None and steps > most:
                return None
            rest = np.flatnonzero(waiting)
            new = rest[(halves[rest] == halves[ahead.pop()]).sum(axis=1) >= equal]
            waiting[new] = False
            group += new.tolist()
            ahead += new.tolist()
        links += _star(ids[group])
    return links


def _star(ids: np.ndarray) -> list[tuple[int, int]]:
    """Links of all to the least."""
    least = int(ids.min())
    return [(x, least) for x in ids.tolist() if x != least]


def _parts(k2: np.ndarray, region: int) -> list[tuple[int, int]]:
    """Row ranges of a sorted region, cut deeper while a range exceeds ``region`` and depth is left."""
    waiting, found = [(0, len(k2), 1)], []
    values = k2.view(np.uint64)
    while waiting:
        start, stop, depth = waiting.pop()
        if stop - start <= region or depth > DEPTH - LEAST_DEPTH:
            found.append((start, stop))
        else:
            prefix = values[start:stop] >> np.uint64(64 - 16 * depth)
            cuts = [start, *(np.flatnonzero(prefix[1:] != prefix[:-1]) + start + 1).tolist(), stop]
            waiting += [(a, b, depth + 1) for a, b in zip(cuts, cuts[1:])]
    return [(a, b) for a, b in found if b - a > 1]


class _Regions:
    """Links, dense rows and edges of one task's regions, gathered as rows to hand on."""

    def __init__(self, equal: int, region: int, deep: bool):
        self.equal, self.region, self.deep = equal, region, deep
        self.key = 3 if deep else 2  # columns that rows of a region share
        self.made: list[list[np.ndarray]] = []

    def put(self, kind: int, rows: list[np.ndarray]) -> None:
        n = len(rows[0])
        self.made.append([np.full(n, kind), *rows, np.zeros(n, np.int64)])

    def link(self, links: list[tuple[int, int]]) -> None:
        if links:
            pairs = np.unique(np.array(links, np.int64), axis=0)
            zero = np.zeros(len(pairs), np.int64)
            self.made.append([zero + _LINK, *[zero] * 7, pairs[:, 0], pairs[:, 1]])

    def settle(self, rows: list[np.ndarray], over: bool = False) -> None:
        """The links of one region's sorted rows; those of a dense region are handed on, or if this is the deep forest all are linked.  ``over``: these are not all of its rows."""
        ids = rows[7]
        sketches = np.stack(rows[3:7], axis=1)
        links = None if over and self.deep else _forest(sketches, ids, self.equal, None if len(ids) <= self.region else self.region)
        if links is None and self.deep:
            links = _star(ids)
        elif links is None:
            links = []
            for a, b in _parts(rows[2], self.region):
                part = _forest(sketches[a:b], ids[a:b], self.equal, None if b - a <= self.region else self.region)
                links += _star(ids[a:b]) if part is None else part
            over = True
        self.link(links)
        if over and not self.deep:
            self.put(_DENSE, rows)

    def one_group(self, rows: list[np.ndarray]) -> bool:
        """Link sorted rows, if a short forest makes them one group."""
        links = _forest(np.stack(rows[3:7], axis=1), rows[7], self.equal, self.region)
        one = links is not None and len(links) == len(np.unique(rows[7])) - 1
        if one:
            self.link(links)
        return one

    def mark(self, kind: int, rows: list[np.ndarray]) -> None:
        """One row for a region: that of its least id."""
        least = int(np.argmin(rows[7]))
        self.put(kind, [c[least : least + 1] for c in rows])

    def edge(self, rows: list[np.ndarray], over: bool) -> None:
        """A region that an edge of a partition may cut: its rows meet those beyond, or if they are many a mark of them does."""
        if not over and len(rows[0]) <= EDGE_ROWS:
            self.put(_EDGE, rows)
        elif not over and not self.deep and self.one_group(rows):
            self.mark(_GROUP, rows)
            self.put(_PENDING, rows)
        else:
            self.settle(rows, True)
            self.mark(_LARGE, rows)

    def joined(self, kind: np.ndarray, rows: list[np.ndarray]) -> None:
        """A region put together from the edges of partitions."""
        marked = kind != _EDGE
        if len(kind) < 2:
            return
        if not marked.any() and not self.deep:
            self.settle(rows)
        elif self.deep:
            # a mark stands for all that are linked to it, so here all are linked
            self.settle(rows, marked.any() or len(kind) > self.region)
        elif (kind == _LARGE).any() or not self.one_group(rows):
            self.mark(_BROKEN, rows)
            plain = [c[~marked] for c in rows]
            if len(plain[0]):
                self.settle(plain, True)

    def handed_on(self) -> Iterator[pa.RecordBatch]:
        if self.made:
            columns = [np.concatenate(c) for c in zip(*self.made)]
            self.made.clear()
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:2]), *map(pa.array, columns[2:])], ["kind", *_ROW, "other"])


def _starts(rows: list[np.ndarray], key: int) -> np.ndarray:
    """Where regions of sorted rows begin."""
    changed = np.zeros(len(rows[0]), bool)
    changed[0] = True
    for c in rows[:key]:
        changed[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def _linked_regions(rows: DataFrame, equal: int, region: int, deep: bool) -> DataFrame:
    """What the regions of sorted rows give, as rows (kind, row, other)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        made = _Regions(equal, region, deep)
        held: list[np.ndarray] | None = None  # the last region so far, which may go on
        first, over = True, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy().astype(np.int64) for c in batch.columns]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            starts = _starts(rows, made.key)
            stops = np.append(starts[1:], len(rows[0]))
            for k in np.flatnonzero((stops - starts > 1)[:-1] | (np.arange(len(starts) - 1) == 0)).tolist():
                one = [c[starts[k] : stops[k]] for c in rows]
                if k == 0 and (first or over):
                    made.edge(one, over) if first else made.settle(one, True)
                elif len(one[0]) > 1:
                    made.settle(one)
            if len(starts) > 1:
                first = over = False
            held = [c[starts[-1] :].copy() for c in rows]
            if len(held[0]) > 8 * region:
                # too many rows to hold: settle these and go on, in the deep forest with the one that all are linked to
                made.settle(held, True)
                if first:
                    made.mark(_LARGE, held)
                least = int(np.argmin(held[7]))
                held, over = [c[least : least + 1].copy() for c in held], True
            yield from made.handed_on()
        if held is not None:
            made.edge(held, over)
            yield from made.handed_on()

    return rows.select(*_ROW).mapInArrow(run, f"kind int, {_ROW_TYPES}, other long")


def _linked_edges(found: DataFrame, equal: int, region: int, deep: bool) -> DataFrame:
    """The same for the regions that edges of partitions cut, put together."""
    key = _ROW[: 3 if deep else 2]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Regions(equal, region, deep)

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy().astype(np.int64) for c in batch.columns]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            starts = _starts(rows[1:], made.key)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                made.joined(rows[0][a:b], [c[a:b] for c in rows[1:]])
            held = [c[starts[-1] :].copy() for c in rows]
            yield from made.handed_on()
        if held is not None:
            made.joined(held[0], held[1:])
            yield from made.handed_on()

    cut = found.where(F.col("kind").isin(_EDGE, _LARGE, _GROUP)).repartition(*key).sortWithinPartitions(*_ROW[:3], "id")
    return cut.select("kind", *_ROW).mapInArrow(run, f"kind int, {_ROW_TYPES}, other long")


def _planted_links(reps: DataFrame, equal: int, region: int, deep: bool) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) of one forest over classes (id, sig), and the rows (id) of its dense regions, if there are any."""
    order = ["tree", "k1", "k2", "id"]
    found = written(_linked_regions(_planted(reps).repartitionByRange(*order).sortWithinPartitions(*order), equal, region, deep), "regions")
    found = found.union(written(_linked_edges(found, equal, region, deep), "edges-of-regions"))
    links = found.where(F.col("kind") == _LINK).select(F.col("id").alias("a"), F.col("other").alias("b"))
    kinds = {r.kind for r in found.where(F.col("kind").isin(_DENSE, _BROKEN)).select("kind").distinct().collect()}
    if deep or not kinds:
        return links, None
    dense = found.where(F.col("kind") == _DENSE).select("id")
    if _BROKEN in kinds:
        broken = written(found.where(F.col("kind") == _BROKEN).select("tree", "k1").distinct(), "broken")  # a table, so that the rows of one region are split
        dense = dense.union(found.where(F.col("kind") == _PENDING).join(broken, ["tree", "k1"]).select("id"))
    return links, written(dense.distinct(), "dense")


def candidates(reps: DataFrame, equal: int, region: int, deep_signed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Candidate links (a, b) between classes (id, sig); ``deep_signed`` gives the deep signatures of some classes (id)."""
    links, dense = _planted_links(reps, equal, region, False)
    if dense is not None:
        links = links.union(_planted_links(written(deep_signed(dense), "deep"), equal, region, True)[0])
    return links


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several ranges in a row."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def exact_links(ids: np.ndarray, sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (id, least id of its group) of the components over full sets; with ``left``, of pairs with a row of it.

    Two sets of a Jaccard similarity of ``percent`` share one of the rarest
    n - ceil(n * percent / 100) + 1 shingles of either, so a row meets only those
    that an index of these brings up: rows of one template, alike in their common
    shingles alone, never meet.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(n), sizes)
    codes = codes[np.lexsort((codes, counts[codes], owner))].astype(np.int64)  # the rarest first in each row
    prefix = sizes + (-percent * sizes) // 100 + 1
    left = np.ones(n, bool) if left is None else left
    waiting = np.ones(n, bool)
    marked = np.zeros(len(values), bool)

    def postings() -> tuple[np.ndarray, np.ndarray, int]:
        """Of the rows not yet reached, by shingle: where each one's begin, the rows, and how many rows there are."""
        rows = np.flatnonzero(waiting)
        token, row = codes[_ranges(bounds[rows], prefix[rows])], np.repeat(rows, prefix[rows])
        common = counts[token] > 1
        token, row = token[common], row[common]
        by = np.argsort(token, kind="stable")
        return np.concatenate(([0], np.cumsum(np.bincount(token, minlength=len(values))))), row[by], len(rows)

    begins, listed, indexed = postings()
    alive = n
    links = []
    for first in range(n):
        if not waiting[first]:
            continue
        waiting[first] = False
        alive -= 1
        group, ahead = [first], [first]
        while ahead and alive:
            x = ahead.pop()
            if 2 * alive < indexed:
                begins, listed, indexed = postings()
            rare = codes[bounds[x] : bounds[x] + prefix[x]]
            met = listed[_ranges(begins[rare], begins[rare + 1] - begins[rare])]
            met = np.unique(met[waiting[met]])
            met = met[(left[met] | left[x]) & (100 * np.minimum(sizes[met], sizes[x]) >= percent * np.maximum(sizes[met], sizes[x]))]
            if not len(met):
                continue
            mine = codes[bounds[x] : bounds[x + 1]]
            marked[mine] = True
            shared = np.bincount(np.repeat(np.arange(len(met)), sizes[met])[marked[codes[_ranges(bounds[met], sizes[met])]]], minlength=len(met))
            marked[mine] = False
            new = met[100 * shared >= percent * (sizes[met] + len(mine) - shared)]
            waiting[new] = False
            alive -= len(new)
            group += new.tolist()
            ahead += new.tolist()
        links += _star(ids[group])
    return links


def _sets(docs: DataFrame, members: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``members`` (id, high, low, ...) with their documents' sets; members grow with the documents, so they are not broadcast at any size."""
    fields = [f for f in members.schema.fields if f.name not in ("high", "low")]
    joined = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(members.drop("high", "low").hint("merge"), "id").select(*[f.name for f in fields], "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(len(fields))):
                sets = [shingle_set(t, words).tobytes() for t in batch.column(len(fields))[start:stop].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c[start:stop] for c in batch.columns[:-1]), pa.array(sets, pa.binary())], [*(f.name for f in fields), "set"])

    return joined.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "set binary"]))


def _linked_groups(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within each group of rows (component, i, j, id, is_left, set)."""
    names = ["component", "i", "j", "id", "is_left", "set"]
    dealt = rows.select(*names).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(group: list[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
            if len(group) > 1:
                links = exact_links(np.array([g[0] for g in group]), [np.frombuffer(g[2], np.uint64) for g in group], percent, np.array([g[1] for g in group]))
                if links:
                    pairs = np.array(links, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        at, group = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            ids, left = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for k, key in enumerate(keys):
                if key != at:
                    yield from linked(group)
                    at, group = key, []
                group.append((ids[k], left[k], batch.column(5)[k].as_py()))
        yield from linked(group)

    return dealt.mapInArrow(run, "a long, b long")


def _linked_to_least(rows: DataFrame, percent: int) -> DataFrame:
    """id, component and whether the set links to the component's least member, of rows (component, id, set)."""
    least = rows.groupBy("component").agg(F.min("id").alias("id")).join(rows, ["component", "id"]).dropDuplicates(["component"])
    least = least.select("component", F.col("set").alias("least"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    pairs = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(least, ["component", "salt"]).select("component", "id", "set", "least")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for mine, other in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (mine, other))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                near.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], ["component", "id", "near"])

    return pairs.mapInArrow(run, "component long, id long, near boolean")


def confirmed(docs: DataFrame, members: DataFrame, key: str, text: str, words: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose components are those of all linked pairs inside each candidate component.

    ``members``: id, n and component, one row a class.
    """
    totals = members.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    spread = F.when((F.col("rows") <= SPREAD) & (F.col("total") <= block), 1).otherwise(F.greatest(F.ceil(F.col("total") / block), F.least(F.lit(PARTS), F.ceil(F.col("rows") / SPREAD)), F.lit(2)))
    parted = written(members.join(totals, "component").select("id", "n", "component", spread.cast("int").alias("parts")), "members")
    every = written(_sets(docs, parted, key, text, words), "sets")  # the texts are shuffled once
    small = every.where("parts = 1").select("component", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", F.lit(True).alias("is_left"), "set")
    links = written(_linked_groups(small, percent), "links")
    large = parted.where("parts > 1")
    if large.isEmpty():
        discard(parted, every)
        return links
    rows = every.where("parts > 1")
    near = written(_linked_to_least(rows, percent), "near")
    rest = near.where("not near")
    # rows that do not link to the least member meet all others: their blocks against all blocks
    pieces = rest.join(large.select("id", "component", "n"), ["id", "component"]).groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / block), F.least(F.lit(RESTS), F.ceil(F.count("*") / SPREAD))).cast("int").alias("rests"))
    sets = rows.join(pieces, "component")
    left = sets.join(rest.select("id", "component"), ["id", "component"]).select("component", F.pmod(F.xxhash64("id"), F.col("rests")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), "id", F.lit(True).alias("is_left"), "set")
    right = sets.select("component", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("j"), "id", F.lit(False).alias("is_left"), "set")
    to_least = near.where("near and id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    across = written(_linked_groups(left.union(right), percent).union(to_least), "across")
    discard(parted, every, near)
    return links.union(across)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, region: int = REGION, block: int = BLOCK) -> DataFrame:
    """(key, n_shingles, component_id) for each row with a key.

    Rows are linked if 100 * intersection >= ``percent`` * union of their sets
    of distinct ``words``-word shingles (a shorter text is one shingle).
    component_id is the least key reachable over links, itself included.  A null
    or empty text, or one of white space, has no shingles and no links.  Rows
    with a null key are left out; rows that share a key count as one node.  Other
    columns are ignored; an empty table gives an empty table.
    """
    signed = written(_signed(docs, key, text, words), "signatures")
    # from a table, so that the join can split the rows of a class of very many copies
    classes = written(signed.where("n > 0").groupBy("high", "low").agg(F.min("id").alias("rep")), "classes")
    classed = signed.join(classes, ["high", "low"], "left")
    reps = classed.where("id = rep").dropDuplicates(["high", "low"])
    equal = int(SKETCH * (percent / 100 + (1 - percent / 100) / 16) - 5 * np.sqrt(SKETCH * percent / 100 * (1 - percent / 100)))
    deep_signed = lambda rows: _deep_signed(docs, rows, key, text, words)
    grouped = components(candidates(reps.select("id", "sig"), equal, region, deep_signed))
    members = reps.select("id", "n").join(grouped, reps["id"] == grouped["node"]).select("id", "n", "component")
    links = confirmed(docs, members, key, text, words, percent, block)
    # the classes of rows that share a key are one node
    several = classed.where("n > 0").groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b <> most").select("id", "b")
    shared = classed.join(several, "id").select(F.col("rep").alias("a"), "b")
    roots = components(links.union(shared)).select(F.col("node").alias("rep"), F.col("component").alias("root"))
    found = classed.select("id", "n", "rep").join(roots, "rep", "left")
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "id").alias("component_id"))
