"""Connected components of an edge table: blocks of edges are contracted to forests, and what is more than one block by alternating stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quire.llm.common import discard, written

#: Edges that a task contracts at once.
BLOCK = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same components, each from a node to the least of its component."""
    nodes, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    half = len(a)
    for x, y in zip(codes[:half].tolist(), codes[half:].tolist()):
        x, y = find(x), find(y)
        if x != y:
            # nodes are sorted, so the root of the smaller code is the least node
            parent[max(x, y)] = min(x, y)
    roots = np.array([find(x) for x in range(len(nodes))], np.int64)
    other = roots != np.arange(len(nodes))
    return nodes[other], nodes[roots[other]]


def _contracted(edges: DataFrame, block: int) -> DataFrame:
    """Each task's edges (a, b) as forests, of at most ``block`` edges at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if held:
                a, b = forest(*(np.concatenate(c) for c in zip(*held)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                some = batch.slice(start, block)
                if n + some.num_rows > block:
                    yield from made(held)
                    held, n = [], 0
                held.append(tuple(c.to_numpy() for c in some.columns))
                n += some.num_rows
        yield from made(held)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _summed(edges: DataFrame, label: str) -> tuple[DataFrame, int, tuple]:
    """A table of edges, with their number and a checksum, taken as it is written."""
    seen = Observation()
    table = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), label)
    return table, seen.get["n"], (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, component) for every node with another at the end of an edge (a long, b long); component is the least node reachable.

    Tasks contract their own edges; then blocks of them are contracted again for
    as long as that halves them.  One block is the answer; more go on by
    alternating stars.  Only counts and checksums reach the driver, and the
    tables of a round go when the next one stands.
    """
    held, n, _ = _summed(_contracted(edges.where("a <> b"), block), "forests")
    while True:
        blocks, before, old = max(1, -(-n // block)), n, held
        held, n, _ = _summed(_contracted(old.repartition(blocks), block), "forests")
        discard(old)
        if blocks == 1:
            break
        if 2 * n > before:
            held = _starred(held)
            break
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).union(held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _starred(edges: DataFrame) -> DataFrame:
    """Edges (a, b) from every node to the least of its component, by alternating stars.

    Large and small stars alternate until nothing moves, in about log(n)
    rounds; each is a partially aggregated minimum and one join.  A hub's rows
    meet only its minimum, and both sides of a join are read from tables, so a
    skewed hub's partition is split.
    """
    held, _, state = _summed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # large star: a node's larger neighbours go to the least of its neighbourhood
        both = held.union(held.select(F.col("b"), F.col("a")))
        least = written(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = written(both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        # small star: a node and its smaller neighbours go to the least of those
        smaller = written(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
        small = large.join(smaller, large["a"] == smaller["u"]).select("a", "b", "m")
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, (held, _, now) = held, _summed(moved, "stars")
        discard(before, least, large, smaller)
        if now == state:
            return held
        state = now
