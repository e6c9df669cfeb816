"""Exact top-k by inner product with MaxScore over blocks of a sharded index.

A vector is a query of signed terms, one a dimension.  Each shard keeps for
every dimension its postings (values in row order) and their bounds.  For a
query the terms are ordered by the most they can add in that shard; the fewest
leading terms whose removal would let nothing compete are essential and their
postings are traversed for all rows; the others are probed, a few at a time,
only for rows whose score so far plus the bounds of what is left still reaches
the query's k-th best.  Shards' best rows are merged.

Blocks of queries are broadcast, as many at a time as a bound in bytes allows,
so no row of the index is shuffled and every pass reads it once.  A query's
floor, its k-th best score so far, begins with a pilot shard and is carried from
shard to shard within a task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import written

#: Rows of an index shard, queries of a block, and dimensions probed between two prunings.
SHARD, BLOCK, PROBE = 2048, 256, 8
#: Bytes of query vectors that are broadcast together, at most (one block at least); more queries make more passes.
TOGETHER = 64 << 20
#: Below any score.
LEAST = -(2**62)


def quantised(table: DataFrame, key: str, vector: str, scale: float = 256.0) -> DataFrame:
    """``key`` and ``v`` array<long>: floor(scale * x) of each component; rows with a null key, a null vector, or a null or non-finite component are left out."""
    finite = "forall({0}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))".format(f"`{vector}`")
    rows = table.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & F.expr(finite))
    return rows.select(F.col(f"`{key}`").cast("long").alias("key"), F.expr(f"transform(`{vector}`, x -> bigint(floor({scale}D * double(x))))").alias("v"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (key, v) in blocks (width, ids, vectors) of at most ``size`` rows of one width."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            values, widths = lists.values.to_numpy(), np.diff(offsets)
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                for cut in range(0, len(at), size):
                    some = at[cut : cut + size]
                    block = values[offsets[some][:, None] + np.arange(width)] if width else np.zeros((len(some), 0), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([width], pa.int64()), pa.array([keys[some].astype("<i8").tobytes()], pa.binary()), pa.array([block.astype("<i8").tobytes()], pa.binary())], ["width", "ids", "vectors"])

    return rows.select("key", "v").mapInArrow(run, "width long, ids binary, vectors binary")


def _unpacked(width: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, "<i8")
    return keys, np.frombuffer(vectors, "<i8").reshape(len(keys), width)


def search_shard(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None, probe: int = PROBE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of one shard for each query, as (query row, shard row, score); without those below the query's floor."""
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    peak = sum(int(a) * int(b) for a, b in zip(np.abs(vectors).max(axis=0), np.abs(queries).max(axis=0)))
    exact = np.float64 if peak < 2**53 else np.int64  # doubles are faster and exact below
    postings = np.ascontiguousarray(vectors.T.astype(exact))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for number, query in enumerate(queries):
        order = np.argsort(np.abs(query) * (high - low), kind="stable")[::-1]
        weights = query.astype(exact)
        bounds = np.sort(np.stack((query * low, query * high)), axis=0)[:, order]
        # the least that the terms before each place add, and the most that those from it on can
        least = np.concatenate(([0], np.cumsum(bounds[0])))
        rest = np.concatenate((np.cumsum(bounds[1][::-1])[::-1], [0]))
        rows = np.arange(len(ids))
        floor = LEAST if floors is None else int(floors[number])
        lead = weights[order[:probe]] @ postings[order[:probe]]
        if len(rows) > k:
            # full scores of the rows that lead on the widest terms may raise the floor
            floor = max(floor, int((weights @ postings[:, np.argpartition(lead, -k)[-k:]]).min()))
        # essential: as many terms as it takes until the others alone reach the floor for no row
        below = np.flatnonzero(least + rest < floor)
        done = max(min(probe, len(order)), int(below[0]) if len(below) else len(order))
        score = lead if done <= probe else weights[order[:done]] @ postings[order[:done]]
        while True:
            competes = score + rest[done] >= floor
            rows, score = rows[competes], score[competes]
            if done == len(order):
                break
            terms = order[done : done + probe]
            score = score + weights[terms] @ postings[np.ix_(terms, rows)]
            done = min(len(order), done + probe)
        # ties at the k-th score go to the smaller id
        best = np.lexsort((ids[rows], -score))[:k]
        found.append((rows[best], score[best]))
    counts = [len(rows) for rows, _ in found]
    return np.repeat(np.arange(len(found)), counts), np.concatenate([r for r, _ in found]), np.concatenate([s for _, s in found]).astype(np.int64)


class Floors:
    """The k best scores so far of each query of one block, and a floor known before.

    Rows behind the known floor may come again, so their scores are not among the best.
    """

    def __init__(self, queries: int, k: int, known: bytes | None):
        self.best = np.full((queries, k), LEAST)
        self.known = np.full(queries, LEAST) if known is None else np.frombuffer(known, "<i8")

    def raised(self, query: np.ndarray, score: np.ndarray) -> None:
        """Take in further scores, which come in the order of queries."""
        counts = np.bincount(query, minlength=len(self.best))
        wide = np.full((len(self.best), int(counts.max(initial=0))), LEAST)
        wide[query, np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)] = score
        k = self.best.shape[1]
        self.best = -np.sort(-np.concatenate((self.best, wide), axis=1), axis=1)[:, :k]

    def __call__(self) -> np.ndarray:
        return np.maximum(self.best[:, -1], self.known)


def _searched(shards: DataFrame, blocks: DataFrame, k: int, pilot: bool) -> DataFrame:
    """Every shard against every broadcast block of its width: (block, place, query_id, vec_id, score, own) of the k best, or of a pilot the floors (block, floors)."""
    pairs = shards.join(F.broadcast(blocks.withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})), "width").select("width", "ids", "vectors", "block", "q_ids", "q_vectors", "floors")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, Floors] = {}
        for batch in batches:
            for width, ids, vectors, block, q_ids, q_vectors, known in zip(*(c.to_pylist() for c in batch.columns)):
                keys, rows = _unpacked(width, ids, vectors)
                query_ids, queries = _unpacked(width, q_ids, q_vectors)
                held = floors.setdefault(block, Floors(len(queries), k, known))
                q, r, s = search_shard(keys, rows, queries, k, held())
                held.raised(q, s)
                if pilot:
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([held().astype("<i8").tobytes()], pa.binary())], ["block", "floors"])
                    continue
                own = (keys[r] == query_ids[q]) & (rows[r] == queries[q]).all(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), block)), pa.array(q.astype(np.int32)), pa.array(query_ids[q]), pa.array(keys[r]), pa.array(s), pa.array(own)], ["block", "place", "query_id", "vec_id", "score", "own"])

    return pairs.mapInArrow(run, "block long, floors binary" if pilot else "block long, place int, query_id long, vec_id long, score long, own boolean")


def top_k(queries: DataFrame, candidates: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """The k candidates of the highest inner product for every query row.

    Both sides are (key long, v array<long>), as :func:`quantised` makes them.  A
    query does not answer itself: one candidate row of its key and vector, if
    there is one, is left out; further rows of that key are answers as any other,
    and query rows that share a key are queries of their own.  Vectors of
    different width never meet; empty ones score 0 against each other.  Returns
    query_id, rank (from 1), vec_id, score; ties go to the smaller key.  A query
    with fewer candidates has them all; one with none has no row.
    """
    least = max(1, -(-queries.count() // (16 * block)))
    blocks = written(_packed(queries.repartition(least), block).withColumn("block", F.monotonically_increasing_id()), "blocks")
    passes = max(1, -(-(blocks.agg(F.sum(F.octet_length("vectors") + F.octet_length("ids"))).first()[0] or 0) // together))
    found = []
    for number in range(passes):
        some = blocks.where(F.pmod(F.xxhash64("block"), F.lit(passes)) == number)
        pilot = _searched(_packed(candidates.limit(shard), shard), some.withColumn("floors", F.lit(None).cast("binary")), k + 1, True).groupBy("block").agg(F.max("floors").alias("floors"))
        found.append(_searched(_packed(candidates, shard), some.join(F.broadcast(pilot), "block", "left"), k + 1, False))
    of_query = Window.partitionBy("block", "place")
    ranked = functools.reduce(DataFrame.union, found).withColumn("n", F.row_number().over(of_query.orderBy(F.col("score").desc(), "vec_id"))).where(F.col("n") <= k + 1)
    # k + 1 are enough, as one of them at most is the query itself
    itself = F.coalesce(F.min(F.when(F.col("own"), F.col("n"))).over(of_query), F.lit(k + 2))
    others = ranked.withColumn("itself", itself).where("n <> itself").withColumn("rank", (F.col("n") - F.when(F.col("n") > F.col("itself"), 1).otherwise(0)).cast("int"))
    return others.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
