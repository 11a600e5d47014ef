"""Exact nearest neighbours by a join of blocks of vectors.

Vectors are normalised and rounded to int8, with the length of what rounding left out. The
product of two blocks of int8 numbers gives, for each pair, an interval that holds the cosine.
A pair whose upper end is below the k-th largest lower end of its query can't be among the
nearest; the others are recomputed in double precision from the vectors as they were given. A
task goes through all blocks of candidates dealt to it with one heap for each query; the heaps
of all tasks are merged at the end.

Queries come in strips of many blocks, and each block of candidates travels once for each strip.
Vectors travel as 32-bit numbers where these hold them exactly.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.llm.common import map_batches, map_groups
from shopflow.sources.scratch import stored

BLOCK = 2048  # candidates of a tile
STRIP = 8192  # queries that a block of candidates travels with
QUERIES = 512  # of a tile


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the lengths of what rounding left out of the unit vectors."""
    # Scaled first: squares of very large or small numbers leave the range of doubles.
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127.0
    small = np.rint(unit / scale[:, None])
    lost = np.sqrt(((unit - small * scale[:, None]) ** 2).sum(axis=1))
    return small.astype(np.int8), scale, lost


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with the vector ``y``; equal rows give equal values."""
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max()
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * math.sqrt((y * y).sum()))


def valid(vector: Column) -> Column:
    """Not null, and of finite components that are not all zero."""
    value = vector.cast("array<double>")
    finite = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(finite & F.exists(value, lambda v: v != 0.0), F.lit(False))


def exactly(vectors: np.ndarray) -> tuple[str, bytes]:
    """Vectors as 32-bit numbers if that changes none, else as 64-bit ones."""
    with np.errstate(over="ignore"):
        small = vectors.astype("<f4")
    kind = "<f4" if (small.astype(np.float64) == vectors).all() else "<f8"
    return kind, vectors.astype(kind).tobytes()


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of about ``size`` rows: dimension, block number, row numbers, ids and vectors as bytes."""
    sizes = rows.groupBy("dimension").agg(F.ceil(F.count("*") / size).alias("blocks"))
    dealt = rows.join(sizes, "dimension").withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
    made = {"dimension": "int", "block": "long", "rows": "binary", "ids": "binary", "kind": "string", "vectors": "binary"}

    def pack(key: tuple, members: list[tuple]) -> list[tuple]:
        row, ids, vectors = zip(*members, strict=True)
        whole = np.array(row, np.int64).tobytes(), np.array(ids, np.int64).tobytes()
        return [(*key, *whole, *exactly(np.array(vectors, np.float64)))]

    return stored(map_groups(dealt, ["dimension", "block"], ["row", "id", "vector"], made, pack), name)


class Nearest:
    """The k nearest candidates of each query row met so far: heaps of (score, -id, row)."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.heaps: dict[int, list[tuple[float, int, int]]] = {}

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        heap = self.heaps.setdefault(query, [])
        for entry in zip(scores.tolist(), (-ids).tolist(), rows.tolist(), strict=True):
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def floor(self, query: int) -> float:
        """A candidate below this score can't enter."""
        heap = self.heaps.get(query, ())
        return heap[0][0] if len(heap) == self.k else -2.0

    def tile(self, query_rows, queries, rows, ids, vectors) -> None:
        q, q_scale, q_lost = quantised(queries)
        c, c_scale, c_lost = quantised(vectors)
        # Products of int8 numbers are whole, and exact in float32 up to 2**24.
        exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
        about = (q.astype(exact) @ c.astype(exact).T).astype(np.float64)
        about *= q_scale[:, None]
        about *= c_scale
        # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|, and |x'| <= 1 + |x - x'|.
        error = q_lost[:, None] + (1.0 + q_lost[:, None]) * c_lost + 1e-9
        k = self.k + 1  # one of them may be the query itself
        low = about - error
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -2.0)
        high = about + error
        for i, query in enumerate(query_rows.tolist()):
            alive = np.flatnonzero((high[i] >= kth[i]) & (high[i] >= self.floor(query)))
            alive = alive[rows[alive] != query]
            if len(alive):
                self.add(query, cosines(vectors[alive], queries[i]), ids[alive], rows[alive])


def nearest(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """The ``k`` candidates of largest cosine for each query, nearest first.

    ``rows``: id (long) and vector; ``is_query`` says which ids are queries. Candidates of a
    query are all rows but its own, of the same dimension. Vectors that are null, zero or hold
    a null or non-finite component take no part, nor do null ids. A repeated id is a candidate,
    and if it is a query a query, for each of its rows. Ties go to the smaller id. Returns
    query_id, rank (from 1), id, score and query_row, which tells repeated queries apart; a query
    without candidates has no row.
    """
    usable = rows.where(F.col("id").isNotNull() & valid(F.col("vector")))
    usable = usable.select("id", F.col("vector").cast("array<double>").alias("vector"))
    usable = usable.withColumns({"dimension": F.size("vector"), "row": F.monotonically_increasing_id()})
    usable = stored(usable, "vectors")
    candidates = packed(usable, BLOCK, "candidates")
    named = [F.col(c).alias(f"query_{c}") for c in ("block", "rows", "kind", "vectors")]
    queries = packed(usable.where(is_query), STRIP, "queries").select("dimension", *named)
    # The tiles: each strip of queries meets each block of candidates of its dimension.
    strips = queries.groupBy("dimension").agg(F.max("query_block").alias("last"))
    spread = candidates.drop("block").join(strips, "dimension").withColumn(
        "query_block", F.explode(F.sequence(F.lit(0).cast("long"), "last"))
    )
    tiles = spread.join(queries, ["dimension", "query_block"]).select(
        "dimension", "rows", "ids", "kind", "vectors", "query_rows", "query_kind", "query_vectors"
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = tiles.repartition(parts)

    def start():
        def make(batch):
            found = Nearest(k)

            def whole(data, kind, d):
                return np.frombuffer(data, kind).reshape(-1, d).astype(np.float64)

            for d, rows, ids, kind, vectors, query_rows, query_kind, queries in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                rows, ids, query_rows = (np.frombuffer(x, np.int64) for x in (rows, ids, query_rows))
                vectors, queries = whole(vectors, kind, d), whole(queries, query_kind, d)
                for q in range(0, len(query_rows), QUERIES):
                    found.tile(query_rows[q : q + QUERIES], queries[q : q + QUERIES], rows, ids, vectors)
            out = [(q, -i, s) for q, heap in found.heaps.items() for s, i, _ in heap]
            return [], [list(c) for c in zip(*out, strict=True)] if out else [[], [], []]

        return make

    near = map_batches(tiles, [], {"query_row": "long", "id": "long", "score": "double"}, start, at_once=64)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = usable.where(is_query).select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return ranked.join(names, "query_row").select("query_id", "rank", "id", "score", "query_row")
