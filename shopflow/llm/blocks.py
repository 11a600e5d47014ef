"""Whole-number vectors in blocks, and blocks met by strips of queries.

Rows get a number of their own, so repeated ids stay apart. They are dealt to the reference
vector of a bounded sample that they lie nearest to, and each reference's rows to blocks of
bounded size. A strip holds many queries, since each block travels once for each strip that has
to see it.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.llm.common import map_batches, map_groups
from shopflow.sources.scratch import stored

SAMPLE = 2048  # rows that references are chosen from
STRIP = 16384  # queries in a strip
PAGE = 1024  # blocks in a page of the directory


def finite(vector: Column) -> Column:
    """Not null, and of finite components."""
    value = vector.cast("array<double>")
    fits = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(fits, F.lit(False))


def whole_vectors(rows: DataFrame, factor: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, id, ``keep``, dimension, vector): components are floor(factor * x) with x as double.

    Rows with a null id, and those whose vector is null or has a null or non-finite component,
    are left out. Vectors whose squares add up to 2**62 or more are an error, as their products
    may leave 64 bits.
    """
    usable = rows.where(F.col("id").isNotNull() & finite(F.col("vector")))
    scaled = F.transform(F.col("vector").cast("array<double>"), lambda v: F.floor(F.lit(float(factor)) * v).cast("double"))
    squares = F.aggregate("vector", F.lit(0.0), lambda t, v: t + v * v)
    kept = usable.select("id", *keep, scaled.alias("vector")).withColumn("square", squares)
    large = F.raise_error(F.lit("components are too large: products may leave 64 bits")).cast("array<bigint>")
    fits = F.when(F.col("square") < 2.0**62, F.col("vector").cast("array<bigint>")).otherwise(large)
    kept = kept.select(
        F.monotonically_increasing_id().alias("row"), "id", *keep, F.size("vector").alias("dimension"), fits.alias("vector")
    )
    return stored(kept, "vectors")


def matrices(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row indexes and matrix (int64) of the vectors of each dimension of a batch."""
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy()
    lengths = np.diff(offsets)
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield at, values[offsets[at][:, None] + np.arange(d)].reshape(len(at), d)


def sampled(items: DataFrame) -> dict[int, np.ndarray]:
    """A bounded sample of the vectors, by a hash of the id: a matrix for each dimension."""
    chosen = items.orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE).select("vector").collect()
    by_size: dict[int, list] = {}
    for r in chosen:
        by_size.setdefault(len(r["vector"]), []).append(r["vector"])
    return {d: np.array(v, np.float64).reshape(len(v), d) for d, v in by_size.items()}


def spread_out(distance: Callable[[int], np.ndarray], n: int, wanted: int) -> list[int]:
    """Indexes of at most ``wanted`` of ``n`` items, each as far as can be from those before it."""
    if n == 0:
        return []
    chosen = [0]
    nearest = distance(0)
    while len(chosen) < min(wanted, n) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distance(chosen[-1]))
    return chosen


def narrow(vectors: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the narrowest type that holds them."""
    top = int(np.abs(vectors).max()) if vectors.size else 0
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind, vectors.astype(kind).tobytes()


def wide(kind: str, data: bytes, dimension: int, count: int, top: float) -> np.ndarray:
    """The numbers, as doubles where products are exact in these: ``top`` is the largest square of a length."""
    vectors = np.frombuffer(data, kind).reshape(count, dimension)
    return vectors.astype(np.float64 if top < 2.0**52 else np.int64)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products (int64) of rows with a query of whole numbers."""
    if vectors.dtype == query.dtype == np.float64:
        return (vectors @ query).astype(np.int64)
    return vectors.astype(np.int64) @ query.astype(np.int64)


class Best:
    """The k best of a query so far, as (score, -id, row)."""

    def __init__(self, k: int, floor: int | None) -> None:
        self.k, self.heap, self.least = k, [], floor

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(scores) > self.k:
            good = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
            scores, ids, rows = scores[good], ids[good], rows[good]
        for entry in zip(scores.tolist(), (-ids).tolist(), rows.tolist(), strict=True):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)

    def floor(self) -> int | None:
        """A lower score can't be among the k best."""
        known = [x for x in (self.least, self.heap[0][0] if len(self.heap) == self.k else None) if x is not None]
        return max(known) if known else None


def in_blocks(rows: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """``rows`` with ``name``: a text that names a block of about ``size`` rows of equal ``keys``."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("blocks"))
    sizes = stored(sizes, "sizes")
    part = F.pmod(F.xxhash64("row"), "blocks")
    return rows.join(sizes, keys).withColumn(name, F.concat_ws("/", *keys, part)).drop("blocks")


def packed(rows: DataFrame, key: str, values: list[str], made: dict[str, str], make: Callable) -> DataFrame:
    """A row for each block, stored: dimension, ``key``, and what ``make`` returns for its rows."""
    kinds = {"dimension": "int", key: "string", **made}
    return stored(map_groups(rows, ["dimension", key], values, kinds, lambda k, m: [(*k, *make(k[0], m))]), key)


def directory(blocks: DataFrame, values: list[str]) -> DataFrame:
    """Pages of (block, ``values``) of up to about PAGE blocks: arrays of bytes, a page for each row."""
    pages = blocks.groupBy("dimension").agg(F.ceil(F.count("*") / PAGE).alias("pages"))
    dealt = blocks.select("dimension", "block", *values).join(pages, "dimension")
    dealt = dealt.withColumn("page", F.pmod(F.xxhash64("block"), "pages"))
    gathered = F.array_sort(F.collect_list(F.struct("block", *values)))
    return stored(dealt.groupBy("dimension", "page", "pages").agg(gathered.alias("entries")), "directory")


def with_pages(strips: DataFrame, pages: DataFrame) -> DataFrame:
    """Each strip with each page of the directory of its dimension; pages hold bounds, not rows."""
    counts = pages.groupBy("dimension").agg(F.max("pages").alias("pages"))
    spread = strips.join(counts, "dimension").withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)))
    return spread.drop("pages").join(pages.drop("pages"), ["dimension", "page"]).repartition(parts(strips))


def parts(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def chosen_places(near: DataFrame, strips: DataFrame) -> DataFrame:
    """(strip, block, chosen): the places in the strips of the rows that ``near`` (strip, row, block) names."""

    def start():
        def make(batch):
            index, made = [], []
            column = batch.column(batch.schema.get_field_index("query_rows"))
            for at, data in enumerate(column.to_pylist()):
                rows = np.frombuffer(data, np.int64)
                index += [at] * len(rows)
                made += zip(rows.tolist(), range(len(rows)), strict=True)
            return index, [list(c) for c in zip(*made, strict=True)] if made else [[], []]

        return make

    places = map_batches(strips, ["strip"], {"row": "long", "place": "int"}, start, at_once=1)
    joined = near.join(places, ["strip", "row"])
    return joined.groupBy("strip", "block").agg(F.sort_array(F.collect_list("place")).alias("chosen"))
