"""Hard negatives by angular triangle filtering.

Each row stores its angles to a few reference directions. The angle between two rows lies between
the largest difference and the smallest sum of their angles to a direction, so its cosine lies in
an interval; times both lengths, with room for rounding, that bounds their inner product. Only
rows whose bounds overlap the scores that are looked for are scored, in whole numbers. The same
bounds, from the least and largest angles and lengths of a block, leave out blocks.

Anchors first look for their nearest rows of the same label, their positives, then for rows of
other labels whose scores lie in a window below each positive's. Both go in two steps: a block near
the anchor gives a floor, and the directory of blocks says which others the anchor must see.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.llm import blocks as b
from shopflow.llm.common import map_batches
from shopflow.sources.scratch import stored

DIRECTIONS = 8
BLOCK = 2048  # rows of a block, about

#: Columns of a block: what travels to a task that scores rows, and what the directory holds.
ROWS = ("ids", "rows", "labels", "kind", "vectors", "angles")
BOUNDS = ("low", "high", "shortest", "longest")


def room(dimension: int) -> float:
    """More than rounding changes an angle, also one kept as a 32-bit number."""
    return 1e-6 + 4.0 * math.sqrt(2.3e-16 * (dimension + 4))


def lengths(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def angles(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles to unit vectors, a column for each; those of a zero vector, which has none, are right."""
    long = lengths(vectors)
    cosine = (vectors.astype(np.float64) @ directions.T) / np.where(long > 0, long, 1.0)[:, None]
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def cosine_bounds(one: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest cosine between vectors of angles ``one`` and ones of angles from ``low`` to ``high``."""
    apart = np.maximum(one - high, low - one).max(axis=-1, initial=0.0) - 2 * slack
    widest = np.clip(math.pi - one, low, high)
    together = np.minimum(one + widest, 2 * math.pi - one - widest).min(axis=-1, initial=math.pi) + 2 * slack
    return np.cos(np.minimum(together, math.pi)), np.cos(np.maximum(apart, 0.0))


def score_bounds(least: np.ndarray, most: np.ndarray, own: np.ndarray, short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score, rounded outwards, from cosines, a length, and another between two bounds."""
    low = own * np.where(least > 0, short, long) * least
    high = own * np.where(most > 0, long, short) * most
    extra = 1.0 + 1e-9 * own * long
    return low - extra, high + extra


def directions_of(items: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors far apart, from a bounded sample, for each dimension that it holds."""
    found = {}
    for d, sample in b.sampled(items).items():
        sample = sample[lengths(sample) > 0]
        unit = sample / lengths(sample)[:, None]
        found[d] = unit[b.spread_out(lambda i, u=unit: np.maximum(0.0, 1.0 - u @ u[i] - 1e-9), len(unit), DIRECTIONS)]
    return found


def regions(items: DataFrame, directions: dict[int, np.ndarray]) -> DataFrame:
    """(row, id, label, dimension, region, data): vectors as bytes; the region is the nearest direction, -1 without any."""

    def start():
        def make(batch):
            region, size, data = np.full(len(batch), -1), np.zeros(len(batch), np.int64), [b""] * len(batch)
            for at, vectors in b.matrices(batch.column(batch.schema.get_field_index("vector"))):
                size[at] = vectors.shape[1]
                if len(known := directions.get(vectors.shape[1], ())):
                    region[at] = angles(vectors, known).argmin(axis=1)
                for i, v in zip(at.tolist(), vectors, strict=True):
                    data[i] = v.tobytes()
            return None, [size, region, data]

        return make

    made = {"dimension": "int", "region": "int", "data": "binary"}
    return stored(map_batches(items, ["row", "id", "label"], made, start), "regions")


def measured(placed: DataFrame, directions: dict[int, np.ndarray]) -> DataFrame:
    """Blocks of rows with their angles, and the bounds of these."""

    def make(dimension: int, members: list[tuple]) -> tuple:
        row, ids, labels, data = zip(*members, strict=True)
        vectors = np.frombuffer(b"".join(data), np.int64).reshape(len(row), dimension)
        kind, small = b.narrow(vectors)
        known = directions.get(dimension, np.zeros((0, dimension)))
        own, long = angles(vectors, known).astype(np.float32), lengths(vectors)
        low, high = own.min(axis=0).astype(np.float64), own.max(axis=0).astype(np.float64)
        arrays = (np.array(x, np.int64).tobytes() for x in (ids, row, labels))
        return *arrays, kind, small, own.tobytes(), low.tobytes(), high.tobytes(), float(long.min()), float(long.max())

    made = {c: "string" if c == "kind" else "binary" for c in (*ROWS, *BOUNDS[:2])} | dict.fromkeys(BOUNDS[2:], "double")
    return b.packed(b.in_blocks(placed, ["dimension", "region"], BLOCK, "block"), "block", ["row", "id", "label", "data"], made, make)


def strips(anchors: DataFrame, width: int) -> DataFrame:
    """Strips of anchors: rows, labels, vectors, and windows of scores: ``width`` pairs of ends, low above high for none."""

    def make(_: int, members: list[tuple]) -> tuple:
        row, label, data, windows = zip(*members, strict=True)
        ends = np.array([w[: 2 * width] for w in windows], np.int64)
        return np.array(row, np.int64).tobytes(), np.array(label, np.int64).tobytes(), b"".join(data), ends.tobytes()

    made = dict.fromkeys(("query_rows", "query_labels", "queries", "windows"), "binary")
    return b.packed(b.in_blocks(anchors, ["dimension"], b.STRIP, "strip"), "strip", ["row", "label", "data", "windows"], made, make)


LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


class Anchors:
    """A strip as a task reads it."""

    def __init__(self, d: int, rows: bytes, labels: bytes, queries: bytes, windows: bytes, directions: np.ndarray) -> None:
        self.rows, self.labels = np.frombuffer(rows, np.int64), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(queries, np.int64).reshape(len(self.rows), d)
        self.windows = np.frombuffer(windows, np.int64).reshape(len(self.rows), -1, 2)
        self.angles, self.lengths = angles(self.vectors, directions), lengths(self.vectors)
        self.room = room(d)


def to_see(strips: DataFrame, pages: DataFrame, directions: dict[int, np.ndarray]) -> DataFrame:
    """Pairs of a strip and a block with scores that may lie in a window of some of its anchors, and of which."""

    def start():
        def make(batch):
            index, made = [], []
            names = ("dimension", "query_rows", "query_labels", "queries", "windows", "entries")
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)
            for at, (d, *strip, entries) in enumerate(zip(*columns, strict=True)):
                a = Anchors(d, *strip, directions.get(d, np.zeros((0, d))))
                some = (a.windows[..., 0] <= a.windows[..., 1]).any(axis=1)
                wanted = a.windows[..., 0].min(axis=1), a.windows[..., 1].max(axis=1)
                for e in entries:
                    ends = np.frombuffer(e["low"], np.float64), np.frombuffer(e["high"], np.float64)
                    cosines = cosine_bounds(a.angles, *ends, a.room)
                    low, high = score_bounds(*cosines, a.lengths, e["shortest"], e["longest"])
                    chosen = np.flatnonzero(some & (high >= wanted[0]) & (low <= wanted[1]))
                    if len(chosen):
                        index.append(at)
                        made.append((e["block"], chosen.tolist()))
            return index, [list(c) for c in zip(*made, strict=True)] if made else [[], []]

        return make

    return map_batches(b.with_pages(strips, pages), ["strip"], {"block": "string", "chosen": "array<int>"}, start, at_once=1)


class Block:
    """A block as a task reads it, and the search in it."""

    def __init__(self, d: int, top: float, ids: bytes, rows: bytes, labels: bytes, kind: str, vectors: bytes, own: bytes) -> None:
        self.ids, self.rows, self.labels = (np.frombuffer(x, np.int64) for x in (ids, rows, labels))
        self.vectors = b.wide(kind, vectors, d, len(self.ids), top)
        self.angles = np.ascontiguousarray(np.frombuffer(own, np.float32).reshape(len(self.ids), -1).T)
        self.lengths, self.room = lengths(self.vectors), room(d)
        self.scored = 0

    def cosines(self, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest cosine of each row with a vector of these angles: a row's angles are points."""
        one = one.astype(np.float32)[:, None]
        apart = np.abs(self.angles - one).max(axis=0, initial=0.0) - 2 * self.room
        together = math.pi - np.abs(self.angles - (np.float32(math.pi) - one)).max(axis=0, initial=0.0) + 2 * self.room
        return np.cos(np.minimum(together, math.pi)), np.cos(np.maximum(apart, 0.0))

    def search(self, a: Anchors, i: int, same: bool, windows: list[tuple[int, int]], best: list[b.Best]) -> None:
        """Adds rows of the same label as the anchor, or of others, whose scores lie in windows."""
        from_ = [max(low, x.floor() or LOWEST) for (low, _), x in zip(windows, best, strict=True)]
        least, most = min(from_), max(high for _, high in windows)
        low, high = score_bounds(*self.cosines(a.angles[i]), a.lengths[i], self.lengths, self.lengths)
        fits = (high >= least) & (low <= most) & ((self.labels == a.labels[i]) == same) & (self.rows != a.rows[i])
        at = np.flatnonzero(fits)
        self.scored += len(at)
        scores = b.products(self.vectors[at], a.vectors[i].astype(self.vectors.dtype))
        for start, (_, end), x in zip(from_, windows, best, strict=True):
            good = (scores >= start) & (scores <= end)
            x.add(scores[good], self.ids[at[good]], self.rows[at[good]])


def searched(
    pairs: DataFrame, strips: DataFrame, blocks: DataFrame, directions: dict, top: float, same: bool, k: int
) -> DataFrame:
    """(query, slot, row, id, score): the ``k`` best that each task finds for each window (slot) of an anchor."""
    tiles = pairs.join(strips.drop("dimension"), "strip").join(blocks.drop(*BOUNDS), "block")
    names = ("dimension", "query_rows", "query_labels", "queries", "windows", "chosen", *ROWS)
    tiles = tiles.select(*names).repartition(b.parts(pairs))

    def start():
        def make(batch):
            found: dict[int, list[b.Best]] = {}
            for d, *strip, chosen, ids, rows, labels, kind, vectors, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = Anchors(d, *strip, directions.get(d, np.zeros((0, d))))
                here = Block(d, top, ids, rows, labels, kind, vectors, own)
                for i in chosen:
                    windows = [(int(low), int(high)) for low, high in a.windows[i]]
                    best = found.setdefault(int(a.rows[i]), [b.Best(k, None) for _ in windows])
                    here.search(a, i, same, windows, best)
            out = [(q, j, r, -n, s) for q, best in found.items() for j, x in enumerate(best) for s, n, r in x.heap]
            return [], [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(5)]

        return make

    made = {"query": "long", "slot": "int", "row": "long", "id": "long", "score": "long"}
    return map_batches(tiles, [], made, start, at_once=64)


def in_two_steps(anchors: DataFrame, blocks: DataFrame, pages: DataFrame, directions: dict, top: float, same: bool, k: int, width: int) -> DataFrame:
    """(query, slot, place, row, id, score): the ``k`` best rows of each window, place from 1.

    ``anchors``: row, dimension, region, label, data, windows.
    """
    made = strips(anchors, width)
    near = b.in_blocks(anchors, ["dimension"], b.STRIP, "strip")
    near = near.select("strip", "row", F.concat_ws("/", "dimension", "region", F.lit(0)).alias("block"))
    first = stored(searched(b.chosen_places(near, made), made, blocks, directions, top, same, k), "first")
    floors = ranked(first, k).where(F.col("place") == k).select("query", "slot", F.col("score").alias("floor"))
    floors = floors.groupBy(F.col("query").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("floors"))
    raised = F.transform(
        F.sequence(F.lit(0), F.lit(2 * width - 1)),
        lambda j: F.when(
            (j % 2 == 0) & F.col("floors").isNotNull(),
            F.greatest(F.get("windows", j), F.try_element_at("floors", F.floor(j / 2).cast("int"))),
        ).otherwise(F.get("windows", j)),
    )
    again = stored(anchors.join(floors, "row", "left").withColumn("windows", raised).drop("floors"), "anchors")
    made = strips(again, width)
    return ranked(searched(to_see(made, pages, directions), made, blocks, directions, top, same, k), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    factor: int = 256,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
) -> DataFrame:
    """The best rows of other labels in a window below each positive of each anchor.

    ``rows``: id (long), vector, label (long); ``is_anchor`` says which ids are anchors. Components
    become floor(factor * x); a score is the inner product with the anchor, higher ones first, ties
    by smaller id. Positives of an anchor are its first other rows of the same label. Negatives of
    a positive are the first rows of other labels with least * p <= 100 * n <= most * p, p and n
    the scores; for p below 0 there are none. Rows with a null id or label, or a vector that is
    null or holds a null or non-finite component, take no part, nor do those of another dimension
    than the anchor's. A repeated id is a row, and if it is one an anchor, for each time. Returns
    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score, and
    anchor_row and positive_row, which tell repeated ids apart.
    """
    items = b.whole_vectors(rows.where(F.col("label").isNotNull()), factor, ("label",))
    square = F.aggregate("vector", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double"))
    top = float(items.agg(F.max(square).alias("top")).first()["top"] or 0.0)
    directions = directions_of(items)
    placed = regions(items.withColumn("label", F.col("label").cast("long")), directions)
    blocks = measured(placed, directions)
    pages = b.directory(blocks, list(BOUNDS))
    anchors = stored(placed.where(is_anchor), "anchors")
    whole = F.array(F.lit(LOWEST), F.lit(HIGHEST))
    near = in_two_steps(anchors.withColumn("windows", whole), blocks, pages, directions, top, True, positives, 1)
    near = stored(near.select("query", "place", "row", "id", "score"), "positives")

    nothing = F.array(F.lit(HIGHEST), F.lit(LOWEST))
    scores = near.groupBy(F.col("query").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("scores"))
    windows = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(positives)),
            lambda j: F.coalesce(F.when(F.try_element_at("scores", j) >= 0, window(F.try_element_at("scores", j), least, most)), nothing),
        )
    )
    sought = stored(anchors.join(scores, "row").withColumn("windows", windows).drop("scores"), "sought")
    found = in_two_steps(sought, blocks, pages, directions, top, False, negatives, positives)
    found = found.select("query", (F.col("slot") + 1).alias("place"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    chosen = near.select("query", "place", F.col("row").alias("positive_row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("row").alias("query"), F.col("id").alias("anchor_id"))
    out = found.join(chosen, ["query", "place"]).join(names, "query")
    return out.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("query").alias("anchor_row"), "positive_row"
    )


def window(score: Column, least: int, most: int) -> Column:
    """First and last whole score n with least * score <= 100 * n <= most * score."""
    exact = score.cast("decimal(20, 0)")
    return F.array(F.ceil(exact * least / 100).cast("long"), F.floor(exact * most / 100).cast("long"))
