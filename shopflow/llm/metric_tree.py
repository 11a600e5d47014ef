"""Exact top-k by inner product: best-first search of M-trees.

Rows are points in a metric space: a coordinate sqrt(M - |x|^2), with M the largest square of a
length, is added to each, and 0 to queries. Then |q - x|^2 = |q|^2 + M - 2 q.x, so the nearest
points are those of the largest product. A tree holds a block of rows. Its nodes are pages with a
routing object, a covering radius and the distance to the parent's routing object; entries of
leaves keep the distance to their page's. A search takes pages in the order of their least
possible distance and stops when that is beyond the k-th best. A child or an entry whose stored
distance shows, by the triangle inequality, that it lies too far gets no distance computed. Bounds
are in doubles with room for rounding; scores are exact products of whole numbers.

The roots of all trees with their radii form the pages of a directory. Queries first search a tree
near them, which gives each a floor; the directory then says which other trees they must see.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.llm import blocks as b
from shopflow.llm.common import map_batches
from shopflow.sources.scratch import stored

TREE = 4096  # rows of a tree, about
LEAF = 128  # entries of a leaf
FANOUT = 64  # children of a page
REGIONS = 256  # reference vectors at most
REGION_ROWS = 4096  # rows for each reference, until there are REGIONS

NODE = np.dtype(
    [("object", "<i4"), ("first", "<i4"), ("last", "<i4"), ("leaf", "?"), ("radius", "<f8"), ("to_parent", "<f8")]
)


def slack(dimension: int, top: float) -> float:
    """More than rounding can change a distance of points whose squares are at most ``top``."""
    return 4.0 * math.sqrt(2.3e-16 * (dimension + 4) * (top + 1.0))


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Points with the added coordinate."""
    x = vectors.astype(np.float64)
    last = np.sqrt(np.maximum(0.0, top - np.einsum("ij,ij->i", x, x)))
    return np.concatenate([x, last[:, None]], axis=1)


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    difference = points - centre
    return np.sqrt(np.einsum("ij,ij->i", difference, difference))


def built(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the entries, their distances to their leaf's routing object, and the nodes; the root is first.

    A page with more than LEAF entries is split around routing objects chosen far apart; where
    that separates nothing (equal points), into parts of equal size.
    """
    order = np.arange(len(points))
    to_leaf = np.zeros(len(points))
    nodes: list[tuple] = []

    def medoid(span: np.ndarray) -> int:
        return int(span[distances(points[span], points[span].mean(axis=0)).argmin()])

    def page(first: int, last: int, obj: int, parent: int) -> tuple:
        far = distances(points[order[first:last]], points[obj])
        return (obj, first, last, True, far.max(), float(distances(points[obj][None], points[parent])[0]))

    root = medoid(order)
    nodes.append(page(0, len(points), root, root))
    k = 0
    while k < len(nodes):
        obj, first, last, _, radius, to_parent = nodes[k]
        span = order[first:last].copy()
        if len(span) <= LEAF:
            to_leaf[first:last] = distances(points[span], points[obj])
            k += 1
            continue
        wanted = min(FANOUT, -(-len(span) // (LEAF // 2)))
        objects = span[b.spread_out(lambda i, s=span: distances(points[s], points[s[i]]), len(span), wanted)]
        near = np.stack([distances(points[span], points[o]) for o in objects]).argmin(axis=0)
        if np.bincount(near).max() == len(span):
            near = np.arange(len(span)) * wanted // len(span)
            objects = np.array([span[np.flatnonzero(near == i)[0]] for i in range(wanted)])
        order[first:last] = span[np.argsort(near, kind="stable")]
        children, at = [], first
        for o, n in zip(objects.tolist(), np.bincount(near, minlength=len(objects)).tolist(), strict=True):
            if n:
                children.append(page(at, at + n, o, obj))
                at += n
        nodes[k] = (obj, len(nodes), len(nodes) + len(children), False, radius, to_parent)
        nodes += children
        k += 1
    made = np.array(nodes, NODE)
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    made["object"] = place[made["object"]]
    return order, to_leaf, made


class Tree:
    """A block's tree as it travels, and the search in it."""

    def __init__(
        self, top: float, dimension: int, ids: bytes, rows: bytes, kind: str, vectors: bytes, to_leaf: bytes, nodes: bytes
    ) -> None:
        self.ids, self.rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
        self.vectors = b.wide(kind, vectors, dimension, len(self.ids), top)
        self.to_leaf, self.nodes = np.frombuffer(to_leaf, np.float64), np.frombuffer(nodes, NODE)
        self.top, self.computed = top, 0

    def distance(self, at: np.ndarray, query: np.ndarray, base: float) -> np.ndarray:
        self.computed += len(at)
        return np.sqrt(np.maximum(0.0, base - 2.0 * b.products(self.vectors[at], query)))

    def search(self, query: np.ndarray, row: int, best: b.Best) -> None:
        square = float((query.astype(np.float64) ** 2).sum())
        base, room = square + self.top, slack(len(query), self.top)

        def reach() -> float:
            floor = best.floor()
            return math.inf if floor is None else math.sqrt(max(0.0, base - 2.0 * floor)) + room

        far = float(self.distance(self.nodes["object"][:1], query, base)[0])
        queue = [(max(0.0, far - float(self.nodes["radius"][0])), 0, far)]
        while queue:
            least, k, far = heapq.heappop(queue)
            limit = reach()
            if least > limit:
                break
            node = self.nodes[k]
            span = slice(int(node["first"]), int(node["last"]))
            if node["leaf"]:
                at = np.flatnonzero(np.abs(far - self.to_leaf[span]) <= limit) + span.start
                at = at[self.rows[at] != row]
                self.computed += len(at)
                scores = b.products(self.vectors[at], query)
                floor = best.floor()
                if floor is not None:
                    at, scores = at[scores >= floor], scores[scores >= floor]
                best.add(scores, self.ids[at], self.rows[at])
                continue
            pages = self.nodes[span]
            at = np.flatnonzero(np.abs(far - pages["to_parent"]) - pages["radius"] <= limit)
            there = self.distance(pages["object"][at], query, base)
            lower = np.maximum(0.0, there - pages["radius"][at])
            for i in np.flatnonzero(lower <= limit).tolist():
                heapq.heappush(queue, (float(lower[i]), span.start + int(at[i]), float(there[i])))


def regions(items: DataFrame, top: float) -> DataFrame:
    """(row, id, dimension, region, vector as bytes): the nearest of the reference vectors, by number; -1 without any."""
    wanted = min(REGIONS, -(-items.count() // REGION_ROWS))
    references = {}
    for d, sample in b.sampled(items).items():
        points = lifted(sample, top)
        references[d] = points[b.spread_out(lambda i, p=points: distances(p, p[i]), len(points), wanted)]

    def start():
        def make(batch):
            rows = len(batch)
            region, size, data = np.full(rows, -1), np.zeros(rows, np.int64), [b""] * rows
            for at, vectors in b.matrices(batch.column(batch.schema.get_field_index("vector"))):
                size[at] = vectors.shape[1]
                if len(points := references.get(vectors.shape[1], ())):
                    about = lifted(vectors, top) @ points.T  # all have the same length
                    region[at] = about.argmax(axis=1)
                for i, v in zip(at.tolist(), vectors, strict=True):
                    data[i] = v.tobytes()
            return None, [size, region, data]

        return make

    return stored(map_batches(items, ["row", "id"], {"dimension": "int", "region": "int", "data": "binary"}, start), "regions")


def planted(rows: DataFrame, top: float) -> DataFrame:
    """A tree for each block of rows: what it holds, and its root's point and radius."""

    def make(dimension: int, members: list[tuple]) -> tuple:
        row, ids, data = zip(*members, strict=True)
        vectors = np.frombuffer(b"".join(data), np.int64).reshape(len(row), dimension)
        points = lifted(vectors, top)
        order, to_leaf, nodes = built(points)
        kind, small = b.narrow(vectors[order])
        arrays = (np.array(ids, np.int64)[order].tobytes(), np.array(row, np.int64)[order].tobytes())
        root = nodes[0]
        centre = points[order][root["object"]]
        return *arrays, kind, small, to_leaf.tobytes(), nodes.tobytes(), centre.tobytes(), float(root["radius"])

    made = dict.fromkeys(("ids", "rows"), "binary") | {"kind": "string"}
    made |= dict.fromkeys(("vectors", "to_leaf", "nodes", "centre"), "binary") | {"radius": "double"}
    return b.packed(rows, "block", ["row", "id", "data"], made, make)


def strips(queries: DataFrame) -> DataFrame:
    """Strips of queries: their rows, vectors, and floors (NaN for none)."""

    def make(dimension: int, members: list[tuple]) -> tuple:
        row, data, floor = zip(*members, strict=True)
        floors = [-1 if f is None else f for f in floor]
        known = [f is not None for f in floor]
        return (
            np.array(row, np.int64).tobytes(),
            b"".join(data),
            np.array(floors, np.int64).tobytes(),
            np.array(known, np.bool_).tobytes(),
        )

    made = dict.fromkeys(("query_rows", "queries", "floors", "known"), "binary")
    return b.packed(queries, "strip", ["row", "data", "floor"], made, make)


def searched(pairs: DataFrame, strips: DataFrame, trees: DataFrame, k: int, top: float) -> DataFrame:
    """(query, row, id, score) of the best that each task finds; ``pairs``: strip, block and queries, by place."""
    tiles = pairs.join(strips.drop("dimension"), "strip").join(trees.drop("centre", "radius"), "block")
    tiles = tiles.select(
        "dimension", "query_rows", "queries", "floors", "known", "chosen", "ids", "rows", "kind", "vectors", "to_leaf", "nodes"
    ).repartition(b.parts(pairs))

    def start():
        def make(batch):
            found: dict[int, b.Best] = {}
            for d, rows, queries, floors, known, chosen, *tree in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, floors = np.frombuffer(rows, np.int64), np.frombuffer(floors, np.int64)
                known = np.frombuffer(known, np.bool_)
                queries = np.frombuffer(queries, np.int64).reshape(len(rows), d)
                here = Tree(top, d, *tree)
                queries = queries.astype(here.vectors.dtype)
                for i in chosen:
                    row = int(rows[i])
                    best = found.setdefault(row, b.Best(k, int(floors[i]) if known[i] else None))
                    here.search(queries[i], row, best)
            out = [(q, r, -i, s) for q, best in found.items() for s, i, r in best.heap]
            return [], [list(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]

        return make

    return map_batches(tiles, [], {"query": "long", "row": "long", "id": "long", "score": "long"}, start, at_once=64)


def to_see(strips: DataFrame, pages: DataFrame, top: float) -> DataFrame:
    """Pairs of a strip and a tree that may hold one of the k best of some of its queries, and which queries."""

    def start():
        def make(batch):
            index, made = [], []
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("dimension", "queries", "floors", "known", "entries"))
            for at, (d, queries, floors, known, entries) in enumerate(zip(*columns, strict=True)):
                floors = np.frombuffer(floors, np.int64).astype(np.float64)
                known = np.frombuffer(known, np.bool_)
                queries = np.frombuffer(queries, np.int64).reshape(len(floors), d).astype(np.float64)
                base = np.einsum("ij,ij->i", queries, queries) + top
                limit = np.where(known, np.sqrt(np.maximum(0.0, base - 2.0 * floors)), np.inf) + slack(d, top)
                for entry in entries:
                    centre = np.frombuffer(entry["centre"], np.float64)[:-1]
                    least = np.sqrt(np.maximum(0.0, base - 2.0 * (queries @ centre))) - entry["radius"]
                    chosen = np.flatnonzero(least <= limit)
                    if len(chosen):
                        index.append(at)
                        made.append((entry["block"], chosen.tolist()))
            return index, [list(c) for c in zip(*made, strict=True)] if made else [[], []]

        return make

    return map_batches(b.with_pages(strips, pages), ["strip"], {"block": "string", "chosen": "array<int>"}, start, at_once=1)


def best_products(rows: DataFrame, is_query: Column, k: int, factor: int) -> DataFrame:
    """The ``k`` candidates with the largest inner product for each query, largest first, ties to the smaller id.

    ``rows``: id (long) and vector; ``is_query`` says which ids are queries. Components become
    floor(factor * x). Candidates are all rows of the query's dimension but the query's own row: a
    repeated id is a candidate and, if it is a query, a query for each of its rows. Null ids, and
    vectors that are null or hold null or non-finite components, take no part. Returns query_id,
    rank (from 1), id, score and query_row, which tells repeated queries apart. A query without
    candidates has no row.
    """
    items = b.whole_vectors(rows, factor)
    square = F.aggregate("vector", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double"))
    top = float(items.agg(F.max(square).alias("top")).first()["top"] or 0.0)
    placed = regions(items, top)
    trees = planted(b.in_blocks(placed, ["dimension", "region"], TREE, "block"), top)
    queries = stored(placed.where(is_query), "queries")

    def in_strips(found: DataFrame) -> DataFrame:
        return strips(b.in_blocks(found, ["dimension"], b.STRIP, "strip"))

    none = F.lit(None).cast("long").alias("floor")
    strips_now = in_strips(queries.select("*", none))
    near = b.in_blocks(queries, ["dimension"], b.STRIP, "strip").select("strip", "row", F.concat_ws("/", "dimension", "region", F.lit(0)).alias("block"))
    first = stored(searched(b.chosen_places(near, strips_now), strips_now, trees, k, top), "first")
    floors = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
    floors = floors.where(F.col("n") >= k).select(F.col("query").alias("row"), "floor")
    strips_now = in_strips(queries.join(floors, "row", "left"))
    pages = b.directory(trees, ["centre", "radius"])
    found = searched(to_see(strips_now, pages, top), strips_now, trees, k, top)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", "id", "score", F.col("query").alias("query_row"))
