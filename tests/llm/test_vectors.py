from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shopflow.llm import angular, blocks, metric_tree, sql

SCHEMA = "id long, vector array<double>, label int, rank int, row string"


def floors(vector, factor):
    return [math.floor(factor * x) for x in vector]


def usable(rows, factor):
    """(row, id, whole vector, label) of the rows that take part."""
    fits = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    return [(n, i, floors(v, factor), y) for n, (i, v, y) in enumerate(rows) if i is not None and fits(v)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def best_by_hand(rows, every, k, factor):
    items, out = usable(rows, factor), []
    for n, i, v, _ in items:
        if i % every == 0:
            scores = sorted((-dot(v, w), j) for m, j, w, _ in items if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def negatives_by_hand(rows, every, factor):
    items = [x for x in usable(rows, factor) if x[3] is not None]
    out = []
    for n, i, v, y in items:
        if i % every:
            continue
        others = [(-dot(v, w), j, m, z) for m, j, w, z in items if m != n and len(w) == len(v)]
        for p, j, *_ in sorted(x for x in others if x[3] == y)[:5]:
            fit = sorted(x for x in others if x[3] != y and 50 * -p <= 100 * -x[0] <= 95 * -p)[:3]
            out += [(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def made(seed, n, dimension=6, copies=0.2):
    """Clustered vectors with repeats, odd rows and another dimension."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(7, dimension))
    rows = []
    for i in range(n):
        v = (centres[i % 7] + 0.3 * rnd.normal(size=dimension)).tolist()
        if rows and rnd.random() < copies:
            v = rows[int(rnd.integers(len(rows)))][1]
        rows.append((i, v, int(rnd.integers(3))))
    odd = [(n, None, 1), (None, [1.0] * dimension, 1), (n + 2, [math.nan] * dimension, 0), (n + 3, [1.0, None], 0)]
    odd += [(n + 4, [math.inf] * dimension, 2), (0, [0.0] * dimension, 0), (20, rows[3][1], None), (20, rows[3][1], 1)]
    odd += [(100, [], 0), (101, [], 1), (60, [1.0, 2.0], 0), (61, [1.5, 2.0], 1), (62, [1.0, 2.5], 0), (63, [0.6, 1.5], 2)]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in rows], SCHEMA).repartition(3)


@pytest.fixture
def small(monkeypatch):
    """Blocks, pages and strips of a few rows, so that little data has many of each."""
    for module, name, value in (
        (metric_tree, "TREE", 60),
        (metric_tree, "REGION_ROWS", 60),
        (metric_tree, "LEAF", 6),
        (metric_tree, "FANOUT", 4),
        (angular, "BLOCK", 50),
        (blocks, "STRIP", 8),
        (blocks, "PAGE", 3),
    ):
        monkeypatch.setattr(module, name, value)


def best(spark, rows, every, k, factor):
    found = metric_tree.best_products(frame(spark, rows), F.col("id") % every == 0, k, factor)
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in found.collect())


def negatives(spark, rows, every, factor):
    found = angular.hard_negatives(frame(spark, rows), F.col("id") % every == 0, factor)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in columns) for r in found.collect())


def test_best_products_equal_brute_force(spark, small):
    rows = made(1, 400)
    assert best(spark, rows, 20, 10, 1024) == best_by_hand(rows, 20, 10, 1024)


def test_negatives_equal_brute_force(spark, small):
    rows = made(3, 300)
    got = negatives(spark, rows, 20, 256)
    assert got == negatives_by_hand(rows, 20, 256)
    assert len(got) > 50


def test_default_blocks_and_a_giant_group_of_copies(spark):
    rows = made(4, 500, copies=0.0) + [(1000 + i, [0.5] * 6, i % 2) for i in range(600)]
    assert best(spark, rows, 50, 10, 1024) == best_by_hand(rows, 50, 10, 1024)
    assert negatives(spark, rows, 100, 256) == negatives_by_hand(rows, 100, 256)


def test_few_candidates_and_empty_tables(spark):
    for rows in ([], [(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (2, [1.0, 0.5], 0)]):
        assert best(spark, rows, 100, 10, 1024) == best_by_hand(rows, 100, 10, 1024)
        assert negatives(spark, rows, 50, 256) == negatives_by_hand(rows, 50, 256)


def test_large_components_stay_exact_and_larger_ones_are_an_error(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, (rnd.normal(size=4) * 500_000).tolist(), i % 2) for i in range(150)]
    assert best(spark, rows, 50, 5, 1024) == best_by_hand(rows, 50, 5, 1024)
    with pytest.raises(Exception, match="too large"):
        best(spark, [(0, [1e30], 1)], 1, 1, 1024)


def tree_of(vectors):
    top = float((vectors.astype(float) ** 2).sum(axis=1).max())
    order, to_leaf, nodes = metric_tree.built(metric_tree.lifted(vectors, top))
    kind, data = blocks.narrow(vectors[order])
    ids = order.astype(np.int64).tobytes()
    return metric_tree.Tree(top, vectors.shape[1], ids, ids, kind, data, to_leaf.tobytes(), nodes.tobytes())


def test_stored_distances_hold_and_save_computations():
    rnd = np.random.default_rng(6)
    vectors = np.floor(1024 * (rnd.normal(size=(30, 8)).repeat(100, axis=0) + 0.05 * rnd.normal(size=(3000, 8)))).astype(np.int64)
    tree = tree_of(vectors)
    points = metric_tree.lifted(tree.vectors, tree.top)
    for node in tree.nodes:
        if node["leaf"]:
            far = metric_tree.distances(points[node["first"] : node["last"]], points[node["object"]])
            assert far.max() <= node["radius"] + 1e-6
            assert np.allclose(far, tree.to_leaf[node["first"] : node["last"]])
    for q in range(0, 3000, 300):
        top = blocks.Best(5, None)
        tree.search(vectors[q].astype(float), q, top)
        scores = vectors @ vectors[q]
        expected = sorted(((int(s), -i, i) for i, s in enumerate(scores) if i != q), reverse=True)[:5]
        assert sorted(top.heap, reverse=True) == expected
    assert tree.computed < 10 * 3000 / 3


def test_angles_bound_every_score_and_save_scoring():
    rnd = np.random.default_rng(7)
    vectors = np.floor(256 * (rnd.normal(size=(12, 8)).repeat(100, axis=0) + 0.05 * rnd.normal(size=(1200, 8)))).astype(np.int64)
    vectors[5] = 0
    unit = rnd.normal(size=(6, 8))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    own = angular.angles(vectors, unit).astype(np.float32).astype(float)
    long = angular.lengths(vectors)
    some = 0
    for q in (0, 5, 700):
        cosines = angular.cosine_bounds(angular.angles(vectors[q][None], unit)[0], own, own, angular.room(8))
        low, high = angular.score_bounds(*cosines, long[q], long, long)
        scores = vectors @ vectors[q]
        assert (low <= scores).all() and (scores <= high).all()
        fifth = np.sort(scores)[-5]
        some += int((high >= fifth).sum())
    assert some < 3 * 1200 / 2 + 1200


@pytest.mark.parametrize("name", ["PRODUCTS", "HARD_NEGATIVES"])
def test_the_sql_means_the_same(name):
    rows = [r for r in made(8, 300) if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [(i, v, y) for i, v, y in rows])
    got = sorted(con.execute(getattr(sql, name)).fetchall())
    if name == "PRODUCTS":
        assert got == best_by_hand(rows, 100, 10, 1024)
    else:
        moved = [(i, v, y if y is None or i % 7 else (y + 1) % 10) for i, v, y in rows]
        assert got == negatives_by_hand(moved, 50, 256)
