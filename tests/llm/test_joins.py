from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from shopflow.llm import chosen_path, edited_pairs, nearest, sketch
from shopflow.llm.components import components


def prose(draw, n):
    return [f"w{draw.randrange(5000)}" for _ in range(n)]


def families(seed=4):
    """Texts with exact copies, near copies and a passage that unrelated texts share."""
    draw = random.Random(seed)
    passage, out = prose(draw, 60), []
    for _ in range(12):
        base = prose(draw, draw.randint(5, 200))
        out.append(base)
        for _ in range(draw.randint(0, 5)):
            near = list(base)
            for _ in range(draw.randint(0, 2)):
                near[draw.randrange(len(near))] = "changed"
            out.append(near)
        out.append(prose(draw, 80) + passage)
    return [" ".join(t) for t in out] + ["One two", "one, two!", "", "", None, "...", "...", "x " * 9000]


def expected_classes(rows):
    hashes = chosen_path.WordHashes()
    sets = [set(chosen_path.shingles(t or "", hashes, 5).tolist()) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if rows[a][0] is not None and rows[b][0] is not None and x and y and len(x & y) >= 0.8 * len(x | y):
            links[a] += 1
            links[b] += 1
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), str(least.get(find(k))), links[k]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("small, tile", [(512, 256), (3, 2)])
def test_classes_and_links_are_those_of_brute_force(make_docs, monkeypatch, small, tile):
    monkeypatch.setattr(chosen_path, "SMALL", small)
    monkeypatch.setattr(chosen_path, "TILE", tile)
    monkeypatch.setattr(chosen_path, "BLOCK", tile)
    rows = [*enumerate(families()), (None, "one two"), (0, "an id with another text than before it")]
    got = chosen_path.similar_documents(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == expected_classes(rows)


def test_one_of_each_class_stays(make_docs):
    rows = [*enumerate(families()), (None, "one two"), (None, "one two")]
    docs = make_docs(rows)
    kept = chosen_path.without_near_copies(docs)
    assert kept.columns == docs.columns
    classes = {c for i, c, _ in expected_classes(rows) if i != "None"}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(map(int, classes))
    assert kept.where("doc_id is null").count() == 2


def test_rows_that_repeat_an_id_and_a_text_stay_once(make_docs):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other")]
    assert sorted(r.doc_id for r in chosen_path.without_near_copies(make_docs(rows)).collect()) == [1, 3]


def test_runs_follow_from_the_recall():
    assert chosen_path.runs_for(0.9, 0.8) < chosen_path.runs_for(0.99, 0.8) < chosen_path.runs_for(0.9999, 0.8)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_merge_and_estimate():
    draw = random.Random(1)
    a, b = (" ".join(prose(draw, n)) for n in (3000, 200))
    both = sketch.merge(sketch.sketch(a), sketch.sketch(b))
    whole = np.union1d(sketch.shingle_hashes(a), sketch.shingle_hashes(b))
    assert np.array_equal(both, sketch.scaled(whole))
    assert sketch.containment(sketch.sketch(b), sketch.sketch(a + b)) > 0.95
    half = a[: len(a) // 2]
    true = len(np.intersect1d(sketch.shingle_hashes(a), sketch.shingle_hashes(half)))
    true /= len(np.union1d(sketch.shingle_hashes(a), sketch.shingle_hashes(half)))
    assert sketch.likeness(sketch.sketch(a), sketch.sketch(half)) == pytest.approx(true, abs=0.08)
    assert np.array_equal(sketch.from_text(sketch.to_text(both)), both)
    assert len(sketch.sketch("short")) == 1 and len(sketch.sketch("")) == 0


def test_edited_fingerprints_pair_each_row_with_its_successor(make_docs):
    draw = random.Random(2)
    rows = [(k * 7 - 50, " ".join(prose(draw, draw.randint(0, 60)))) for k in range(80)]
    rows += [(6, "twice"), (6, "twice"), (None, "no id"), (10**17 + 1, None), (10**17 + 3, "é😀" * 9)]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = []
    for (i, text), (_, after) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own = sketch.sketch(text)
        expected.append(
            (str(i), len(text), hashlib.sha256(changed.encode()).hexdigest(), sketch.to_text(own),
             round(sketch.likeness(own, sketch.sketch(changed)), 9), round(sketch.likeness(own, sketch.sketch(after)), 9))
        )
    got = edited_pairs.edited_fingerprints(make_docs(rows)).collect()
    assert sorted(expected) == sorted(
        (str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
        for r in got
    )


def test_fingerprints_of_few_or_no_rows(make_docs):
    one = edited_pairs.edited_fingerprints(make_docs(["abcdef"])).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(6, 1.0)]
    assert edited_pairs.edited_fingerprints(make_docs(["x"]).where("doc_id < 0")).count() == 0
    assert sketch.fingerprints(make_docs(["a", None])).count() == 2


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>")


def test_nearest_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 60)
    monkeypatch.setattr(nearest, "QUERIES", 7)
    draw = np.random.default_rng(5)
    x = draw.standard_normal((400, 16)).astype(np.float32)
    x[100:160] = x[3]  # a common vector
    x[200:220] *= 1e-30
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(900, None), (950, [0.0] * 16), (1000, [float("nan")] * 16), (None, [1.0] * 16), (850, [None] * 16)]
    short = [(5000, [1.0, 2.0]), (5001, [2.0, 1.0]), (5050, [3.0])]
    got = nearest.nearest(vectors(spark, [*rows, *bad, *short]), F.col("id") % 50 == 0, 5).collect()
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1)[:, None]
    for q in range(0, 400, 50):
        score = np.round(d @ d[q], 12)
        score[q] = -9
        best = np.lexsort((np.arange(400), -score))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.id for r in mine] == best.tolist() and [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([r.score for r in mine], score[best], atol=1e-12)
    assert [(r["rank"], r.id) for r in got if r.query_id == 5000] == [(1, 5001)]
    assert {r.query_id for r in got} == {*range(0, 400, 50), 5000}


def test_quantisation_bounds_hold():
    draw = np.random.default_rng(6)
    x, y = draw.standard_normal((50, 8)), draw.standard_normal((60, 8))
    (a, sa, la), (b, sb, lb) = nearest.quantised(x), nearest.quantised(y)
    about = (a.astype(float) @ b.astype(float).T) * sa[:, None] * sb
    true = np.array([nearest.cosines(x, v) for v in y]).T
    assert (np.abs(true - about) <= la[:, None] + (1 + la[:, None]) * lb + 1e-12).all()


def test_repeated_ids_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 1.0])]
    got = nearest.nearest(vectors(spark, rows), F.col("id") == 0, 3).collect()
    each = [(0, 1, 0, 1.0), (0, 2, 1, 0.707107), (0, 3, 1, 0.0)]  # for both rows with id 0
    assert sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in got) == sorted(each * 2)
    assert len({r.query_row for r in got}) == 2
    assert nearest.nearest(vectors(spark, rows).where("id > 9"), F.col("id") == 0, 3).count() == 0


def test_strips_of_few_queries_and_vectors_that_need_64_bits(spark, monkeypatch):
    monkeypatch.setattr(nearest, "STRIP", 4)
    monkeypatch.setattr(nearest, "QUERIES", 2)
    monkeypatch.setattr(nearest, "BLOCK", 16)
    draw = np.random.default_rng(9)
    d = draw.standard_normal((120, 3))
    d[40:70] = d[7]
    d[::2] = d[::2].astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "id long, vector array<double>").repartition(3)
    got = nearest.nearest(table, F.col("id") % 10 == 0, 5).collect()
    for q in range(0, 120, 10):
        score = nearest.cosines(d, d[q])
        best = [i for i in np.lexsort((np.arange(120), -score)).tolist() if i != q][:5]
        mine = sorted((r["rank"], r.id, r.score) for r in got if r.query_id == q)
        assert mine == [(n + 1, i, score[i]) for n, i in enumerate(best)]
