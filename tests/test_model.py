from __future__ import annotations

import datetime as dt
import math

import pytest
from shop_checks import rows
from pyspark.sql import functions as F

from shopflow.functions import selection as sel
from shopflow.operators import model as mo
from workload import views as v

DIR = "/root/testdata/sf0.001"


def dated(spark, *offsets):
    day = dt.date(2024, 1, 1)
    data = [(str(i), day + dt.timedelta(days=o) if o is not None else None) for i, o in enumerate(offsets)]
    return spark.createDataFrame(data, "user_session STRING, session_date DATE")


def sides(df):
    marked = mo.time_split(df, "session_date", ["user_session"])
    return (
        {r.session_date.day if r.session_date else None for r in marked.filter("in_train").collect()},
        {r.session_date.day if r.session_date else None for r in marked.filter("NOT in_train").collect()},
    )


def test_time_split(spark):
    assert sides(dated(spark, 0, 1, 2, 3, 4, None)) == ({1, 2, 3, 4}, {5})
    assert sides(dated(spark, 0, 1, 1)) == ({1}, {2})
    assert sides(dated(spark, *range(15))) == (set(range(1, 13)), {13, 14, 15})


@pytest.mark.parametrize("offsets", [[0] * 400, [None] * 400])
def test_time_split_falls_back_to_the_hash(spark, offsets):
    marked = mo.time_split(dated(spark, *offsets), "session_date", ["user_session"])
    by_hash = mo.hash_split(dated(spark, *offsets), ["user_session"])
    assert rows(marked) == rows(by_hash)
    assert 0.7 < marked.filter("in_train").count() / 400 < 0.9


def test_random_split_is_complete(spark):
    train, test = mo.random_split(spark.range(1000), 0.8, 42)
    assert train.count() + test.count() == 1000
    assert train.intersect(test).isEmpty()


def test_selection(spark):
    df = spark.createDataFrame([(1, 1, 1, 1)], "num_views INT, Num_PURCHASES INT, denied INT, purchase_in_session INT")
    picked = sel.select_features(
        df, ["num_views", "Num_PURCHASES", "denied", "purchase_in_session", "zzz", "gone"], denied=["denied"]
    )
    assert picked == (["num_views"], ["Num_PURCHASES", "denied", "purchase_in_session"], ["gone", "zzz"])
    with pytest.raises(ValueError, match="no usable"):
        sel.select_features(df, ["Num_PURCHASES"])


def test_leakage_audit(spark):
    record = spark.createDataFrame([(["num_views", "Has_Purchase", "x"],)], "features_used ARRAY<STRING>")
    assert rows(sel.leakage_audit(record)) == [("Has_Purchase", True), ("num_views", False), ("x", False)]


def test_fill_missing(spark):
    df = spark.createDataFrame([(None, None, True), (1, 2.5, False)], "a BIGINT, b DOUBLE, purchase_in_session BOOLEAN")
    assert rows(sel.fill_missing(df, ["a", "b"])) == [(0, 0.0, 1), (1, 2.5, 0)]


@pytest.fixture(scope="module")
def fitted(spark):
    sessions = v.behaviour_sessions(spark, DIR).cache()
    features = sel.select_features(sessions).kept
    return sessions, features, mo.fit(sessions, features)


def test_scores_equal_the_plain_expression(spark, fitted):
    sessions, features, model = fitted
    weights, intercept = mo.model_weights(model)
    assert list(weights) == features == mo.model_features(model)
    direct = sessions.select(mo.logistic_score(weights, intercept).alias("p"))
    a = sorted(r.pred_prob for r in mo.score(model, sessions).collect())
    b = sorted(r.p for r in direct.collect())
    assert len(a) == sessions.count()
    assert all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b))


def test_evaluator_and_rank_sum_agree(spark, fitted):
    from shopflow.operators.scores import auc_exact

    sessions, _, model = fitted
    exact = auc_exact(mo.score(model, sessions)).first().auc
    assert mo.evaluator_auc(model, sessions) == pytest.approx(exact, abs=2e-3)
    assert 0.5 < exact < 1.0


def test_model_survives_storage(spark, fitted, tmp_path):
    sessions, features, model = fitted
    path = str(tmp_path / "model")
    mo.save_model(model, path)
    mo.save_model(model, path)
    loaded = mo.load_model(path)
    assert mo.model_weights(loaded) == mo.model_weights(model)
    assert mo.load_model(str(tmp_path / "none")) is None


def test_signed_ranking(spark):
    weights = spark.createDataFrame(
        [("zeta", 9.0), ("num_views", 0.5), ("num_carts", 0.7), ("is_weekend", 0.0), ("alpha", -3.0), ("hour_of_day", -0.1)],
        "feature STRING, weight DOUBLE",
    )
    ranked = mo.rank_drivers(weights, "s", "w", signed=True)
    got = [(r.direction, r["rank"], r.feature) for r in ranked.orderBy("direction", "rank").collect()]
    assert got == [
        ("negative", 1, "hour_of_day"),
        ("negative", 2, "alpha"),
        ("positive", 1, "num_carts"),
        ("positive", 2, "num_views"),
        ("positive", 3, "zeta"),
    ]
    said = {r.feature: r.description for r in ranked.collect()}
    assert said["zeta"] == mo.OTHER_DESCRIPTION and said["num_carts"] == mo.FEATURE_DESCRIPTIONS["num_carts"]
    assert mo.rank_drivers(weights, "s", "w", signed=False, top=2).count() == 4


def test_correlation_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1)], "c INT, x INT, purchase_in_session INT")
    got = {r.feature: r.weight for r in mo.correlation_rows(df, ["c", "x"]).collect()}
    assert got["c"] == 0.0 and got["x"] == pytest.approx(0.8660254)
    none = mo.correlation_rows(df.filter("false"), ["c", "x"])
    assert {r.weight for r in none.collect()} == {0.0}


def test_coefficient_drivers_are_disjoint(spark, fitted):
    sessions, features, model = fitted
    got = mo.coefficient_drivers(model, sessions)
    names = [r.feature for r in got.collect()]
    assert len(names) == len(set(names)) and set(names) <= set(features)
    assert got.filter("direction = 'positive' AND weight < 0").isEmpty()
