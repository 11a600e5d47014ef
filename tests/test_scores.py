from __future__ import annotations

import datetime as dt

import pytest
from shop_checks import plan_of, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopflow.operators import scores as sc
from shopflow.schema import TABLES, table_schema

relaxed = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
DAY = dt.date(2024, 1, 1)


def scored(spark, pairs, day=DAY):
    return spark.createDataFrame([(day, y, p) for y, p in pairs], "session_date DATE, label INT, pred_prob DOUBLE")


@pytest.fixture(scope="module")
def sample(spark):
    return scored(spark, [(0, 0.0), (1, 0.29), (1, 0.5), (0, 0.5), (1, 0.99), (1, 1.0)])


def test_declared_columns(spark, sample):
    cube = sc.score_cube(sample)
    for name, df in {
        "propensity_daily": sc.propensity_daily(cube),
        "propensity_hist": sc.score_histogram(cube),
        "propensity_threshold": sc.threshold_point(cube),
        "calibration_bins": sc.calibration_bins(cube),
        "threshold_curves": sc.threshold_curve(cube),
    }.items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in table_schema(name)]
        assert name in TABLES


def test_bins_points_and_ties(spark, sample):
    cube = sc.score_cube(sample)
    assert [(r.bucket_low, r.bucket_high, r.probability_bin, r.sessions_count) for r in sc.score_histogram(cube).collect()] == [
        (0.0, 0.1, "0.0-0.1", 1),
        (0.2, 0.3, "0.2-0.3", 1),
        (0.5, 0.6, "0.5-0.6", 2),
        (0.9, 1.0, "0.9-1.0", 2),
    ]
    assert rows(sc.threshold_point(cube)) == [(0.5, 0.666667, 0.75, 0.75)]
    row = sc.confusion_scores(sample).first()
    assert (row.tn, row.fp, row.fn, row.tp, row.total, row.positives) == (1, 1, 1, 3, 6, 4)
    assert (row.accuracy, row.precision, row.recall, row.f1, row.positive_rate) == (0.666667, 0.75, 0.75, 0.75, 0.666667)
    kpis = sc.propensity_kpis(cube).first()
    assert kpis.high_propensity_share == 0.666667 and kpis.predicted_conversion_rate == 0.546667


def test_threshold_curve(spark, sample):
    curve = {r.threshold: tuple(r)[1:] for r in sc.threshold_curve(sc.score_cube(sample)).collect()}
    assert set(curve) == {0.0, 0.29, 0.5, 0.99, 1.0}
    assert curve[0.0] == (0.666667, 1.0, 0.8, 1.0)
    assert curve[0.99] == (1.0, 0.5, 0.666667, 0.333333)
    assert curve[1.0] == (0.0, 0.0, 0.0, 0.0)
    assert sc.threshold_curve(sc.score_cube(sample), closing_row=False).count() == 4


def test_no_positives_and_no_rows(spark):
    only_negative = sc.score_cube(scored(spark, [(0, 0.2), (0, 0.7)]))
    assert rows(sc.threshold_point(only_negative)) == [(0.5, 0.5, 0.0, 0.0)]
    assert all(r.recall == 0.0 and r.f1 == 0.0 for r in sc.threshold_curve(only_negative).collect())
    none = sc.score_cube(scored(spark, []))
    assert rows(sc.threshold_point(none)) == [(0.5, 0.0, 0.0, 0.0)]
    assert rows(sc.propensity_kpis(none)) == [(True, 0.0, 0.0, 0.0, 0.0, 0.5)]
    assert rows(sc.threshold_curve(none)) == [(1.0, 0.0, 0.0, 0.0, 0.0)]
    assert rows(sc.confusion_scores(scored(spark, []))) == [(0,) * 6 + (0.0,) * 5]
    assert sc.propensity_daily(none).isEmpty() and sc.calibration_bins(none).isEmpty()


@pytest.mark.parametrize(
    "pairs, auc, perfect",
    [
        ([(0, 0.5), (1, 0.5), (0, 0.5), (1, 0.5)], 0.5, False),
        ([(0, 0.1), (0, 0.2), (1, 0.3), (1, 0.9)], 1.0, True),
        ([(1, 0.1), (0, 0.9)], 0.0, False),
        ([(1, 0.4)], None, None),
        ([], None, None),
    ],
)
def test_auc_of_plain_cases(spark, pairs, auc, perfect):
    row = sc.auc_exact(scored(spark, pairs)).first()
    assert (row.auc, row.suspiciously_perfect) == (auc, perfect)


@relaxed
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.1, 0.2, 0.25, 0.5, 0.8])), min_size=2, max_size=40))
def test_auc_and_roc_agree_with_all_pairs(spark, pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    if not pos or not neg:
        return
    won = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert sc.auc_exact(scored(spark, pairs)).first().auc == pytest.approx(won / len(pos) / len(neg), abs=1e-6)
    for r in sc.roc_curve(scored(spark, pairs)).collect():
        assert r.tpr == pytest.approx(sum(p >= r.threshold for p in pos) / len(pos))
        assert r.fpr == pytest.approx(sum(p >= r.threshold for p in neg) / len(neg))


def test_counts_agree_across_tables(spark):
    df = spark.range(5000).select(
        F.lit(DAY).alias("session_date"),
        (F.xxhash64("id") % 2).cast("int").alias("y"),
        (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1001)) / 1000).alias("pred_prob"),
    ).withColumn("label", F.abs("y"))
    cube = sc.score_cube(df)
    first = sc.threshold_curve(cube).orderBy("threshold").first()
    assert (first.recall, first.pct_flagged) == (1.0, 1.0)
    assert sc.score_histogram(cube).agg(F.sum("sessions_count")).first()[0] == 5000
    assert sc.calibration_bins(cube).agg(F.sum("sessions")).first()[0] == 5000
    c = sc.confusion_scores(df).first()
    assert c.tp + c.fp + c.fn + c.tn == 5000
    assert "Cartesian" not in plan_of(sc.threshold_curve(cube))


def test_split_provenance(spark):
    early = scored(spark, [(0, 0.1)], dt.date(2024, 1, 1))
    late = scored(spark, [(1, 0.1)], dt.date(2024, 1, 2))
    assert rows(sc.split_provenance(early, late, "session_date"))[0][0] == "time-based"
    assert rows(sc.split_provenance(early, early, "session_date"))[0][0] == "time-based"
    assert rows(sc.split_provenance(late, early, "session_date"))[0][0] == "random"
    assert rows(sc.split_provenance(early, late, "session_date", "random"))[0][0] == "random"
    assert rows(sc.split_provenance(early, late, "no_such")) == [("random", None, None, None, None)]


def test_nearest_threshold(spark):
    curve = spark.createDataFrame(
        [(t, 0.1, 0.2, 0.3, 0.4) for t in (0.1, 0.2, 0.4)], TABLES["threshold_curves"]
    )
    spare = spark.createDataFrame([(0.5, 0.7, 0.1, 0.1)], TABLES["propensity_threshold"])

    def pick(x, c=curve):
        return sc.nearest_threshold(c, F.lit(x), spare).first()

    assert pick(0.2).threshold == 0.2
    assert pick(0.3).threshold == 0.2
    assert pick(0.9).threshold == 0.4
    fallback = pick(0.3, curve.filter("false"))
    assert (fallback.threshold, fallback.high_propensity_share, fallback.f1) == (0.5, 0.7, None)


def test_default_threshold(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 0.0), (3, -1.0), (4, None), (5, 0.001), (6, 1.0)], "i INT, r DOUBLE")
    got = [r[0] for r in df.orderBy("i").select(sc.default_threshold("r")).collect()]
    assert got == [0.2, 0.1, 0.1, 0.1, 0.01, 0.99]


def test_weighted_score_and_its_fallbacks(spark):
    daily = spark.createDataFrame([(DAY, 10, 1, 0.2, 0.1), (DAY, 30, 5, 0.4, None)], TABLES["propensity_daily"])
    row = sc.weighted_score(daily).first()
    assert row.predicted_conversion_rate == pytest.approx(0.35)
    assert row.actual_session_conversion_rate == pytest.approx(0.15)
    assert row.calibration_gap == pytest.approx(0.2)
    none = daily.filter("false")
    assert rows(sc.weighted_score(none)) == [(None, None, None)]
    kpis = spark.createDataFrame([(0.3, 0.2, 0.11)], "predicted_conversion_rate DOUBLE, actual_session_conversion_rate DOUBLE, calibration_gap DOUBLE")
    assert rows(sc.weighted_score(none, kpis))[0][:2] == (0.3, 0.2)
    zero = spark.createDataFrame([(DAY, 0, 0, 0.2, 0.0)], TABLES["propensity_daily"])
    assert rows(sc.weighted_score(zero)) == [(0.0, 0.0, 0.0)]


def test_backfills(spark):
    assert sc.fill_f1(spark.createDataFrame([(0.5, 0.5)], "precision DOUBLE, recall DOUBLE")).first().f1 == 0.5
    assert sc.fill_f1(spark.createDataFrame([(0.0, 0.0)], "precision DOUBLE, recall DOUBLE")).first().f1 is None
    kept = spark.createDataFrame([(0.5, 0.5, 0.9)], "precision DOUBLE, recall DOUBLE, f1 DOUBLE")
    assert sc.fill_f1(kept).first().f1 == 0.9
    daily = spark.createDataFrame([(DAY, 4, 1, None), (DAY, 0, 0, 0.5)], "date DATE, sessions BIGINT, purchases BIGINT, mean_pred_prob DOUBLE")
    assert {r.actual_session_conversion_rate for r in sc.fill_daily_rates(daily).collect()} == {0.25, 0.0}
    hist = spark.createDataFrame([(0.1, 0.2, None), (0.0, 0.1, 5)], "bucket_low DOUBLE, bucket_high DOUBLE, sessions_count BIGINT")
    assert [(r.bucket_label, r.sessions_count) for r in sc.fill_bin_labels(hist).collect()] == [("0.0-0.1", 5), ("0.1-0.2", 0)]
    text = "bin_low STRING, bin_high STRING, mean_pred_prob STRING, actual_rate STRING, sessions STRING"
    bins = spark.createDataFrame([("0.0", "0.1", "0.05", "x", "3"), ("0.1", "0.2", "0.15", "0.1", None)], text)
    assert rows(sc.clean_calibration(bins)) == [(0.1, 0.2, 0.15, 0.1, 0.0, "0.10-0.20")]


def test_a_cube_keeps_its_threshold(spark, sample):
    cube = sc.score_cube(sample, threshold=0.9)
    assert sc.threshold_point(cube).first().threshold == 0.9
    assert sc.propensity_kpis(cube).first().threshold == 0.9


def test_scores_that_are_not_numbers_are_left_out(spark):
    cube = sc.score_cube(scored(spark, [(1, 0.5), (0, float("nan")), (0, None)]))
    assert cube.agg({"sessions": "sum"}).first()[0] == 1
    assert all(r.threshold is not None for r in sc.threshold_curve(cube).collect())


def test_threshold_falls_back_to_the_record_then_the_row_then_a_half(spark, sample):
    from pyspark.sql import functions as F

    cube = sc.score_cube(sample, threshold=0.4)
    none = sc.threshold_curve(cube).where("threshold < 0")
    kpis, point = sc.propensity_kpis(cube), sc.threshold_point(sc.score_cube(sample, threshold=0.6))
    absent = kpis.withColumn("available", F.lit(False))
    at = F.lit(0.1)
    assert sc.nearest_threshold(none, at, point, kpis).first().threshold == 0.4
    assert sc.nearest_threshold(none, at, point, absent).first().threshold == 0.6
    assert sc.nearest_threshold(none, at).first().threshold == 0.5


def test_actual_rate_falls_back_to_the_totals(spark, sample):
    from pyspark.sql import functions as F

    cube = sc.score_cube(sample)
    none = sc.propensity_daily(cube).where("date IS NULL")
    absent = sc.propensity_kpis(cube).withColumn("available", F.lit(False))
    totals = spark.sql("SELECT 3 AS purchases, 12 AS sessions")
    row = sc.weighted_score(none, absent, totals).first()
    assert row.actual_session_conversion_rate == 0.25 and row.predicted_conversion_rate is None
