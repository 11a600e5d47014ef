from __future__ import annotations

import datetime as dt

import pytest
from shop_checks import plan_of, rows
from pyspark.sql import functions as F

from shopflow.operators import sessions as se
from shopflow.schema import table_schema

EVENTS = (
    "user_session STRING, user_id BIGINT, event_time TIMESTAMP, event_date DATE, event_type STRING, "
    "product_id BIGINT, category_id BIGINT, price DOUBLE"
)


def events(spark, *rows_):
    out = []
    for session, user, when, kind, product, category, price in rows_:
        t = dt.datetime.fromisoformat(when) if when else None
        out.append((session, user, t, t.date() if t else None, kind, product, category, price))
    return spark.createDataFrame(out, EVENTS)


@pytest.fixture()
def log(spark):
    return events(
        spark,
        ("one", 5, "2024-03-02 10:00:00", "view", 1, 1, 10.0),  # Saturday, a single event
        ("night", 8, "2024-03-03 23:59:50", "cart", 1, None, 5.0),  # Sunday
        ("night", 7, "2024-03-04 00:00:20", "purchase", None, 1, 5.0),
        ("night", None, "2024-03-04 00:00:10", "odd", 2, 2, 5.0),
        ("views", 9, "2024-03-04 08:00:00", "view", 1, 1, None),  # Monday
        ("views", 9, "2024-03-04 08:00:01", "view", 1, 1, 4.0),
        ("views", 9, "2024-03-04 08:00:02", "view", 2, 1, 8.0),
        (None, 9, "2024-03-04 08:00:02", "view", 2, 1, 8.0),
    )


def starts_of(events):
    return se.starts_from_session_days(se.session_days(events))


def test_features_of_edge_sessions(spark, log):
    table = se.session_features(log)
    assert [(f.name, f.dataType) for f in table.schema] == [
        (f.name, f.dataType) for f in table_schema("session_features")
    ]
    got = {r.user_session: r for r in table.collect()}
    assert set(got) == {"one", "night", "views"}
    one, night, views = got["one"], got["night"], got["views"]
    assert (one.session_duration_seconds, one.total_events, one.is_weekend, one.day_of_week) == (0, 1, 1, 7)
    assert (night.user_id, night.total_events, night.num_carts, night.num_purchases) == (7, 3, 1, 1)
    assert (night.unique_products, night.unique_categories) == (2, 2)
    assert (night.session_duration_seconds, night.session_date) == (30, dt.date(2024, 3, 3))
    assert (night.avg_price_viewed, night.max_price_viewed) == (None, None)
    assert (night.is_weekend, night.day_of_week, night.hour_of_day, night.purchase_in_session) == (1, 1, 23, 1)
    assert (views.avg_price_viewed, views.max_price_viewed, views.num_views) == (6.0, 8.0, 3)
    assert (views.is_weekend, views.day_of_week, views.purchase_in_session) == (0, 2, 0)


def test_feature_summary(spark, log):
    assert rows(se.feature_summary(se.session_features(log))) == [(3, 0.333333)]
    assert rows(se.feature_summary(se.session_features(log.filter("false")))) == [(0, 0.0)]


def test_join_dates_sessions_by_first_event_in_range(spark, log):
    features = se.session_features(log)
    in_range = log.filter("event_date >= '2024-03-04' AND user_session IS NOT NULL")
    joined = se.sessions_in_range(features, starts_of(in_range), "2024-03-04", "2024-03-04")
    got = {r.user_session: (r.session_date, r.total_events) for r in joined.collect()}
    assert got == {"night": (dt.date(2024, 3, 4), 3), "views": (dt.date(2024, 3, 4), 3)}


def test_one_scan_gives_the_joined_rows(spark, log):
    from shopflow.operators.events import reportable_events
    from shopflow.schema import TABLES

    names = [c.split(" ")[0] for c in TABLES["session_features"].split(", ")]
    for bounds in ((None, None), ("2024-03-04", None), ("2024-03-02", "2024-03-03"), (None, "2024-01-01")):
        starts = starts_of(reportable_events(log, *bounds))
        joined = se.sessions_in_range(se.session_features(log), starts, *bounds).select(*names)
        assert rows(se.session_features_in_range(log, *bounds)) == rows(joined)


def test_day_of_week_is_derived_when_absent(spark, log):
    features = se.session_features(log).drop("day_of_week")
    joined = se.sessions_in_range(features, starts_of(log.dropna(subset=["user_session"])))
    assert {r.user_session: r.day_of_week for r in joined.collect()} == {"one": 7, "night": 1, "views": 2}


def test_session_days_carry_the_starts(spark, log):
    kept = log.dropna(subset=["user_session"])
    first = kept.groupBy("user_session").agg(F.min("event_time").alias("session_start"))
    direct = rows(first.withColumn("session_date", F.to_date("session_start")))
    assert rows(se.starts_from_session_days(se.session_days(kept))) == direct
    assert se.session_days(kept).filter("user_session = 'night'").agg(F.count_distinct("event_date")).first()[0] == 2


def test_session_kpis_and_weekday_conversion(spark, log):
    features = se.session_features(log)
    row = se.session_kpis(features).first()
    assert (row.total_sessions, row.purchase_sessions) == (3, 1)
    assert row.avg_session_duration_seconds == pytest.approx(32 / 3)
    empty = se.session_kpis(features.filter("false")).first()
    assert tuple(empty) == (0, 0, 0.0, 0.0)
    got = {r.session_date.day: (r.sessions, r.purchases, r.conversion_rate) for r in se.conversion_by_weekday(features).collect()}
    assert got == {2: (1, 0, 0.0), 3: (1, 1, 1.0), 4: (1, 0, 0.0)}


def test_hot_session_is_spread_before_it_is_merged(spark):
    """A third of all events in one session: the first shuffle also hashes the counted values."""
    n = 30_000
    log = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 977).cast("string"))).alias("user_session"),
        F.lit(1).cast("bigint").alias("user_id"),
        F.timestamp_seconds(F.col("id")).alias("event_time"),
        F.to_date(F.timestamp_seconds(F.col("id"))).alias("event_date"),
        F.lit("view").alias("event_type"),
        F.col("id").alias("product_id"),
        (F.col("id") % 500).alias("category_id"),
        F.lit(1.0).alias("price"),
    )
    table = se.session_features(log)
    assert "Exchange hashpartitioning(user_session#" in plan_of(table)
    first_shuffle = [line for line in plan_of(table).splitlines() if "Exchange hashpartitioning" in line][-1]
    assert "product_id" in first_shuffle and "category_id" in first_shuffle
    hot = table.filter("user_session = 'hot'").first()
    assert (hot.total_events, hot.unique_products, hot.unique_categories) == (n // 3, n // 3, 500)


def test_results_do_not_depend_on_the_driver_zone(spark, log, monkeypatch):
    import time

    before = rows(se.session_features(log).select("user_session", "session_date", "hour_of_day"))
    monkeypatch.setenv("TZ", "Europe/Paris")
    time.tzset()
    try:
        after = rows(se.session_features(log).select("user_session", "session_date", "hour_of_day"))
    finally:
        monkeypatch.delenv("TZ")
        time.tzset()
    assert before == after
