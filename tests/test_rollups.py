from __future__ import annotations

import datetime as dt

import pytest
from shop_checks import plan_of, rows
from pyspark.sql import functions as F

from shopflow.operators import rollups as ro
from shopflow.operators.events import purchases
from shopflow.operators.sessions import session_days, session_features, session_kpis
from workload import views as v

DIR = "/root/testdata/sf0.001"
SCHEMA = (
    "user_session STRING, user_id BIGINT, event_time TIMESTAMP, event_date DATE, event_type STRING, "
    "category_id BIGINT, category_code STRING, brand STRING, price DOUBLE, product_id BIGINT"
)


@pytest.fixture(scope="module")
def log(spark):
    d1, d2 = dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 1, 2, 9)
    data = [
        ("a", 1, d1, d1.date(), "view", 1, "c", "b", 1.0, 1),
        ("a", 1, d2, d2.date(), "purchase", 7, None, None, 2.0, 1),
        ("b", 2, d2, d2.date(), "purchase", 7, None, "", None, 1),
        ("b", 2, d2, d2.date(), "cart", 7, "", "b", 4.0, 1),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_funnel_counts_a_session_on_each_of_its_days(spark, log):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    want = [(d1, 1, 0, 0, 1), (d2, 0, 1, 2, 2)]
    assert rows(ro.funnel_daily(log)) == want
    assert rows(ro.funnel_from_session_days(session_days(log))) == want


def test_rollups_with_missing_names_and_prices(spark, log):
    bought = purchases(log)
    d2 = dt.date(2024, 1, 2)
    assert rows(ro.category_daily(bought)) == [(d2, "7", 2, 2.0, 2.0, 2.0, 2.0)]
    assert rows(ro.brand_daily(bought)) == [(d2, "unknown", 2, 2.0, 2.0, 2.0, 2.0)]
    assert rows(ro.purchases_by_hour(bought)) == [(d2, 9, 2, 2.0, 2.0, 2.0, 2.0)]
    cube = ro.commerce_cube(bought)
    assert rows(ro.rollup_from_cube(cube, ["event_date", "brand"], "top_brands")) == rows(ro.brand_daily(bought))


def test_rollup_without_any_price_keeps_nulls(spark, log):
    bought = purchases(log).filter("price IS NULL")
    direct = rows(ro.category_daily(bought))
    assert direct == [(dt.date(2024, 1, 2), "7", 1, None, None, None, None)]
    assert rows(ro.rollup_from_cube(ro.commerce_cube(bought), ["event_date", "category"], "top_categories")) == direct


def test_kpi_record(spark, log):
    record = ro.kpi_record(ro.activity_kpis(log), session_kpis(session_features(log)), currency="EUR")
    row = record.first().asDict()
    assert row == {
        "total_events": 4,
        "total_users": 2,
        "total_sessions": 2,
        "total_purchases": 2,
        "total_revenue": 2.0,
        "avg_order_value": 1.0,
        "conversion_rate": 1.0,
        "avg_session_duration_seconds": 43200.0,
        "avg_events_per_session": 2.0,
        "min_event_date": "2024-01-01",
        "max_event_date": "2024-01-02",
        "min_purchase_price": 2.0,
        "max_purchase_price": 2.0,
        "currency": "EUR",
    }
    shared = ro.kpi_record(
        ro.event_kpis_from_session_days(session_days(log)),
        session_kpis(session_features(log)),
        ro.purchase_kpis_from_cube(ro.commerce_cube(purchases(log))),
        "EUR",
    )
    assert shared.first().asDict() == row
    assert "Cartesian" not in plan_of(record) and "NestedLoop" not in plan_of(record)


def test_everything_on_no_rows(spark, log):
    none = log.filter("false")
    for table in (ro.funnel_daily(none), ro.category_daily(none), ro.brand_daily(none), ro.purchases_by_hour(none)):
        assert table.isEmpty()
    record = ro.kpi_record(ro.event_kpis(none), session_kpis(session_features(none)), ro.purchase_kpis(none)).first()
    assert (record.total_events, record.total_revenue, record.avg_order_value, record.min_event_date) == (0, 0.0, 0.0, None)


def test_purchase_totals_agree_across_rollups(spark):
    events = v.shop_events(spark, DIR)
    bought = purchases(events)

    def total(df, c):
        return df.agg(F.sum(c)).first()[0]

    want = bought.count()
    assert total(ro.funnel_daily(events), "purchases") == want
    for table in (ro.purchases_by_hour(bought), ro.category_daily(bought), ro.brand_daily(bought)):
        assert total(table, "purchase_count") == want
    revenues = {
        total(t, "revenue") for t in (ro.purchases_by_hour(bought), ro.category_daily(bought), ro.brand_daily(bought))
    }
    assert len(revenues) == 1
