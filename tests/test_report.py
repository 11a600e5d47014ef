from __future__ import annotations

import datetime as dt

from shop_checks import plan_of, rows

from shopflow.operators import report as re
from shopflow.schema import TABLES, empty_table

D = [dt.date(2024, 1, d) for d in range(1, 11)]


def table(spark, name, *data):
    return spark.createDataFrame(list(data), TABLES[name])


def funnel(spark):
    return table(spark, "funnel_daily", (D[0], 10, 4, 2, 6), (D[1], 0, 0, 0, 0))


def sales(spark, name, key):
    return table(
        spark,
        name,
        (D[0], key[0], 2, 30.0, 15.0, 10.0, 20.0),
        (D[1], key[0], 1, 5.0, 5.0, 5.0, 5.0),
        (D[1], key[1], 1, 35.0, None, None, 40.0),
    )


def test_date_bounds(spark):
    kpis = spark.createDataFrame([("2023-12-31", "not a date")], "min_event_date STRING, max_event_date STRING")
    got = re.date_bounds([(funnel(spark), "event_date"), (funnel(spark), "absent")], kpis)
    assert rows(got) == [(dt.date(2023, 12, 31), D[1])]
    today = dt.date.today()
    none = re.date_bounds([(empty_table(spark, "funnel_daily"), "event_date")]).first()
    assert abs((none.min_date - today).days) <= 1 and none.min_date == none.max_date
    inverted = spark.createDataFrame([("2024-02-02", "2024-02-01")], "min_event_date STRING, max_event_date STRING")
    assert rows(re.date_bounds([(empty_table(spark, "funnel_daily"), "event_date")], inverted)) == [
        (dt.date(2024, 2, 1), dt.date(2024, 2, 2))
    ]


def test_relative_ranges(spark):
    bounds = spark.createDataFrame([(D[0], D[9])], "min_date DATE, max_date DATE")
    assert rows(re.last_days(bounds, 7)) == [(D[3], D[9])]
    assert rows(re.last_days(bounds, 30)) == [(D[0], D[9])]
    assert rows(re.last_days(bounds, None)) == [(D[0], D[9])]
    days = spark.createDataFrame([(d,) for d in D], "d DATE")
    kept = re.filter_to(days, "d", re.last_days(bounds, 7))
    assert kept.count() == 7 and "NestedLoop" not in plan_of(kept)
    assert re.filter_dates(days, "absent", "2024-01-02").count() == 10


def test_categories_and_prices(spark):
    cats = sales(spark, "top_categories", ("b", "a"))
    assert [r[0] for r in re.category_options(cats).collect()] == ["a", "b"]
    assert re.filter_categories(cats, []).count() == 3
    assert re.filter_categories(cats, ["b"]).count() == 2
    assert re.filter_prices(cats, 5.0, 15.0).count() == 2
    assert re.filter_prices(cats, 5.0, 14.9).count() == 1
    assert re.filter_prices(funnel(spark), 0.0, 0.0).count() == 2
    assert rows(re.price_bounds([cats, funnel(spark)])) == [(5.0, 40.0)]
    assert rows(re.price_bounds([empty_table(spark, "top_categories")])) == [(None, None)]


def totals(spark, hourly, cats, **flags):
    return re.report_totals(funnel(spark), hourly, cats, **flags).first()


def test_totals_choose_their_source(spark):
    cats, hourly = sales(spark, "top_categories", ("b", "a")), sales(spark, "purchases_by_hour", (9, 3))
    no_cats, no_hours = cats.filter("false"), hourly.filter("false")
    row = totals(spark, hourly, cats)
    assert (row.views, row.carts, row.purchases, row.sessions, row.revenue, row.events) == (10, 4, 4, 6, 70.0, 18)
    assert (row.avg_order_value, row.view_to_purchase_rate) == (17.5, 0.4)
    row = totals(spark, hourly, no_cats, categories_chosen=True)
    assert (row.purchases, row.revenue, row.avg_order_value) == (0, 0, 0)
    row = totals(spark, hourly, no_cats, prices_chosen=True)
    assert (row.purchases, row.revenue) == (4, 70.0)
    row = totals(spark, no_hours, no_cats, prices_chosen=True)
    assert (row.purchases, row.revenue) == (2, 0)
    row = re.report_totals(funnel(spark).filter("false"), no_hours, no_cats).first()
    assert tuple(row) == (0.0,) * 8


def test_tops_break_ties_by_name(spark):
    cats = sales(spark, "top_categories", ("b", "a"))
    assert rows(re.top_category(cats)) == [("a", 35.0)]
    hourly = sales(spark, "purchases_by_hour", (9, 3))
    assert rows(re.peak_hour(hourly)) == [(9, 3)]
    top = re.top_by_revenue(cats, "category").collect()
    assert [(r.category, r.purchase_count, r.revenue, r.avg_price) for r in top] == [
        ("a", 1, 35.0, None),
        ("b", 3, 35.0, 10.0),
    ]
    assert [r.weighted_avg_price for r in top] == [35.0, 35.0 / 3]
    assert re.top_by_revenue(cats, "category", 1).count() == 1
    assert [tuple(r) for r in re.hourly_totals(hourly).collect()] == [(3, 1, 35.0), (9, 3, 35.0)]


def test_weekdays(spark):
    week = table(
        spark, "conversion_by_weekday", (D[0], 2, 4, 1, 0.25), (D[7], 2, 0, 0, 0.0), (D[1], 3, 0, 0, 0.0), (D[2], 4, 2, 1, 0.5)
    )
    assert rows(re.best_weekday(week)) == [(4, "Wed", 0.5)]
    assert [(r.weekday, r.conversion_rate) for r in re.weekday_totals(week).collect()] == [
        ("Mon", 0.25),
        ("Tue", 0.0),
        ("Wed", 0.5),
    ]
    assert rows(re.best_weekday(week.filter("sessions = 0 AND day_of_week = 3"))) == [(3, "Tue", None)]


def test_long_forms(spark):
    assert [tuple(r) for r in re.funnel_totals(funnel(spark)).collect()] == [
        ("View", 10, 1.0),
        ("Cart", 4, 0.4),
        ("Purchase", 2, 0.2),
    ]
    assert [r.share_of_first for r in re.funnel_totals(funnel(spark).filter("views = 0")).collect()] == [0.0] * 3
    assert re.daily_activity(funnel(spark)).count() == 6
    record = spark.createDataFrame([(0.9, None, 0.5)], "auc DOUBLE, recall DOUBLE, precision DOUBLE")
    assert rows(re.metric_rows(record)) == [("auc", 0.9), ("precision", 0.5)]


def test_confusion_cells_from_any_form(spark):
    want = rows(re.confusion_cells(spark.createDataFrame([(1, 2, 3, 4)], "tn BIGINT, fp BIGINT, fn BIGINT, tp BIGINT")))
    assert ("Positive", "Negative", 3) in want and ("Negative", "Positive", 2) in want
    nested = spark.createDataFrame([((1, 2, 3, 4),)], "confusion_matrix STRUCT<tn: BIGINT, fp: BIGINT, fn: BIGINT, tp: BIGINT>")
    assert rows(re.confusion_cells(nested)) == want
    listed = spark.createDataFrame([([[1, 2], [3, 4]],)], "confusion_matrix ARRAY<ARRAY<BIGINT>>")
    assert rows(re.confusion_cells(listed)) == want


def test_distribution_over_range(spark):
    dist = table(
        spark,
        "session_distributions",
        ("x", D[0], 0.0, 1.5, 2),
        ("x", D[1], 0.0, 1.5, 3),
        ("y", D[1], 0.0, 1.0, 9),
    )
    assert rows(re.distribution_over_range(dist, "x")) == [(0.0, 1.5, 5, "0-2")]
    assert [r[0] for r in re.metric_options(dist).collect()] == ["x", "y"]


def test_insights_fill_up(spark):
    cats, hourly = sales(spark, "top_categories", ("b", "a")), sales(spark, "purchases_by_hour", (9, 3))
    week = table(spark, "conversion_by_weekday", (D[0], 2, 4, 1, 0.25))
    full = re.insight_rows(re.report_totals(funnel(spark), hourly, cats), hourly, cats, week).collect()
    assert [r.insight for r in full] == [
        "session_conversion_rate",
        "view_to_purchase_rate",
        "revenue",
        "top_category",
        "peak_purchase_hour",
    ]
    assert full[4].label == "09" and full[3].label == "a"
    none = cats.filter("false")
    some = re.insight_rows(re.report_totals(funnel(spark), hourly, none), hourly, none, week).collect()
    assert [r.insight for r in some][3:] == ["peak_purchase_hour", "best_weekday"]
    assert some[4].label == "Mon"


def test_no_match(spark):
    none = empty_table(spark, "top_brands")
    assert rows(re.no_match([none, none])) == [(True,)]
    assert rows(re.no_match([none, funnel(spark)])) == [(False,)]
