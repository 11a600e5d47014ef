"""Rollup and KPI queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopflow.operators import rollups
from shopflow.operators.events import purchases
from shopflow.operators.sessions import session_days, session_kpis
from workload import views as v
from workload.registry import query

_L_FUNNEL = """
    SELECT event_date, COUNT(*) FILTER (event_type = 'view') AS views,
      COUNT(*) FILTER (event_type = 'cart') AS carts,
      COUNT(*) FILTER (event_type = 'purchase') AS purchases, COUNT(DISTINCT user_session) AS sessions
    FROM l GROUP BY event_date
"""
_KPI_SQL = """
    SELECT COUNT(*) AS total_events, COUNT(DISTINCT user_id) AS total_users,
      (SELECT COUNT(*) FROM {s}) AS total_sessions,
      COUNT(*) FILTER (event_type = 'purchase') AS total_purchases,
      ROUND(SUM(price) FILTER (event_type = 'purchase'), 2) AS total_revenue,
      ROUND(SUM(price) FILTER (event_type = 'purchase') / COUNT(*) FILTER (event_type = 'purchase'), 2)
        AS avg_order_value,
      (SELECT ROUND(SUM(purchase_in_session) / COUNT(*), 6) FROM {s}) AS conversion_rate,
      (SELECT ROUND(AVG(session_duration_seconds), 2) FROM {s}) AS avg_session_duration_seconds,
      (SELECT ROUND(AVG(total_events), 2) FROM {s}) AS avg_events_per_session,
      CAST(MIN(event_date) AS VARCHAR) AS min_event_date, CAST(MAX(event_date) AS VARCHAR) AS max_event_date,
      ROUND(MIN(price) FILTER (event_type = 'purchase'), 2) AS min_purchase_price,
      ROUND(MAX(price) FILTER (event_type = 'purchase'), 2) AS max_purchase_price, 'USD' AS currency
    FROM {e}
"""


@query(
    "event_kpis",
    """
    SELECT COUNT(*) AS total_events, COUNT(DISTINCT user_id) AS total_users,
      MIN(event_date) AS min_event_date, MAX(event_date) AS max_event_date FROM l
    """,
    "l",
)
def event_kpis(spark, sf_dir):
    return rollups.event_kpis(v.commerce_events(spark, sf_dir, part=False))


@query(
    "purchase_kpis",
    """
    SELECT COUNT(*) AS total_purchases, SUM(price) AS total_revenue, AVG(price) AS avg_purchase_price,
      MIN(price) AS min_purchase_price, MAX(price) AS max_purchase_price FROM lp
    """,
    "lp",
)
def purchase_kpis(spark, sf_dir):
    return rollups.purchase_kpis(purchases(v.commerce_events(spark, sf_dir, user=False, part=False)))


@query("kpi_record", _KPI_SQL.format(e="l", s="ls"), "l ls")
def kpi_record(spark, sf_dir):
    events = v.commerce_events(spark, sf_dir, part=False)
    return rollups.kpi_record(
        rollups.activity_kpis(events), session_kpis(v.commerce_sessions(spark, sf_dir))
    )


@query("kpi_record_shared_scan", _KPI_SQL.format(e="er", s="es"), "er es")
def kpi_record_shared(spark, sf_dir):
    """The same record from the shared session-day table and sales cube."""
    return rollups.kpi_record(
        rollups.event_kpis_from_session_days(session_days(v.shop_events(spark, sf_dir))),
        session_kpis(v.behaviour_sessions(spark, sf_dir)),
        rollups.purchase_kpis_from_cube(rollups.commerce_cube(v.shop_purchases(spark, sf_dir))),
    )


@query("funnel_daily", "SELECT * FROM funnel", "funnel")
def funnel_daily(spark, sf_dir):
    return rollups.funnel_daily(v.shop_events(spark, sf_dir))


@query("funnel_daily_commerce", _L_FUNNEL, "l")
def funnel_daily_commerce(spark, sf_dir):
    return rollups.funnel_daily(v.commerce_events(spark, sf_dir, user=False, part=False))


@query("funnel_from_session_days", _L_FUNNEL, "l")
def funnel_shared(spark, sf_dir):
    return rollups.funnel_from_session_days(session_days(v.commerce_events(spark, sf_dir, part=False)))


@query(
    "session_days",
    """
    SELECT user_session, event_date, user_id, COUNT(*) AS events,
      COUNT(*) FILTER (event_type = 'view') AS views, COUNT(*) FILTER (event_type = 'cart') AS carts,
      COUNT(*) FILTER (event_type = 'purchase') AS purchases, MIN(event_time) AS first_event
    FROM er GROUP BY ALL
    """,
    "er",
)
def days(spark, sf_dir):
    table = session_days(v.shop_events(spark, sf_dir))
    return table.withColumn("first_event", F.col("first_event").cast("timestamp_ntz"))


@query("purchases_by_hour", "SELECT * FROM hourly", "hourly")
def purchases_by_hour(spark, sf_dir):
    return rollups.purchases_by_hour(v.shop_purchases(spark, sf_dir))


@query("category_daily", "SELECT * FROM categories", "categories")
def category_daily(spark, sf_dir):
    return rollups.category_daily(v.shop_purchases(spark, sf_dir))


@query("category_daily_commerce", "SELECT * FROM l_categories", "l_categories")
def category_daily_commerce(spark, sf_dir):
    return rollups.category_daily(purchases(v.commerce_events(spark, sf_dir, user=False)))


@query("brand_daily", "SELECT * FROM brands", "brands")
def brand_daily(spark, sf_dir):
    return rollups.brand_daily(v.shop_purchases(spark, sf_dir))


@query("brand_daily_commerce", "SELECT * FROM l_brands", "l_brands")
def brand_daily_commerce(spark, sf_dir):
    return rollups.brand_daily(purchases(v.commerce_events(spark, sf_dir, user=False)))


def _l_cube(spark, sf_dir):
    return rollups.commerce_cube(purchases(v.commerce_events(spark, sf_dir, user=False)))


@query("hourly_from_cube", "SELECT * FROM l_hourly", "l_hourly")
def hourly_from_cube(spark, sf_dir):
    return rollups.rollup_from_cube(_l_cube(spark, sf_dir), ["event_date", "hour"], "purchases_by_hour")


@query("categories_from_cube", "SELECT * FROM l_categories", "l_categories")
def categories_from_cube(spark, sf_dir):
    return rollups.rollup_from_cube(_l_cube(spark, sf_dir), ["event_date", "category"], "top_categories")


@query("brands_from_cube", "SELECT * FROM l_brands", "l_brands")
def brands_from_cube(spark, sf_dir):
    return rollups.rollup_from_cube(_l_cube(spark, sf_dir), ["event_date", "brand"], "top_brands")
