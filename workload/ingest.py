"""Cleaning and filtering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopflow.operators.events import (
    clean_events,
    ingest_summary,
    purchases,
    reportable_events,
    with_brand,
    with_category,
)
from workload import views as v
from workload.registry import query


@query(
    "clean_events",
    """
    SELECT event_date, event_type, COUNT(*) AS events, COUNT(price) AS priced, SUM(price) AS price_sum,
      MIN(event_time) AS first_event, MAX(event_time) AS last_event, COUNT(DISTINCT user_id) AS users,
      CAST(SUM(CAST(epoch(event_time) AS BIGINT) % 1000003) AS BIGINT) AS time_check
    FROM clean_e GROUP BY event_date, event_type
    """,
    "clean_e",
)
def clean(spark, sf_dir):
    return (
        clean_events(v.raw_behaviour(spark, sf_dir))
        .groupBy("event_date", "event_type")
        .agg(
            F.count("*").alias("events"),
            F.count("price").alias("priced"),
            F.sum("price").alias("price_sum"),
            F.min("event_time").cast("timestamp_ntz").alias("first_event"),
            F.max("event_time").cast("timestamp_ntz").alias("last_event"),
            F.count_distinct("user_id").alias("users"),
            F.sum(F.unix_timestamp("event_time") % 1000003).alias("time_check"),
        )
    )


@query(
    "clean_event_rows",
    """
    SELECT event_time, event_type, product_id, category_id, category_code, brand, price, user_id,
      user_session, event_date
    FROM clean_e
    """,
    "clean_e",
)
def clean_rows(spark, sf_dir):
    events = clean_events(v.raw_behaviour(spark, sf_dir))
    return events.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


@query(
    "ingest_summary",
    """
    SELECT (SELECT COUNT(*) FROM raw_e) AS input_rows, COUNT(*) AS output_rows,
      COUNT(DISTINCT user_id) AS distinct_users, COUNT(DISTINCT user_session) AS distinct_sessions,
      strftime(MIN(event_time), '%Y-%m-%d %H:%M:%S') AS min_event_time,
      strftime(MAX(event_time), '%Y-%m-%d %H:%M:%S') AS max_event_time
    FROM clean_e
    """,
    "raw_e clean_e",
)
def summary(spark, sf_dir):
    row = ingest_summary(v.raw_behaviour(spark, sf_dir))
    as_text = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("min_event_time", "max_event_time")}
    return row.withColumns(as_text)


@query(
    "event_filters",
    f"""
    SELECT event_date, COUNT(*) AS events, COUNT(*) FILTER (event_type = 'purchase') AS purchases,
      COUNT(DISTINCT user_session) AS sessions
    FROM er WHERE event_date BETWEEN DATE '{v.START}' AND DATE '{v.END}' GROUP BY event_date
    """,
    "er",
)
def event_filters(spark, sf_dir):
    return (
        v.shop_events(spark, sf_dir, v.START, v.END)
        .groupBy("event_date")
        .agg(
            F.count("*").alias("events"),
            F.count_if(F.col("event_type") == "purchase").alias("purchases"),
            F.count_distinct("user_session").alias("sessions"),
        )
    )


@query(
    "event_filters_all_types",
    """
    SELECT event_type, COUNT(*) AS events FROM e WHERE user_session IS NOT NULL GROUP BY event_type
    """,
    "e",
)
def event_filters_all_types(spark, sf_dir):
    kept = reportable_events(v.behaviour(spark, sf_dir), event_types=None)
    return kept.groupBy("event_type").agg(F.count("*").alias("events"))


@query(
    "purchase_rows",
    """
    SELECT user_session, event_time, product_id, price, user_id FROM l WHERE event_type = 'purchase'
    """,
    "l",
)
def purchase_rows(spark, sf_dir):
    kept = purchases(v.commerce_events(spark, sf_dir, part=False))
    return kept.select(
        "user_session", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "product_id", "price", "user_id"
    )


@query(
    "category_brand_resolution",
    """
    SELECT CASE WHEN COALESCE(category_code, CAST(category_id AS VARCHAR)) = '' THEN 'unknown'
        ELSE COALESCE(category_code, CAST(category_id AS VARCHAR), 'unknown') END AS category,
      CASE WHEN brand IS NULL OR brand = '' THEN 'unknown' ELSE brand END AS brand, COUNT(*) AS events
    FROM e GROUP BY 1, 2
    """,
    "e",
)
def category_brand_resolution(spark, sf_dir):
    named = with_brand(with_category(v.behaviour(spark, sf_dir)))
    return named.groupBy("category", "brand").agg(F.count("*").alias("events"))
