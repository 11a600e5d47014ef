"""The test tables seen as shop events.

Behaviour events come from ``events``; a session is a user's day. Commerce events come
from ``lineitem`` with ``orders`` and ``part``; a session is an order and spans several
days. Prices are whole cents, which keeps sums of doubles exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.operators.events import purchases, reportable_events
from shopflow.operators.model import logistic_score
from shopflow.operators.sessions import (
    session_features_in_range,
)

# Report range used by the queries that filter days.
START, END = "2024-01-05", "2024-01-24"
L_START, L_END = "1996-03-01", "1999-08-31"

# A fixed example model: scores spread over (0, 1) on the behaviour sessions.
EXAMPLE_WEIGHTS = {
    "total_events": 0.125,
    "num_views": -0.375,
    "num_carts": 0.75,
    "unique_products": 0.0625,
    "avg_price_viewed": 0.0001,
    "max_price_viewed": -0.00005,
    "hour_of_day": -0.03125,
    "day_of_week": -0.0625,
    "is_weekend": 0.25,
}
EXAMPLE_INTERCEPT = -0.5
SCORE_STEPS = 2**30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(number, prefix: str, modulus: int, name):
    m = number % modulus
    return F.when(m == 0, None).when(m == 1, "").otherwise(F.concat(F.lit(prefix), name.cast("string")))


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean events from ``events``; some have no session or no price."""
    k = F.col("k")
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", F.regexp_extract("props", r"([0-9]+)", 1).cast("bigint"))
        .withColumn("event_time", F.date_trunc("second", F.col("ts").cast("timestamp")))
        .select(
            "event_time",
            F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type")).alias("event_type"),
            k.alias("product_id"),
            F.floor(k / 10).alias("category_id"),
            _code(k, "cat.", 5, F.floor(k / 10)).alias("category_code"),
            _code(k, "b", 7, k % 7).alias("brand"),
            F.when(k % 13 != 5, F.round(F.col("value") * 100)).alias("price"),
            "user_id",
            F.when(
                k % 11 != 3,
                F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("event_time").cast("string")),
            ).alias("user_session"),
            F.to_date("event_time").alias("event_date"),
            "event_id",
        )
    )


def raw_behaviour(spark: SparkSession, sf_dir: str, keep: str | None = None) -> DataFrame:
    """The behaviour events as raw text rows, every so often broken in some way; and a column to ``keep``."""
    text = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")
    n = F.col("event_id")
    written = (
        F.when(n % 101 == 0, "not a time")
        .when(n % 103 == 0, None)
        .when(n % 2 == 0, F.concat(F.lit("  "), text))
        .otherwise(F.concat(text, F.lit("  UTC")))
    )
    return behaviour(spark, sf_dir).select(
        written.alias("event_time"),
        F.when(n % 107 != 0, F.col("event_type")).alias("event_type"),
        "product_id",
        "category_id",
        "category_code",
        "brand",
        F.when(n % 109 == 0, -1.0).otherwise(F.col("price")).alias("price"),
        F.when(n % 127 != 0, F.col("user_id")).alias("user_id"),
        "user_session",
        *([keep] if keep else []),
    )


def commerce(spark: SparkSession, sf_dir: str, user: bool = True, part: bool = True) -> DataFrame:
    """Clean events from ``lineitem``; columns from orders and part only where asked for."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    if user:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if part:
        parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
        lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    hours = F.col("l_linenumber") * 3 + (F.col("l_orderkey") % 3).cast("int")
    kind = F.when(F.col("l_returnflag") == "N", "view").when(F.col("l_returnflag") == "A", "cart")
    return lines.withColumn(
        "event_time", F.timestamp_add("HOUR", hours, F.col("l_shipdate")).cast("timestamp")
    ).select(
        "event_time",
        kind.otherwise("purchase").alias("event_type"),
        F.col("l_partkey").alias("product_id"),
        *(
            [
                F.col("p_size").cast("bigint").alias("category_id"),
                F.col("p_type").alias("category_code"),
                F.col("p_brand").alias("brand"),
            ]
            if part
            else []
        ),
        F.round(F.col("l_extendedprice") * 100).alias("price"),
        *([F.col("o_custkey").alias("user_id")] if user else []),
        F.col("l_orderkey").cast("string").alias("user_session"),
        F.to_date("event_time").alias("event_date"),
    )


def shop_events(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    return reportable_events(behaviour(spark, sf_dir), start, end)


def shop_purchases(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    return purchases(shop_events(spark, sf_dir, start, end))


def commerce_events(spark: SparkSession, sf_dir: str, start=None, end=None, **parts) -> DataFrame:
    return reportable_events(commerce(spark, sf_dir, **parts), start, end)


def behaviour_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the behaviour sessions that hold an allowed event."""
    return session_features_in_range(behaviour(spark, sf_dir))


def commerce_sessions(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """Features and dates of the commerce sessions with an event in range, in one scan."""
    return session_features_in_range(commerce(spark, sf_dir), start, end)


def scored(sessions: DataFrame) -> DataFrame:
    """Example scores, cut to multiples of 2^-30 so that their sums are exact in any order."""
    steps = F.lit(float(SCORE_STEPS))
    return sessions.select(
        "user_session",
        "session_date",
        F.col("purchase_in_session").alias("label"),
        (F.floor(logistic_score(EXAMPLE_WEIGHTS, EXAMPLE_INTERCEPT) * steps) / steps).alias("pred_prob"),
    )


def example_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_session, session_date, label, pred_prob) of the behaviour sessions."""
    return scored(behaviour_sessions(spark, sf_dir))
