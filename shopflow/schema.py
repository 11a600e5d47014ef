"""Declared schemas: the raw event file and every table the library produces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "DATE": T.DateType(),
}


def _struct(columns: str) -> T.StructType:
    """A schema from "name TYPE, ..." that needs no running session."""
    pairs = [c.split(" ") for c in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Names and types of the raw event file, in file order.
RAW_EVENT_SCHEMA = _struct(
    "event_time STRING, event_type STRING, product_id BIGINT, category_id BIGINT, "
    "category_code STRING, brand STRING, price DOUBLE, user_id BIGINT, user_session STRING"
)
RAW_COLUMNS = RAW_EVENT_SCHEMA.names

# The event types that count as shop activity.
SHOP_EVENT_TYPES = ("view", "cart", "purchase")

_SALES = "purchase_count BIGINT, revenue DOUBLE, avg_price DOUBLE, min_price DOUBLE, max_price DOUBLE"

# Column order and types of the produced tables.
TABLES = {
    "session_features": (
        "user_session STRING, user_id BIGINT, total_events BIGINT, num_views BIGINT, "
        "num_carts BIGINT, num_purchases BIGINT, unique_products BIGINT, "
        "unique_categories BIGINT, session_duration_seconds BIGINT, session_date DATE, "
        "avg_price_viewed DOUBLE, max_price_viewed DOUBLE, hour_of_day INT, "
        "day_of_week INT, is_weekend INT, purchase_in_session INT"
    ),
    "funnel_daily": "event_date DATE, views BIGINT, carts BIGINT, purchases BIGINT, sessions BIGINT",
    "purchases_by_hour": f"event_date DATE, hour INT, {_SALES}",
    "conversion_by_weekday": (
        "session_date DATE, day_of_week INT, sessions BIGINT, purchases BIGINT, "
        "conversion_rate DOUBLE"
    ),
    "top_categories": f"event_date DATE, category STRING, {_SALES}",
    "top_brands": f"event_date DATE, brand STRING, {_SALES}",
    "session_distributions": (
        "metric STRING, session_date DATE, bin_start DOUBLE, bin_end DOUBLE, count BIGINT"
    ),
    "propensity_daily": (
        "date DATE, sessions BIGINT, purchases BIGINT, mean_pred_prob DOUBLE, "
        "actual_session_conversion_rate DOUBLE"
    ),
    "propensity_hist": (
        "bucket_low DOUBLE, bucket_high DOUBLE, probability_bin STRING, sessions_count BIGINT"
    ),
    "propensity_threshold": (
        "threshold DOUBLE, pct_sessions_above DOUBLE, precision_at_threshold DOUBLE, "
        "recall_at_threshold DOUBLE"
    ),
    "calibration_bins": (
        "bin_low DOUBLE, bin_high DOUBLE, mean_pred_prob DOUBLE, actual_rate DOUBLE, sessions BIGINT"
    ),
    "threshold_curves": (
        "threshold DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE, pct_flagged DOUBLE"
    ),
}


def table_schema(name: str) -> T.StructType:
    return _struct(TABLES[name])


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """A zero-row table with the declared columns, for outputs that are unavailable."""
    return spark.createDataFrame([], table_schema(name))


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project ``df`` onto the declared columns of table ``name``, in order and type."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in table_schema(name)])
