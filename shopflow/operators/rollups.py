"""Daily conversion and commerce rollups, and the headline KPI record."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.functions.expressions import is_event, ratio
from shopflow.operators.events import in_date_range, with_brand, with_category
from shopflow.schema import conform


# Names of the KPIs of all events, and of the sales measures with their names in the KPIs.
EVENT_KPIS = ("total_events", "total_users", "min_event_date", "max_event_date")
SALES = {
    "purchase_count": "total_purchases",
    "revenue": "total_revenue",
    "avg_price": "avg_purchase_price",
    "min_price": "min_purchase_price",
    "max_price": "max_purchase_price",
}


def _event_measures(rows: Column) -> list[Column]:
    found = (rows, F.count_distinct("user_id"), F.min("event_date"), F.max("event_date"))
    return [c.alias(name) for c, name in zip(found, EVENT_KPIS, strict=True)]


def _sales_measures(rows: Column, price: Column) -> dict[str, Column]:
    found = (rows, F.sum(price), F.avg(price), F.min(price), F.max(price))
    return dict(zip(SALES, found, strict=True))


def _sales_kpis(measures: dict[str, Column]) -> list[Column]:
    return [c.alias(SALES[name]) for name, c in measures.items()]


def event_kpis(events: DataFrame) -> DataFrame:
    return events.agg(*_event_measures(F.count("*")))


def event_kpis_from_session_days(days: DataFrame) -> DataFrame:
    return days.agg(*_event_measures(F.coalesce(F.sum("events"), F.lit(0))))


def purchase_kpis(purchases: DataFrame) -> DataFrame:
    return purchases.agg(*_sales_kpis(_sales_measures(F.count("*"), F.col("price"))))


def activity_kpis(events: DataFrame) -> DataFrame:
    """The event and the purchase KPIs together, from one scan of the events."""
    price = F.when(is_event("purchase"), F.col("price"))
    bought = _sales_measures(F.count_if(is_event("purchase")), price)
    return events.agg(*_event_measures(F.count("*")), *_sales_kpis(bought))


def _merged_sales() -> dict[str, Column]:
    found = (
        F.sum("rows"),
        F.sum("price_sum"),
        ratio_or_null(F.sum("price_sum"), F.sum("priced_rows")),
        F.min("price_min"),
        F.max("price_max"),
    )
    return dict(zip(SALES, found, strict=True))


def purchase_kpis_from_cube(cube: DataFrame) -> DataFrame:
    merged = _merged_sales()
    merged["purchase_count"] = F.coalesce(merged["purchase_count"], F.lit(0))
    return cube.agg(*_sales_kpis(merged))


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator)


def one_row(df: DataFrame) -> Column:
    """The single row of ``df`` as a struct-valued scalar subquery (no join is planned)."""
    return df.select(F.struct(*df.columns).alias("row")).scalar()


def kpi_record(
    activity: DataFrame,
    sessions_row: DataFrame,
    purchases_row: DataFrame | None = None,
    currency: str = "USD",
) -> DataFrame:
    """Headline numbers as one row; missing values count as zero.

    ``activity`` comes from :func:`activity_kpis`, or holds event KPIs only with the
    purchase KPIs in ``purchases_row``. ``sessions_row`` comes from session_kpis.
    """
    wide = activity.withColumn("s", one_row(sessions_row))
    if purchases_row is None:
        wide = wide.withColumn("p", F.struct(*[c for c in activity.columns if "purchase" in c or "revenue" in c]))
    else:
        wide = wide.withColumn("p", one_row(purchases_row))

    def number(name: str, digits: int) -> Column:
        return F.round(F.coalesce(F.col(name), F.lit(0.0)), digits)

    revenue = F.coalesce(F.col("p.total_revenue"), F.lit(0.0))
    return wide.select(
        F.coalesce("total_events", F.lit(0)).alias("total_events"),
        F.coalesce("total_users", F.lit(0)).alias("total_users"),
        F.col("s.total_sessions").alias("total_sessions"),
        F.col("p.total_purchases").alias("total_purchases"),
        F.round(revenue, 2).alias("total_revenue"),
        F.round(ratio(revenue, "p.total_purchases"), 2).alias("avg_order_value"),
        F.round(ratio("s.purchase_sessions", "s.total_sessions"), 6).alias("conversion_rate"),
        number("s.avg_session_duration_seconds", 2).alias("avg_session_duration_seconds"),
        number("s.avg_events_per_session", 2).alias("avg_events_per_session"),
        F.col("min_event_date").cast("string").alias("min_event_date"),
        F.col("max_event_date").cast("string").alias("max_event_date"),
        number("p.min_purchase_price", 2).alias("min_purchase_price"),
        number("p.max_purchase_price", 2).alias("max_purchase_price"),
        F.lit(currency).alias("currency"),
    )


def funnel_daily(events: DataFrame) -> DataFrame:
    """Views, carts, purchases and distinct sessions per day.

    A session that runs over midnight counts on both days.
    """
    return events.groupBy("event_date").agg(
        F.count_if(is_event("view")).alias("views"),
        F.count_if(is_event("cart")).alias("carts"),
        F.count_if(is_event("purchase")).alias("purchases"),
        F.count_distinct("user_session").alias("sessions"),
    )


def funnel_from_session_days(days: DataFrame) -> DataFrame:
    return days.groupBy("event_date").agg(
        F.sum("views").alias("views"),
        F.sum("carts").alias("carts"),
        F.sum("purchases").alias("purchases"),
        F.count_distinct("user_session").alias("sessions"),
    )


def _sales() -> list[Column]:
    return [c.alias(name) for name, c in _sales_measures(F.count("*"), F.col("price")).items()]


def purchases_by_hour(purchases: DataFrame) -> DataFrame:
    return purchases.groupBy("event_date", F.hour("event_time").alias("hour")).agg(*_sales())


def category_daily(purchases: DataFrame) -> DataFrame:
    return with_category(purchases).groupBy("event_date", "category").agg(*_sales())


def brand_daily(purchases: DataFrame) -> DataFrame:
    return with_brand(purchases).groupBy("event_date", "brand").agg(*_sales())


def commerce_cube(purchases: DataFrame) -> DataFrame:
    """Mergeable sales measures per (day, hour, category, brand): one scan for all rollups."""
    return (
        with_brand(with_category(purchases))
        .groupBy("event_date", F.hour("event_time").alias("hour"), "category", "brand")
        .agg(
            F.count("*").alias("rows"),
            F.count("price").alias("priced_rows"),
            F.sum("price").alias("price_sum"),
            F.min("price").alias("price_min"),
            F.max("price").alias("price_max"),
        )
    )


def rollup_from_cube(cube: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """Merge the cube down to ``keys``, laid out as the named output table."""
    merged = cube.groupBy(*keys).agg(*[c.alias(name) for name, c in _merged_sales().items()])
    return conform(merged, table)


def page_totals(cube: DataFrame) -> DataFrame:
    """Sales by hour, category, brand and weekday, and of all, over the days of ``cube``: one pass for a page.

    (level, key, purchase_count, revenue, avg_price, min_price, max_price); the key is text, that of
    the level ``all`` NULL. Levels are grouping sets, so a row of the cube is read once.
    """
    levels = {"hour": F.col("hour"), "category": F.col("category"), "brand": F.col("brand")}
    levels["weekday"] = F.dayofweek("event_date")
    keyed = cube.select("*", *[c.cast("string").alias(f"{name}_key") for name, c in levels.items()])
    keys = [f"{name}_key" for name in levels]
    sets = [[F.col(k)] for k in keys] + [[]]
    merged = keyed.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        F.grouping_id(*keys).alias("set"), *[c.alias(name) for name, c in _merged_sales().items()]
    )
    level = F.lit("all")
    for i, name in enumerate(levels):  # the bits of the columns that a set leaves out are 1
        level = F.when(F.col("set") == (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)), name).otherwise(level)
    return merged.select(level.alias("level"), F.coalesce(*keys).alias("key"), *SALES)


def daily_user_bitmaps(events: DataFrame) -> DataFrame:
    """(event_date, block, users): who was there on a day, a bit for each user id, in blocks of 32,768 ids.

    Made once, the blocks give exact distinct users of any days without the events. A block takes 4 KB
    whatever it holds, which suits ids that are dense, as numbered accounts are.
    """
    ids = events.filter(F.col("user_id").isNotNull() & F.col("event_date").isNotNull())
    blocks = ids.groupBy("event_date", F.bitmap_bucket_number("user_id").alias("block"))
    return blocks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("users"))


def users_of_range(
    bitmaps: DataFrame, start: str | date | None = None, end: str | date | None = None
) -> DataFrame:
    """Distinct users of a range of days as one row, from :func:`daily_user_bitmaps`."""
    blocks = in_date_range(bitmaps, "event_date", start, end).groupBy("block")
    merged = blocks.agg(F.bitmap_count(F.bitmap_or_agg("users")).alias("users"))
    return merged.agg(F.coalesce(F.sum("users"), F.lit(0)).alias("total_users"))
