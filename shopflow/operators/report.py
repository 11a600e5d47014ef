"""Filtering and re-aggregation of the report tables for a chosen range of days.

The inputs are daily aggregates, so each operator is one small aggregation. Results that
combine tables use scalar subqueries of one-row aggregates rather than joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.functions.expressions import range_label, ratio, weekday_name
from shopflow.operators.events import in_date_range
from shopflow.operators.rollups import one_row


def date_bounds(tables: Sequence[tuple[DataFrame, str]], kpis: DataFrame | None = None) -> DataFrame:
    """First and last date over many tables and the KPI record; today if there is none."""
    parts = [
        df.agg(F.min(F.col(c).cast("date")).alias("lo"), F.max(F.col(c).cast("date")).alias("hi"))
        for df, c in tables
        if c in df.columns
    ]
    if kpis is not None:
        parts.append(
            kpis.select(
                F.col("min_event_date").try_cast("date").alias("lo"),
                F.col("max_event_date").try_cast("date").alias("hi"),
            )
        )
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    bounds = every.agg(
        F.coalesce(F.min("lo"), F.current_date()).alias("lo"),
        F.coalesce(F.max("hi"), F.current_date()).alias("hi"),
    )
    return bounds.select(
        F.least("lo", "hi").alias("min_date"), F.greatest("lo", "hi").alias("max_date")
    )


def filter_dates(
    df: DataFrame, column: str, start: str | date | None = None, end: str | date | None = None
) -> DataFrame:
    """Inclusive date filter; a table without the column passes unchanged."""
    return in_date_range(df, column, start, end) if column in df.columns else df


def last_days(bounds: DataFrame, days: int | None) -> DataFrame:
    """Start and end of the last ``days`` days within the bounds; all of them for None."""
    end = F.col("max_date")
    start = F.col("min_date")
    if days is not None:
        start = F.greatest(start, F.date_sub(end, days - 1))
    return bounds.select(start.alias("start_date"), end.alias("end_date"))


def filter_to(df: DataFrame, column: str, window: DataFrame) -> DataFrame:
    """Rows within the one-row (start_date, end_date) table, which stays inside Spark."""
    days = one_row(window)
    return df.filter(F.col(column).between(days["start_date"], days["end_date"]))


def category_options(categories: DataFrame) -> DataFrame:
    return categories.select("category").dropna().distinct().orderBy("category")


def filter_categories(categories: DataFrame, chosen: Iterable[str]) -> DataFrame:
    chosen = list(chosen)
    return categories.filter(F.col("category").isin(chosen)) if chosen else categories


def price_bounds(tables: Sequence[DataFrame]) -> DataFrame:
    """Lowest and highest price over the min, max and average price columns of all tables."""

    def extreme(df: DataFrame, names: Sequence[str], agg, pick) -> Column:
        found = [agg(n) for n in names if n in df.columns]
        if not found:
            return F.lit(None).cast("double")
        return found[0] if len(found) == 1 else pick(*found)

    parts = [
        df.agg(
            extreme(df, ("min_price", "avg_price"), F.min, F.least).alias("lo"),
            extreme(df, ("max_price", "avg_price"), F.max, F.greatest).alias("hi"),
        )
        for df in tables
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.agg(F.min("lo").alias("price_min"), F.max("hi").alias("price_max"))


def filter_prices(df: DataFrame, low: float, high: float) -> DataFrame:
    """Rows whose average price is within [low, high]; tables without one pass unchanged."""
    return df.filter(F.col("avg_price").between(low, high)) if "avg_price" in df.columns else df


def _total(c: str, kind: str = "double") -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(kind)


def report_totals(
    funnel: DataFrame,
    hourly: DataFrame,
    categories: DataFrame,
    categories_chosen: bool = False,
    prices_chosen: bool = False,
) -> DataFrame:
    """Totals of the filtered tables as one row.

    Purchases and revenue come from the category table; if that is empty they are zero
    under a category filter, else from the hourly table (purchases only under a price
    filter) or the funnel.
    """
    h = one_row(
        hourly.agg(
            F.count("*").alias("n"),
            _total("purchase_count").alias("purchases"),
            _total("revenue").alias("revenue"),
        )
    )
    c = one_row(
        categories.agg(
            F.count("*").alias("n"),
            _total("purchase_count").alias("purchases"),
            _total("revenue").alias("revenue"),
        )
    )
    base = funnel.agg(
        _total("views").alias("views"),
        _total("carts").alias("carts"),
        _total("purchases").alias("funnel_purchases"),
        _total("sessions").alias("sessions"),
    ).withColumns({"h": h, "c": c})

    chosen, priced = F.lit(categories_chosen), F.lit(prices_chosen)
    sold = (
        F.when(F.col("c.n") > 0, F.col("c.purchases"))
        .when(chosen, F.lit(0.0))
        .when(priced & (F.col("h.n") > 0), F.col("h.purchases"))
        .otherwise(F.col("funnel_purchases"))
    )
    revenue = (
        F.when(F.col("c.n") > 0, F.col("c.revenue"))
        .when(chosen, F.lit(0.0))
        .otherwise(F.col("h.revenue"))
    )
    totals = base.select("views", "carts", sold.alias("purchases"), "sessions", revenue.alias("revenue"))
    return totals.withColumns(
        {
            "events": F.col("views") + F.col("carts") + F.col("purchases"),
            "avg_order_value": ratio("revenue", "purchases"),
            "view_to_purchase_rate": ratio("purchases", "views"),
        }
    )


def peak_hour(hourly: DataFrame) -> DataFrame:
    return (
        hourly.groupBy("hour")
        .agg(F.sum("purchase_count").alias("purchase_count"))
        .orderBy(F.desc("purchase_count"), "hour")
        .limit(1)
    )


def top_category(categories: DataFrame) -> DataFrame:
    return (
        categories.groupBy("category")
        .agg(F.sum("revenue").alias("revenue"))
        .orderBy(F.desc_nulls_last("revenue"), "category")
        .limit(1)
    )


def best_weekday(weekdays: DataFrame) -> DataFrame:
    """Weekday with the highest share of buying sessions; unknown rates come last."""
    sums = weekdays.groupBy("day_of_week").agg(
        F.sum("sessions").alias("sessions"), F.sum("purchases").alias("purchases")
    )
    rated = sums.select(
        "day_of_week",
        weekday_name("day_of_week").alias("weekday"),
        F.when(F.col("sessions") != 0, F.col("purchases") / F.col("sessions")).alias("rate"),
    )
    return rated.orderBy(F.desc_nulls_last("rate"), "day_of_week").limit(1)


def top_by_revenue(table: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Top ``k`` keys by revenue, with the plain and the sales-weighted mean of avg_price."""
    sums = table.groupBy(key).agg(
        F.sum("purchase_count").alias("purchase_count"),
        F.sum("revenue").alias("revenue"),
        F.avg("avg_price").alias("avg_price"),
    )
    return (
        sums.withColumn("weighted_avg_price", ratio("revenue", "purchase_count"))
        .orderBy(F.desc_nulls_last("revenue"), key)
        .limit(k)
    )


def hourly_totals(hourly: DataFrame) -> DataFrame:
    return (
        hourly.groupBy("hour")
        .agg(F.sum("purchase_count").alias("purchase_count"), F.sum("revenue").alias("revenue"))
        .orderBy("hour")
    )


def weekday_totals(weekdays: DataFrame) -> DataFrame:
    sums = weekdays.groupBy("day_of_week").agg(
        F.sum("sessions").alias("sessions"), F.sum("purchases").alias("purchases")
    )
    return sums.withColumns(
        {
            "conversion_rate": ratio("purchases", "sessions"),
            "weekday": weekday_name("day_of_week"),
        }
    ).orderBy("day_of_week")


def metric_options(distributions: DataFrame) -> DataFrame:
    return distributions.select("metric").distinct().orderBy("metric")


def distribution_over_range(distributions: DataFrame, metric: str) -> DataFrame:
    """Sessions per bin of one metric over all given days."""
    return (
        distributions.filter(F.col("metric") == metric)
        .groupBy("bin_start", "bin_end")
        .agg(F.sum("count").alias("count"))
        .withColumn("bin_label", range_label("bin_start", "bin_end", 0))
        .orderBy("bin_start")
    )


def funnel_totals(funnel: DataFrame) -> DataFrame:
    """Views, carts and purchases as stages, each with its share of the first stage."""
    sums = funnel.agg(
        _total("views", "bigint").alias("View"),
        _total("carts", "bigint").alias("Cart"),
        _total("purchases", "bigint").alias("Purchase"),
    )
    first = F.col("first_stage")
    stages = sums.withColumn("first_stage", F.col("View")).unpivot(
        ["first_stage"], ["View", "Cart", "Purchase"], "stage", "count"
    )
    return stages.select("stage", "count", ratio("count", first).alias("share_of_first"))


def daily_activity(funnel: DataFrame) -> DataFrame:
    """(event_date, series, value) rows of the daily funnel."""
    return funnel.unpivot(["event_date"], ["views", "carts", "purchases"], "series", "value")


# The scores listed for a model, in order.
MODEL_SCORES = ("auc", "accuracy", "precision", "recall", "f1")


def metric_rows(record: DataFrame, names: Sequence[str] = MODEL_SCORES) -> DataFrame:
    """(metric, value) rows of a one-row record; absent and NULL metrics are left out."""
    present = [n for n in names if n in record.columns]
    wide = record.select(*[F.col(n).cast("double").alias(n) for n in present])
    return wide.unpivot([], present, "metric", "value").dropna(subset=["value"])


def confusion_cells(record: DataFrame) -> DataFrame:
    """Confusion counts as (actual, predicted, count) cells.

    Takes tn, fp, fn, tp columns, or a ``confusion_matrix`` column holding a struct of
    those names or a 2x2 array.
    """
    if "confusion_matrix" in record.columns:
        kind = record.schema["confusion_matrix"].dataType.typeName()
        cell = F.col("confusion_matrix")
        if kind == "array":
            record = record.select(
                cell[0][0].alias("tn"), cell[0][1].alias("fp"), cell[1][0].alias("fn"), cell[1][1].alias("tp")
            )
        else:
            record = record.select("confusion_matrix.*")
    cells = record.select(*[F.col(n).cast("bigint").alias(n) for n in ("tn", "fp", "fn", "tp")])
    long = cells.unpivot([], ["tn", "fp", "fn", "tp"], "cell", "count")
    actual = F.when(F.col("cell").isin("fn", "tp"), "Positive").otherwise("Negative")
    predicted = F.when(F.col("cell").isin("fp", "tp"), "Positive").otherwise("Negative")
    return long.select(actual.alias("actual"), predicted.alias("predicted"), "count")


def insight_rows(
    totals: DataFrame,
    hourly: DataFrame,
    categories: DataFrame,
    weekdays: DataFrame,
    session_rate: DataFrame | None = None,
) -> DataFrame:
    """Five facts as (position, insight, value, label); the wording is left to the reader.

    The best weekday is listed only if there is room, and a hint fills what is left.
    ``session_rate`` is a one-row table with an actual_session_conversion_rate.
    """
    null_text, null_number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def fact(df: DataFrame, position: int, name: str, value: Column, label: Column) -> DataFrame:
        return df.select(
            F.lit(position).alias("position"),
            F.lit(name).alias("insight"),
            value.cast("double").alias("value"),
            label.cast("string").alias("label"),
        )

    rate = session_rate if session_rate is not None else totals
    rate_value = (
        F.col("actual_session_conversion_rate")
        if session_rate is not None
        else ratio("purchases", "sessions")
    )
    facts = [
        fact(rate, 1, "session_conversion_rate", rate_value, null_text),
        fact(totals, 2, "view_to_purchase_rate", F.col("view_to_purchase_rate"), null_text),
        fact(totals, 3, "revenue", F.col("revenue"), null_text),
        fact(top_category(categories), 4, "top_category", F.col("revenue"), F.col("category")),
        fact(peak_hour(hourly), 5, "peak_purchase_hour", F.col("purchase_count"), F.lpad(F.col("hour").cast("string"), 2, "0")),
        fact(best_weekday(weekdays), 6, "best_weekday", F.coalesce("rate", F.lit(0.0)), F.col("weekday")),
    ]
    hints = totals.select(F.explode(F.sequence(F.lit(7), F.lit(9))).alias("position"))
    facts.append(
        hints.select("position", F.lit("hint").alias("insight"), null_number.alias("value"), null_text.alias("label"))
    )
    every = facts[0]
    for f in facts[1:]:
        every = every.unionByName(f)
    return every.orderBy("position").limit(5)


def no_match(tables: Sequence[DataFrame]) -> DataFrame:
    """One row telling whether all the given tables are empty."""
    probes = [df.select(F.lit(1).alias("x")).limit(1) for df in tables]
    every = probes[0]
    for p in probes[1:]:
        every = every.union(p)
    return every.agg((F.count("x") == 0).alias("no_match"))
