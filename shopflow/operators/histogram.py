"""Daily histograms of session metrics on quantile-based bins."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.functions.expressions import edge_bin, usable_edges
from shopflow.operators.events import in_date_range
from shopflow.operators.ranks import exact_quantiles
from shopflow.schema import conform

# The metrics reported by default, in order.
SESSION_METRICS = (
    "session_duration_seconds",
    "total_events",
    "num_views",
    "num_carts",
    "num_purchases",
    "avg_price_viewed",
    "max_price_viewed",
)


def present_metrics(sessions: DataFrame, metrics: Sequence[str] = SESSION_METRICS) -> list[str]:
    return [m for m in metrics if m in sessions.columns]


def metric_values(
    sessions: DataFrame, metrics: Sequence[str] = SESSION_METRICS, date_column: str = "session_date"
) -> DataFrame:
    """(metric, date, value) rows of the non-NULL metric values."""
    metrics = present_metrics(sessions, metrics)
    wide = sessions.select(date_column, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = wide.unpivot([date_column], metrics, "metric", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def approx_edges(
    sessions: DataFrame, metrics: Sequence[str] = SESSION_METRICS, bins: int = 10, accuracy: int = 100
) -> DataFrame:
    """Bin edges per metric from one pass of quantile sketches (rank error 1/accuracy)."""
    metrics = present_metrics(sessions, metrics)
    shares = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    sketches = sessions.agg(
        *[F.percentile_approx(F.col(m).cast("double"), shares, F.lit(accuracy)).alias(m) for m in metrics]
    )
    rows = sketches.unpivot([], metrics, "metric", "quantiles")
    return _as_edges(rows)


def exact_edges(
    sessions: DataFrame, metrics: Sequence[str] = SESSION_METRICS, bins: int = 10
) -> DataFrame:
    """Bin edges per metric at exact sample quantiles."""
    values = metric_values(sessions, metrics).select("metric", "value")
    return _as_edges(exact_quantiles(values, "metric", "value", bins))


#: Size of the sketches, and the rank error, as a share of all rows, that quantiles from them stay within.
SKETCH_SIZE = 800
SKETCH_ERROR = 0.01


def daily_sketches(
    sessions: DataFrame,
    metrics: Sequence[str] = SESSION_METRICS,
    date_column: str = "session_date",
    size: int = SKETCH_SIZE,
) -> DataFrame:
    """(session_date, metric, sketch): a mergeable sketch of a day's values, a few kilobytes each.

    Stored once, they give the edges of any range of days without the sessions.
    """
    metrics = present_metrics(sessions, metrics)
    finite = [F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")).alias(m) for m in metrics]
    wide = sessions.select(F.col(date_column).alias("session_date"), *finite)
    sketches = [F.kll_sketch_agg_double(m, F.lit(size)).alias(m) for m in metrics]
    rows = wide.groupBy("session_date").agg(*sketches).unpivot(["session_date"], metrics, "metric", "sketch")
    return rows.filter(F.kll_sketch_get_n_double("sketch") > 0)


def merged_quantiles(
    sketches: DataFrame, start: str | date | None = None, end: str | date | None = None, steps: int = 10
) -> DataFrame:
    """(metric, quantiles): those at 0, 1/steps, ..., 1 of a range of days, from :func:`daily_sketches`."""
    merged = in_date_range(sketches, "session_date", start, end).groupBy("metric")
    merged = merged.agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    shares = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    return merged.select("metric", F.kll_sketch_get_quantile_double("sketch", shares).alias("quantiles"))


def sketched_edges(
    sketches: DataFrame, start: str | date | None = None, end: str | date | None = None, bins: int = 10
) -> DataFrame:
    """Bin edges per metric for a range of days, from :func:`daily_sketches`."""
    return _as_edges(merged_quantiles(sketches, start, end, bins))


def _as_edges(quantiles: DataFrame) -> DataFrame:
    edges = quantiles.select("metric", usable_edges("quantiles").alias("edges"))
    return edges.filter(F.size("edges") >= 2)


def session_distributions(
    sessions: DataFrame,
    edges: DataFrame,
    metrics: Sequence[str] = SESSION_METRICS,
    date_column: str = "session_date",
) -> DataFrame:
    """Sessions per metric, day and bin. ``edges`` holds one row per metric, of any length.

    The bin's edges are the grouping key, so the aggregation buffers stay fixed width.
    """
    binned = (
        metric_values(sessions, metrics, date_column)
        .join(edges, "metric")
        .withColumn("bin", edge_bin("value", "edges"))
        .select(
            "metric",
            F.col(date_column).alias("session_date"),
            F.get("edges", F.col("bin")).alias("bin_start"),
            F.get("edges", F.col("bin") + 1).alias("bin_end"),
        )
    )
    counts = binned.groupBy("metric", "session_date", "bin_start", "bin_end").agg(
        F.count("*").alias("count")
    )
    return conform(counts, "session_distributions")
