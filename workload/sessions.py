"""Session feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopflow.operators.events import reportable_events
from shopflow.operators.histogram import (
    approx_edges,
    daily_sketches,
    exact_edges,
    session_distributions,
    sketched_edges,
)
from shopflow.operators.sessions import (
    conversion_by_weekday,
    feature_summary,
    session_days,
    session_features,
    session_features_in_range,
    session_kpis,
    starts_from_session_days,
    sessions_in_range,
)
from shopflow.sources.scratch import stored
from workload import views as v
from workload.registry import query
from workload.sql_views import _FEATURES

HISTOGRAM_RANGES = (("2024-01-01", "2024-01-31"), (v.START, v.END))


@query("session_features_behaviour", "SELECT * FROM ef", "ef")
def features_behaviour(spark, sf_dir):
    return session_features(v.behaviour(spark, sf_dir))


@query("session_features_commerce", "SELECT * FROM lf", "lf")
def features_commerce(spark, sf_dir):
    return session_features(v.commerce(spark, sf_dir))


@query("session_features_in_range", _FEATURES.format(source="lr"), "lr")
def features_in_range(spark, sf_dir):
    return session_features(v.commerce(spark, sf_dir), v.L_START, v.L_END)


@query(
    "feature_summary",
    """
    SELECT COUNT(*) AS row_count, ROUND(SUM(purchase_in_session) / COUNT(*), 6) AS positive_rate FROM lf
    """,
    "lf",
)
def summary(spark, sf_dir):
    return feature_summary(session_features(v.commerce(spark, sf_dir)))


@query("session_dates_join", "SELECT * FROM lsr", "lsr")
def dates_join(spark, sf_dir):
    """All features joined with the dates of the sessions in range, as the report does."""
    source = v.commerce(spark, sf_dir)
    starts = starts_from_session_days(session_days(reportable_events(source, v.L_START, v.L_END)))
    return sessions_in_range(session_features(source), starts, v.L_START, v.L_END).drop("session_start")


@query(
    "weekday_of_first_event",
    """
    SELECT user_session, CAST(dayofweek(MIN(event_time)) + 1 AS INTEGER) AS day_of_week FROM lr GROUP BY user_session
    """,
    "lr",
)
def weekday_of_first_event(spark, sf_dir):
    """Features that were stored without a weekday get that of the first event in range."""
    source = v.commerce(spark, sf_dir)
    starts = starts_from_session_days(session_days(reportable_events(source, v.L_START, v.L_END)))
    lacking = session_features(source).drop("day_of_week", "session_date")
    return sessions_in_range(lacking, starts).select("user_session", "day_of_week")


@query("sessions_in_range_one_scan", "SELECT * FROM lsr", "lsr")
def in_range_one_scan(spark, sf_dir):
    return session_features_in_range(v.commerce(spark, sf_dir), v.L_START, v.L_END)


@query(
    "session_day_starts",
    """
    SELECT f.* EXCLUDE (session_date), d.session_date
    FROM ef f JOIN (SELECT user_session, CAST(MIN(event_time) AS DATE) AS session_date FROM er
      GROUP BY user_session) d USING (user_session)
    """,
    "ef er",
)
def day_starts(spark, sf_dir):
    days = session_days(v.shop_events(spark, sf_dir))
    features = session_features(v.behaviour(spark, sf_dir))
    return sessions_in_range(features, starts_from_session_days(days)).drop("session_start")


@query(
    "session_kpis",
    """
    SELECT COUNT(*) AS total_sessions, CAST(SUM(purchase_in_session) AS BIGINT) AS purchase_sessions,
      ROUND(AVG(session_duration_seconds), 6) AS avg_session_duration_seconds,
      ROUND(AVG(total_events), 6) AS avg_events_per_session
    FROM ls
    """,
    "ls",
)
def kpis(spark, sf_dir):
    rounded = {
        c: F.round(c, 6) for c in ("avg_session_duration_seconds", "avg_events_per_session")
    }
    return session_kpis(v.commerce_sessions(spark, sf_dir)).withColumns(rounded)


@query("conversion_by_weekday", "SELECT * FROM weekdays", "weekdays")
def weekday_conversion(spark, sf_dir):
    return conversion_by_weekday(v.behaviour_sessions(spark, sf_dir))


@query("session_histogram", "SELECT * FROM ed_dist", "ed_dist")
def histogram(spark, sf_dir):
    sessions = stored(v.behaviour_sessions(spark, sf_dir), "sessions")
    return session_distributions(sessions, exact_edges(sessions))


@query("session_histogram_commerce", "SELECT * FROM ld_dist", "ld_dist")
def histogram_commerce(spark, sf_dir):
    sessions = stored(v.commerce_sessions(spark, sf_dir), "sessions")
    return session_distributions(sessions, exact_edges(sessions))


@query(
    "approx_histogram",
    " UNION ALL ".join(
        f"SELECT '{a}' AS start, metric, session_date, COUNT(*) AS count, TRUE AS in_order FROM ed_values"
        f" WHERE session_date BETWEEN DATE '{a}' AND DATE '{b}' GROUP BY metric, session_date"
        for a, b in HISTOGRAM_RANGES
    ),
    "ed_values",
)
def approx_histogram(spark, sf_dir):
    """Histograms of two ranges on edges from the same daily sketches: sessions by day, bins in order.

    ``sketched_quantiles`` holds the ranks of the edges against the exact ones.
    """
    sessions = stored(v.behaviour_sessions(spark, sf_dir), "sessions")
    sketches = stored(daily_sketches(sessions), "sketches")
    parts = []
    for start, end in HISTOGRAM_RANGES:
        days = sessions.filter(F.col("session_date").between(start, end))
        bins = session_distributions(days, sketched_edges(sketches, start, end))
        totals = bins.groupBy("metric", "session_date").agg(
            F.sum("count").alias("count"), F.bool_and(F.col("bin_start") < F.col("bin_end")).alias("in_order")
        )
        parts.append(totals.withColumn("start", F.lit(start)))
    return parts[0].unionByName(parts[1])


@query(
    "approx_histogram_totals",
    """
    SELECT metric, session_date, COUNT(*) AS count FROM ed_values GROUP BY metric, session_date
    """,
    "ed_values",
)
def approx_histogram_totals(spark, sf_dir):
    """Whatever the edges, a day's bins add up to its sessions with a value."""
    sessions = stored(v.behaviour_sessions(spark, sf_dir), "sessions")
    bins = session_distributions(sessions, approx_edges(sessions))
    return bins.groupBy("metric", "session_date").agg(F.sum("count").alias("count"))
