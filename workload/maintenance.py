"""Queries on stored state that is kept up to date, merged for any days, or laid out for joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shopflow.functions.selection import DEFAULT_FEATURES, LABEL
from shopflow.operators import model, rollups
from shopflow.operators.events import reportable_events
from shopflow.operators.histogram import SKETCH_ERROR, daily_sketches, merged_quantiles, metric_values
from shopflow.operators.sessions import session_days, session_features, sessions_in_range, starts_from_session_days
from shopflow.plans import layout, publish, refresh
from shopflow.plans.export import Report
from shopflow.schema import conform
from shopflow.sources.scratch import scratch_path
from shopflow.sources.writers import write_events, write_table
from workload import views as v
from workload.registry import query
from workload.sql_views import _FEATURES

# Days that are loaded again, with other events.
RELOAD = ("2024-01-10", "2024-01-12")
WEEK = ("2024-01-10", "2024-01-16")
# Two and three ranges of days that are answered from one stored record.
RANGES = (("2024-01-01", "2024-01-31"), (v.START, v.END), ("2024-01-11", "2024-01-12"))


def _ranges(template: str, ranges=RANGES) -> str:
    return " UNION ALL ".join(template.format(start=a, end=b) for a, b in ranges)


def _united(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Sessions of a user's four days, so that many go on over midnight.
_LONG = """
    w AS (SELECT * EXCLUDE (user_session), CAST(user_id AS VARCHAR) || '-' || CAST((event_date - DATE '2024-01-01') // 4 AS VARCHAR)
      AS user_session FROM e)
"""
_CHANGED = f"""
    changed AS (
      SELECT * REPLACE (CASE WHEN product_id % 3 = 0 THEN 'view' ELSE event_type END AS event_type, price + 1 AS price)
      FROM w WHERE event_date BETWEEN DATE '{RELOAD[0]}' AND DATE '{RELOAD[1]}' AND product_id % 5 <> 0
      UNION ALL SELECT * FROM w WHERE event_date NOT BETWEEN DATE '{RELOAD[0]}' AND DATE '{RELOAD[1]}')
"""


def long_sessions(spark, sf_dir):
    part = F.floor(F.date_diff("event_date", F.lit("2024-01-01").cast("date")) / 4).cast("string")
    name = F.concat(F.col("user_id").cast("string"), F.lit("-"), part)
    return v.behaviour(spark, sf_dir).withColumn("user_session", name)


def changed_days(events):
    """The events of the days that are loaded again: some are gone, others changed."""
    kept = events.filter(F.col("event_date").between(*RELOAD) & (F.col("product_id") % 5 != 0))
    kind = F.when(F.col("product_id") % 3 == 0, "view").otherwise(F.col("event_type"))
    return kept.withColumns({"event_type": kind, "price": F.col("price") + 1})


@query("features_after_reload", f"WITH {_LONG}, {_CHANGED} {_FEATURES.format(source='changed')}", "e")
def features_after_reload(spark, sf_dir):
    """Features brought up to date after days were loaded again, without building them all."""
    events, features = scratch_path(spark, "events"), scratch_path(spark, "features")
    source = long_sessions(spark, sf_dir)
    write_events(source, events)
    refresh.write_feature_buckets(session_features(spark.read.parquet(events)), features, buckets=16)
    refresh.reload_events(spark, changed_days(source), events, features, *RELOAD, buckets=16)
    return refresh.read_feature_buckets(spark, features)


@query("bucketed_session_dates", "SELECT * FROM lsr", "lsr")
def bucketed_session_dates(spark, sf_dir):
    """Features joined with the dates of their sessions, both stored by the same buckets of sessions."""
    source = v.commerce(spark, sf_dir)
    own = uuid.uuid4().hex
    names = f"features_{own}", f"session_days_{own}"
    sides = session_features(source), session_days(reportable_events(source))
    features, days = layout.bucketed_sides(*sides, names, scratch_path(spark, "buckets"), buckets=8)
    in_range = days.filter(F.col("event_date").between(v.L_START, v.L_END))
    dated = sessions_in_range(features, starts_from_session_days(in_range))
    return conform(dated, "session_features")


@query(
    "features_of_week",
    f"""
    WITH {_LONG}, f AS ({_FEATURES.format(source='w')})
    SELECT f.* EXCLUDE (session_date), d.session_date
    FROM f JOIN (SELECT user_session, CAST(MIN(event_time) AS DATE) AS session_date FROM w
      WHERE event_date BETWEEN DATE '{WEEK[0]}' AND DATE '{WEEK[1]}' AND event_type IN ('view', 'cart', 'purchase')
      GROUP BY user_session) d USING (user_session)
    """,
    "e",
)
def features_of_week(spark, sf_dir):
    """Features of a week's sessions, also of those that began before, from storage by day."""
    features, days = scratch_path(spark, "features"), scratch_path(spark, "days")
    source = long_sessions(spark, sf_dir)
    layout.write_features_by_day(session_features(source), features)
    layout.write_session_days(session_days(reportable_events(source)), days, session_features(source))
    return layout.features_of_days(spark, features, days, *WEEK)


def _edges_hold(values, edges, bins=10):
    """Whether each quantile's rank is right within the error: rows below and up to the i-th edge."""
    edges = edges.select("metric", "edges", F.posexplode("edges").alias("i", "edge"))
    ranks = values.join(edges, "metric").groupBy("metric", "i").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value") < F.col("edge")).alias("below"),
        F.count_if(F.col("value") <= F.col("edge")).alias("to"),
    )
    share, room = F.col("i") / bins, SKETCH_ERROR
    fits = (F.col("below") <= (share + room) * F.col("n")) & (F.col("to") >= (share - room) * F.col("n"))
    return ranks.groupBy("metric").agg(F.max("n").alias("n"), F.bool_and(fits).alias("edges_hold"))


@query(
    "sketched_quantiles",
    _ranges(
        """
    SELECT '{start}' AS start, metric, COUNT(*) AS n, TRUE AS edges_hold FROM ed_values
    WHERE session_date BETWEEN DATE '{start}' AND DATE '{end}' GROUP BY metric"""
    ),
    "ed_values",
)
def sketched_quantiles(spark, sf_dir):
    """Quantiles of any days from daily sketches that are stored once; their ranks among all values."""
    sessions = v.behaviour_sessions(spark, sf_dir)
    values = scratch_path(spark, "values")
    write_table(metric_values(sessions), values)
    values = spark.read.parquet(values)
    path = scratch_path(spark, "sketches")
    write_table(daily_sketches(sessions), path)
    parts = []
    for start, end in RANGES:
        edges = merged_quantiles(spark.read.parquet(path), start, end).withColumnRenamed("quantiles", "edges")
        held = _edges_hold(values.filter(F.col("session_date").between(start, end)), edges)
        parts.append(held.select(F.lit(start).alias("start"), "metric", "n", "edges_hold"))
    return _united(parts)


_KEPT = [c for c in DEFAULT_FEATURES if c != "num_purchases"]
_CORR = " UNION ALL ".join(
    f"SELECT '{{start}}' AS start, '{c}' AS feature, COALESCE(CORR(CAST(COALESCE({c}, 0) AS DOUBLE), "
    f"CAST({LABEL} AS DOUBLE)), 0) AS w FROM es WHERE session_date BETWEEN DATE '{{start}}' AND DATE '{{end}}'"
    for c in _KEPT
)


@query(
    "drivers_of_range",
    f"""
    WITH c AS ({_ranges(_CORR, RANGES[:2])}),
    s AS (SELECT 'positive' AS direction, start, feature, w, w AS x FROM c UNION ALL SELECT 'negative', start, feature, w, -w FROM c)
    SELECT start, direction, CAST(ROW_NUMBER() OVER (PARTITION BY start, direction ORDER BY x DESC, feature) AS INTEGER) AS rank,
      feature, ROUND(w, 6) AS weight
    FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY start, direction ORDER BY x DESC, feature) <= 8
    """,
    "es",
)
def drivers_of_range(spark, sf_dir):
    """Correlation drivers of two ranges from one record of daily moments."""
    path = scratch_path(spark, "moments")
    write_table(model.daily_moments(v.behaviour_sessions(spark, sf_dir), _KEPT), path)
    moments = spark.read.parquet(path)
    columns = ("start", "direction", "rank", "feature", "weight")
    return _united(
        [
            model.drivers_from_moments(moments, *r).withColumn("start", F.lit(r[0])).select(*columns)
            for r in RANGES[:2]
        ]
    )


@query(
    "users_of_range",
    _ranges(
        """
    SELECT '{start}' AS start, COUNT(DISTINCT user_id) AS total_users FROM er
    WHERE event_date BETWEEN DATE '{start}' AND DATE '{end}'"""
    ),
    "er",
)
def users_of_range(spark, sf_dir):
    """Distinct users of three ranges from one stored table of daily bitmaps."""
    path = scratch_path(spark, "users")
    write_table(rollups.daily_user_bitmaps(v.shop_events(spark, sf_dir)), path)
    bitmaps = spark.read.parquet(path)
    counts = [rollups.users_of_range(bitmaps, *r).withColumn("start", F.lit(r[0])) for r in RANGES]
    return _united(counts)


_LEVEL = """
    SELECT '{level}' AS level, CAST({key} AS VARCHAR) AS key, COUNT(*) AS purchase_count, SUM(price) AS revenue,
      SUM(price) / COUNT(price) AS avg_price, MIN(price) AS min_price, MAX(price) AS max_price
    FROM named GROUP BY {group}
"""
_LEVELS = (("hour", "hour", "hour"), ("category", "category", "category"), ("brand", "brand", "brand"), ("weekday", "weekday", "weekday"), ("all", "NULL", "()"))


@query(
    "page_totals",
    """
    WITH named AS (SELECT price, hour(event_time) AS hour, dayofweek(event_date) + 1 AS weekday,
      CASE WHEN COALESCE(category_code, CAST(category_id AS VARCHAR)) = '' THEN 'unknown'
        ELSE COALESCE(category_code, CAST(category_id AS VARCHAR), 'unknown') END AS category,
      CASE WHEN brand IS NULL OR brand = '' THEN 'unknown' ELSE brand END AS brand FROM ep)
    """
    + " UNION ALL ".join(_LEVEL.format(level=a, key=b, group=c) for a, b, c in _LEVELS),
    "ep",
)
def page_totals(spark, sf_dir):
    """All levels of a page's sales from one pass over the stored cube."""
    path = scratch_path(spark, "cube")
    write_table(rollups.commerce_cube(v.shop_purchases(spark, sf_dir)), path)
    return rollups.page_totals(spark.read.parquet(path))


@query("published_report", "SELECT * FROM funnel", "funnel")
def published_report(spark, sf_dir):
    """The funnel that readers are led to after a second version is published and a third one fails."""
    root = scratch_path(spark, "site")
    events = v.shop_events(spark, sf_dir)
    bought = rollups.brand_daily(v.shop_purchases(spark, sf_dir))

    def version(funnel, brands):
        return Report({"funnel_daily": funnel, "top_brands": brands}, {"kpis": rollups.event_kpis(events)})

    some = rollups.funnel_daily(events.filter(F.col("event_date").between(v.START, v.END)))
    publish.publish(spark, version(some, bought), root)
    publish.publish(spark, version(rollups.funnel_daily(events), bought), root)
    try:
        publish.publish(spark, version(some, bought.withColumn("brand", F.raise_error(F.lit("lost")).cast("string"))), root)
    except Exception as exc:  # noqa: BLE001 - the failure that is provoked
        if "lost" not in str(exc):
            raise
    return publish.read_published(spark, root, "funnel_daily")
