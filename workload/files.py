"""Queries that write the test tables out in some form and read them back."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from shopflow.functions.selection import LABEL
from shopflow.operators import model, report, rollups
from shopflow.operators.events import clean_events, purchases, reportable_events
from shopflow.operators.histogram import exact_edges
from shopflow.operators.sessions import session_features, session_kpis
from shopflow.plans.export import export_report
from shopflow.sources import readers, writers
from shopflow.sources.scratch import scratch_path, stored
from workload import views as v
from workload.commerce import _KPI_SQL
from workload.registry import query

# Months asked for; the test orders ship in some of them.
MONTHS = [f"{y}-{m:02d}" for y in range(1994, 2003) for m in range(1, 13)]
_MONTHS = ", ".join(f"('{m}')" for m in MONTHS)


def _csv_months(spark, sf_dir):
    """Commerce events as raw CSV, one folder a month."""
    path = scratch_path(spark, "raw")
    text = v.commerce(spark, sf_dir).select(
        F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")).alias("event_time"),
        "event_type",
        "product_id",
        "category_id",
        "category_code",
        "brand",
        "price",
        "user_id",
        "user_session",
        F.date_format("event_time", "yyyy-MM").alias("month"),
    )
    text.hint("rebalance", "month").write.partitionBy("month").option("header", True).csv(path)
    return path


@query(
    "csv_roundtrip",
    """
    SELECT event_date, event_type, COUNT(*) AS events, SUM(price) AS price_sum,
      CAST(SUM(product_id) AS BIGINT) AS products, CAST(SUM(category_id) AS BIGINT) AS category_ids,
      COUNT(DISTINCT brand) AS brands, COUNT(DISTINCT category_code) AS codes, COUNT(DISTINCT user_id) AS users
    FROM l GROUP BY event_date, event_type
    """,
    "l",
)
def csv_roundtrip(spark, sf_dir):
    raw = readers.read_months(spark, _csv_months(spark, sf_dir), MONTHS, "month={month}", allow_missing=True)
    return (
        clean_events(raw)
        .groupBy("event_date", "event_type")
        .agg(
            F.count("*").alias("events"),
            F.sum("price").alias("price_sum"),
            F.sum("product_id").alias("products"),
            F.sum("category_id").alias("category_ids"),
            F.count_distinct("brand").alias("brands"),
            F.count_distinct("category_code").alias("codes"),
            F.count_distinct("user_id").alias("users"),
        )
    )


@query(
    "raw_manifest",
    f"""
    SELECT 'month=' || m.month AS name, CASE WHEN COUNT(l.event_time) > 0 THEN 'ok' ELSE 'missing' END AS status
    FROM (VALUES {_MONTHS}) m(month) LEFT JOIN l ON strftime(l.event_time, '%Y-%m') = m.month GROUP BY m.month
    UNION ALL SELECT 'month=tiny', 'too small'
    """,
    "l",
)
def raw_manifest(spark, sf_dir):
    """Months against a size that a line of text does not reach."""
    path = _csv_months(spark, sf_dir)
    spark.range(1).select(F.lit("x").alias("line")).coalesce(1).write.text(f"{path}/month=tiny")
    names = [*readers.month_files(MONTHS, "month={month}"), "month=tiny"]
    expected = spark.createDataFrame([(n,) for n in names], "name STRING")
    return readers.file_manifest(spark, path, expected, min_mb=0.00005).select("name", "status")


def _stored_events(spark, sf_dir):
    path = scratch_path(spark, "events")
    writers.write_events(v.behaviour(spark, sf_dir), path)
    return path


@query(
    "partition_roundtrip",
    f"""
    SELECT event_date, COUNT(*) AS events, COUNT(DISTINCT user_session) AS sessions,
      SUM(CASE WHEN event_date BETWEEN DATE '{v.START}' AND DATE '{v.END}' THEN price + 1 ELSE price END) AS price_sum
    FROM e GROUP BY event_date
    """,
    "e",
)
def partition_roundtrip(spark, sf_dir):
    """Write all days, then reload a range of days with changed prices."""
    path = _stored_events(spark, sf_dir)
    changed = v.behaviour(spark, sf_dir).withColumn("price", F.col("price") + 1)
    writers.reload_days(changed, path, v.START, v.END)
    events = readers.require_rows(spark, path, "no events")
    return events.groupBy("event_date").agg(
        F.count("*").alias("events"),
        F.count_distinct("user_session").alias("sessions"),
        F.sum("price").alias("price_sum"),
    )


@query(
    "partition_pruned_funnel",
    f"SELECT * FROM funnel WHERE event_date BETWEEN DATE '{v.START}' AND DATE '{v.END}'",
    "funnel",
)
def partition_pruned_funnel(spark, sf_dir):
    """The funnel of some days from day-partitioned storage: other days are not read."""
    events = spark.read.parquet(_stored_events(spark, sf_dir))
    return rollups.funnel_daily(reportable_events(events, v.START, v.END))


@query("small_table_roundtrip", "SELECT * FROM l_brands", "l_brands")
def small_table_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "brands")
    bought = purchases(v.commerce_events(spark, sf_dir, user=False))
    writers.write_table(rollups.brand_daily(bought), path)
    return readers.read_optional(spark, path, "top_brands")


_KPI_NUMBERS = {
    "total_events": "BIGINT",
    "total_users": "BIGINT",
    "total_sessions": "BIGINT",
    "total_purchases": "BIGINT",
    "total_revenue": "DOUBLE",
    "avg_order_value": "DOUBLE",
    "conversion_rate": "DOUBLE",
    "avg_session_duration_seconds": "DOUBLE",
    "avg_events_per_session": "DOUBLE",
    "min_purchase_price": "DOUBLE",
    "max_purchase_price": "DOUBLE",
}
_KPI_TEXTS = ("min_event_date", "max_event_date", "currency")
_KPI_VALUES = f"WITH k AS ({_KPI_SQL.format(e='l', s='ls')}) " + " UNION ALL ".join(
    [f"SELECT '{c}' AS metric, CAST({c} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS label FROM k" for c in _KPI_NUMBERS]
    + [f"SELECT '{c}', CAST(NULL AS DOUBLE), {c} FROM k" for c in _KPI_TEXTS]
)


def _kpis(spark, sf_dir):
    events = v.commerce_events(spark, sf_dir, part=False)
    return rollups.kpi_record(
        rollups.activity_kpis(events), session_kpis(v.commerce_sessions(spark, sf_dir))
    )


@query("record_roundtrip", _KPI_VALUES, "l ls")
def record_roundtrip(spark, sf_dir):
    """The whole KPI record as JSON, read back with all numbers as doubles."""
    path = scratch_path(spark, "kpis")
    writers.write_record(_kpis(spark, sf_dir), path)
    record = readers.read_record(spark, path)
    numbers = report.metric_rows(record, list(_KPI_NUMBERS)).withColumn("label", F.lit(None).cast("string"))
    texts = record.unpivot([], list(_KPI_TEXTS), "metric", "label").withColumn("value", F.lit(None).cast("double"))
    return numbers.unionByName(texts)


@query("metric_csv_roundtrip", _KPI_VALUES, "l ls")
def metric_csv_roundtrip(spark, sf_dir):
    """The whole KPI record as (metric, value) lines of a CSV file."""
    path = scratch_path(spark, "metrics")
    writers.write_metric_csv(_kpis(spark, sf_dir), path)
    rows = spark.read.schema("metric STRING, value STRING").csv(path, header=True)
    text = F.col("metric").isin(*_KPI_TEXTS)
    return rows.select(
        "metric", F.when(~text, F.col("value").try_cast("double")).alias("value"), F.when(text, F.col("value")).alias("label")
    )


@query(
    "split_roundtrip",
    f"""
    WITH d AS (SELECT session_date AS d, ROW_NUMBER() OVER (ORDER BY session_date) AS rn, COUNT(*) OVER () AS n
      FROM (SELECT DISTINCT session_date FROM lf)),
    cut AS (SELECT MIN(d) AS cutoff FROM d WHERE rn = CAST(FLOOR(n * CAST(0.8 AS DOUBLE)) AS BIGINT) + 1)
    SELECT CASE WHEN session_date < cutoff THEN 'train' ELSE 'test' END AS side, COUNT(*) AS sessions,
      CAST(SUM({LABEL}) AS BIGINT) AS positives
    FROM lf, cut GROUP BY 1
    """,
    "lf",
)
def split_roundtrip(spark, sf_dir):
    features = stored(session_features(v.commerce(spark, sf_dir)), "features")
    marked = model.time_split(features, "session_date", ["user_session"])
    train, test = scratch_path(spark, "train"), scratch_path(spark, "test")
    writers.write_split(marked, train, test)
    sides = [
        spark.read.parquet(p).select(F.lit(name).alias("side"), LABEL)
        for name, p in (("train", train), ("test", test))
    ]
    return (
        sides[0]
        .unionByName(sides[1])
        .groupBy("side")
        .agg(F.count("*").alias("sessions"), F.sum(LABEL).alias("positives"))
    )


@query("model_roundtrip", "SELECT session_date, COUNT(*) AS sessions, TRUE AS same_mean FROM es GROUP BY session_date", "es")
def model_roundtrip(spark, sf_dir):
    """Scores of a model that was saved and loaded again, by day, beside those of its weights alone."""
    sessions = stored(v.behaviour_sessions(spark, sf_dir), "sessions")
    path = scratch_path(spark, "model")
    model.save_model(model.fit(sessions, list(v.EXAMPLE_WEIGHTS)), path)
    loaded = model.load_model(path)
    found = model.score(loaded, sessions).groupBy("session_date")
    found = found.agg(F.count("*").alias("sessions"), F.avg("pred_prob").alias("mean"))
    plain = sessions.withColumn("plain", model.logistic_score(*model.model_weights(loaded)))
    plain = plain.groupBy("session_date").agg(F.avg("plain").alias("plain"))
    same = (F.abs(F.col("mean") - F.col("plain")) < 1e-9).alias("same_mean")
    return found.join(plain, "session_date").select("session_date", "sessions", same)


_EXPORTED = """
    SELECT 'funnel_daily' AS name, COUNT(*) AS rows, CAST(SUM(sessions) AS DOUBLE) AS total FROM funnel
    UNION ALL SELECT 'purchases_by_hour', COUNT(*), SUM(revenue) FROM hourly
    UNION ALL SELECT 'conversion_by_weekday', COUNT(*), SUM(sessions) FROM weekdays
    UNION ALL SELECT 'top_categories', COUNT(*), SUM(revenue) FROM categories
    UNION ALL SELECT 'top_brands', COUNT(*), SUM(revenue) FROM brands
    UNION ALL SELECT 'session_distributions', COUNT(*), SUM(count) FROM ed_dist
    UNION ALL SELECT 'kpis', 1, (SELECT COUNT(*) FROM er)
"""
_EXPORT_VIEWS = "funnel hourly weekdays categories brands ed_dist er es"
#: A column of each table whose total can be told without the model.
_TOTALS = {
    "funnel_daily": "sessions",
    "purchases_by_hour": "revenue",
    "conversion_by_weekday": "sessions",
    "top_categories": "revenue",
    "top_brands": "revenue",
    "session_distributions": "count",
    "propensity_daily": "sessions",
    "propensity_hist": "sessions_count",
    "propensity_threshold": "threshold",
    "calibration_bins": "sessions",
    "threshold_curves": "threshold",
}


def _exported(spark, sf_dir, with_model):
    """A report written by the export stage from stored inputs, and read back: rows and a total of each table."""
    at = {n: scratch_path(spark, n) for n in ("events", "features", "metrics", "model", "report")}
    writers.write_events(v.behaviour(spark, sf_dir), at["events"])
    features = session_features(spark.read.parquet(at["events"]))
    features.write.parquet(at["features"])
    features = spark.read.parquet(at["features"])
    writers.write_record(session_kpis(features), at["metrics"])
    if with_model:
        model.save_model(model.fit(features, list(v.EXAMPLE_WEIGHTS)), at["model"])
    edges = exact_edges(v.behaviour_sessions(spark, sf_dir))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # without a model, num_purchases is left out of the drivers
        built = export_report(
            spark, at["events"], at["features"], at["metrics"], at["model"], at["report"], edges=stored(edges, "edges")
        )
    rows = [
        built.tables[name].agg(
            F.lit(name).alias("name"), F.count("*").alias("rows"), F.sum(column).cast("double").alias("total")
        )
        for name, column in _TOTALS.items()
    ]
    kpis = built.records["kpis"]
    rows.append(kpis.select(F.lit("kpis").alias("name"), F.lit(1).cast("bigint").alias("rows"), F.col("total_events").cast("double").alias("total")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(
    "report_export",
    f"""{_EXPORTED}
    UNION ALL SELECT name, 0, NULL FROM (VALUES ('propensity_daily'), ('propensity_hist'), ('propensity_threshold'),
      ('calibration_bins'), ('threshold_curves')) t(name)
    """,
    _EXPORT_VIEWS,
)
def report_export(spark, sf_dir):
    """All tables of an exported report without a model: those of the scores are there and empty."""
    return _exported(spark, sf_dir, False)


@query(
    "report_export_model",
    f"""{_EXPORTED}
    UNION ALL SELECT 'propensity_daily', COUNT(DISTINCT session_date), COUNT(*) FROM es
    UNION ALL SELECT 'propensity_hist', NULL, COUNT(*) FROM es UNION ALL SELECT 'propensity_threshold', 1, 0.5
    UNION ALL SELECT 'calibration_bins', NULL, COUNT(*) FROM es UNION ALL SELECT 'threshold_curves', NULL, NULL
    """,
    _EXPORT_VIEWS,
)
def report_export_model(spark, sf_dir):
    """The export with a fitted model. How many bins its scores fill is left out: SQL can't tell."""
    bins = F.col("name").isin("propensity_hist", "calibration_bins", "threshold_curves")
    built = _exported(spark, sf_dir, True)
    return built.select(
        "name",
        F.when(~bins | (F.col("rows") == 0), F.col("rows")).alias("rows"),
        F.when(F.col("name") != "threshold_curves", F.col("total")).alias("total"),
    )
