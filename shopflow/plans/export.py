"""The report export: every aggregate table and record for a range of days.

Three shared tables are written once and merged from there: activity per session and day,
sales per (day, hour, category, brand), and score sums per day and score bin. The event
log is thus scanned twice (once for purchases only) and the scored sessions once, for
eleven tables and four records.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.functions.selection import DEFAULT_FEATURES, usable_features
from shopflow.operators import rollups, scores
from shopflow.operators.events import as_date, purchases, reportable_events
from shopflow.operators.histogram import approx_edges, session_distributions
from shopflow.operators.model import coefficient_drivers, correlation_drivers, load_model, score
from shopflow.operators.sessions import (
    conversion_by_weekday,
    session_days,
    session_kpis,
    sessions_in_range,
    starts_from_session_days,
)
from shopflow.schema import SHOP_EVENT_TYPES, empty_table, table_schema
from shopflow.sources.readers import read_record, require_rows
from shopflow.sources.scratch import emptied, stored
from shopflow.sources.writers import require_absent, write_record, write_table


REPORT_TABLES = (
    "funnel_daily",
    "purchases_by_hour",
    "conversion_by_weekday",
    "top_categories",
    "top_brands",
    "session_distributions",
    "propensity_daily",
    "propensity_hist",
    "propensity_threshold",
    "calibration_bins",
    "threshold_curves",
)
REPORT_RECORDS = ("kpis", "model_metrics", "propensity_drivers", "propensity_kpis")


class Report(NamedTuple):
    tables: dict[str, DataFrame]
    records: dict[str, DataFrame]


def propensity_tables(
    spark: SparkSession, sessions: DataFrame, model: PipelineModel | None, threshold: float
) -> Report:
    """The five score tables and the KPI record; typed empty tables without a model."""
    if model is None:
        names = (
            "propensity_daily",
            "propensity_hist",
            "propensity_threshold",
            "calibration_bins",
            "threshold_curves",
        )
        missing = F.lit(None).cast("double")
        kpis = spark.range(1).select(
            F.lit(False).alias("available"),
            missing.alias("predicted_conversion_rate"),
            missing.alias("actual_session_conversion_rate"),
            missing.alias("calibration_gap"),
            missing.alias("high_propensity_share"),
            F.lit(float(threshold)).alias("threshold"),
        )
        return Report({n: empty_table(spark, n) for n in names}, {"propensity_kpis": kpis})
    cube = stored(scores.score_cube(score(model, sessions), threshold), "score_cube")
    tables = {
        "propensity_daily": scores.propensity_daily(cube),
        "propensity_hist": scores.score_histogram(cube),
        "propensity_threshold": scores.threshold_point(cube),
        "calibration_bins": scores.calibration_bins(cube),
        "threshold_curves": scores.threshold_curve(cube),
    }
    return Report(tables, {"propensity_kpis": scores.propensity_kpis(cube)})


def build_report(
    spark: SparkSession,
    events: DataFrame,
    features: DataFrame,
    model: PipelineModel | None = None,
    start: str | date | None = None,
    end: str | date | None = None,
    event_types: Iterable[str] | None = SHOP_EVENT_TYPES,
    wanted: Sequence[str] = DEFAULT_FEATURES,
    threshold: float = 0.5,
    currency: str = "USD",
    edges: DataFrame | None = None,
) -> Report:
    """All report tables and records. Storing what several of them share starts jobs at once.

    ``edges`` of the session distributions are approximate quantiles if not given; see
    ``exact_edges``.
    """
    in_range = reportable_events(events, start, end, event_types)
    days = stored(session_days(in_range), "session_days")
    cube = stored(rollups.commerce_cube(purchases(in_range)), "commerce_cube")
    joined = sessions_in_range(features, starts_from_session_days(days), start, end)
    sessions = stored(joined, "sessions")

    tables = {
        "funnel_daily": rollups.funnel_from_session_days(days),
        "purchases_by_hour": rollups.rollup_from_cube(cube, ["event_date", "hour"], "purchases_by_hour"),
        "conversion_by_weekday": conversion_by_weekday(sessions),
        "top_categories": rollups.rollup_from_cube(cube, ["event_date", "category"], "top_categories"),
        "top_brands": rollups.rollup_from_cube(cube, ["event_date", "brand"], "top_brands"),
        "session_distributions": session_distributions(
            sessions, approx_edges(sessions) if edges is None else edges
        ),
    }
    propensity = propensity_tables(spark, sessions, model, threshold)
    if model is None:
        drivers = correlation_drivers(features, usable_features(features, wanted))
    else:
        drivers = coefficient_drivers(model, features)
    kpis = rollups.kpi_record(
        rollups.event_kpis_from_session_days(days),
        session_kpis(sessions),
        rollups.purchase_kpis_from_cube(cube),
        currency,
    )
    records = {"kpis": kpis, "propensity_drivers": drivers, **propensity.records}
    return Report({**tables, **propensity.tables}, records)


def export_report(
    spark: SparkSession,
    events_path: str,
    features_path: str,
    metrics_path: str,
    model_path: str,
    out: str,
    overwrite: bool = False,
    start: str | date | None = None,
    end: str | date | None = None,
    **settings,
) -> Report:
    """Check inputs and targets, then write every table and record under ``out``.

    Without ``overwrite`` nothing is computed or written if any of the targets is there. The tables
    made on the way are deleted; what is returned reads the report.
    """
    first, last = as_date(start), as_date(end)
    if first and last and first > last:
        raise ValueError(f"start {first} is after end {last}")
    events = require_rows(spark, events_path, "events are missing or empty; run ingest")
    features = require_rows(spark, features_path, "session features are missing or empty")
    metrics = read_record(spark, metrics_path)
    if not overwrite:
        require_absent(spark, [f"{out}/{name}" for name in (*REPORT_TABLES, *REPORT_RECORDS)])
    with emptied(spark):
        report = build_report(spark, events, features, load_model(model_path), start, end, **settings)
        records = {**report.records, "model_metrics": metrics}
        for name, record in records.items():
            write_record(record, f"{out}/{name}", overwrite)
        for name, table in report.tables.items():
            write_table(table, f"{out}/{name}", overwrite)
    return read_report(spark, out)


def read_report(spark: SparkSession, out: str) -> Report:
    """A written report's tables and records."""
    tables = {name: spark.read.schema(table_schema(name)).parquet(f"{out}/{name}") for name in REPORT_TABLES}
    return Report(tables, {name: spark.read.json(f"{out}/{name}") for name in REPORT_RECORDS})
