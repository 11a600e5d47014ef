"""Queries against their SQL on the smallest tables; tools/check_oracle.py does them all."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry_points  # noqa: E402
from check_oracle import compare, tables  # noqa: E402

DIR = "/root/testdata/sf0.001"
CHECKED = [
    "clean_event_rows",
    "ingest_summary",
    "session_features_behaviour",
    "session_features_commerce",
    "session_dates_join",
    "kpi_record",
    "funnel_daily",
    "brands_from_cube",
    "session_histogram",
    "threshold_curve",
    "auc_exact",
    "time_split",
    "hash_split",
    "correlation_drivers",
    "report_totals_filtered",
    "partition_roundtrip",
    "score_cube",
    "threshold_point_other",
    "threshold_lookup_no_curve",
    "weighted_score",
    "weighted_score_no_scores",
    "session_histogram_20_bins",
    "approx_histogram_totals",
    "fitted_model_scores",
    "fitted_model_checks",
    "degraded_outputs",
    "insight_rows",
]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    tables(connection, DIR)
    return connection


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["event_date", "views", "carts", "purchases", "sessions"]
    assert not df.isEmpty()


def test_every_oracle_belongs_to_a_query_and_runs(con):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    for name, sql in entry_points.oracle_sql().items():
        assert con.execute(sql).fetchall(), name


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, con, name):
    df = entry_points.queries()[name](spark, DIR)
    assert compare(df, con.execute(entry_points.oracle_sql()[name])) is None


def test_no_query_multiplies_tables(spark):
    for name in ("kpi_record", "report_totals", "threshold_lookup", "relative_range", "insight_rows", "auc_exact"):
        plan = entry_points.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
