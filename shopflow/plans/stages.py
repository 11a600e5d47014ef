"""Ingest and features: each stage is one write and one read of what it wrote."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shopflow.operators.events import clean_summary, is_valid_event, with_parsed_time
from shopflow.operators.sessions import feature_summary, session_features
from shopflow.schema import RAW_COLUMNS
from shopflow.sources.readers import any_value, count_lines, fits, read_raw_lines, require_rows
from shopflow.sources.scratch import stored
from shopflow.sources.writers import by_day, save_mode, write_days, write_record


def ingest(
    spark: SparkSession,
    csv_paths: str | Sequence[str],
    events_path: str,
    overwrite: bool = False,
    cluster: bool = True,
    record_path: str | None = None,
    **options: str | bool,
) -> DataFrame:
    """Clean raw files into day-partitioned events; the one-row summary, also as a JSON record.

    The files are parsed once: lines are counted as they are written. Rejected lines go as far
    as the writing tasks for that. There, in the last stage, Spark takes the counts of each task
    once, also if tasks of lost executors run again; before a shuffle it would add them twice. The
    rest of the summary comes from the columns of the written table. ``options`` go to the CSV reader.
    """
    lines = with_parsed_time(read_raw_lines(session_beside(spark), csv_paths, **options))
    seen = Observation("lines")
    counted = (by_day(lines) if cluster else lines).observe(seen, *count_lines())
    kept = counted.filter(fits() & any_value() & is_valid_event())
    write_days(kept.select(*RAW_COLUMNS, "event_date"), events_path, save_mode(overwrite))
    events = require_rows(spark, events_path, "no valid rows after cleaning")
    counts = [F.lit(seen.get[c]).cast("bigint").alias(c) for c in ("input_rows", "malformed_rows")]
    summary = clean_summary(events)
    return recorded(summary.select(*counts, *summary.columns), "ingest_summary", record_path)


def session_beside(spark: SparkSession) -> SparkSession:
    """A session of its own with the same settings, for observed frames.

    Once a session has observed a frame, Spark 4.1 can no longer send a freshly fitted model of that
    session to tasks.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def recorded(summary: DataFrame, name: str, record_path: str | None) -> DataFrame:
    """A one-row result computed once, and written as a JSON record where a path is given."""
    summary = stored(summary, name)
    if record_path:
        write_record(summary, record_path)
    return summary


def build_features(
    spark: SparkSession,
    events_path: str,
    features_path: str,
    overwrite: bool = False,
    start: str | date | None = None,
    end: str | date | None = None,
    record_path: str | None = None,
) -> DataFrame:
    """Write one row per session; the one-row summary of the written table, also as a JSON record."""
    events = require_rows(spark, events_path, "events are missing or empty; run ingest")
    features = session_features(events, start, end)
    features.write.mode(save_mode(overwrite)).parquet(features_path)
    summary = feature_summary(spark.read.parquet(features_path))
    return recorded(summary, "feature_summary", record_path)
