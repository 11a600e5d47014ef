"""Stored layouts that make features cheap to join with the dates of their sessions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.operators.events import in_date_range
from shopflow.operators.sessions import sessions_in_range
from shopflow.schema import conform
from shopflow.sources.writers import write_bucketed

BUCKETS = 200


def bucketed_sides(
    features: DataFrame, days: DataFrame, names: tuple[str, str], path: str | None = None, buckets: int = BUCKETS
) -> tuple[DataFrame, DataFrame]:
    """Features and activity per session and day as catalog tables with the same buckets of sessions.

    Joins of the two, and groupings of either, by session then need no shuffle. ``days`` comes
    from :func:`session_days`.
    """
    spark = features.sparkSession
    for rows, name in zip((features, days), names, strict=True):
        write_bucketed(rows, name, buckets, path=f"{path}/{name}" if path else None)
    return spark.table(names[0]), spark.table(names[1])


def write_features_by_day(features: DataFrame, path: str) -> None:
    """Features as Parquet partitioned by the day that a session began."""
    features.hint("rebalance", "session_date").write.partitionBy("session_date").parquet(path)


def write_session_days(days: DataFrame, path: str, features: DataFrame) -> None:
    """Activity per session and day, partitioned by day, with the day under which its features are stored.

    That day leads to a session's features also from days after midnight. Sessions without features
    are left out.
    """
    began = features.select("user_session", F.col("session_date").alias("began"))
    dated = days.join(began, "user_session")
    dated.hint("rebalance", "event_date").write.partitionBy("event_date").parquet(path)


def features_of_days(
    spark: SparkSession,
    features_path: str,
    days_path: str,
    start: str | date | None = None,
    end: str | date | None = None,
) -> DataFrame:
    """Features of the sessions with activity on the days, dated by their first event on them.

    Reads the partitions of these days of the activity, and of the features those in which
    these sessions began: the days of beginning, a row for each calendar day at most, are
    broadcast, which prunes the features while the query runs, however many sessions there are.
    """
    days = in_date_range(spark.read.parquet(days_path), "event_date", start, end)
    starts = days.groupBy("user_session", "began").agg(F.min("first_event").alias("session_start"))
    starts = starts.withColumn("session_date", F.to_date("session_start"))
    features = spark.read.parquet(features_path)
    began = days.select(F.col("began").alias("session_date")).distinct()
    features = features.join(F.broadcast(began), "session_date", "left_semi")
    found = sessions_in_range(features, starts.select("user_session", "session_start", "session_date"))
    return conform(found, "session_features")
