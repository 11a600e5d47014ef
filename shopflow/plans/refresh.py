"""Keeping stored session features right after days of events were reloaded.

Features are stored by buckets of sessions. A reload touches the sessions that have, or had,
events on its days; only these are computed again, from the days that their events span, and
only the buckets that hold them are written.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.operators.events import in_date_range
from shopflow.operators.sessions import session_features
from shopflow.schema import conform
from shopflow.sources.readers import require_rows
from shopflow.sources.scratch import stored
from shopflow.sources.writers import reload_days, save_mode

BUCKETS = 256
BUCKET = "session_bucket"


def bucket_of(key: str = "user_session", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_feature_buckets(
    features: DataFrame, path: str, buckets: int = BUCKETS, overwrite: bool = False, only: bool = False
) -> None:
    """Features as Parquet partitioned by bucket of session; ``only`` replaces those that the rows are in."""
    if only:
        overwrite = True
    (
        features.withColumn(BUCKET, bucket_of(buckets=buckets))
        .hint("rebalance", BUCKET)
        .write.mode(save_mode(overwrite))
        .option("partitionOverwriteMode", "dynamic" if only else "static")
        .option("compression", "snappy")
        .partitionBy(BUCKET)
        .parquet(path)
    )


def read_feature_buckets(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame:
    """Stored features; with ``only`` the files of other buckets are not read."""
    features = require_rows(spark, path, "session features are missing or empty; run build_features")
    if only is not None:
        features = features.filter(F.col(BUCKET).isin(list(only)))
    return conform(features, "session_features")


def sessions_on_days(events: DataFrame, start: str | date, end: str | date) -> DataFrame:
    on = in_date_range(events, "event_date", start, end)
    return on.filter(F.col("user_session").isNotNull()).select("user_session").distinct()


def reload_events(
    spark: SparkSession,
    changed: DataFrame,
    events_path: str,
    features_path: str,
    start: str | date,
    end: str | date,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Reload days of stored events and bring the stored features up to date; the sessions touched.

    ``changed`` holds all events of the days from start to end that are to be replaced. A session
    of which no event is left disappears. ``buckets`` is what the features were written with.
    Events are read on the days of the touched sessions only, which the old features tell, and
    features of the touched buckets only. If the run dies after the events were replaced, running
    it again with all of ``changed`` brings back the sessions that it names, but not those that only
    the old events named: then build the features anew.
    """
    before = sessions_on_days(spark.read.parquet(events_path), start, end)
    after = sessions_on_days(changed, start, end)
    touched = stored(before.unionByName(after).distinct().withColumn(BUCKET, bucket_of(buckets=buckets)), "touched")
    hit = [r[0] for r in touched.select(BUCKET).distinct().collect()]  # at most ``buckets``
    if not hit:
        return touched.drop(BUCKET)
    old = read_feature_buckets(spark, features_path, hit)
    # A session ends at the latest its duration after the end of the hour that it began in.
    seconds = F.col("hour_of_day") * 3600 + 3599 + F.col("session_duration_seconds")
    last = F.to_date(F.timestamp_seconds(F.unix_seconds(F.col("session_date").cast("timestamp")) + seconds))
    span = old.join(touched, "user_session", "left_semi").agg(F.min("session_date").alias("first"), F.max(last).alias("last")).first()
    bounds = F.lit(start).cast("date"), F.lit(end).cast("date")
    first, last_day = spark.range(1).select(
        F.least(bounds[0], F.lit(span["first"])).alias("first"), F.greatest(bounds[1], F.lit(span["last"])).alias("last")
    ).first()

    reload_days(changed, events_path, start, end)
    days = in_date_range(spark.read.parquet(events_path), "event_date", first, last_day)
    fresh = session_features(days.join(touched.select("user_session"), "user_session", "left_semi"))
    kept = old.join(touched.select("user_session"), "user_session", "left_anti")
    merged = stored(kept.unionByName(fresh), "merged")
    write_feature_buckets(merged, features_path, buckets, only=True)
    gone = set(hit) - {r[0] for r in merged.select(bucket_of(buckets=buckets).alias("b")).distinct().collect()}
    for bucket in gone:  # no session is left in these
        empty = merged.limit(0).withColumn(BUCKET, bucket_of(buckets=buckets)).drop(BUCKET)
        empty.write.mode("overwrite").parquet(f"{features_path}/{BUCKET}={bucket}")
    return touched.drop(BUCKET)
