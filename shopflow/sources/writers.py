"""Writing tables and records. Output file counts follow the data size.

The REBALANCE hint lets adaptive execution merge small and split large partitions by
measured size, so a day holding a third of all events becomes several files written by
several tasks, and a small table becomes one file without pulling the aggregation before
it into a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.operators.events import in_date_range


def save_mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_events(
    events: DataFrame,
    path: str,
    overwrite: bool = False,
    mode: str | None = None,
    cluster: bool = True,
) -> None:
    """Clean events as Parquet partitioned by event_date.

    ``cluster=False`` skips the shuffle by day. That suits input already ordered by time,
    where a task meets few days; otherwise every task would write a file for each day.
    """
    write_days(by_day(events) if cluster else events, path, mode or save_mode(overwrite))


def by_day(events: DataFrame) -> DataFrame:
    """Rows of a day together, a hot day in several tasks: those sizes are known to adaptive execution only."""
    if events.sparkSession.conf.get("spark.sql.adaptive.enabled", "true") != "true":
        raise ValueError("switch on spark.sql.adaptive.enabled: without it a day is one task, however large")
    return events.hint("rebalance", "event_date")


def write_days(events: DataFrame, path: str, mode: str) -> None:
    writer = events.write.mode(mode).option("compression", "snappy").partitionBy("event_date")
    writer.parquet(path)


def reload_days(events: DataFrame, path: str, start: str | date, end: str | date) -> None:
    """Replace only the days from start to end that the events hold; other days stay."""
    (
        by_day(in_date_range(events, "event_date", start, end))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy("event_date")
        .parquet(path)
    )


def write_table(df: DataFrame, path: str, overwrite: bool = True) -> None:
    (
        df.hint("rebalance")
        .write.mode(save_mode(overwrite))
        .option("compression", "snappy")
        .parquet(path)
    )


def write_split(sessions: DataFrame, train_path: str, test_path: str) -> None:
    """Train and test rows of a frame with in_train; rows with a NULL flag go to neither."""
    write_table(sessions.filter("in_train").drop("in_train"), train_path)
    write_table(sessions.filter("NOT in_train").drop("in_train"), test_path)


def require_absent(spark: SparkSession, paths: Sequence[str]) -> None:
    """An error that names the first of ``paths`` with anything in it."""
    for path in paths:
        try:
            spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            raise FileExistsError(path)


def write_record(record: DataFrame, path: str, overwrite: bool = True) -> None:
    """A one-row table as a JSON file."""
    record.coalesce(1).write.mode(save_mode(overwrite)).option("ignoreNullFields", False).json(path)


def record_as_rows(record: DataFrame) -> DataFrame:
    """All columns of a one-row table as (metric, value) text; nested values as JSON."""

    def text(field: T.StructField):
        nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
        column = F.to_json(field.name) if nested else F.col(field.name).cast("string")
        return column.alias(field.name)

    wide = record.select(*[text(f) for f in record.schema])
    return wide.unpivot([], record.columns, "metric", "value")


def write_metric_csv(record: DataFrame, path: str) -> None:
    rows = record_as_rows(record)
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_bucketed(
    rows: DataFrame, table: str, buckets: int, key: str = "user_session", path: str | None = None
) -> None:
    """A catalog table bucketed by ``key``, so joins on it skip this side's shuffle.

    Rows are dealt to buckets first, so a bucket is one sorted file and needs no sort to be joined.
    ``path`` says where its files go, else the warehouse.
    """
    writer = rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
