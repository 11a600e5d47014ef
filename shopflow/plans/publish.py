"""Publishing a report: all of a new version is written before anyone is led to it.

A version is a folder of its own. What readers follow is a small table of published versions, to
which a version's row is added when all its tables are there. Adding a row either happens or does
not, so a run that dies midway leaves readers on the version before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.plans.export import Report
from shopflow.sources.readers import require_rows
from shopflow.sources.scratch import remove
from shopflow.sources.writers import write_record, write_table

POINTERS = "published"


def published_versions(spark: SparkSession, root: str) -> DataFrame:
    """(position, version): the last position is what readers see."""
    return require_rows(spark, f"{root}/{POINTERS}", "nothing is published yet").select("position", "version")


def current_version(spark: SparkSession, root: str) -> str:
    last = published_versions(spark, root).orderBy(F.desc("position"), F.desc("version"))
    return last.first()["version"]


def publish(spark: SparkSession, report: Report, root: str) -> str:
    """Writes a new version of all tables and records under ``root``, then leads readers to it."""
    version = uuid.uuid4().hex
    for name, record in report.records.items():
        write_record(record, f"{root}/{version}/{name}", overwrite=False)
    for name, table in report.tables.items():
        write_table(table, f"{root}/{version}/{name}", overwrite=False)
    try:
        position = published_versions(spark, root).agg(F.max("position")).first()[0] + 1
    except FileNotFoundError:
        position = 1
    pointer = spark.createDataFrame([(position, version)], "position bigint, version string")
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/{POINTERS}")
    return version


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version that is published now; later versions do not change it."""
    return spark.read.parquet(f"{root}/{current_version(spark, root)}/{name}")


def read_published_record(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.json(f"{root}/{current_version(spark, root)}/{name}")


def drop_old_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes all but the last ``keep`` published versions, which readers may still read."""
    order = published_versions(spark, root).orderBy(F.desc("position"), F.desc("version"))
    old = [r["version"] for r in order.collect()][max(1, keep) :]
    for version in old:
        remove(spark, f"{root}/{version}")
    return old
