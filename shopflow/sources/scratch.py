"""A shared place for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that set none, by application.
_LOCAL: dict[str, str] = {}
#: Folders of the blocks of :func:`emptied` that are open, the innermost last.
_OPEN: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application under the one in spark.checkpoint.dir.

    Without that setting a local session, whose tasks share the driver's disk, gets a temporary
    folder. A cluster session has no folder that all executors share, so that is an error.
    """
    application = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(application)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _LOCAL[application] = tempfile.mkdtemp(prefix="shopflow-")
    return f"{root.rstrip('/')}/shopflow-{application}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table; inside a block of :func:`emptied`, one that goes when it ends."""
    return f"{_OPEN[-1] if _OPEN else scratch_root(spark)}/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once into a scratch table: for frames that several passes read.

    The table outlives lost executors, and its lineage is a plain file scan.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def emptied(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables made inside the block at its end, also when it fails.

    For stages whose results are written elsewhere: frames that read the tables are of no use
    afterwards.
    """
    own = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    _OPEN.append(own)
    try:
        yield
    finally:
        _OPEN.remove(own)
        remove(spark, own)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there, through the file system that Spark uses for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
