"""Reading raw files, stored tables and records."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.schema import RAW_COLUMNS, RAW_EVENT_SCHEMA, empty_table


#: Holds the text of a line that doesn't fit the schema.
MALFORMED = "_malformed"


def _path_missing(exc: AnalysisException) -> bool:
    return exc.getCondition() == "PATH_NOT_FOUND"


def read_raw_lines(spark: SparkSession, paths: str | Sequence[str], **options: str | bool) -> DataFrame:
    """Event CSV files with a header, and in ``MALFORMED`` each line that doesn't fit the schema."""
    schema = T.StructType([*RAW_EVENT_SCHEMA.fields, T.StructField(MALFORMED, T.StringType())])
    return (
        spark.read.schema(schema)
        .options(**{"header": True, **options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED})
        .csv(paths if isinstance(paths, str) else list(paths))
    )


def read_raw_events(spark: SparkSession, paths: str | Sequence[str], **options: str) -> DataFrame:
    """Event CSV files with a header; lines that do not fit the schema are dropped.

    Spark parses only the columns a query uses, so a count would let malformed lines pass.
    The filter names every column, which makes any query drop the same lines.
    """
    raw = read_raw_lines(spark, paths, **options)
    return raw.filter(fits() & any_value()).select(*RAW_COLUMNS)


def any_value() -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in RAW_COLUMNS]).isNotNull()


def fits() -> Column:
    return F.col(MALFORMED).isNull()


def count_lines() -> list[Column]:
    """input_rows that fit the schema and malformed_rows, as aggregates of :func:`read_raw_lines`."""
    return [
        F.count_if(fits() & any_value()).alias("input_rows"),
        F.count_if(~fits()).alias("malformed_rows"),
    ]


def month_files(months: Sequence[str], template: str = "{month}.csv") -> list[str]:
    if not months:
        raise ValueError("no months given")
    return [template.format(month=m) for m in months]


def absent_months(
    spark: SparkSession, folder: str, months: Sequence[str], template: str = "{month}.csv"
) -> list[str]:
    """Those of the months that have no file or folder."""
    there = entries(spark, folder)
    return [m for m, name in zip(months, month_files(months, template), strict=True) if name not in there]


def entries(spark: SparkSession, folder: str) -> set[str]:
    """Names of the files and folders in a folder, from one listing; none if there is no such folder."""
    base = "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/"
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).inputFiles()
    except AnalysisException as exc:
        if not _path_missing(exc):
            raise
        return set()
    return {unquote(f.rsplit(base, 1)[-1].split("/", 1)[0]) for f in listed}


def read_months(
    spark: SparkSession,
    folder: str,
    months: Sequence[str],
    template: str = "{month}.csv",
    allow_missing: bool = False,
) -> DataFrame:
    """Raw events of the months, each a file or folder.

    An absent month is an error. With ``allow_missing`` only the absence of all is;
    :func:`absent_months` names those that are left out.
    """
    absent = absent_months(spark, folder, months, template)
    if absent and (not allow_missing or len(absent) == len(months)):
        raise FileNotFoundError(f"no {', '.join(month_files(absent, template))} in {folder}")
    there = [m for m in months if m not in absent]
    return read_raw_events(spark, [f"{folder.rstrip('/')}/{n}" for n in month_files(there, template)])


def file_manifest(
    spark: SparkSession, folder: str, expected: DataFrame, min_mb: float = 100.0
) -> DataFrame:
    """Each expected entry (column ``name``) of a folder: its size and ok, too small or missing.

    An entry is a file, or a folder whose files are summed. Sizes come from the file
    listing; no content is read.
    """
    base = "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/"
    try:
        listed = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(folder)
            .select("path", "length")
        )
    except AnalysisException as exc:
        if not _path_missing(exc):
            raise
        listed = spark.createDataFrame([], "path STRING, length BIGINT")
    entry = F.substring_index(F.substring_index("path", base, -1), "/", 1)
    sizes = listed.groupBy(entry.alias("name")).agg(F.sum("length").alias("size_bytes"))
    smallest = int(min_mb * 1024 * 1024)
    status = (
        F.when(F.col("size_bytes").isNull(), "missing")
        .when(F.col("size_bytes") < smallest, "too small")
        .otherwise("ok")
    )
    return expected.select("name").join(sizes, "name", "left").withColumn("status", status)


def require_rows(spark: SparkSession, path: str, hint: str) -> DataFrame:
    """The Parquet table at ``path``; the hint as an error if absent, unreadable or empty."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as exc:
        raise FileNotFoundError(hint) from exc
    if table.isEmpty():
        raise ValueError(hint)
    return table


def read_optional(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The Parquet table at ``path``, or the typed empty table if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if not _path_missing(exc):
            raise
        return empty_table(spark, table)


def read_record(spark: SparkSession, path: str) -> DataFrame:
    """A one-row JSON record with every number, truth value and numeric text as a double."""
    return normalise_record(spark.read.json(path, multiLine=True))


def normalise_record(record: DataFrame) -> DataFrame:
    texts = [f.name for f in record.schema if isinstance(f.dataType, T.StringType)]
    numeric_texts: set[str] = set()
    if texts:
        probe = record.select(*[F.col(c).try_cast("double").isNotNull().alias(c) for c in texts]).first()
        numeric_texts = {c for c in texts if probe and probe[c]}

    def convert(field: T.StructField):
        number = isinstance(field.dataType, (T.NumericType, T.BooleanType))
        column = F.col(field.name)
        return column.cast("double").alias(field.name) if number or field.name in numeric_texts else column

    return record.select(*[convert(f) for f in record.schema])
