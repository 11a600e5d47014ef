"""Queries that run whole stages, with what they write and report."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from shopflow.functions.selection import DEFAULT_FEATURES, LABEL, select_features, selection_rows
from shopflow.operators import rollups
from shopflow.operators.sessions import session_features
from shopflow.plans import propensity, stages
from shopflow.schema import TABLES, empty_table
from shopflow.sources import readers, writers
from shopflow.sources.scratch import scratch_path
from workload import views as v
from workload.registry import query


def _raw_lines(spark, sf_dir):
    """The raw events as CSV; every 89th line has a word for its product, every 97th lacks fields."""
    path = scratch_path(spark, "raw")
    raw = v.raw_behaviour(spark, sf_dir, keep="event_id")
    n = F.col("event_id")
    text = raw.withColumn("product_id", F.when(n % 89 == 0, "none").otherwise(F.col("product_id").cast("string")))
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text.columns if c != "event_id"]
    line = F.when(n % 97 == 0, F.concat_ws(",", *fields[:3])).otherwise(F.concat_ws(",", *fields))
    text.select(line.alias("line")).write.text(path)
    return path


_LINES = """
    good AS (SELECT r.* FROM raw_ids r WHERE event_id % 89 <> 0 AND event_id % 97 <> 0),
    kept AS (SELECT * FROM good WHERE user_id IS NOT NULL AND event_time IS NOT NULL AND event_type IS NOT NULL
      AND (price >= 0 OR price IS NULL))
"""


@query(
    "ingest_one_parse",
    f"""
    WITH {_LINES}
    SELECT (SELECT COUNT(*) FROM good) AS input_rows,
      (SELECT COUNT(*) FROM raw_ids WHERE event_id % 89 = 0 OR event_id % 97 = 0) AS malformed_rows,
      COUNT(*) AS output_rows, COUNT(DISTINCT user_id) AS distinct_users,
      COUNT(DISTINCT CASE WHEN user_session <> '' THEN user_session END) AS distinct_sessions,
      MIN(event_time) AS min_event_time, MAX(event_time) AS max_event_time
    FROM kept
    """,
    "raw_ids",
)
def ingest_one_parse(spark, sf_dir):
    """The summary of an ingest that counts lines while it writes them."""
    summary = stages.ingest(spark, _raw_lines(spark, sf_dir), scratch_path(spark, "events"), header=False)
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("min_event_time", "max_event_time")}
    return summary.withColumns(times)


@query(
    "stage_records",
    f"""
    WITH {_LINES},
    f AS (SELECT user_session, MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS bought,
        CAST(MIN(event_time) AS DATE) AS d FROM kept WHERE user_session <> '' GROUP BY user_session),
    days AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) AS rn, COUNT(*) OVER () AS n FROM (SELECT DISTINCT d FROM f)),
    cut AS (SELECT MIN(d) AS cutoff FROM days WHERE rn = GREATEST(1, LEAST(n - 1, CAST(FLOOR(n * CAST(0.8 AS DOUBLE)) AS BIGINT))) + 1),
    test AS (SELECT f.* FROM f, cut WHERE d >= cutoff), train AS (SELECT f.* FROM f, cut WHERE d < cutoff)
    SELECT 'ingest' AS stage, 'input_rows' AS field, CAST((SELECT COUNT(*) FROM good) AS VARCHAR) AS value
    UNION ALL SELECT 'ingest', 'malformed_rows', CAST((SELECT COUNT(*) FROM raw_ids WHERE event_id % 89 = 0 OR event_id % 97 = 0) AS VARCHAR)
    UNION ALL SELECT 'ingest', 'output_rows', CAST(COUNT(*) AS VARCHAR) FROM kept
    UNION ALL SELECT 'ingest', 'distinct_users', CAST(COUNT(DISTINCT user_id) AS VARCHAR) FROM kept
    UNION ALL SELECT 'ingest', 'distinct_sessions', CAST(COUNT(*) AS VARCHAR) FROM f
    UNION ALL SELECT 'features', 'row_count', CAST(COUNT(*) AS VARCHAR) FROM f
    UNION ALL SELECT 'features', 'positive_rate', printf('%.6f', SUM(bought) / COUNT(*)) FROM f
    UNION ALL SELECT s, 'pct_positive_test', (SELECT printf('%.6f', SUM(bought) / COUNT(*)) FROM test) FROM (VALUES ('evaluation'), ('csv')) t(s)
    UNION ALL SELECT s, 'pct_positive_train', (SELECT printf('%.6f', SUM(bought) / COUNT(*)) FROM train) FROM (VALUES ('evaluation'), ('csv')) t(s)
    UNION ALL SELECT s, 'train_end', (SELECT CAST(MAX(d) AS VARCHAR) FROM train) FROM (VALUES ('evaluation'), ('csv')) t(s)
    UNION ALL SELECT s, 'test_rows', (SELECT CAST(COUNT(*) AS VARCHAR) FROM test) FROM (VALUES ('evaluation'), ('csv')) t(s)
    UNION ALL SELECT s, 'threshold_used', '0.500000' FROM (VALUES ('evaluation'), ('csv')) t(s)
    UNION ALL SELECT s, 'split_method', 'time-based' FROM (VALUES ('evaluation'), ('csv')) t(s)
    """,
    "raw_ids",
)
def stage_records(spark, sf_dir):
    """The JSON records of ingest, features and evaluation, and the evaluation's CSV, as they were written."""
    at = {n: scratch_path(spark, n) for n in ("events", "features", "train", "test", "model", "r1", "r2", "r3", "csv")}
    stages.ingest(spark, _raw_lines(spark, sf_dir), at["events"], record_path=at["r1"], header=False)
    stages.build_features(spark, at["events"], at["features"], record_path=at["r2"])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # num_purchases is left out, as it gives the label away
        propensity.train(spark, at["features"], at["train"], at["test"], at["model"])
    propensity.evaluate(spark, at["train"], at["test"], at["model"], record_path=at["r3"], csv_path=at["csv"])

    def listed(stage, columns):
        record = spark.read.json(at[stage])
        if "confusion_matrix" in record.columns:
            cells = [F.col(f"confusion_matrix.{c}") for c in ("tn", "fp", "fn", "tp")]
            record = record.withColumn("test_rows", cells[0] + cells[1] + cells[2] + cells[3])
        text = [
            (F.format_string("%.6f", c) if dict(record.dtypes)[c] == "double" else F.col(c).cast("string")).alias(c)
            for c in columns
        ]
        return record.select(*text).unpivot([], list(columns), "field", "value")

    counts = ("input_rows", "malformed_rows", "output_rows", "distinct_users", "distinct_sessions")
    facts = ("pct_positive_test", "pct_positive_train", "train_end", "test_rows", "threshold_used", "split_method")
    out = listed("r1", counts).withColumn("stage", F.lit("ingest"))
    out = out.unionByName(listed("r2", ("row_count", "positive_rate")).withColumn("stage", F.lit("features")))
    out = out.unionByName(listed("r3", facts).withColumn("stage", F.lit("evaluation")))
    written = spark.read.schema("metric STRING, value STRING").csv(at["csv"], header=True)
    cells = F.from_json("value", "tn bigint, fp bigint, fn bigint, tp bigint")
    rows = F.when(F.col("metric") == "confusion_matrix", (cells["tn"] + cells["fp"] + cells["fn"] + cells["tp"]).cast("string"))
    number = F.when(F.col("metric").isin("pct_positive_test", "pct_positive_train", "threshold_used"), F.format_string("%.6f", F.col("value").try_cast("double")))
    named = F.when(F.col("metric") == "confusion_matrix", "test_rows").otherwise(F.col("metric"))
    csv = written.select(F.lit("csv").alias("stage"), named.alias("field"), F.coalesce(rows, number, "value").alias("value"))
    return out.unionByName(csv.filter(F.col("field").isin(*facts)))


@query(
    "feature_selection",
    "SELECT feature, status, (SELECT COUNT(*) FROM es) AS sessions FROM (VALUES "
    + ", ".join(f"('{c}', '{'leaking' if 'purchase' in c else 'kept'}')" for c in DEFAULT_FEATURES)
    + f", ('{LABEL}', 'leaking'), ('Num_PURCHASES_lately', 'leaking'), ('not_there', 'missing'), ('another', 'missing')) t(feature, status)",
    "es",
)
def feature_selection(spark, sf_dir):
    """What becomes of each wanted feature, beside the sessions that it was looked for in."""
    sessions = v.behaviour_sessions(spark, sf_dir)
    chosen = select_features(sessions, [*DEFAULT_FEATURES, LABEL, "Num_PURCHASES_lately", "not_there", "another"])
    count = sessions.agg(F.count("*").alias("n")).scalar()
    return selection_rows(spark, chosen).withColumn("sessions", count)


@query(
    "save_modes",
    """
    SELECT 'first' AS step, 'written' AS outcome, (SELECT COUNT(*) FROM brands) AS rows
    UNION ALL SELECT 'again', 'refused', (SELECT COUNT(*) FROM brands)
    UNION ALL SELECT 'overwrite', 'written', (SELECT COUNT(*) FROM brands WHERE purchase_count > 1)
    UNION ALL SELECT 'append', 'written', (SELECT COUNT(*) FROM brands WHERE purchase_count > 1) + (SELECT COUNT(*) FROM brands)
    """,
    "brands",
)
def save_modes(spark, sf_dir):
    """Event days written once, refused a second time, overwritten and added to."""
    path = scratch_path(spark, "events")
    rows = rollups.brand_daily(v.shop_purchases(spark, sf_dir))
    fewer = rows.filter("purchase_count > 1")
    out = []
    for step, df, settings in (
        ("first", rows, {}),
        ("again", fewer, {}),
        ("overwrite", fewer, {"overwrite": True}),
        ("append", rows, {"mode": "append"}),
    ):
        try:
            writers.write_events(df, path, **settings)
            outcome = "written"
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            outcome = "refused"
        out.append((step, outcome, spark.read.parquet(path).count()))
    return spark.createDataFrame(out, "step STRING, outcome STRING, rows BIGINT")


@query(
    "readiness",
    """
    SELECT 'features' AS name, 'ready' AS status, (SELECT COUNT(*) FROM lf) AS rows
    UNION ALL SELECT 'nothing', 'empty', 0 UNION ALL SELECT 'nowhere', 'missing', 0 UNION ALL SELECT 'optional', 'absent', 0
    """,
    "lf",
)
def readiness(spark, sf_dir):
    """Inputs that are there, hold no row, or are missing; and an optional one that is not there."""
    at = {n: scratch_path(spark, n) for n in ("features", "nothing", "nowhere", "optional")}
    writers.write_table(session_features(v.commerce(spark, sf_dir)), at["features"])
    writers.write_table(empty_table(spark, "session_features"), at["nothing"])
    out = []
    for name in ("features", "nothing", "nowhere"):
        try:
            out.append((name, "ready", readers.require_rows(spark, at[name], "run build_features").count()))
        except FileNotFoundError:
            out.append((name, "missing", 0))
        except ValueError:
            out.append((name, "empty", 0))
    optional = readers.read_optional(spark, at["optional"], "session_features")
    assert optional.columns == [c.split(" ")[0] for c in TABLES["session_features"].split(", ")]
    out.append(("optional", "absent", optional.count()))
    return spark.createDataFrame(out, "name STRING, status STRING, rows BIGINT")
