"""Training and evaluation of the propensity model on stored session features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.functions.selection import DEFAULT_FEATURES, LABEL, fill_missing, usable_features
from shopflow.operators.model import (
    fit,
    hash_split,
    load_model,
    model_features,
    save_model,
    score,
    time_split,
)
from shopflow.operators.rollups import one_row
from shopflow.operators.scores import (
    auc_from_counts,
    class_balance,
    confusion_from_counts,
    score_counts,
    split_provenance,
)
from shopflow.plans.stages import recorded
from shopflow.sources.readers import require_rows
from shopflow.sources.scratch import stored
from shopflow.sources.writers import write_metric_csv, write_split


def train(
    spark: SparkSession,
    features_path: str,
    train_path: str,
    test_path: str,
    model_path: str,
    method: str = "time",
    share: float = 0.8,
    seed: int = 42,
    wanted: Sequence[str] = DEFAULT_FEATURES,
    label: str = LABEL,
    date_column: str = "session_date",
) -> PipelineModel:
    """Split stored features, store both sets, fit on the training set and save the model.

    Wanted features that leak the label or are not there are left out, with a warning.
    """
    features = require_rows(spark, features_path, "session features are missing or empty")
    kept = usable_features(features, wanted, label)
    has_date = date_column in features.columns
    columns = ["user_session", label, *kept, *([date_column] if has_date else [])]
    sessions = fill_missing(features.select(*columns), kept, label)
    if method in ("time", "time-based") and has_date:
        marked = time_split(sessions, date_column, ["user_session"], share, seed)
    else:
        marked = hash_split(sessions, ["user_session"], share, seed)
    write_split(marked, train_path, test_path)
    model = fit(spark.read.parquet(train_path), kept, label)
    save_model(model, model_path)
    return model


def evaluation_record(
    scored: DataFrame,
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str = LABEL,
    threshold: float = 0.5,
    method: str = "time",
    date_column: str = "session_date",
) -> DataFrame:
    """All facts about a fitted model on its test set as one row.

    The test set is scored once, into counts per distinct score.
    """
    counts = stored(score_counts(scored), "score_counts")
    base = split_provenance(train, test, date_column, method).withColumns(
        {
            "train_balance": one_row(class_balance(train, label)),
            "m": one_row(confusion_from_counts(counts, threshold)),
            "a": one_row(auc_from_counts(counts)),
        }
    )
    return base.select(
        "split_method",
        "train_start",
        "train_end",
        "test_start",
        "test_end",
        F.col("train_balance.positive_rate").alias("pct_positive_train"),
        F.col("m.positive_rate").alias("pct_positive_test"),
        F.round(F.lit(float(threshold)), 6).alias("threshold_used"),
        F.lit(label).alias("label_column"),
        F.array(*[F.lit(f) for f in features]).alias("features_used"),
        F.col("a.auc").alias("auc"),
        *[F.col(f"m.{c}").alias(c) for c in ("accuracy", "precision", "recall", "f1", "positive_rate")],
        F.struct(*[F.col(f"m.{c}").alias(c) for c in ("tn", "fp", "fn", "tp")]).alias("confusion_matrix"),
        F.lit("test").alias("evaluation_set"),
        F.col("a.suspiciously_perfect").alias("suspiciously_perfect_metrics"),
    )


def evaluate(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    model_path: str,
    threshold: float = 0.5,
    method: str = "time",
    label: str = LABEL,
    record_path: str | None = None,
    csv_path: str | None = None,
) -> DataFrame:
    """The evaluation record of a saved model, with the features it was fitted on.

    Computed once, and written as a JSON record and as (metric, value) CSV where paths are given.
    """
    test_rows = require_rows(spark, test_path, "test set is missing or empty; run train")
    train_rows = require_rows(spark, train_path, "training set is missing or empty; run train")
    model = load_model(model_path)
    if model is None:
        raise FileNotFoundError("model is missing or unreadable; run train")
    scored = score(model, test_rows, label)
    record = evaluation_record(scored, train_rows, test_rows, model_features(model), label, threshold, method)
    record = recorded(record, "evaluation_record", record_path)
    if csv_path:
        write_metric_csv(record, csv_path)
    return record
