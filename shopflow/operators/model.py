"""Session purchase propensity: splits, fitting, scoring, and what drives the score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopflow.functions.expressions import key_share, ratio
from shopflow.functions.selection import DEFAULT_FEATURES, LABEL, fill_missing
from shopflow.operators.events import in_date_range

# The features listed first among the drivers.
PREFERRED_DRIVERS = tuple(c for c in DEFAULT_FEATURES if c != "num_purchases")

FEATURE_DESCRIPTIONS = {
    "total_events": "events of any kind",
    "num_views": "product views",
    "num_carts": "times a product was put into the cart",
    "unique_products": "different products touched",
    "unique_categories": "different categories touched",
    "session_duration_seconds": "seconds from first to last event",
    "avg_price_viewed": "mean price of the views",
    "max_price_viewed": "highest price viewed",
    "hour_of_day": "hour of the first event, 0 to 23",
    "day_of_week": "weekday of the first event, Sunday = 1",
    "is_weekend": "1 if the first event fell on a Saturday or Sunday",
}
OTHER_DESCRIPTION = "another session feature"

# Default fit settings.
FIT_DEFAULTS = {"maxIter": 50, "regParam": 0.01, "elasticNetParam": 0.0}


def hash_split(df: DataFrame, keys: Sequence[str], share: float = 0.8, seed: int = 42) -> DataFrame:
    """Add in_train by a hash of the keys: the same rows whatever the partitioning."""
    return df.withColumn("in_train", key_share(keys, seed) < F.lit(share))


def random_split(df: DataFrame, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Spark's own seeded split; which rows go where depends on the partitioning."""
    train, test = df.randomSplit([share, 1.0 - share], seed)
    return train, test


def split_cutoff(df: DataFrame, date_column: str, share: float = 0.8) -> DataFrame:
    """The first test date as one row; NULL with fewer than two distinct dates.

    Of n dates the first max(1, min(n - 1, floor(n * share))) train. The window runs over
    distinct calendar days only, never over sessions.
    """
    dates = df.select(F.col(date_column).alias("d")).dropna().distinct()
    everything = Window.partitionBy(F.lit(0))
    ranked = dates.select(
        "d",
        F.row_number().over(everything.orderBy("d")).alias("position"),
        F.count("*").over(everything).alias("n"),
    )
    first = F.greatest(
        F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(float(share))))
    )
    chosen = (F.col("n") >= 2) & (F.col("position") == first + 1)
    return ranked.agg(F.min(F.when(chosen, F.col("d"))).alias("cutoff"))


def time_split(
    df: DataFrame, date_column: str, keys: Sequence[str], share: float = 0.8, seed: int = 42
) -> DataFrame:
    """Add in_train: earlier dates train, later dates test, rows without a date neither.

    With fewer than two dates the rows are split by a hash of ``keys`` instead.
    """
    cutoff = split_cutoff(df, date_column, share).select("cutoff").scalar()
    with_cutoff = df.withColumn("cutoff", cutoff)
    return with_cutoff.withColumn(
        "in_train",
        F.when(F.col("cutoff").isNotNull(), F.col(date_column) < F.col("cutoff")).otherwise(
            key_share(keys, seed) < F.lit(share)
        ),
    ).drop("cutoff")


def fit(
    train: DataFrame, features: Sequence[str], label: str = LABEL, **settings: float
) -> PipelineModel:
    """Logistic regression on the named features; their names are kept in the model."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    regression = LogisticRegression(
        featuresCol="features", labelCol=label, **{**FIT_DEFAULTS, **settings}
    )
    return Pipeline(stages=[assembler, regression]).fit(fill_missing(train, features, label))


def model_features(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """The saved model, or None if there is nothing at ``path``; a damaged one is an error."""
    try:
        SparkSession.active().read.text(f"{path}/metadata")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return PipelineModel.load(path)


def score(
    model: PipelineModel, sessions: DataFrame, label: str = LABEL, date_column: str = "session_date"
) -> DataFrame:
    """(session_date, label, pred_prob) of each session."""
    scored = model.transform(fill_missing(sessions, model_features(model), label))
    return scored.select(
        F.col(date_column).alias("session_date"),
        F.col(label).alias("label"),
        vector_to_array("probability").getItem(1).alias("pred_prob"),
    )


def logistic_score(weights: Mapping[str, float], intercept: float) -> Column:
    """The score of a linear model as a plain expression: no vectors, all in codegen."""
    margin = F.lit(float(intercept))
    for name, weight in weights.items():
        margin = margin + F.lit(float(weight)) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-margin))


def model_weights(model: PipelineModel) -> tuple[dict[str, float], float]:
    regression = model.stages[-1]
    weights = [float(w) for w in regression.coefficients]
    return dict(zip(model_features(model), weights)), float(regression.intercept)


def evaluator_auc(model: PipelineModel, sessions: DataFrame, label: str = LABEL) -> float:
    """AUC by MLlib's evaluator, over every distinct score."""
    scored = model.transform(fill_missing(sessions, model_features(model), label))
    return BinaryClassificationEvaluator(labelCol=label, numBins=0).evaluate(scored)


def coefficient_rows(model: PipelineModel, like: DataFrame) -> DataFrame:
    """(feature, weight) rows of a fitted model."""
    weights, _ = model_weights(model)
    return like.sparkSession.createDataFrame(list(weights.items()), "feature STRING, weight DOUBLE")


def _correlation(x: Column, y: Column) -> Column:
    """Pearson correlation, 0 where it is undefined; corr() itself raises there under ANSI."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_rows(features_table: DataFrame, features: Sequence[str], label: str = LABEL) -> DataFrame:
    """(feature, weight) rows of correlations with the label, all from one aggregation."""
    filled = fill_missing(features_table, features, label)
    target = F.col(label).cast("double")
    wide = filled.agg(*[_correlation(F.col(f).cast("double"), target).alias(f) for f in features])
    return wide.unpivot([], list(features), "feature", "weight").withColumn(
        "weight", F.coalesce(F.nanvl("weight", F.lit(0.0)), F.lit(0.0))
    )


def daily_moments(
    features_table: DataFrame, features: Sequence[str], label: str = LABEL, date_column: str = "session_date"
) -> DataFrame:
    """(session_date, feature, n, sums and central products with the label): what correlations of any days need.

    A mergeable record with a row for each day and feature. Missing values count as 0.
    """
    filled = fill_missing(features_table, features, label)
    y = F.col(label).cast("double")
    long = filled.select(
        F.col(date_column).alias("session_date"), y.alias("y"), *[F.col(f).cast("double").alias(f) for f in features]
    ).unpivot(["session_date", "y"], list(features), "feature", "x")
    n = F.count("*")
    return long.groupBy("session_date", "feature").agg(
        n.alias("n"),
        F.sum("x").alias("x_sum"),
        F.sum("y").alias("y_sum"),
        (F.var_pop("x") * n).alias("xx"),
        (F.var_pop("y") * n).alias("yy"),
        (F.covar_pop("x", "y") * n).alias("xy"),
    )


def merged_moments(moments: DataFrame) -> DataFrame:
    """(feature, n, xx, yy, xy) over all days of ``moments``.

    Products around the days' means become products around the common mean, which keeps the
    precision that sums of squares would lose.
    """
    whole = moments.groupBy("feature").agg(
        *[F.sum(c).alias(f"{c}_all") for c in ("n", "x_sum", "y_sum")]
    )
    off_x = F.col("x_sum") / F.col("n") - F.col("x_sum_all") / F.col("n_all")
    off_y = F.col("y_sum") / F.col("n") - F.col("y_sum_all") / F.col("n_all")
    return (
        moments.join(whole, "feature")
        .groupBy("feature")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("xx") + F.col("n") * off_x * off_x).alias("xx"),
            F.sum(F.col("yy") + F.col("n") * off_y * off_y).alias("yy"),
            F.sum(F.col("xy") + F.col("n") * off_x * off_y).alias("xy"),
        )
    )


def drivers_from_moments(
    moments: DataFrame, start: str | date | None = None, end: str | date | None = None, top: int = 8
) -> DataFrame:
    """Correlation drivers of a range of days from :func:`daily_moments`: no session is read."""
    merged = merged_moments(in_date_range(moments, "session_date", start, end))
    weight = ratio(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
    weights = merged.select("feature", F.coalesce(F.nanvl(weight, F.lit(0.0)), F.lit(0.0)).alias("weight"))
    return rank_drivers(weights, "feature_correlation", "correlation", False, top)


def rank_drivers(
    weights: DataFrame, source: str, score_label: str, signed: bool, top: int = 8
) -> DataFrame:
    """The strongest drivers either way, preferred features first, with descriptions.

    ``signed`` keeps only weights above zero as positive and below zero as negative; else
    every feature is in both lists.
    """
    described = F.create_map(*[F.lit(x) for pair in FEATURE_DESCRIPTIONS.items() for x in pair])
    up, down = F.col("weight"), -F.col("weight")
    sides = [("positive", up), ("negative", down)]
    parts = []
    for direction, strength in sides:
        side = weights.filter(strength > 0) if signed else weights
        parts.append(
            side.select(
                F.lit(direction).alias("direction"), "feature", "weight", strength.alias("strength")
            )
        )
    order = Window.partitionBy("direction").orderBy(
        F.col("feature").isin(*PREFERRED_DRIVERS).desc(), F.desc("strength"), "feature"
    )
    ranked = parts[0].unionByName(parts[1]).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top).select(
        F.lit(source).alias("source"),
        F.lit(score_label).alias("score_label"),
        "direction",
        "rank",
        "feature",
        F.round("weight", 6).alias("weight"),
        F.coalesce(F.try_element_at(described, F.col("feature")), F.lit(OTHER_DESCRIPTION)).alias(
            "description"
        ),
    )


def coefficient_drivers(model: PipelineModel, like: DataFrame, top: int = 8) -> DataFrame:
    return rank_drivers(coefficient_rows(model, like), "model_coefficients", "weight", True, top)


def correlation_drivers(
    features_table: DataFrame, features: Sequence[str], label: str = LABEL, top: int = 8
) -> DataFrame:
    rows = correlation_rows(features_table, features, label)
    return rank_drivers(rows, "feature_correlation", "correlation", False, top)
