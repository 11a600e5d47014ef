"""Tables about scored sessions: (session_date, label 0/1, pred_prob in [0, 1]).

Most of them are merges of :func:`score_cube`, a small table of sums per day and score
bin, so the scored sessions are read once for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.functions.expressions import harmonic_mean, ratio, unit_bin, unit_edge
from shopflow.operators.ranks import running_totals
from shopflow.schema import conform

CURVE_BINS = 100
REPORT_BINS = 10


def score_cube(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Sums per (day, hundredth of score): at most 100 rows a day.

    Rows without a score, NULL or NaN, are left out. The cube keeps the threshold that its
    flagged counts belong to.
    """
    flagged = F.col("pred_prob") >= F.lit(threshold)
    return (
        scored.filter(F.col("pred_prob").isNotNull() & ~F.isnan("pred_prob"))
        .groupBy("session_date", unit_bin("pred_prob", CURVE_BINS).alias("bin"))
        .agg(
            F.count("*").alias("sessions"),
            F.sum("label").alias("positives"),
            F.sum("pred_prob").alias("prob_sum"),
            F.count_if(flagged).alias("flagged"),
            F.coalesce(F.sum(F.when(flagged, F.col("label"))), F.lit(0)).alias("flagged_positives"),
        )
        .withColumn("threshold", F.lit(float(threshold)))
    )


def _cube_threshold() -> Column:
    """The threshold a cube was built with; the default of 0.5 where the cube has no row."""
    return F.coalesce(F.max("threshold"), F.lit(0.5)).alias("threshold")


def propensity_daily(cube: DataFrame) -> DataFrame:
    daily = cube.groupBy(F.col("session_date").alias("date")).agg(
        F.sum("sessions").alias("sessions"),
        F.sum("positives").alias("purchases"),
        F.sum("prob_sum").alias("prob_sum"),
    )
    return conform(
        daily.withColumns(
            {
                "mean_pred_prob": ratio("prob_sum", "sessions"),
                "actual_session_conversion_rate": ratio("purchases", "sessions"),
            }
        ),
        "propensity_daily",
    )


def propensity_kpis(cube: DataFrame) -> DataFrame:
    """Rates over all scored sessions, and the share flagged at the cube's threshold."""
    sums = cube.agg(
        _cube_threshold(),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("sessions", "positives", "prob_sum", "flagged")
        ]
    )
    predicted, actual = ratio("prob_sum", "sessions"), ratio("positives", "sessions")
    return sums.select(
        F.lit(True).alias("available"),
        F.round(predicted, 6).alias("predicted_conversion_rate"),
        F.round(actual, 6).alias("actual_session_conversion_rate"),
        F.round(predicted - actual, 6).alias("calibration_gap"),
        F.round(ratio("flagged", "sessions"), 6).alias("high_propensity_share"),
        F.round("threshold", 6).alias("threshold"),
    )


def _report_bin() -> Column:
    return F.expr(f"bin div {CURVE_BINS // REPORT_BINS}")


def score_histogram(cube: DataFrame) -> DataFrame:
    """Sessions per tenth of score, with a label such as 0.3-0.4; empty bins are absent."""
    counts = cube.groupBy(_report_bin().alias("tenth")).agg(F.sum("sessions").alias("sessions_count"))
    low, high = unit_edge("tenth", REPORT_BINS), unit_edge(F.col("tenth") + 1, REPORT_BINS)
    labelled = counts.select(
        low.alias("bucket_low"),
        high.alias("bucket_high"),
        F.concat_ws("-", F.format_number(low, 1), F.format_number(high, 1)).alias("probability_bin"),
        "sessions_count",
    )
    return conform(labelled, "propensity_hist").orderBy("bucket_low")


def calibration_bins(cube: DataFrame) -> DataFrame:
    """Mean predicted against actual rate per tenth of score."""
    sums = cube.groupBy(_report_bin().alias("tenth")).agg(
        F.sum("sessions").alias("sessions"),
        F.sum("positives").alias("positives"),
        F.sum("prob_sum").alias("prob_sum"),
    )
    return conform(
        sums.select(
            unit_edge("tenth", REPORT_BINS).alias("bin_low"),
            unit_edge(F.col("tenth") + 1, REPORT_BINS).alias("bin_high"),
            ratio("prob_sum", "sessions").alias("mean_pred_prob"),
            ratio("positives", "sessions").alias("actual_rate"),
            "sessions",
        ),
        "calibration_bins",
    ).orderBy("bin_low")


def threshold_point(cube: DataFrame) -> DataFrame:
    """Share, precision and recall at the threshold the cube was built with."""
    sums = cube.agg(
        _cube_threshold(),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("sessions", "positives", "flagged", "flagged_positives")
        ]
    )
    return sums.select(
        "threshold",
        F.round(ratio("flagged", "sessions"), 6).alias("pct_sessions_above"),
        F.round(ratio("flagged_positives", "flagged"), 6).alias("precision_at_threshold"),
        F.round(ratio("flagged_positives", "positives"), 6).alias("recall_at_threshold"),
    )


def _from_the_top(cube: DataFrame) -> DataFrame:
    """Per score bin, sums over it and every higher bin. At most 100 rows in one window."""
    bins = cube.groupBy("bin").agg(
        F.sum("sessions").alias("sessions"), F.sum("positives").alias("positives")
    )
    every = Window.partitionBy(F.lit(0))
    down = every.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bins.select(
        "bin",
        F.sum("sessions").over(down).alias("flagged"),
        F.sum("positives").over(down).alias("tp"),
        F.sum("sessions").over(every).alias("all_sessions"),
        F.sum("positives").over(every).alias("all_positives"),
    )


def threshold_curve(cube: DataFrame, closing_row: bool = True) -> DataFrame:
    """Precision, recall, F1 and flagged share at the low edge of each non-empty bin.

    ``closing_row`` adds the all-zero row at threshold 1.0.
    """
    precision, recall = ratio("tp", "flagged"), ratio("tp", "all_positives")
    curve = _from_the_top(cube).select(
        unit_edge("bin", CURVE_BINS).alias("threshold"),
        F.round(precision, 6).alias("precision"),
        F.round(recall, 6).alias("recall"),
        F.round(harmonic_mean(precision, recall), 6).alias("f1"),
        F.round(ratio("flagged", "all_sessions"), 6).alias("pct_flagged"),
    )
    if closing_row:
        zero = F.lit(0.0)
        last = curve.sparkSession.range(1).select(
            F.lit(1.0).alias("threshold"),
            *[zero.alias(c) for c in ("precision", "recall", "f1", "pct_flagged")],
        )
        curve = curve.unionByName(last)
    return curve


def binned_roc(cube: DataFrame) -> DataFrame:
    """ROC points at the low edge of each non-empty score bin (at most 100)."""
    return _from_the_top(cube).select(
        unit_edge("bin", CURVE_BINS).alias("threshold"),
        ratio(F.col("flagged") - F.col("tp"), F.col("all_sessions") - F.col("all_positives")).alias("fpr"),
        ratio("tp", "all_positives").alias("tpr"),
    )


def predicted_label(threshold: float = 0.5) -> Column:
    """1 where the score reaches the threshold; a tie is positive."""
    return (F.col("pred_prob") >= F.lit(threshold)).cast("int")


def confusion_scores(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts and the scores derived from them, as one row.

    Each session counts by itself; sums combine before the one row they meet in.
    """
    each = scored.filter(F.col("pred_prob").isNotNull()).select(
        "pred_prob",
        (F.col("label") == 1).cast("bigint").alias("pos"),
        (F.col("label") == 0).cast("bigint").alias("neg"),
    )
    return confusion_from_counts(each, threshold)


def score_counts(scored: DataFrame) -> DataFrame:
    """(pred_prob, pos, neg): sessions of each class per distinct score."""
    return (
        scored.filter(F.col("pred_prob").isNotNull())
        .groupBy("pred_prob")
        .agg(
            F.count_if(F.col("label") == 1).alias("pos"),
            F.count_if(F.col("label") == 0).alias("neg"),
        )
    )


def confusion_from_counts(counts: DataFrame, threshold: float = 0.5) -> DataFrame:
    hit = predicted_label(threshold) == 1

    def total(column: Column | int) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    cells = counts.agg(
        total(F.when(~hit, F.col("neg"))).alias("tn"),
        total(F.when(hit, F.col("neg"))).alias("fp"),
        total(F.when(~hit, F.col("pos"))).alias("fn"),
        total(F.when(hit, F.col("pos"))).alias("tp"),
    ).withColumns(
        {
            "total": F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"),
            "positives": F.col("tp") + F.col("fn"),
        }
    )
    precision = ratio("tp", F.col("tp") + F.col("fp"))
    recall = ratio("tp", F.col("tp") + F.col("fn"))
    return cells.select(
        "total",
        "positives",
        "tn",
        "fp",
        "fn",
        "tp",
        F.round(ratio(F.col("tp") + F.col("tn"), "total"), 6).alias("accuracy"),
        F.round(precision, 6).alias("precision"),
        F.round(recall, 6).alias("recall"),
        F.round(harmonic_mean(precision, recall), 6).alias("f1"),
        F.round(ratio("positives", "total"), 6).alias("positive_rate"),
    )


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(label) == 1).alias("positives"),
    ).withColumn("positive_rate", F.round(ratio("positives", "total"), 6))


def date_bounds(df: DataFrame, column: str) -> DataFrame:
    """First and last date as ISO text; NULLs if the column is absent."""
    dates = F.col(column).cast("date") if column in df.columns else F.lit(None).cast("date")
    return df.agg(
        F.min(dates).cast("string").alias("start"), F.max(dates).cast("string").alias("end")
    )


def auc_exact(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counted half; one row.

    The perfect flag marks a value of 1.0 after rounding. A single class gives NULL.
    """
    return auc_from_counts(score_counts(scored))


def auc_from_counts(counts: DataFrame) -> DataFrame:
    ranked = running_totals(counts, "pred_prob", ["pos", "neg"])
    big = "decimal(20,0)"
    twice_won = F.col("pos").cast(big) * (2 * F.col("neg_before") + F.col("neg")).cast(big)
    sums = ranked.agg(
        F.sum(twice_won).cast("double").alias("twice_won"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    auc = F.round(F.when(pairs > 0, F.col("twice_won") / (2.0 * pairs)), 6)
    return sums.select(
        F.coalesce("positives", F.lit(0)).alias("positives"),
        F.coalesce("negatives", F.lit(0)).alias("negatives"),
        auc.alias("auc"),
        (auc >= 1.0).alias("suspiciously_perfect"),
    )


def roc_curve(scored: DataFrame) -> DataFrame:
    """One (threshold, fpr, tpr) point per distinct score, at or above which all is flagged."""
    ranked = running_totals(score_counts(scored), "pred_prob", ["pos", "neg"])
    return ranked.select(
        F.col("pred_prob").alias("threshold"),
        ratio(F.col("neg_total") - F.col("neg_before"), "neg_total").alias("fpr"),
        ratio(F.col("pos_total") - F.col("pos_before"), "pos_total").alias("tpr"),
    )


def split_provenance(train: DataFrame, test: DataFrame, column: str, configured: str = "time") -> DataFrame:
    """Date bounds of both sets and whether they really form a time-based split."""
    bounds = (
        date_bounds(train, column)
        .withColumnsRenamed({"start": "train_start", "end": "train_end"})
        .withColumn(
            "test",
            date_bounds(test, column).select(F.struct("start", "end").alias("row")).scalar(),
        )
    )
    timed = F.lit(configured in ("time", "time-based"))
    ordered = timed & (F.col("train_end") <= F.col("test.start"))
    return bounds.select(
        F.when(ordered, "time-based").otherwise("random").alias("split_method"),
        "train_start",
        "train_end",
        F.col("test.start").alias("test_start"),
        F.col("test.end").alias("test_end"),
    )


def weighted_score(
    daily: DataFrame, kpis: DataFrame | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """Session-weighted mean score, actual rate and their gap over the given days.

    No days at all gives the stored KPI values, where those are supplied and ``available``.
    Without these the actual rate is purchases / sessions of ``totals`` (one row), if given;
    what is left is NULL.
    """
    sums = daily.agg(
        F.count("*").alias("days"),
        F.coalesce(F.sum(F.coalesce("mean_pred_prob", F.lit(0.0)) * F.coalesce("sessions", F.lit(0))), F.lit(0.0)).alias("won"),
        F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"),
        F.coalesce(F.sum("purchases"), F.lit(0)).alias("purchases"),
    )
    names = ("predicted_conversion_rate", "actual_session_conversion_rate", "calibration_gap")
    fallback = dict.fromkeys(names, F.lit(None).cast("double"))
    if kpis is not None:
        usable = kpis.filter(F.col("available").cast("boolean")) if "available" in kpis.columns else kpis
        sums = sums.withColumn("kpis", usable.select(F.struct(*names).alias("row")).scalar())
        fallback = {c: F.col(f"kpis.{c}") for c in names}
    if totals is not None:
        sums = sums.withColumn("rate", totals.select(ratio("purchases", "sessions").alias("r")).scalar())
        actual = names[1]
        fallback[actual] = F.coalesce(fallback[actual], F.col("rate"))
    has_days = F.col("days") > 0
    rates = sums.select(
        F.when(has_days, ratio("won", "sessions"))
        .otherwise(fallback["predicted_conversion_rate"])
        .alias("predicted_conversion_rate"),
        F.when(has_days, ratio("purchases", "sessions"))
        .otherwise(fallback["actual_session_conversion_rate"])
        .alias("actual_session_conversion_rate"),
        fallback["calibration_gap"].alias("stored_gap"),
    )
    gap = F.col("predicted_conversion_rate") - F.col("actual_session_conversion_rate")
    return rates.withColumn("calibration_gap", F.coalesce(gap, "stored_gap")).drop("stored_gap")


def default_threshold(base_rate: Column | str) -> Column:
    """The base rate kept within [0.01, 0.99]; 0.1 where it is missing or not positive."""
    rate = F.col(base_rate) if isinstance(base_rate, str) else base_rate
    usable = F.when(rate > 0, rate).otherwise(F.lit(0.1))
    return F.least(F.greatest(usable, F.lit(0.01)), F.lit(0.99))


def nearest_threshold(
    curve: DataFrame,
    target: Column,
    fallback: DataFrame | None = None,
    kpis: DataFrame | None = None,
) -> DataFrame:
    """The curve row closest to ``target`` (lower threshold on a tie).

    With no curve row, threshold and share of ``kpis`` (a propensity_kpis record that is
    ``available``), if given; without these, the row of ``fallback`` (a threshold_point table)
    closest to 0.5; without any, the threshold 0.5 alone.
    """
    null = F.lit(None).cast("double")
    rows = curve.filter(F.col("threshold").isNotNull()).select(
        F.lit(0).alias("source"),
        F.abs(F.col("threshold") - target).alias("distance"),
        "threshold",
        F.col("pct_flagged").alias("high_propensity_share"),
        "precision",
        "recall",
        "f1",
    )
    if kpis is not None:
        stored = kpis.filter(F.col("available").cast("boolean") & F.col("threshold").isNotNull())
        rows = rows.unionByName(
            stored.select(
                F.lit(1).alias("source"),
                F.lit(0.0).alias("distance"),
                "threshold",
                "high_propensity_share",
                *[null.alias(c) for c in ("precision", "recall", "f1")],
            )
        )
    if fallback is not None:
        spare = fallback.filter(F.col("threshold").isNotNull()).select(
            F.lit(2).alias("source"),
            F.abs(F.col("threshold") - 0.5).alias("distance"),
            "threshold",
            F.col("pct_sessions_above").alias("high_propensity_share"),
            null.alias("precision"),
            null.alias("recall"),
            null.alias("f1"),
        )
        rows = rows.unionByName(spare)
    last = curve.sparkSession.range(1).select(
        F.lit(3).alias("source"),
        F.lit(0.0).alias("distance"),
        F.lit(0.5).alias("threshold"),
        *[null.alias(c) for c in ("high_propensity_share", "precision", "recall", "f1")],
    )
    rows = rows.unionByName(last)
    return rows.orderBy("source", "distance", "threshold").limit(1).drop("source", "distance")


def fill_f1(metrics: DataFrame) -> DataFrame:
    """f1 from precision and recall where it is missing and their sum is not zero."""
    p, r = F.col("precision"), F.col("recall")
    derived = F.when((p + r) != 0, 2 * p * r / (p + r))
    known = F.col("f1").cast("double") if "f1" in metrics.columns else F.lit(None).cast("double")
    return metrics.withColumn("f1", F.coalesce(known, derived))


def fill_daily_rates(daily: DataFrame) -> DataFrame:
    """Daily score table in date order with missing rates derived and NULLs as zero."""
    column = "actual_session_conversion_rate"
    rate = F.col(column) if column in daily.columns else ratio("purchases", "sessions")
    return daily.withColumns(
        {
            column: F.coalesce(rate.cast("double"), F.lit(0.0)),
            "mean_pred_prob": F.coalesce(F.col("mean_pred_prob").cast("double"), F.lit(0.0)),
        }
    ).orderBy("date")


def fill_bin_labels(hist: DataFrame) -> DataFrame:
    """Score histogram with a label for each bin, in bin order, missing counts as zero."""
    low, high = F.coalesce("bucket_low", F.lit(0.0)), F.coalesce("bucket_high", F.lit(0.0))
    derived = F.concat_ws("-", F.format_number(low, 1), F.format_number(high, 1))
    label = F.col("probability_bin") if "probability_bin" in hist.columns else derived
    return hist.withColumns(
        {"bucket_label": label, "sessions_count": F.coalesce("sessions_count", F.lit(0))}
    ).orderBy("bucket_low")


def clean_calibration(bins: DataFrame) -> DataFrame:
    """Calibration rows with every number readable, a label each, missing counts as zero."""
    numbers = ("bin_low", "bin_high", "mean_pred_prob", "actual_rate", "sessions")
    read = bins.withColumns({c: F.col(c).try_cast("double") for c in numbers})
    kept = read.dropna(subset=list(numbers[:4]))
    return kept.withColumns(
        {
            "sessions": F.coalesce("sessions", F.lit(0.0)),
            "bin_label": F.concat_ws("-", F.format_number("bin_low", 2), F.format_number("bin_high", 2)),
        }
    )
