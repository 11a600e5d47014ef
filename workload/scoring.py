"""Queries about scored sessions, on a fixed example model."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopflow.operators import scores
from shopflow.plans.propensity import evaluation_record
from shopflow.sources.scratch import stored
from workload import views as v
from workload.registry import query

# Days before this one are the training side where a query needs two sets.
TEST_FROM = "2024-01-25"

_CONFUSION = """
    c AS (
      SELECT COUNT(*) AS total, SUM(label) AS positives,
        COUNT(*) FILTER (label = 1 AND pred_prob >= 0.5) AS tp,
        COUNT(*) FILTER (label = 0 AND pred_prob >= 0.5) AS fp,
        COUNT(*) FILTER (label = 1 AND pred_prob < 0.5) AS fn,
        COUNT(*) FILTER (label = 0 AND pred_prob < 0.5) AS tn
      FROM {source}
    ),
    pr AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c)
"""
_AUC = """
    g AS (SELECT pred_prob, SUM(label) AS pos, SUM(1 - label) AS neg FROM {source} GROUP BY pred_prob),
    ranked AS (
      SELECT pred_prob, pos, neg,
        COALESCE(SUM(neg) OVER (ORDER BY pred_prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before,
        COALESCE(SUM(pos) OVER (ORDER BY pred_prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_before,
        SUM(neg) OVER () AS n, SUM(pos) OVER () AS p
      FROM g
    )
"""


@query(
    "score_sessions",
    "SELECT user_session, session_date, label, pred_prob FROM scored",
    "scored",
)
def score_sessions(spark, sf_dir):
    return v.example_scores(spark, sf_dir)


def _cube(spark, sf_dir):
    return scores.score_cube(v.example_scores(spark, sf_dir))


@query(
    "score_cube",
    """
    SELECT session_date, i AS bin, COUNT(*) AS sessions, CAST(SUM(label) AS BIGINT) AS positives,
      SUM(pred_prob) AS prob_sum, COUNT(*) FILTER (pred_prob >= 0.5) AS flagged,
      COUNT(*) FILTER (pred_prob >= 0.5 AND label = 1) AS flagged_positives
    FROM scored JOIN curve_edges ON pred_prob >= lo AND (pred_prob < hi OR (i = 99 AND pred_prob <= hi))
    GROUP BY session_date, i
    """,
    "scored curve_edges",
)
def cube(spark, sf_dir):
    return _cube(spark, sf_dir).drop("threshold")


@query(
    "propensity_daily",
    """
    SELECT date, sessions, purchases, ROUND(mean_pred_prob, 7) AS mean_pred_prob,
      actual_session_conversion_rate FROM daily_scores
    """,
    "daily_scores",
)
def propensity_daily(spark, sf_dir):
    daily = scores.propensity_daily(_cube(spark, sf_dir))
    return daily.withColumn("mean_pred_prob", F.round("mean_pred_prob", 7))


@query(
    "propensity_kpis",
    """
    SELECT TRUE AS available, ROUND(AVG(pred_prob), 6) AS predicted_conversion_rate,
      ROUND(SUM(label) / COUNT(*), 6) AS actual_session_conversion_rate,
      ROUND(AVG(pred_prob) - SUM(label) / COUNT(*), 6) AS calibration_gap,
      ROUND(COUNT(*) FILTER (pred_prob >= 0.5) / COUNT(*), 6) AS high_propensity_share,
      CAST(0.5 AS DOUBLE) AS threshold
    FROM scored
    """,
    "scored",
)
def propensity_kpis(spark, sf_dir):
    return scores.propensity_kpis(_cube(spark, sf_dir))


_TENTHS = """
    t AS (
      SELECT i / 10.0 AS lo, (i + 1) / 10.0 AS hi, COUNT(*) AS n, SUM(label) AS pos, AVG(pred_prob) AS mean_prob
      FROM scored JOIN range(0, 10) r(i)
        ON pred_prob >= i / 10.0 AND (pred_prob < (i + 1) / 10.0 OR (i = 9 AND pred_prob <= 1.0))
      GROUP BY i
    )
"""


@query(
    "score_histogram",
    f"""
    WITH {_TENTHS} SELECT lo AS bucket_low, hi AS bucket_high,
      printf('%.1f', lo) || '-' || printf('%.1f', hi) AS probability_bin, n AS sessions_count FROM t
    """,
    "scored",
)
def score_histogram(spark, sf_dir):
    return scores.score_histogram(_cube(spark, sf_dir))


@query(
    "calibration_bins",
    f"""
    WITH {_TENTHS} SELECT lo AS bin_low, hi AS bin_high, ROUND(mean_prob, 7) AS mean_pred_prob,
      pos / n AS actual_rate, n AS sessions FROM t
    """,
    "scored",
)
def calibration_bins(spark, sf_dir):
    bins = scores.calibration_bins(_cube(spark, sf_dir))
    return bins.withColumn("mean_pred_prob", F.round("mean_pred_prob", 7))


@query(
    "threshold_point",
    """
    SELECT CAST(0.4 AS DOUBLE) AS threshold, ROUND(COUNT(*) FILTER (pred_prob >= 0.4) / COUNT(*), 6) AS pct_sessions_above,
      ROUND(COUNT(*) FILTER (pred_prob >= 0.4 AND label = 1) / COUNT(*) FILTER (pred_prob >= 0.4), 6)
        AS precision_at_threshold,
      ROUND(COUNT(*) FILTER (pred_prob >= 0.4 AND label = 1) / SUM(label), 6) AS recall_at_threshold
    FROM scored
    """,
    "scored",
)
def threshold_point(spark, sf_dir):
    at = scores.score_cube(v.example_scores(spark, sf_dir), threshold=0.4)
    return scores.threshold_point(at)


@query(
    "threshold_point_other",
    """
    SELECT CAST(0.6 AS DOUBLE) AS threshold, ROUND(f / n, 6) AS pct_sessions_above,
      CASE WHEN f = 0 THEN 0.0 ELSE ROUND(t / f, 6) END AS precision_at_threshold,
      ROUND(t / p, 6) AS recall_at_threshold
    FROM (SELECT COUNT(*) AS n, SUM(label) AS p, COUNT(*) FILTER (pred_prob >= 0.6) AS f,
      COUNT(*) FILTER (pred_prob >= 0.6 AND label = 1) AS t FROM scored)
    """,
    "scored",
)
def threshold_point_other(spark, sf_dir):
    return scores.threshold_point(scores.score_cube(v.example_scores(spark, sf_dir), threshold=0.6))


@query("threshold_curve", "SELECT * FROM curve", "curve")
def threshold_curve(spark, sf_dir):
    return scores.threshold_curve(_cube(spark, sf_dir))


@query(
    "confusion_metrics",
    f"""
    WITH {_CONFUSION.format(source="scored")}
    SELECT total, CAST(positives AS BIGINT) AS positives, tn, fp, fn, tp,
      ROUND((tp + tn) / total, 6) AS accuracy, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall,
      ROUND(2 * p * r / (p + r), 6) AS f1, ROUND(positives / total, 6) AS positive_rate FROM pr
    """,
    "scored",
)
def confusion_metrics(spark, sf_dir):
    return scores.confusion_scores(v.example_scores(spark, sf_dir))


@query(
    "class_balance",
    """
    SELECT COUNT(*) AS total, CAST(SUM(label) AS BIGINT) AS positives, ROUND(SUM(label) / COUNT(*), 6) AS positive_rate
    FROM scored
    """,
    "scored",
)
def class_balance(spark, sf_dir):
    return scores.class_balance(v.example_scores(spark, sf_dir))


@query(
    "split_bounds",
    """
    SELECT CAST(MIN(session_date) AS VARCHAR) AS start, CAST(MAX(session_date) AS VARCHAR) AS "end" FROM ls
    """,
    "ls",
)
def split_bounds(spark, sf_dir):
    return scores.date_bounds(v.commerce_sessions(spark, sf_dir), "session_date")


def _two_sides(spark, sf_dir):
    scored = stored(v.example_scores(spark, sf_dir), "scored")
    late = F.col("session_date") >= F.lit(TEST_FROM).cast("date")
    return scored.filter(~late), scored.filter(late)


_PROVENANCE = f"""
    SELECT CASE WHEN MAX(session_date) FILTER (session_date < DATE '{TEST_FROM}')
        <= MIN(session_date) FILTER (session_date >= DATE '{TEST_FROM}') THEN 'time-based' ELSE 'random' END AS split_method,
      CAST(MIN(session_date) FILTER (session_date < DATE '{TEST_FROM}') AS VARCHAR) AS train_start,
      CAST(MAX(session_date) FILTER (session_date < DATE '{TEST_FROM}') AS VARCHAR) AS train_end,
      CAST(MIN(session_date) FILTER (session_date >= DATE '{TEST_FROM}') AS VARCHAR) AS test_start,
      CAST(MAX(session_date) FILTER (session_date >= DATE '{TEST_FROM}') AS VARCHAR) AS test_end
    FROM scored
"""


@query("split_provenance", _PROVENANCE, "scored")
def split_provenance(spark, sf_dir):
    train, test = _two_sides(spark, sf_dir)
    return scores.split_provenance(train, test, "session_date")


@query(
    "auc_exact",
    f"""
    WITH {_AUC.format(source="scored")}
    SELECT CAST(SUM(pos) AS BIGINT) AS positives, CAST(SUM(neg) AS BIGINT) AS negatives,
      ROUND(SUM(pos * (2 * neg_before + neg)) / (2.0 * SUM(pos) * SUM(neg)), 6) AS auc,
      ROUND(SUM(pos * (2 * neg_before + neg)) / (2.0 * SUM(pos) * SUM(neg)), 6) >= 1.0 AS suspiciously_perfect
    FROM ranked
    """,
    "scored",
)
def auc_exact(spark, sf_dir):
    return scores.auc_exact(v.example_scores(spark, sf_dir))


@query(
    "roc_curve",
    f"""
    WITH {_AUC.format(source="scored")}
    SELECT pred_prob AS threshold, (n - neg_before) / n AS fpr, (p - pos_before) / p AS tpr FROM ranked
    """,
    "scored",
)
def roc_curve(spark, sf_dir):
    return scores.roc_curve(v.example_scores(spark, sf_dir))


@query(
    "binned_roc",
    "SELECT lo AS threshold, (flagged - tp) / (t - p) AS fpr, tp / p AS tpr FROM from_top",
    "from_top",
)
def binned_roc(spark, sf_dir):
    return scores.binned_roc(_cube(spark, sf_dir))


@query(
    "evaluation_record",
    f"""
    WITH test AS (SELECT * FROM scored WHERE session_date >= DATE '{TEST_FROM}'),
    train AS (SELECT * FROM scored WHERE session_date < DATE '{TEST_FROM}'),
    {_CONFUSION.format(source="test")}, {_AUC.format(source="test")},
    a AS (SELECT ROUND(SUM(pos * (2 * neg_before + neg)) / (2.0 * SUM(pos) * SUM(neg)), 6) AS auc FROM ranked),
    prov AS ({_PROVENANCE})
    SELECT prov.*, (SELECT ROUND(SUM(label) / COUNT(*), 6) FROM train) AS pct_positive_train,
      ROUND(positives / total, 6) AS pct_positive_test, CAST(0.5 AS DOUBLE) AS threshold_used,
      'label' AS label_column, auc, ROUND((tp + tn) / total, 6) AS accuracy, ROUND(p, 6) AS precision,
      ROUND(r, 6) AS recall, ROUND(2 * p * r / (p + r), 6) AS f1, ROUND(positives / total, 6) AS positive_rate,
      tn, fp, fn, tp, 'test' AS evaluation_set, '{",".join(v.EXAMPLE_WEIGHTS)}' AS features_used, auc >= 1.0 AS suspiciously_perfect_metrics
    FROM prov, pr, a
    """,
    "scored",
)
def evaluation(spark, sf_dir):
    train, test = _two_sides(spark, sf_dir)
    record = evaluation_record(test, train, test, list(v.EXAMPLE_WEIGHTS), label="label")
    listed = record.withColumn("features_used", F.array_join("features_used", ","))
    return listed.select("*", "confusion_matrix.*").drop("confusion_matrix")


@query(
    "weighted_score",
    """
    SELECT ROUND(SUM(mean_pred_prob * sessions) / SUM(sessions), 7) AS predicted_conversion_rate,
      ROUND(SUM(purchases) / SUM(sessions), 7) AS actual_session_conversion_rate,
      ROUND(SUM(mean_pred_prob * sessions) / SUM(sessions) - SUM(purchases) / SUM(sessions), 7) AS calibration_gap
    FROM daily_scores
    """,
    "daily_scores",
)
def weighted_score(spark, sf_dir):
    cube = stored(_cube(spark, sf_dir), "score_cube")
    row = scores.weighted_score(scores.propensity_daily(cube), scores.propensity_kpis(cube))
    return row.select(*[F.round(c, 7).alias(c) for c in row.columns])


@query(
    "threshold_lookup",
    """
    WITH base AS (SELECT SUM(label) / COUNT(*) AS r FROM scored),
    target AS (SELECT LEAST(GREATEST(CASE WHEN r > 0 THEN r ELSE 0.1 END, 0.01), 0.99) AS x FROM base)
    SELECT threshold, pct_flagged AS high_propensity_share, precision, recall, f1
    FROM curve, target ORDER BY ABS(threshold - x), threshold LIMIT 1
    """,
    "scored curve",
)
def threshold_lookup(spark, sf_dir):
    cube = stored(_cube(spark, sf_dir), "score_cube")
    rate = scores.weighted_score(scores.propensity_daily(cube))
    target = rate.select(scores.default_threshold("actual_session_conversion_rate").alias("x")).scalar()
    return scores.nearest_threshold(scores.threshold_curve(cube), target, scores.threshold_point(cube))


@query(
    "threshold_lookup_no_curve",
    """
    SELECT CAST(0.5 AS DOUBLE) AS threshold,
      ROUND(COUNT(*) FILTER (pred_prob >= 0.5) / COUNT(*), 6) AS high_propensity_share,
      CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall, CAST(NULL AS DOUBLE) AS f1
    FROM scored
    """,
    "scored",
)
def threshold_lookup_no_curve(spark, sf_dir):
    """The KPI record answers where no session was scored into a curve."""
    cube = stored(_cube(spark, sf_dir), "score_cube")
    curve = scores.threshold_curve(cube.filter("sessions < 0"), closing_row=False)
    kpis = scores.propensity_kpis(cube)
    return scores.nearest_threshold(curve, F.lit(0.1), scores.threshold_point(cube), kpis)


@query(
    "weighted_score_no_scores",
    """
    SELECT CAST(NULL AS DOUBLE) AS predicted_conversion_rate,
      ROUND(SUM(label) / COUNT(*), 7) AS actual_session_conversion_rate, CAST(NULL AS DOUBLE) AS calibration_gap
    FROM scored
    """,
    "scored",
)
def weighted_score_no_scores(spark, sf_dir):
    """Without score data the actual rate comes from totals; the rest is unknown."""
    cube = stored(_cube(spark, sf_dir), "score_cube")
    totals = cube.agg(F.sum("positives").alias("purchases"), F.sum("sessions").alias("sessions"))
    none = scores.propensity_daily(cube.filter("sessions < 0"))
    absent = scores.propensity_kpis(cube).withColumn("available", F.lit(False))
    row = scores.weighted_score(none, absent, totals)
    return row.select(*[F.round(c, 7).alias(c) for c in row.columns])


@query(
    "backfilled_daily_rates",
    """
    SELECT date, sessions, purchases, ROUND(mean_pred_prob, 7) AS mean_pred_prob,
      purchases / sessions AS actual_session_conversion_rate FROM daily_scores
    """,
    "daily_scores",
)
def backfilled_daily_rates(spark, sf_dir):
    daily = scores.propensity_daily(_cube(spark, sf_dir)).drop("actual_session_conversion_rate")
    filled = scores.fill_daily_rates(daily)
    return filled.withColumn("mean_pred_prob", F.round("mean_pred_prob", 7))


@query(
    "backfilled_bin_labels",
    f"""
    WITH {_TENTHS} SELECT lo AS bucket_low, hi AS bucket_high, n AS sessions_count,
      printf('%.1f', lo) || '-' || printf('%.1f', hi) AS bucket_label FROM t
    """,
    "scored",
)
def backfilled_bin_labels(spark, sf_dir):
    return scores.fill_bin_labels(scores.score_histogram(_cube(spark, sf_dir)).drop("probability_bin"))


@query(
    "cleaned_calibration",
    f"""
    WITH {_TENTHS} SELECT lo AS bin_low, hi AS bin_high, ROUND(mean_prob, 7) AS mean_pred_prob,
      pos / n AS actual_rate, CAST(n AS DOUBLE) AS sessions,
      printf('%.2f', lo) || '-' || printf('%.2f', hi) AS bin_label FROM t WHERE lo >= 0.15
    """,
    "scored",
)
def cleaned_calibration(spark, sf_dir):
    """Bins as text, some unreadable, as a file of unknown origin would hold them."""
    bins = scores.calibration_bins(_cube(spark, sf_dir))
    text = bins.select(*[F.col(c).cast("string").alias(c) for c in bins.columns])
    broken = text.withColumn(
        "actual_rate", F.when(F.col("bin_low").cast("double") < 0.15, "n/a").otherwise(F.col("actual_rate"))
    )
    cleaned = scores.clean_calibration(broken)
    return cleaned.withColumn("mean_pred_prob", F.round("mean_pred_prob", 7))


@query(
    "f1_backfill",
    f"""
    WITH {_CONFUSION.format(source="scored")}
    SELECT ROUND(p, 6) AS precision, ROUND(r, 6) AS recall,
      ROUND(2 * ROUND(p, 6) * ROUND(r, 6) / (ROUND(p, 6) + ROUND(r, 6)), 9) AS f1 FROM pr
    """,
    "scored",
)
def f1_backfill(spark, sf_dir):
    record = scores.confusion_scores(v.example_scores(spark, sf_dir)).select("precision", "recall")
    return scores.fill_f1(record).withColumn("f1", F.round("f1", 9))
