"""Split, selection, driver and fitted-model queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shopflow.functions.expressions import ratio
from shopflow.functions.selection import (
    DEFAULT_FEATURES,
    LABEL,
    fill_missing,
    leakage_audit,
    select_features,
)
from shopflow.operators import model, scores
from shopflow.plans.export import propensity_tables
from shopflow.plans.propensity import evaluation_record
from shopflow.sources.scratch import scratch_path, stored
from workload import views as v
from workload.registry import query

_KEPT = [c for c in DEFAULT_FEATURES if c != "num_purchases"]


@query(
    "time_split",
    """
    WITH d AS (SELECT session_date AS d, ROW_NUMBER() OVER (ORDER BY session_date) AS rn, COUNT(*) OVER () AS n
      FROM (SELECT DISTINCT session_date FROM ls WHERE session_date IS NOT NULL)),
    cut AS (SELECT MIN(d) AS cutoff FROM d
      WHERE rn = GREATEST(1, LEAST(n - 1, CAST(FLOOR(n * CAST(0.8 AS DOUBLE)) AS BIGINT))) + 1)
    SELECT session_date < cutoff AS in_train, COUNT(*) AS sessions,
      CAST(SUM(purchase_in_session) AS BIGINT) AS positives, MIN(session_date) AS first_date,
      MAX(session_date) AS last_date
    FROM ls, cut GROUP BY 1
    """,
    "ls",
)
def time_split(spark, sf_dir):
    needed = v.commerce_sessions(spark, sf_dir).select("user_session", "session_date", LABEL)
    sessions = stored(needed, "sessions")
    marked = model.time_split(sessions, "session_date", ["user_session"])
    return marked.groupBy("in_train").agg(
        F.count("*").alias("sessions"),
        F.sum(LABEL).alias("positives"),
        F.min("session_date").alias("first_date"),
        F.max("session_date").alias("last_date"),
    )


@query(
    "hash_split",
    """
    SELECT user_session,
      (CAST('0x' || substr(md5('42|' || user_session), 1, 12) AS BIGINT) % 1000000) / 1000000 < CAST(0.8 AS DOUBLE)
        AS in_train
    FROM lf
    """,
    "lf",
)
def hash_split(spark, sf_dir):
    keys = v.commerce(spark, sf_dir, user=False, part=False).select("user_session").distinct()
    return model.hash_split(keys, ["user_session"])


@query(
    "leakage_selection",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(SUM(COALESCE({c}, 0)) AS DOUBLE) AS total FROM es"
        for c in _KEPT
        if c != "avg_price_viewed"
    )
    + " UNION ALL SELECT 'avg_price_viewed', ROUND(SUM(COALESCE(avg_price_viewed, 0)), 3) FROM es",
    "es",
)
def leakage_selection(spark, sf_dir):
    """Totals of the features that pass the selection, missing values filled."""
    sessions = v.behaviour_sessions(spark, sf_dir)
    wanted = [*DEFAULT_FEATURES, LABEL, "Num_PURCHASES_lately", "not_there"]
    kept = select_features(sessions, wanted).kept
    totals = fill_missing(sessions, kept).agg(
        *[F.round(F.sum(F.col(c).cast("double")), 3).alias(c) for c in kept]
    )
    return totals.unpivot([], kept, "feature", "total")


@query(
    "leakage_audit",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {'TRUE' if 'purchase' in c else 'FALSE'} AS leaky, COUNT(*) AS sessions"
        f" FROM es WHERE {c} <> 0"
        for c in ("num_views", "num_carts", "num_purchases", "purchase_in_session")
    ),
    "es",
)
def audit(spark, sf_dir):
    """Each session lists its non-zero measures; the audit flags the telling ones."""
    names = ("num_views", "num_carts", "num_purchases", "purchase_in_session")
    listed = v.behaviour_sessions(spark, sf_dir).select(
        F.array_compact(F.array(*[F.when(F.col(c) != 0, c) for c in names])).alias("features_used")
    )
    return leakage_audit(listed).groupBy("feature", "leaky").agg(F.count("*").alias("sessions"))


def _corr_rows() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, COALESCE(CORR(CAST(COALESCE({c}, 0) AS DOUBLE), CAST(purchase_in_session AS DOUBLE)), 0) AS weight"
        " FROM es"
        for c in _KEPT
    )


_DESCRIBED = " UNION ALL ".join(
    "SELECT '{}' AS feature, '{}' AS description".format(c, model.FEATURE_DESCRIPTIONS[c]) for c in _KEPT
)
_RANKED = """
    sides AS (
      SELECT 'positive' AS direction, feature, weight, weight AS strength FROM w {positive}
      UNION ALL SELECT 'negative', feature, weight, -weight FROM w {negative}
    ),
    ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY direction ORDER BY strength DESC, feature) AS INTEGER) AS rank FROM sides)
    SELECT '{source}' AS source, '{score_label}' AS score_label, direction, rank, feature,
      ROUND(weight, 6) AS weight, description
    FROM ranked JOIN described USING (feature) WHERE rank <= 8
"""


@query(
    "correlation_drivers",
    f"WITH w AS ({_corr_rows()}), described AS ({_DESCRIBED}), "
    + _RANKED.format(positive="", negative="", source="feature_correlation", score_label="correlation"),
    "es",
)
def correlation_drivers(spark, sf_dir):
    return model.correlation_drivers(v.behaviour_sessions(spark, sf_dir), _KEPT)


@query(
    "coefficient_drivers",
    f"WITH w AS ({_corr_rows().replace('CORR(', 'COVAR_SAMP(')}), described AS ({_DESCRIBED}), "
    + _RANKED.format(
        positive="WHERE weight > 0", negative="WHERE weight < 0", source="model_coefficients", score_label="weight"
    ),
    "es",
)
def coefficient_drivers(spark, sf_dir):
    """The ranking of signed weights, here covariances, which SQL can compute as well."""
    sessions = fill_missing(v.behaviour_sessions(spark, sf_dir), _KEPT)
    wide = sessions.agg(
        *[F.covar_samp(F.col(c).cast("double"), F.col(LABEL).cast("double")).alias(c) for c in _KEPT]
    )
    weights = wide.unpivot([], _KEPT, "feature", "weight")
    return model.rank_drivers(weights, "model_coefficients", "weight", signed=True)


def _fitted(spark, sf_dir):
    sessions = stored(v.behaviour_sessions(spark, sf_dir), "sessions")
    kept = select_features(sessions).kept
    marked = model.time_split(
        sessions.select("user_session", "session_date", LABEL, *kept), "session_date", ["user_session"]
    )
    marked = stored(marked, "split")
    train, test = marked.filter("in_train"), marked.filter("NOT in_train")
    return model.fit(train, kept), kept, train, test


_CUT = """
    d AS (SELECT session_date AS d, ROW_NUMBER() OVER (ORDER BY session_date) AS rn, COUNT(*) OVER () AS n
      FROM (SELECT DISTINCT session_date FROM es WHERE session_date IS NOT NULL)),
    cut AS (SELECT MIN(d) AS cutoff FROM d
      WHERE rn = GREATEST(1, LEAST(n - 1, CAST(FLOOR(n * CAST(0.8 AS DOUBLE)) AS BIGINT))) + 1)
"""


@query(
    "fitted_model_drivers",
    f"""
    WITH {_CUT} SELECT COUNT(*) AS train_sessions, TRUE AS ranks_follow_weights, TRUE AS signs_fit, TRUE AS features_are_kept
    FROM es, cut WHERE session_date < cutoff
    """,
    "es",
)
def fitted_model_drivers(spark, sf_dir):
    """Facts of the drivers of a fitted model: their order, signs and names."""
    fitted, kept, train, _ = _fitted(spark, sf_dir)
    drivers = model.coefficient_drivers(fitted, train)
    weights, _ = model.model_weights(fitted)
    expected = {
        (direction, rank + 1, feature)
        for direction, sign in (("positive", 1), ("negative", -1))
        for rank, (_, feature) in enumerate(sorted((-sign * w, f) for f, w in weights.items() if sign * w > 0)[:8])
    }
    found = {(r["direction"], r["rank"], r["feature"]) for r in drivers.collect()}  # 16 rows at most
    facts = drivers.agg(
        F.bool_and((F.col("weight") >= 0) == (F.col("direction") == "positive")).alias("signs_fit"),
        F.bool_and(F.col("feature").isin(*kept)).alias("features_are_kept"),
    )
    return facts.select(
        train.agg(F.count("*").alias("n")).scalar().alias("train_sessions"),
        F.lit(found == expected).alias("ranks_follow_weights"),
        "signs_fit",
        "features_are_kept",
    )


@query(
    "trained_model_metrics",
    f"""
    WITH {_CUT},
    te AS (SELECT es.* FROM es, cut WHERE session_date >= cutoff), tr AS (SELECT es.* FROM es, cut WHERE session_date < cutoff)
    SELECT 'time-based' AS split_method, CAST(MIN(tr.session_date) AS VARCHAR) AS train_start, CAST(MAX(tr.session_date) AS VARCHAR) AS train_end,
      ROUND(SUM(tr.{LABEL}) / COUNT(*), 6) AS pct_positive_train,
      (SELECT CAST(MIN(session_date) AS VARCHAR) FROM te) AS test_start, (SELECT CAST(MAX(session_date) AS VARCHAR) FROM te) AS test_end,
      (SELECT ROUND(SUM({LABEL}) / COUNT(*), 6) FROM te) AS pct_positive_test, CAST(0.5 AS DOUBLE) AS threshold_used,
      '{LABEL}' AS label_column, '{",".join(_KEPT)}' AS features_used, (SELECT COUNT(*) FROM te) AS sessions,
      (SELECT CAST(SUM({LABEL}) AS BIGINT) FROM te) AS positives, TRUE AS accuracy_fits, TRUE AS precision_fits, TRUE AS recall_fits,
      TRUE AS f1_fits, TRUE AS auc_in_range, 'test' AS evaluation_set
    FROM tr
    """,
    "es",
)
def trained_model_metrics(spark, sf_dir):
    """The evaluation record of a fitted model: what SQL can tell, and whether its scores fit its matrix."""
    fitted, kept, train, test = _fitted(spark, sf_dir)
    record = stored(evaluation_record(model.score(fitted, test), train, test, kept), "record")
    tn, fp, fn, tp = (F.col(f"confusion_matrix.{c}") for c in ("tn", "fp", "fn", "tp"))
    near = lambda name, value: (F.abs(F.col(name) - value) < 2e-6).alias(f"{name}_fits")
    return record.select(
        "split_method",
        *[F.col(c).cast("string").alias(c) for c in ("train_start", "train_end", "test_start", "test_end")],
        "pct_positive_train",
        "pct_positive_test",
        "threshold_used",
        "label_column",
        F.array_join("features_used", ",").alias("features_used"),
        (tn + fp + fn + tp).alias("sessions"),
        (tp + fn).alias("positives"),
        near("accuracy", ratio(tn + tp, tn + fp + fn + tp)),
        near("precision", ratio(tp, tp + fp)),
        near("recall", ratio(tp, tp + fn)),
        near("f1", ratio(2 * tp, 2 * tp + fp + fn)),
        F.col("auc").between(0, 1).alias("auc_in_range"),
        "evaluation_set",
    )


@query(
    "trained_model_curve",
    f"""
    WITH {_CUT} SELECT COUNT(*) AS sessions, TRUE AS falls, TRUE AS begins_with_all, TRUE AS ends_with_none
    FROM es, cut WHERE session_date >= cutoff
    """,
    "es",
)
def trained_model_curve(spark, sf_dir):
    """Facts of a fitted model's curve: shares and recall fall with the threshold, from all to none."""
    fitted, _, _, test = _fitted(spark, sf_dir)
    curve = stored(scores.threshold_curve(scores.score_cube(model.score(fitted, test))), "curve")
    before = Window.partitionBy(F.lit(0)).orderBy("threshold")  # 101 rows at most
    steps = curve.select(
        (F.col("pct_flagged") <= F.coalesce(F.lag("pct_flagged").over(before), F.lit(1.0))).alias("fewer"),
        (F.col("recall") <= F.coalesce(F.lag("recall").over(before), F.lit(1.0))).alias("less"),
    )
    ends = curve.agg(F.min_by("pct_flagged", "threshold").alias("first"), F.max_by("pct_flagged", "threshold").alias("last"))
    return steps.agg(F.bool_and(F.col("fewer") & F.col("less")).alias("falls")).select(
        test.agg(F.count("*").alias("n")).scalar().alias("sessions"),
        "falls",
        ends.select(F.col("first") == 1.0).scalar().alias("begins_with_all"),
        ends.select(F.col("last") == 0.0).scalar().alias("ends_with_none"),
    )


@query(
    "fitted_model_scores",
    f"""
    WITH {_CUT} SELECT session_date < cutoff AS in_train, session_date, COUNT(*) AS sessions,
      CAST(SUM(purchase_in_session) AS BIGINT) AS positives, TRUE AS same_reloaded, TRUE AS same_by_weights
    FROM es, cut GROUP BY ALL
    """,
    "es",
)
def fitted_model_scores(spark, sf_dir):
    """Each session's score by the fitted model, the reloaded one, and its weights alone."""
    fitted, _, train, test = _fitted(spark, sf_dir)
    path = scratch_path(spark, "model")
    model.save_model(fitted, path)
    loaded = model.load_model(path)
    sessions = train.unionByName(test)

    def by_session(m, name):
        found = model.score(m, sessions, date_column="user_session")
        return found.select(F.col("session_date").alias("user_session"), F.col("pred_prob").alias(name))

    plain = sessions.withColumn("plain", model.logistic_score(*model.model_weights(loaded)))
    both = by_session(fitted, "first").join(by_session(loaded, "again"), "user_session")
    return (
        plain.join(both, "user_session")
        .groupBy("in_train", "session_date")
        .agg(
            F.count("*").alias("sessions"),
            F.sum(LABEL).alias("positives"),
            F.bool_and(F.col("first") == F.col("again")).alias("same_reloaded"),
            F.bool_and(F.abs(F.col("plain") - F.col("again")) < 1e-9).alias("same_by_weights"),
        )
    )


@query(
    "fitted_model_checks",
    f"""
    WITH {_CUT} SELECT COUNT(*) AS test_sessions, CAST(SUM(purchase_in_session) AS BIGINT) AS test_positives,
      TRUE AS mean_score_is_rate, TRUE AS drivers_in_order
    FROM es, cut WHERE session_date >= cutoff
    """,
    "es",
)
def fitted_model_checks(spark, sf_dir):
    """Confusion counts of the test set; the mean score that a free intercept implies; drivers by rank."""
    fitted, kept, train, test = _fitted(spark, sf_dir)
    off = F.abs(F.avg("pred_prob") - F.avg("label"))
    mean = model.score(fitted, train).agg((off < 1e-4).alias("met")).scalar()
    above = F.lag(F.abs("weight")).over(Window.partitionBy("direction").orderBy("rank"))
    sign = F.when(F.col("direction") == "positive", F.col("weight")).otherwise(-F.col("weight"))
    ranked = model.coefficient_drivers(fitted, train).select(
        ((F.abs("weight") <= F.coalesce(above, F.abs("weight"))) & (sign >= 0)).alias("fits")
    )
    record = evaluation_record(model.score(fitted, test), train, test, kept).select("confusion_matrix.*")
    return record.select(
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("test_sessions"),
        (F.col("fn") + F.col("tp")).alias("test_positives"),
        mean.alias("mean_score_is_rate"),
        ranked.agg(F.bool_and("fits").alias("met")).scalar().alias("drivers_in_order"),
    )


@query(
    "degraded_outputs",
    f"""
    WITH w AS ({_corr_rows()}), top AS (
      SELECT feature, weight, ROW_NUMBER() OVER (ORDER BY weight DESC, feature) AS rn,
        ROW_NUMBER() OVER (ORDER BY weight, feature) AS low FROM w
    )
    SELECT 'driver_positive' AS output, feature AS name, ROUND(weight, 6) AS value FROM top WHERE rn <= 8
    UNION ALL SELECT 'driver_negative', feature, ROUND(weight, 6) FROM top WHERE low <= 8
    UNION ALL SELECT 'table', t.name, 0.0 FROM (VALUES ('propensity_daily'), ('propensity_hist'),
      ('propensity_threshold'), ('calibration_bins'), ('threshold_curves')) t(name)
    """,
    "es",
)
def degraded_outputs(spark, sf_dir):
    """Without a model: correlation drivers, and typed tables that hold no rows."""
    sessions = v.behaviour_sessions(spark, sf_dir)
    fitted = model.load_model(f"{sf_dir}/no-such-model")
    report = propensity_tables(spark, sessions, fitted, 0.5)
    side = F.concat(F.lit("driver_"), F.col("direction")).alias("output")
    drivers = model.correlation_drivers(sessions, _KEPT)
    out = drivers.select(side, F.col("feature").alias("name"), F.col("weight").alias("value"))
    for name, table in report.tables.items():
        rows = table.agg(F.count("*").cast("double").alias("value"))
        out = out.unionByName(rows.select(F.lit("table").alias("output"), F.lit(name).alias("name"), "value"))
    return out
