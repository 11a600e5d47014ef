"""Queries that filter and re-aggregate the report tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from shopflow.operators import report, rollups, scores
from shopflow.operators.events import purchases
from shopflow.operators.histogram import exact_edges, session_distributions
from shopflow.operators.sessions import conversion_by_weekday, session_kpis
from shopflow.sources.scratch import stored
from workload import views as v
from workload.registry import query

_EVENT_DAYS = f"event_date BETWEEN DATE '{v.START}' AND DATE '{v.END}'"
_SESSION_DAYS = f"session_date BETWEEN DATE '{v.START}' AND DATE '{v.END}'"
CHOSEN = ("cat.2", "cat.5", "unknown")
_CHOSEN = ", ".join(f"'{c}'" for c in CHOSEN)
PRICES = (3000.0, 9000.0)
_PRICED = f"avg_price BETWEEN {PRICES[0]} AND {PRICES[1]}"


class Tables:
    """The report tables from shared, stored bases: for queries that need several."""

    def __init__(self, spark, sf_dir):
        self.at = (spark, sf_dir)

    @cached_property
    def cube(self):
        return stored(rollups.commerce_cube(v.shop_purchases(*self.at)), "commerce_cube")

    @cached_property
    def sessions(self):
        return stored(v.behaviour_sessions(*self.at), "sessions")

    @cached_property
    def funnel(self):
        return stored(rollups.funnel_daily(v.shop_events(*self.at)), "funnel")

    @property
    def hourly(self):
        return rollups.rollup_from_cube(self.cube, ["event_date", "hour"], "purchases_by_hour")

    @property
    def categories(self):
        return rollups.rollup_from_cube(self.cube, ["event_date", "category"], "top_categories")

    @property
    def brands(self):
        return rollups.rollup_from_cube(self.cube, ["event_date", "brand"], "top_brands")

    @property
    def weekdays(self):
        return conversion_by_weekday(self.sessions)

    @cached_property
    def distributions(self):
        return stored(session_distributions(self.sessions, exact_edges(self.sessions)), "distributions")

    @property
    def daily_scores(self):
        return scores.propensity_daily(scores.score_cube(v.scored(self.sessions)))

    @property
    def kpis(self):
        activity = rollups.activity_kpis(v.shop_events(*self.at))
        return rollups.kpi_record(activity, session_kpis(self.sessions))


def _event_days(df, start=v.START, end=v.END):
    return report.filter_dates(df, "event_date", start, end)


def _session_days(df, start=v.START, end=v.END):
    return report.filter_dates(df, "session_date", start, end)


def _funnel(spark, sf_dir):
    return rollups.funnel_daily(v.shop_events(spark, sf_dir))


def _hourly(spark, sf_dir):
    return rollups.purchases_by_hour(v.shop_purchases(spark, sf_dir))


def _categories(spark, sf_dir):
    return rollups.category_daily(v.shop_purchases(spark, sf_dir))


def _brands(spark, sf_dir):
    return rollups.brand_daily(v.shop_purchases(spark, sf_dir))


def _weekdays(spark, sf_dir):
    return conversion_by_weekday(v.behaviour_sessions(spark, sf_dir))


_BOUNDS = """
    SELECT MIN(lo) AS min_date, MAX(hi) AS max_date FROM (
      SELECT MIN(event_date) AS lo, MAX(event_date) AS hi FROM funnel
      UNION ALL SELECT MIN(event_date), MAX(event_date) FROM hourly
      UNION ALL SELECT MIN(session_date), MAX(session_date) FROM weekdays
      UNION ALL SELECT MIN(event_date), MAX(event_date) FROM categories
      UNION ALL SELECT MIN(event_date), MAX(event_date) FROM brands
      UNION ALL SELECT MIN(session_date), MAX(session_date) FROM ed_dist
      UNION ALL SELECT MIN(date), MAX(date) FROM daily_scores
      UNION ALL SELECT MIN(event_date), MAX(event_date) FROM er)
"""
_SEVEN = "funnel hourly weekdays categories brands ed_dist daily_scores"


def _seven(t):
    """The seven report tables that have days, with the column that holds them."""
    return [
        (t.funnel, "event_date"),
        (t.hourly, "event_date"),
        (t.weekdays, "session_date"),
        (t.categories, "event_date"),
        (t.brands, "event_date"),
        (t.distributions, "session_date"),
        (t.daily_scores, "date"),
    ]


def _bounds(t):
    return report.date_bounds(_seven(t), t.kpis)


@query("report_bounds", _BOUNDS, f"{_SEVEN} er")
def report_bounds(spark, sf_dir):
    return _bounds(Tables(spark, sf_dir))


@query(
    "relative_range",
    f"""
    WITH b AS ({_BOUNDS})
    SELECT f.* FROM funnel f, b WHERE event_date BETWEEN GREATEST(min_date, max_date - 6) AND max_date
    """,
    f"{_SEVEN} er",
)
def relative_range(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return report.filter_to(t.funnel, "event_date", report.last_days(_bounds(t), 7))


@query("category_options", "SELECT DISTINCT category FROM categories", "categories")
def category_options(spark, sf_dir):
    return report.category_options(rollups.category_daily(v.shop_purchases(spark, sf_dir)))


@query(
    "category_filter",
    f"SELECT * FROM categories WHERE category IN ({_CHOSEN})",
    "categories",
)
def category_filter(spark, sf_dir):
    return report.filter_categories(_categories(spark, sf_dir), CHOSEN)


@query(
    "price_bounds",
    """
    SELECT MIN(lo) AS price_min, MAX(hi) AS price_max FROM (
      SELECT MIN(LEAST(min_price, avg_price)) AS lo, MAX(GREATEST(max_price, avg_price)) AS hi FROM categories
      UNION ALL SELECT MIN(LEAST(min_price, avg_price)), MAX(GREATEST(max_price, avg_price)) FROM brands
      UNION ALL SELECT MIN(LEAST(min_price, avg_price)), MAX(GREATEST(max_price, avg_price)) FROM hourly)
    """,
    "categories brands hourly",
)
def price_bounds(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return report.price_bounds([t.categories, t.brands, t.hourly])


@query("price_filter", f"SELECT * FROM brands WHERE {_PRICED}", "brands")
def price_filter(spark, sf_dir):
    return report.filter_prices(_brands(spark, sf_dir), *PRICES)


_TOTALS = """
    SELECT views, carts, purchases, sessions, revenue, views + carts + purchases AS events,
      CASE WHEN purchases <> 0 THEN revenue / purchases ELSE 0.0 END AS avg_order_value,
      CASE WHEN views <> 0 THEN purchases / views ELSE 0.0 END AS view_to_purchase_rate
    FROM (SELECT CAST(SUM(views) AS DOUBLE) AS views, CAST(SUM(carts) AS DOUBLE) AS carts,
        CAST(SUM(sessions) AS DOUBLE) AS sessions FROM funnel WHERE {days}),
      (SELECT CAST(COALESCE(SUM(purchase_count), 0) AS DOUBLE) AS purchases, COALESCE(SUM(revenue), 0) AS revenue
       FROM {table} WHERE {days} {more})
"""


@query("report_totals", _TOTALS.format(table="categories", days=_EVENT_DAYS, more=""), "funnel categories")
def report_totals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return report.report_totals(_event_days(t.funnel), _event_days(t.hourly), _event_days(t.categories))


@query(
    "report_totals_filtered",
    _TOTALS.format(table="categories", days=_EVENT_DAYS, more=f"AND category IN ({_CHOSEN}) AND {_PRICED}"),
    "funnel categories",
)
def report_totals_filtered(spark, sf_dir):
    t = Tables(spark, sf_dir)
    kept = report.filter_prices(report.filter_categories(_event_days(t.categories), CHOSEN), *PRICES)
    hourly = report.filter_prices(_event_days(t.hourly), *PRICES)
    return report.report_totals(
        _event_days(t.funnel), hourly, kept, categories_chosen=True, prices_chosen=True
    )


@query(
    "peak_hour",
    """
    SELECT hour, CAST(SUM(purchase_count) AS BIGINT) AS purchase_count FROM hourly
    GROUP BY hour ORDER BY 2 DESC, hour LIMIT 1
    """,
    "hourly",
)
def peak_hour(spark, sf_dir):
    return report.peak_hour(_hourly(spark, sf_dir))


@query(
    "top_category",
    """
    SELECT category, SUM(revenue) AS revenue FROM categories
    GROUP BY category ORDER BY 2 DESC, category LIMIT 1
    """,
    "categories",
)
def top_category(spark, sf_dir):
    return report.top_category(_categories(spark, sf_dir))


_DAY_NAME = """CASE day_of_week WHEN 1 THEN 'Sun' WHEN 2 THEN 'Mon' WHEN 3 THEN 'Tue' WHEN 4 THEN 'Wed'
  WHEN 5 THEN 'Thu' WHEN 6 THEN 'Fri' WHEN 7 THEN 'Sat' END"""


@query(
    "best_weekday",
    f"""
    SELECT day_of_week, {_DAY_NAME} AS weekday, SUM(purchases) / SUM(sessions) AS rate FROM weekdays
    GROUP BY day_of_week ORDER BY 3 DESC, 1 LIMIT 1
    """,
    "weekdays",
)
def best_weekday(spark, sf_dir):
    return report.best_weekday(_weekdays(spark, sf_dir))


_TOP = """
    SELECT {key}, CAST(SUM(purchase_count) AS BIGINT) AS purchase_count, SUM(revenue) AS revenue,
      ROUND(AVG(avg_price), 3) AS avg_price, SUM(revenue) / SUM(purchase_count) AS weighted_avg_price
    FROM {table} GROUP BY {key} ORDER BY revenue DESC, {key} LIMIT 10
"""


@query("top_categories", _TOP.format(key="category", table="categories"), "categories")
def top_categories(spark, sf_dir):
    top = report.top_by_revenue(rollups.category_daily(v.shop_purchases(spark, sf_dir)), "category")
    return top.withColumn("avg_price", F.round("avg_price", 3))


@query("top_brands", _TOP.format(key="brand", table="l_brands"), "l_brands")
def top_brands(spark, sf_dir):
    bought = purchases(v.commerce_events(spark, sf_dir, user=False))
    top = report.top_by_revenue(rollups.brand_daily(bought), "brand")
    return top.withColumn("avg_price", F.round("avg_price", 3))


@query(
    "hourly_totals",
    """
    SELECT hour, CAST(SUM(purchase_count) AS BIGINT) AS purchase_count, SUM(revenue) AS revenue FROM hourly
    GROUP BY hour
    """,
    "hourly",
)
def hourly_totals(spark, sf_dir):
    return report.hourly_totals(_hourly(spark, sf_dir))


@query(
    "weekday_totals",
    f"""
    SELECT day_of_week, CAST(SUM(sessions) AS BIGINT) AS sessions, CAST(SUM(purchases) AS BIGINT) AS purchases,
      SUM(purchases) / SUM(sessions) AS conversion_rate, {_DAY_NAME} AS weekday
    FROM weekdays GROUP BY day_of_week
    """,
    "weekdays",
)
def weekday_totals(spark, sf_dir):
    return report.weekday_totals(_weekdays(spark, sf_dir))


def _distributions(spark, sf_dir):
    sessions = stored(v.behaviour_sessions(spark, sf_dir), "sessions")
    return session_distributions(sessions, exact_edges(sessions))


@query("metric_options", "SELECT DISTINCT metric FROM ed_dist", "ed_dist")
def metric_options(spark, sf_dir):
    return report.metric_options(_distributions(spark, sf_dir))


@query("session_histogram_20_bins", "SELECT * FROM fine_dist", "fine_dist")
def session_histogram_20_bins(spark, sf_dir):
    sessions = stored(v.behaviour_sessions(spark, sf_dir), "sessions")
    return session_distributions(sessions, exact_edges(sessions, bins=20))


@query(
    "distribution_range",
    f"""
    SELECT bin_start, bin_end, CAST(SUM(count) AS BIGINT) AS count,
      printf('%.0f', bin_start) || '-' || printf('%.0f', bin_end) AS bin_label
    FROM ed_dist WHERE metric = 'session_duration_seconds' AND {_SESSION_DAYS} GROUP BY bin_start, bin_end
    """,
    "ed_dist",
)
def distribution_range(spark, sf_dir):
    days = report.filter_dates(_distributions(spark, sf_dir), "session_date", v.START, v.END)
    return report.distribution_over_range(days, "session_duration_seconds")


@query(
    "funnel_totals",
    """
    WITH t AS (SELECT CAST(SUM(views) AS BIGINT) AS v, CAST(SUM(carts) AS BIGINT) AS c,
      CAST(SUM(purchases) AS BIGINT) AS p FROM funnel)
    SELECT 'View' AS stage, v AS count, v / v AS share_of_first FROM t
    UNION ALL SELECT 'Cart', c, c / v FROM t UNION ALL SELECT 'Purchase', p, p / v FROM t
    """,
    "funnel",
)
def funnel_totals(spark, sf_dir):
    return report.funnel_totals(_funnel(spark, sf_dir))


@query(
    "daily_activity_long",
    """
    SELECT event_date, 'views' AS series, views AS value FROM funnel
    UNION ALL SELECT event_date, 'carts', carts FROM funnel
    UNION ALL SELECT event_date, 'purchases', purchases FROM funnel
    """,
    "funnel",
)
def daily_activity_long(spark, sf_dir):
    return report.daily_activity(_funnel(spark, sf_dir))


_COUNTS = """
    c AS (
      SELECT COUNT(*) FILTER (label = 1 AND pred_prob >= 0.5) AS tp, COUNT(*) FILTER (label = 0 AND pred_prob >= 0.5) AS fp,
        COUNT(*) FILTER (label = 1 AND pred_prob < 0.5) AS fn, COUNT(*) FILTER (label = 0 AND pred_prob < 0.5) AS tn
      FROM scored
    )
"""


@query(
    "metric_rows",
    f"""
    WITH {_COUNTS}, r AS (SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r, (tp + tn) / (tp + tn + fp + fn) AS a FROM c)
    SELECT 'accuracy' AS metric, ROUND(a, 6) AS value FROM r
    UNION ALL SELECT 'precision', ROUND(p, 6) FROM r
    UNION ALL SELECT 'recall', ROUND(r, 6) FROM r
    UNION ALL SELECT 'f1', ROUND(2 * p * r / (p + r), 6) FROM r
    """,
    "scored",
)
def metric_rows(spark, sf_dir):
    """The record has no AUC, so that metric is left out."""
    record = scores.confusion_scores(v.example_scores(spark, sf_dir)).withColumn("auc", F.lit(None).cast("double"))
    return report.metric_rows(record)


@query(
    "confusion_long",
    f"""
    WITH {_COUNTS} SELECT 'Negative' AS actual, 'Negative' AS predicted, tn AS count FROM c
    UNION ALL SELECT 'Negative', 'Positive', fp FROM c UNION ALL SELECT 'Positive', 'Negative', fn FROM c
    UNION ALL SELECT 'Positive', 'Positive', tp FROM c
    """,
    "scored",
)
def confusion_long(spark, sf_dir):
    return report.confusion_cells(scores.confusion_scores(v.example_scores(spark, sf_dir)))


@query(
    "insight_rows",
    """
    WITH f AS (SELECT SUM(views) AS views FROM funnel),
    c AS (SELECT SUM(purchase_count) AS purchases, SUM(revenue) AS revenue FROM categories),
    d AS (SELECT SUM(purchases) / SUM(sessions) AS rate FROM daily_scores)
    SELECT CAST(1 AS INTEGER) AS position, 'session_conversion_rate' AS insight, rate AS value, CAST(NULL AS VARCHAR) AS label FROM d
    UNION ALL SELECT 2, 'view_to_purchase_rate', purchases / views, NULL FROM c, f
    UNION ALL SELECT 3, 'revenue', revenue, NULL FROM c
    UNION ALL SELECT 4, 'top_category', revenue, category FROM (
      SELECT category, SUM(revenue) AS revenue FROM categories GROUP BY category
      ORDER BY 2 DESC, 1 LIMIT 1)
    UNION ALL SELECT 5, 'peak_purchase_hour', CAST(n AS DOUBLE), lpad(CAST(hour AS VARCHAR), 2, '0') FROM (
      SELECT hour, SUM(purchase_count) AS n FROM hourly GROUP BY hour ORDER BY 2 DESC, 1 LIMIT 1)
    """,
    "funnel categories hourly daily_scores",
)
def insight_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    funnel, hourly, categories = t.funnel, t.hourly, t.categories
    daily = scores.propensity_daily(scores.score_cube(v.scored(t.sessions)))
    return report.insight_rows(
        report.report_totals(funnel, hourly, categories),
        hourly,
        categories,
        t.weekdays,
        scores.weighted_score(daily),
    )


@query(
    "insight_rows_no_match",
    """
    SELECT CAST(1 AS INTEGER) AS position, 'session_conversion_rate' AS insight, CAST(0 AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS label
    FROM (SELECT COUNT(*) FROM funnel WHERE event_date > DATE '2030-01-01')
    UNION ALL SELECT 2, 'view_to_purchase_rate', 0.0, NULL UNION ALL SELECT 3, 'revenue', 0.0, NULL
    UNION ALL SELECT 7, 'hint', NULL, NULL UNION ALL SELECT 8, 'hint', NULL, NULL
    """,
    "funnel",
)
def insight_rows_no_match(spark, sf_dir):
    """A range after all data: hints fill the places of the missing facts."""
    t, late = Tables(spark, sf_dir), ("2030-01-02", None)
    funnel, hourly, categories = (_event_days(df, *late) for df in (t.funnel, t.hourly, t.categories))
    totals = report.report_totals(funnel, hourly, categories)
    return report.insight_rows(totals, hourly, categories, _session_days(t.weekdays, *late))


def _none(start: str, end: str) -> str:
    counts = " + ".join(
        f"(SELECT COUNT(*) FROM {name} WHERE {column} BETWEEN DATE '{start}' AND DATE '{end}')"
        for name, column in zip(_SEVEN.split(), ("event_date",) * 2 + ("session_date",) + ("event_date",) * 2 + ("session_date", "date"))
    )
    return f"SELECT '{start}' AS start, {counts} = 0 AS no_match"


LATE = ("2030-01-02", "2030-01-31")


@query("no_match", f"{_none(v.START, v.END)} UNION ALL {_none(*LATE)}", _SEVEN)
def no_match(spark, sf_dir):
    """Days with data, and days after all of it."""
    tables = _seven(Tables(spark, sf_dir))
    found = [
        report.no_match([report.filter_dates(df, column, *days) for df, column in tables]).withColumn("start", F.lit(days[0]))
        for days in ((v.START, v.END), LATE)
    ]
    return found[0].unionByName(found[1])
