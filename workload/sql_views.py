"""The same views as SQL, for checking results in another engine."""

from __future__ import annotations

from workload import views as v

_FEATURES = """
SELECT user_session, MIN(user_id) AS user_id, COUNT(*) AS total_events,
  COUNT(*) FILTER (event_type = 'view') AS num_views,
  COUNT(*) FILTER (event_type = 'cart') AS num_carts,
  COUNT(*) FILTER (event_type = 'purchase') AS num_purchases,
  COUNT(DISTINCT product_id) AS unique_products,
  COUNT(DISTINCT category_id) AS unique_categories,
  CAST(epoch(MAX(event_time)) - epoch(MIN(event_time)) AS BIGINT) AS session_duration_seconds,
  CAST(MIN(event_time) AS DATE) AS session_date,
  AVG(price) FILTER (event_type = 'view') AS avg_price_viewed,
  MAX(price) FILTER (event_type = 'view') AS max_price_viewed,
  CAST(hour(MIN(event_time)) AS INTEGER) AS hour_of_day,
  CAST(dayofweek(MIN(event_time)) + 1 AS INTEGER) AS day_of_week,
  CAST(CASE WHEN dayofweek(MIN(event_time)) IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
  CAST(MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INTEGER) AS purchase_in_session
FROM {source} WHERE user_session IS NOT NULL GROUP BY user_session
"""

_IN_RANGE = """
SELECT f.* EXCLUDE (session_date), d.session_date
FROM {features} f JOIN (
  SELECT user_session, CAST(MIN(event_time) AS DATE) AS session_date
  FROM {events} GROUP BY user_session
) d USING (user_session)
"""

_SALES = """
  COUNT(*) AS purchase_count, SUM(price) AS revenue, AVG(price) AS avg_price,
  MIN(price) AS min_price, MAX(price) AS max_price
"""

_CATEGORY = """CASE WHEN COALESCE(category_code, CAST(category_id AS VARCHAR)) IS NULL
  OR COALESCE(category_code, CAST(category_id AS VARCHAR)) = '' THEN 'unknown'
  ELSE COALESCE(category_code, CAST(category_id AS VARCHAR)) END"""
_BRAND = "CASE WHEN brand IS NULL OR brand = '' THEN 'unknown' ELSE brand END"

_MARGIN = f"CAST({v.EXAMPLE_INTERCEPT} AS DOUBLE)" + "".join(
    f" + CAST({w!r} AS DOUBLE) * COALESCE(CAST({c} AS DOUBLE), 0.0)" for c, w in v.EXAMPLE_WEIGHTS.items()
)

_METRICS = (
    "session_duration_seconds",
    "total_events",
    "num_views",
    "num_carts",
    "num_purchases",
    "avg_price_viewed",
    "max_price_viewed",
)


def _histogram(prefix: str, sessions: str, bins: int = 10) -> dict[str, str]:
    """Views ``<prefix>_edges`` and ``<prefix>_dist``: exact quantile bins and counts."""
    values = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, session_date, CAST({m} AS DOUBLE) AS value FROM {sessions} WHERE {m} IS NOT NULL"
        for m in _METRICS
    )
    p = prefix
    return {
        f"{p}_values": values,
        f"{p}_running": f"""
SELECT metric, value, SUM(n) OVER (PARTITION BY metric ORDER BY value) AS c, SUM(n) OVER (PARTITION BY metric) AS t
FROM (SELECT metric, value, COUNT(*) AS n FROM {p}_values GROUP BY metric, value)""",
        f"{p}_cuts": f"""
SELECT metric, COUNT(DISTINCT q) AS n, MIN(q) AS lo, MAX(q) AS hi, list_sort(list(DISTINCT q)) AS e
FROM (SELECT metric, i, MIN(value) AS q FROM {p}_running, range(0, {bins + 1}) r(i) WHERE c * {bins} >= t * i GROUP BY metric, i)
GROUP BY metric""",
        f"{p}_edges": f"""
SELECT metric, CASE
  WHEN n = 1 THEN [lo - GREATEST(1.0, ABS(lo) * 0.1), lo, lo + GREATEST(1.0, ABS(lo) * 0.1)]
  WHEN n = 2 THEN [lo, (lo + hi) / 2.0, hi] ELSE e END AS e
FROM {p}_cuts""",
        f"{p}_bins": f"""
SELECT metric, e[i] AS bin_start, e[i + 1] AS bin_end, i + 1 = len(e) AS last
FROM {p}_edges, range(1, {bins + 2}) r(i) WHERE i < len(e)""",
        f"{p}_dist": f"""
SELECT v.metric, v.session_date, b.bin_start, b.bin_end, COUNT(*) AS count
FROM {p}_values v JOIN {p}_bins b ON v.metric = b.metric AND v.value >= b.bin_start
  AND (v.value < b.bin_end OR (b.last AND v.value <= b.bin_end))
GROUP BY ALL""",
    }


VIEWS: dict[str, str] = {
    "e0": """
SELECT event_id, date_trunc('second', ts) AS event_time,
  CASE event_type WHEN 'click' THEN 'cart' ELSE event_type END AS event_type, user_id, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM events""",
    "e": """
SELECT event_time, event_type, k AS product_id, k // 10 AS category_id,
  CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'cat.' || CAST(k // 10 AS VARCHAR) END AS category_code,
  CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'b' || CAST(k % 7 AS VARCHAR) END AS brand,
  CASE WHEN k % 13 <> 5 THEN ROUND(value * 100) END AS price, user_id,
  CASE WHEN k % 11 <> 3 THEN CAST(user_id AS VARCHAR) || '-' || CAST(CAST(event_time AS DATE) AS VARCHAR) END
    AS user_session,
  CAST(event_time AS DATE) AS event_date, event_id
FROM e0""",
    "raw_e": """
SELECT CASE WHEN event_id % 101 = 0 OR event_id % 103 = 0 THEN NULL ELSE event_time END AS event_time,
  CASE WHEN event_id % 107 <> 0 THEN event_type END AS event_type,
  product_id, category_id, category_code, brand,
  CASE WHEN event_id % 109 = 0 THEN -1.0 ELSE price END AS price,
  CASE WHEN event_id % 127 <> 0 THEN user_id END AS user_id, user_session
FROM e""",
    "raw_ids": """
SELECT event_id, CASE WHEN event_id % 101 = 0 OR event_id % 103 = 0 THEN NULL ELSE event_time END AS event_time,
  CASE WHEN event_id % 107 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 109 = 0 THEN -1.0 ELSE price END AS price,
  CASE WHEN event_id % 127 <> 0 THEN user_id END AS user_id, user_session
FROM e""",
    "clean_e": """
SELECT *, CAST(event_time AS DATE) AS event_date FROM raw_e
WHERE user_id IS NOT NULL AND event_time IS NOT NULL AND event_type IS NOT NULL
  AND (price >= 0 OR price IS NULL)""",
    "er": """
SELECT * FROM e WHERE event_time IS NOT NULL AND user_session IS NOT NULL
  AND event_type IN ('view', 'cart', 'purchase')""",
    "ep": "SELECT * FROM er WHERE event_type = 'purchase'",
    "l": """
SELECT l_shipdate + to_hours(CAST(l_linenumber * 3 + l_orderkey % 3 AS INTEGER)) AS event_time,
  CASE l_returnflag WHEN 'N' THEN 'view' WHEN 'A' THEN 'cart' ELSE 'purchase' END AS event_type,
  l_partkey AS product_id, CAST(p_size AS BIGINT) AS category_id, p_type AS category_code,
  p_brand AS brand, ROUND(l_extendedprice * 100) AS price, o_custkey AS user_id,
  CAST(l_orderkey AS VARCHAR) AS user_session,
  CAST(l_shipdate + to_hours(CAST(l_linenumber * 3 + l_orderkey % 3 AS INTEGER)) AS DATE) AS event_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "lp": "SELECT * FROM l WHERE event_type = 'purchase'",
    "lr": f"SELECT * FROM l WHERE event_date BETWEEN DATE '{v.L_START}' AND DATE '{v.L_END}'",
    "ef": _FEATURES.format(source="e"),
    "lf": _FEATURES.format(source="l"),
    "es": _IN_RANGE.format(features="ef", events="er"),
    "ls": _IN_RANGE.format(features="lf", events="l"),
    "lsr": _IN_RANGE.format(features="lf", events="lr")
    + f" WHERE d.session_date BETWEEN DATE '{v.L_START}' AND DATE '{v.L_END}'",
    "scored": f"""
SELECT user_session, session_date, purchase_in_session AS label,
  FLOOR(1.0 / (1.0 + EXP(-({_MARGIN}))) * {v.SCORE_STEPS}) / {v.SCORE_STEPS} AS pred_prob
FROM es""",
    "funnel": """
SELECT event_date, COUNT(*) FILTER (event_type = 'view') AS views,
  COUNT(*) FILTER (event_type = 'cart') AS carts,
  COUNT(*) FILTER (event_type = 'purchase') AS purchases, COUNT(DISTINCT user_session) AS sessions
FROM er GROUP BY event_date""",
    "hourly": f"SELECT event_date, CAST(hour(event_time) AS INTEGER) AS hour, {_SALES} FROM ep GROUP BY ALL",
    "categories": f"SELECT event_date, {_CATEGORY} AS category, {_SALES} FROM ep GROUP BY ALL",
    "brands": f"SELECT event_date, {_BRAND} AS brand, {_SALES} FROM ep GROUP BY ALL",
    "l_hourly": f"SELECT event_date, CAST(hour(event_time) AS INTEGER) AS hour, {_SALES} FROM lp GROUP BY ALL",
    "l_categories": f"SELECT event_date, {_CATEGORY} AS category, {_SALES} FROM lp GROUP BY ALL",
    "l_brands": f"SELECT event_date, {_BRAND} AS brand, {_SALES} FROM lp GROUP BY ALL",
    "weekdays": """
SELECT session_date, day_of_week, COUNT(*) AS sessions, CAST(SUM(purchase_in_session) AS BIGINT) AS purchases,
  SUM(purchase_in_session) / COUNT(*) AS conversion_rate
FROM es GROUP BY session_date, day_of_week""",
    "daily_scores": """
SELECT session_date AS date, COUNT(*) AS sessions, CAST(SUM(label) AS BIGINT) AS purchases,
  AVG(pred_prob) AS mean_pred_prob, SUM(label) / COUNT(*) AS actual_session_conversion_rate
FROM scored GROUP BY session_date""",
    "curve_edges": "SELECT i, i / 100.0 AS lo, (i + 1) / 100.0 AS hi FROM range(0, 100) r(i)",
    "curve_bins": """
SELECT i, lo, COUNT(*) AS n, SUM(label) AS pos FROM scored JOIN curve_edges
  ON pred_prob >= lo AND (pred_prob < hi OR (i = 99 AND pred_prob <= hi))
GROUP BY i, lo""",
    "from_top": """
SELECT lo, SUM(n) OVER down AS flagged, SUM(pos) OVER down AS tp, SUM(n) OVER () AS t, SUM(pos) OVER () AS p
FROM curve_bins WINDOW down AS (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)""",
    "curve": """
SELECT lo AS threshold, ROUND(tp / flagged, 6) AS precision, ROUND(tp / p, 6) AS recall,
  CASE WHEN tp = 0 THEN 0.0 ELSE ROUND(2 * (tp / flagged) * (tp / p) / (tp / flagged + tp / p), 6) END AS f1,
  ROUND(flagged / t, 6) AS pct_flagged
FROM from_top
UNION ALL SELECT 1.0, 0.0, 0.0, 0.0, 0.0""",
    **_histogram("ed", "es"),
    **_histogram("ld", "ls"),
    **_histogram("fine", "es", 20),
}


def _needed(names: list[str]) -> list[str]:
    """The views and, before each, the views its text mentions."""
    import re

    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for other in VIEWS:
            if other != name and re.search(rf"\b(FROM|JOIN|,)\s*{other}\b", VIEWS[name]):
                visit(other)
        done.append(name)

    for n in names:
        visit(n)
    return done


def with_views(names: list[str], body: str) -> str:
    body = body.strip()
    ctes = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in _needed(names))
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
