"""Choosing model inputs by name, with label leakage kept out."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default model inputs, in order.
DEFAULT_FEATURES = (
    "total_events",
    "num_views",
    "num_carts",
    "num_purchases",
    "unique_products",
    "unique_categories",
    "session_duration_seconds",
    "avg_price_viewed",
    "max_price_viewed",
    "hour_of_day",
    "day_of_week",
    "is_weekend",
)
LABEL = "purchase_in_session"

# Names that give the label away.
LEAKAGE_COLUMNS = (
    "purchase_in_session",
    "has_purchase",
    "purchase_count",
    "event_purchase_count",
    "event_type_purchase",
)
LEAKAGE_HINTS = (
    "purchase",
    "event_type_purchase",
    "has_purchase",
    "purchase_count",
    "event_purchase_count",
)


class Selection(NamedTuple):
    kept: list[str]
    leaking: list[str]
    missing: list[str]


def select_features(
    df: DataFrame,
    wanted: Iterable[str] = DEFAULT_FEATURES,
    label: str = LABEL,
    denied: Iterable[str] = LEAKAGE_COLUMNS,
) -> Selection:
    """Split wanted columns into usable, label-leaking, and absent from ``df``."""
    wanted, denied = list(wanted), set(denied)
    leaking = [c for c in wanted if c == label or c in denied or "purchase" in c.lower()]
    clean = [c for c in wanted if c not in leaking]
    kept = [c for c in clean if c in df.columns]
    if not kept:
        raise ValueError("no usable feature is left after leakage and availability checks")
    return Selection(kept, leaking, sorted(set(clean) - set(kept)))


def usable_features(
    df: DataFrame, wanted: Iterable[str] = DEFAULT_FEATURES, label: str = LABEL, denied: Iterable[str] = LEAKAGE_COLUMNS
) -> list[str]:
    """The features that can be used, with a warning that names those that are left out and why."""
    chosen = select_features(df, wanted, label, denied)
    for names, reason in ((chosen.leaking, "give the label away"), (chosen.missing, "are not in the table")):
        if names:
            warnings.warn(f"features left out as they {reason}: {', '.join(names)}", stacklevel=2)
    return chosen.kept


def selection_rows(spark: SparkSession, chosen: Selection) -> DataFrame:
    """(feature, status): each wanted feature as kept, leaking or missing."""
    rows = [(name, status) for status, names in zip(Selection._fields, chosen, strict=True) for name in names]
    return spark.createDataFrame(rows, "feature string, status string")


def looks_leaky(name: Column | str, hints: Iterable[str] = LEAKAGE_HINTS) -> Column:
    """True where a column holding feature names contains one of the hints."""
    name = F.lower(F.col(name) if isinstance(name, str) else name)
    found = F.lit(False)
    for hint in hints:
        found = found | name.contains(hint)
    return found


def leakage_audit(records: DataFrame, features: str = "features_used") -> DataFrame:
    """One row per recorded feature name with a leaky flag."""
    return records.select(F.explode(features).alias("feature")).withColumn(
        "leaky", looks_leaky("feature")
    )


def fill_missing(df: DataFrame, features: Iterable[str], label: str = LABEL) -> DataFrame:
    """NULL features become 0 and the label an int."""
    return df.fillna({c: 0 for c in features}).withColumn(label, F.col(label).cast("int"))
