"""Scalar expressions. All are built-in, so they stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day-of-week numbering follows Spark's dayofweek().
WEEKDAY_NAMES = {1: "Sun", 2: "Mon", 3: "Tue", 4: "Wed", 5: "Thu", 6: "Fri", 7: "Sat"}
UNKNOWN = "unknown"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """numerator / denominator, 0.0 where the denominator is zero or NULL (ANSI safe)."""
    n, d = _col(numerator), _col(denominator)
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def harmonic_mean(a: Column, b: Column) -> Column:
    return ratio(2 * a * b, a + b)


def event_time(text: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Timestamp of ``text`` with an optional trailing UTC marker; NULL for bad text."""
    bare = F.regexp_replace(F.trim(_col(text)), r"\s+UTC$", "")
    return F.try_to_timestamp(bare, F.lit(pattern))


def or_unknown(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.isNull() | (c == ""), F.lit(UNKNOWN)).otherwise(c)


def category_name(code: Column | str, category_id: Column | str) -> Column:
    """Category code, else the id as text. An empty code is unknown, not the id."""
    return or_unknown(F.coalesce(_col(code), _col(category_id).cast("string")))


def weekday_name(day_of_week: Column | str) -> Column:
    names = F.create_map(*[F.lit(x) for pair in WEEKDAY_NAMES.items() for x in pair])
    return F.try_element_at(names, _col(day_of_week))


def is_event(kind: str) -> Column:
    return F.col("event_type") == kind


def unit_bin(p: Column | str, bins: int) -> Column:
    """Index of the equal-width bin of [0, 1] holding ``p``; NULL for NULL and NaN.

    Bins are [i/bins, (i+1)/bins), the last one closed. The product ``p * bins`` can land
    one bin off for binary fractions, so the guess is corrected against the true edges.
    """
    p = _col(p)
    n = F.lit(float(bins))
    guess = F.floor(p * n)
    exact = (
        guess
        - F.when(p < guess / n, 1).otherwise(0)
        + F.when(p >= (guess + 1) / n, 1).otherwise(0)
    )
    return (
        F.when(p.isNull() | F.isnan(p), F.lit(None).cast("bigint"))
        .when((p < 0) | (p > 1), F.raise_error(F.lit("score outside [0, 1]")).cast("bigint"))
        .otherwise(F.least(exact, F.lit(bins - 1).cast("bigint")))
    )


def unit_edge(index: Column | str, bins: int) -> Column:
    return _col(index) / F.lit(float(bins))


def edge_bin(value: Column | str, edges: Column | str) -> Column:
    """Index of the bin of ``value`` among ascending ``edges``; last bin closed.

    Counts the edges at or below the value, however many there are.
    """
    value, edges = _col(value), _col(edges)
    reached = F.size(F.filter(edges, lambda e: e <= value))
    return F.greatest(F.least(reached, F.size(edges) - 1) - 1, F.lit(0))


def usable_edges(quantiles: Column | str) -> Column:
    """Sorted distinct finite edges, widened where fewer than three are left.

    Fixed values: the least widening 1.0 and its share of a tenth.

    One value v becomes (v-e, v, v+e) with e = max(1, |v|/10); two become low, midpoint,
    high. No finite value at all gives an empty array.
    """
    finite = F.array_sort(
        F.array_distinct(
            F.filter(
                _col(quantiles),
                lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
            )
        )
    )
    low, high = F.get(finite, F.lit(0)), F.get(finite, F.lit(1))
    spread = F.greatest(F.lit(1.0), F.abs(low) * 0.1)
    middle = (low + high) / 2.0
    return (
        F.when(F.size(finite) == 1, F.array(low - spread, low, low + spread))
        .when(
            (F.size(finite) == 2) & ((middle == low) | (middle == high)),
            F.array(low - spread, low, high + spread),
        )
        .when(F.size(finite) == 2, F.array(low, middle, high))
        .otherwise(finite)
    )


def range_label(low: Column | str, high: Column | str, decimals: int) -> Column:
    """'low-high' with fixed decimals, halves rounded to even and no digit grouping."""

    def text(c: Column) -> Column:
        if decimals == 0:
            return F.bround(c, 0).cast("bigint").cast("string")
        return F.bround(c, decimals).cast(f"decimal(38,{decimals})").cast("string")

    return F.concat_ws("-", text(_col(low)), text(_col(high)))


def key_share(keys: Iterable[Column | str], seed: int, slots: int = 1_000_000) -> Column:
    """A value in [0, 1) fixed by the keys and seed, whatever the partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_col(k).cast("string") for k in keys])
    number = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
    return F.pmod(number, F.lit(slots)) / F.lit(float(slots))
