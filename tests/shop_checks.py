"""What the tests share besides fixtures."""

from __future__ import annotations


def rows(df):
    """Rows as plain tuples, sorted by their text."""
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
