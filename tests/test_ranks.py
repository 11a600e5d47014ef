from __future__ import annotations

import math

from shop_checks import plan_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopflow.operators.ranks import exact_quantiles, running_totals

relaxed = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@relaxed
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=80), st.sampled_from([2, 7, 64]))
def test_running_totals_agree_with_a_loop(spark, items, buckets):
    weights = {}
    for x in items:
        weights[float(x)] = weights.get(float(x), 0) + 1
    df = spark.createDataFrame(list(weights.items()), "v DOUBLE, n BIGINT")
    got = {r.v: (r.n_before, r.n_total) for r in running_totals(df, "v", ["n"], buckets=buckets).collect()}
    before, want = 0, {}
    for x in sorted(weights):
        want[x] = (before, len(items))
        before += weights[x]
    assert got == want


@relaxed
@given(
    st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40)), min_size=1, max_size=80),
    st.sampled_from([3, 10]),
)
def test_exact_quantiles_agree_with_sorting(spark, pairs, steps):
    df = spark.createDataFrame([(k, float(x)) for k, x in pairs], "k STRING, v DOUBLE")
    got = {r.k: list(r.quantiles) for r in exact_quantiles(df, "k", "v", steps, buckets=4).collect()}
    want = {}
    for k in {k for k, _ in pairs}:
        ordered = sorted(float(x) for key, x in pairs if key == k)
        n = len(ordered)
        want[k] = [ordered[max(math.ceil(i * n / steps), 1) - 1] for i in range(steps + 1)]
    assert got == want


def test_quantiles_with_a_value_on_a_third_of_all_rows(spark):
    df = spark.range(30_000).select(
        F.lit("m").alias("k"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v")
    )
    ordered = sorted(7.0 if i % 3 == 0 else float(i) for i in range(30_000))
    got = exact_quantiles(df, "k", "v", 10).first().quantiles
    assert list(got) == [ordered[max(i * 3000, 1) - 1] for i in range(11)]


def test_no_window_over_all_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    plan = plan_of(running_totals(df, "v", ["n"]))
    windows = [line for line in plan.splitlines() if "windowspecdefinition(" in line]
    assert windows and all("windowspecdefinition(bucket" in w or "_offset" in w or "_total" in w for w in windows)
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_rows(spark):
    df = spark.createDataFrame([], "v DOUBLE, n BIGINT")
    assert running_totals(df, "v", ["n"]).count() == 0
