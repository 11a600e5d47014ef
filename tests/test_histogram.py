from __future__ import annotations

import pytest

import datetime as dt

from shop_checks import plan_of, rows
from pyspark.sql import functions as F

from shopflow.operators import histogram as hi
from shopflow.schema import table_schema
from workload import views as v

DIR = "/root/testdata/sf0.001"
D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def sessions(spark, *data):
    return spark.createDataFrame(list(data), "session_date DATE, total_events BIGINT, avg_price_viewed DOUBLE")


def test_degenerate_metrics(spark):
    same = sessions(spark, (D1, 5, None), (D2, 5, None))
    for edges in (hi.exact_edges(same), hi.approx_edges(same)):
        assert rows(hi.session_distributions(same, edges)) == [
            ("total_events", D1, 5.0, 6.0, 1),
            ("total_events", D2, 5.0, 6.0, 1),
        ]
    two = sessions(spark, (D1, 1, 2.0), (D1, 3, 2.0), (D1, 3, None))
    got = rows(hi.session_distributions(two, hi.exact_edges(two)))
    assert got == [
        ("avg_price_viewed", D1, 2.0, 3.0, 2),
        ("total_events", D1, 1.0, 2.0, 1),
        ("total_events", D1, 2.0, 3.0, 2),
    ]


def test_largest_value_lands_in_the_last_bin(spark):
    df = sessions(spark, *[(D1, i, None) for i in range(1, 21)])
    got = rows(hi.session_distributions(df, hi.exact_edges(df)))
    assert sorted(got, key=lambda r: r[2])[-1] == ("total_events", D1, 18.0, 20.0, 3)
    assert sum(r[4] for r in got) == 20


def test_no_rows_and_schema(spark):
    none = sessions(spark)
    table = hi.session_distributions(none, hi.approx_edges(none))
    assert table.isEmpty()
    assert [(f.name, f.dataType) for f in table.schema] == [
        (f.name, f.dataType) for f in table_schema("session_distributions")
    ]


def test_counts_add_up_to_sessions_with_a_value(spark):
    df = v.behaviour_sessions(spark, DIR).cache()
    for edges in (hi.exact_edges(df), hi.approx_edges(df)):
        table = hi.session_distributions(df, edges)
        got = {r.metric: r.n for r in table.groupBy("metric").agg(F.sum("count").alias("n")).collect()}
        want = df.agg(*[F.count(m).alias(m) for m in hi.SESSION_METRICS]).first().asDict()
        assert got == {m: n for m, n in want.items() if n}


def test_approximate_edges_bracket_the_data(spark):
    df = v.behaviour_sessions(spark, DIR).cache()
    for r in hi.approx_edges(df).collect():
        low, high = df.agg(F.min(r.metric), F.max(r.metric)).first()
        assert r.edges == sorted(r.edges)
        assert r.edges[0] <= low and r.edges[-1] >= high
        assert 3 <= len(r.edges) <= 11


def test_one_aggregation_over_fixed_width_buffers(spark):
    df = v.behaviour_sessions(spark, DIR).cache()
    plan = plan_of(hi.session_distributions(df, hi.approx_edges(df)))
    assert "SortAggregate" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("bins", [1, 2, 10, 11, 20, 40])
def test_every_edge_counts(spark, bins):
    df = spark.range(1000).selectExpr("date'2024-01-01' AS session_date", "id AS total_events")
    edges = hi.exact_edges(df, ["total_events"], bins)
    counts = hi.session_distributions(df, edges, ["total_events"]).collect()
    assert sum(r["count"] for r in counts) == 1000
    if bins >= 10:
        assert len(counts) == bins and max(r["count"] for r in counts) <= 1000 // bins + 2
