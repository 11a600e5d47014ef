"""Stored state kept up to date, merged, laid out and published."""

from __future__ import annotations

import math
import random
import warnings
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from shop_checks import plan_of, rows

from shopflow.functions.selection import usable_features
from shopflow.operators import histogram, model, rollups
from shopflow.operators.events import reportable_events
from shopflow.operators.ranks import exact_quantiles
from shopflow.operators.sessions import session_days, session_features, sessions_in_range, starts_from_session_days
from shopflow.plans import layout, publish, refresh, stages
from shopflow.plans.export import Report
from shopflow.sources import scratch
from shopflow.sources import writers as wr
from workload import maintenance as m

DIR = "/root/testdata/sf0.001"
relaxed = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def long_events(spark):
    return scratch.stored(m.long_sessions(spark, DIR), "long")


def scans(df):
    return [line for line in plan_of(df).splitlines() if "FileScan parquet" in line]


def test_refresh_touches_only_buckets_of_changed_sessions(spark, long_events, tmp_path):
    events, features = str(tmp_path / "events"), str(tmp_path / "features")
    wr.write_events(long_events, events)
    refresh.write_feature_buckets(session_features(spark.read.parquet(events)), features, buckets=64)
    files = {p: p.stat().st_mtime_ns for p in Path(features).rglob("*.parquet")}
    one = long_events.filter("event_date = '2024-01-10' AND user_session IS NOT NULL").select("user_session").first()[0]
    day = long_events.filter("event_date = '2024-01-10'")
    changed = day.withColumn("price", F.when(F.col("user_session") == one, F.col("price") + 1).otherwise(F.col("price")))
    touched = refresh.reload_events(spark, changed, events, features, "2024-01-10", "2024-01-10", buckets=64)
    hit = {r[0] for r in touched.select(refresh.bucket_of(buckets=64)).collect()}
    again = {p: p.stat().st_mtime_ns for p in Path(features).rglob("*.parquet")}
    kept = {p for p in files if again.get(p) == files[p]}
    assert 0 < len(hit) < 64
    assert {int(p.parent.name.split("=")[1]) for p in files if p not in kept} <= hit
    assert {int(p.parent.name.split("=")[1]) for p in kept}.isdisjoint(hit)
    fresh = session_features(spark.read.parquet(events))
    assert rows(refresh.read_feature_buckets(spark, features)) == rows(fresh)
    few = refresh.read_feature_buckets(spark, features, [3, 5])
    assert "PartitionFilters: [isnotnull(session_bucket" in scans(few)[0] or "session_bucket#" in scans(few)[0].split("PartitionFilters: [")[1].split("]")[0]


def test_refresh_drops_sessions_that_lost_all_events(spark, tmp_path):
    cells = [("s1", "2024-01-01", 1), ("s1", "2024-01-02", 1), ("s2", "2024-01-02", 2), ("s3", "2024-01-03", 3)]
    make = lambda some: spark.createDataFrame(some, "user_session string, d string, user_id bigint").selectExpr(
        "CAST(d AS timestamp) AS event_time", "'view' AS event_type", "1L AS product_id", "1L AS category_id",
        "CAST(1 AS double) AS price", "user_id", "user_session", "CAST(d AS date) AS event_date",
    )
    events, features = str(tmp_path / "events"), str(tmp_path / "features")
    wr.write_events(make(cells), events)
    refresh.write_feature_buckets(session_features(spark.read.parquet(events)), features)
    refresh.reload_events(spark, make([("s1", "2024-01-02", 1)] * 3 + [("s4", "2024-01-02", 4)]), events, features, "2024-01-02", "2024-01-02")
    got = {r.user_session: r.total_events for r in refresh.read_feature_buckets(spark, features).collect()}
    assert got == {"s1": 4, "s3": 1, "s4": 1}


def test_buckets_of_sessions_join_without_exchange(spark, long_events, tmp_path):
    sides = session_features(long_events), session_days(reportable_events(long_events))
    features, days = layout.bucketed_sides(*sides, ("t_features", "t_days"), str(tmp_path), buckets=4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = sessions_in_range(features, starts_from_session_days(days), "2024-01-05", "2024-01-20")
        plan = plan_of(joined)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_week_reads_only_its_partitions(spark, long_events, tmp_path):
    features, days = str(tmp_path / "features"), str(tmp_path / "days")
    layout.write_features_by_day(session_features(long_events), features)
    layout.write_session_days(session_days(reportable_events(long_events)), days, session_features(long_events))
    week = layout.features_of_days(spark, features, days, "2024-01-10", "2024-01-16")
    got = week.collect()
    plan = plan_of(week)
    assert any("dynamicpruning" in line and "session_date" in line for line in plan.splitlines() if "FileScan" in line)
    starts = starts_from_session_days(session_days(reportable_events(long_events, "2024-01-10", "2024-01-16")))
    want = sessions_in_range(session_features(long_events), starts).select(*week.columns)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want.collect())))
    began = {r.user_session for r in session_features(long_events).filter("session_date < '2024-01-10'").select("user_session").collect()}
    assert began & {r.user_session for r in got}  # sessions from before the week


@relaxed
@given(
    st.lists(st.tuples(st.sampled_from("ab"), st.floats(-1e9, 1e9) | st.integers(-3, 3).map(float)), min_size=1, max_size=60),
    st.sampled_from([1, 4, 10]),
    st.sampled_from([1, 16384]),
)
def test_selected_quantiles_agree_with_sorting(spark, pairs, steps, buckets):
    df = spark.createDataFrame(pairs, "k string, v double")
    got = {r.k: list(r.quantiles) for r in exact_quantiles(df, "k", "v", steps, buckets=buckets).collect()}
    for k in {k for k, _ in pairs}:
        ordered = sorted(x for key, x in pairs if key == k)
        assert got[k] == [ordered[max(math.ceil(i * len(ordered) / steps), 1) - 1] for i in range(steps + 1)]


def test_selected_quantiles_of_odd_values(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, -0.0, 1e308, -1e308, 5e-324, math.inf, -math.inf, None)], "k string, v double")
    got = exact_quantiles(df, "k", "v", 6).first().quantiles
    assert list(got) == [-math.inf, -1e308, 0.0, 0.0, 5e-324, 1e308, math.inf]  # ranks 1, 2, 3, 4, 5, 6, 7 of 7
    assert exact_quantiles(df.limit(0), "k", "v", 6).isEmpty()
    assert "Window" not in plan_of(exact_quantiles(df, "k", "v", 6))


def test_sketches_of_days_merge_within_their_error(spark):
    rnd = random.Random(3)
    cells = [(f"2024-01-{1 + i % 9:02d}", rnd.choice([1.0, rnd.lognormvariate(3, 2)])) for i in range(20000)]
    sessions = spark.createDataFrame([*cells, ("2024-01-01", math.nan), ("2024-01-02", None)], "d string, num_views double")
    sketches = histogram.daily_sketches(sessions.withColumn("session_date", F.to_date("d")), ["num_views"])
    assert sketches.count() == 9
    for start, end in ((1, 9), (2, 4), (5, 5)):
        ordered = sorted(x for d, x in cells if start <= int(d[-2:]) <= end)
        got = histogram.merged_quantiles(sketches, f"2024-01-0{start}", f"2024-01-0{end}").first().quantiles
        for i, q in enumerate(got):
            below, to = sum(x < q for x in ordered), sum(x <= q for x in ordered)
            room = histogram.SKETCH_ERROR * len(ordered)
            assert below - room <= i / 10 * len(ordered) <= to + room
    assert histogram.sketched_edges(sketches, "2025-01-01").isEmpty()


def test_moments_of_days_give_the_correlations_of_any_range(spark):
    rnd = random.Random(4)
    cells = [(f"2024-01-{1 + i % 5:02d}", 1e9 + rnd.random(), float(i % 7 == 0), 3.0, i % 2) for i in range(600)]
    df = spark.createDataFrame(cells, "d string, big double, rare double, same double, purchase_in_session int")
    df = df.withColumn("session_date", F.to_date("d"))
    moments = model.daily_moments(df, ["big", "rare", "same"])
    for days in ((None, None), ("2024-01-02", "2024-01-03")):
        part = df if days[0] is None else df.filter(F.col("session_date").between(*days))
        want = {r.feature: r.weight for r in model.correlation_rows(part, ["big", "rare", "same"]).collect()}
        got = model.merged_moments(moments if days[0] is None else moments.filter(F.col("session_date").between(*days)))
        for r in got.collect():
            weight = r.xy / math.sqrt(r.xx * r.yy) if r.xx * r.yy > 0 else 0.0
            assert abs(weight - want[r.feature]) < 1e-4
        drivers = model.drivers_from_moments(moments, *days)
        assert drivers.filter("feature = 'same'").first().weight == 0.0
    assert "features" not in plan_of(model.drivers_from_moments(moments.limit(0)))


def test_users_by_bitmaps(spark):
    cells = [("2024-01-01", 1), ("2024-01-01", 1), ("2024-01-01", 40000), ("2024-01-02", 1), ("2024-01-03", -5), ("2024-01-03", None), (None, 7)]
    events = spark.createDataFrame(cells, "d string, user_id bigint").withColumn("event_date", F.to_date("d"))
    bitmaps = rollups.daily_user_bitmaps(events)
    count = lambda *days: rollups.users_of_range(bitmaps, *days).first()[0]
    assert [count(), count("2024-01-01", "2024-01-02"), count("2024-01-02", "2024-01-03"), count("2025-01-01")] == [3, 2, 2, 0]


def test_page_totals_read_the_cube_once(spark, long_events, tmp_path):
    cube = rollups.commerce_cube(long_events.filter("event_type = 'purchase'"))
    cube.write.parquet(str(tmp_path / "cube"))
    totals = rollups.page_totals(spark.read.parquet(str(tmp_path / "cube")))
    assert len(scans(totals)) == 1
    sums = {r.level: r.n for r in totals.groupBy("level").agg(F.sum("purchase_count").alias("n")).collect()}
    assert set(sums) == {"hour", "category", "brand", "weekday", "all"} and len(set(sums.values())) == 1


def test_a_failed_version_leaves_readers_on_the_old_one(spark, tmp_path):
    root = str(tmp_path / "site")
    with pytest.raises(FileNotFoundError, match="published"):
        publish.current_version(spark, root)
    one, two = spark.range(3), spark.range(5)
    publish.publish(spark, Report({"t": one}, {"r": one.agg(F.sum("id").alias("s"))}), root)
    lost = spark.range(1).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish.publish(spark, Report({"t": two, "u": lost}, {}), root)
    reader = publish.read_published(spark, root, "t")
    assert reader.count() == 3 and publish.read_published_record(spark, root, "r").first().s == 3
    publish.publish(spark, Report({"t": two}, {}), root)
    assert publish.read_published(spark, root, "t").count() == 5
    assert reader.count() == 3
    publish.publish(spark, Report({"t": two}, {}), root)
    assert len(publish.drop_old_versions(spark, root, keep=2)) == 1
    assert publish.read_published(spark, root, "t").count() == 5


def test_ingest_counts_lines_in_one_parse(spark, tmp_path):
    good = "2024-01-0{} 10:00:00 UTC,view,1,2,c,b,5.0,9,s1"
    lines = [good.format(1 + i % 3) for i in range(60)] + ["2024-01-01 10:00:00 UTC,view,one,2,c,b,5.0,9,s1"] * 7
    lines += ["not a time,view,1,2,c,b,5.0,9,s1"] * 2 + ["2024-01-01"] * 4
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    for cluster in (True, False):
        out = str(tmp_path / f"events{cluster}")
        got = stages.ingest(spark, str(tmp_path / "in.csv"), out, cluster=cluster, record_path=f"{out}-record", header=False).first()
        assert (got.input_rows, got.malformed_rows, got.output_rows) == (62, 11, 60)
        assert spark.read.json(f"{out}-record").first().malformed_rows == 11
    table = spark.createDataFrame([(float(i), i % 2, "2024-01-01") for i in range(20)], "num_views double, purchase_in_session int, session_date string")
    assert model.score(model.fit(table, ["num_views"]), table).count() == 20


def test_scratch_tables_go_with_their_block(spark):
    with scratch.emptied(spark):
        inner = scratch.stored(spark.range(3), "x")
        path = Path(inner.inputFiles()[0].removeprefix("file://")).parent
        assert inner.count() == 3 and path.exists()
    assert not path.exists()
    with pytest.raises(ZeroDivisionError), scratch.emptied(spark):
        inner = scratch.stored(spark.range(3), "x")
        path = Path(inner.inputFiles()[0].removeprefix("file://")).parent
        raise ZeroDivisionError
    assert not path.exists()
    kept = scratch.stored(spark.range(3), "x")
    assert kept.count() == 3


def test_features_left_out_are_named(spark):
    df = spark.createDataFrame([(1, 2)], "num_views int, num_purchases int")
    with pytest.warns(UserWarning) as seen:
        assert usable_features(df, ["num_views", "num_purchases", "num_vews"]) == ["num_views"]
    assert "num_purchases" in str(seen[0].message) and "num_vews" in str(seen[1].message)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert usable_features(df, ["num_views"]) == ["num_views"]


def test_days_are_not_written_without_adaptive_execution(spark, long_events, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with pytest.raises(ValueError, match="adaptive"):
            wr.write_events(long_events, str(tmp_path / "x"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
