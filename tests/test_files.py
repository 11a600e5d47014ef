from __future__ import annotations

import json
from pathlib import Path

import pytest
from shop_checks import rows
from pyspark.errors import AnalysisException

from shopflow.operators.events import clean_events, ingest_summary
from shopflow.schema import RAW_COLUMNS, TABLES, empty_table, table_schema
from shopflow.sources import readers as rd
from shopflow.sources import scratch
from shopflow.sources import writers as wr

HEADER = ",".join(RAW_COLUMNS)
GOOD = "2019-10-01 00:00:00 UTC,view,1,2,a.b,x,5.5,9,s1"


def csv(folder: Path, name: str, *lines: str) -> None:
    (folder / name).write_text("\n".join([HEADER, *lines]) + "\n")


def test_malformed_lines_are_dropped_for_every_projection(spark, tmp_path):
    csv(tmp_path, "2019-Oct.csv", GOOD, GOOD.replace(",1,2,", ",one,2,"), "2019-10-01 00:00:00 UTC,view", GOOD)
    raw = rd.read_raw_events(spark, str(tmp_path))
    assert raw.columns == RAW_COLUMNS
    assert raw.count() == 2
    assert len(raw.select("brand").collect()) == 2
    assert ingest_summary(raw).first().input_rows == 2


def test_month_files(spark, tmp_path):
    csv(tmp_path, "2019-Oct.csv", GOOD)
    csv(tmp_path, "2019-Nov.csv", GOOD, GOOD)
    csv(tmp_path, "2019-Dec.csv", GOOD, GOOD, GOOD)
    folder = str(tmp_path)
    assert rd.read_months(spark, folder, ["2019-Oct", "2019-Nov"]).count() == 3
    mixed = ["2019-Oct", "2018-Jan"]
    with pytest.raises(FileNotFoundError, match="2018-Jan"):
        rd.read_months(spark, folder, mixed)
    assert rd.absent_months(spark, folder, mixed) == ["2018-Jan"]
    assert rd.read_months(spark, folder, mixed, allow_missing=True).count() == 1
    assert rd.read_months(spark, folder, ["2019-Dec"]).count() == 3
    with pytest.raises(FileNotFoundError, match="2018-Jan"):
        rd.read_months(spark, folder, ["2018-Jan"])
    with pytest.raises(ValueError):
        rd.read_months(spark, folder, [])


def test_manifest(spark, tmp_path):
    csv(tmp_path, "a.csv", GOOD)
    (tmp_path / "big.csv").write_bytes(b"x" * 2 * 1024 * 1024)
    (tmp_path / "folder").mkdir()
    for part in "12":
        (tmp_path / "folder" / part).write_bytes(b"x" * 600 * 1024)
    expected = spark.createDataFrame([("a.csv",), ("big.csv",), ("folder",), ("c.csv",)], "name STRING")
    got = {r.name: (r.size_bytes, r.status) for r in rd.file_manifest(spark, str(tmp_path), expected, 1.0).collect()}
    assert got["big.csv"] == (2 * 1024 * 1024, "ok")
    assert got["folder"] == (1200 * 1024, "ok")
    assert got["a.csv"][1] == "too small"
    assert got["c.csv"] == (None, "missing")
    nowhere = rd.file_manifest(spark, str(tmp_path / "none"), expected)
    assert {r.status for r in nowhere.collect()} == {"missing"}


def events(spark, tmp_path, *days):
    csv(tmp_path, "in.csv", *[GOOD.replace("2019-10-01", d) for d in days])
    return clean_events(rd.read_raw_events(spark, str(tmp_path / "in.csv")))


def test_partitioned_write_and_reload(spark, tmp_path):
    source = events(spark, tmp_path, "2019-10-01", "2019-10-02", "2019-10-02", "2019-10-03")
    out = str(tmp_path / "events")
    wr.write_events(source, out)
    assert sorted(p.name for p in Path(out).glob("event_date=*")) == [f"event_date=2019-10-0{d}" for d in (1, 2, 3)]
    with pytest.raises(AnalysisException):
        wr.write_events(source, out)
    wr.write_events(source, out, overwrite=True)
    wr.reload_days(source.withColumn("brand", source.user_session), out, "2019-10-02", "2019-10-02")
    stored = spark.read.parquet(out)
    assert rows(stored.groupBy("event_date", "brand").count().selectExpr("day(event_date)", "brand", "count")) == [
        (1, "x", 1),
        (2, "s1", 2),
        (3, "x", 1),
    ]
    wr.write_events(source, out, mode="append")
    assert spark.read.parquet(out).count() == 8


def test_hot_day_is_written_by_several_tasks(spark, tmp_path):
    """A day with most of the rows is split by measured size; small days are not."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        log = spark.range(200_000, numPartitions=16).selectExpr(
            "CASE WHEN id % 10 < 8 THEN date'2024-01-01' ELSE date_add(date'2024-01-02', cast(id % 3 as int)) END AS event_date",
            "uuid() AS user_session",
        )
        out = str(tmp_path / "hot")
        wr.write_events(log, out)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {d.name: len(list(d.glob("*.parquet"))) for d in Path(out).glob("event_date=*")}
    assert files["event_date=2024-01-01"] >= 8
    assert spark.read.parquet(out).count() == 200_000


def test_ordered_input_needs_no_shuffle(spark, tmp_path):
    log = spark.range(400, numPartitions=4).selectExpr("date_add(date'2024-01-01', cast(id div 100 as int)) AS event_date", "id")
    out = str(tmp_path / "ordered")
    wr.write_events(log, out, cluster=False)
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in Path(out).glob("event_date=*"))
    assert spark.read.parquet(out).count() == 400


def test_guards_and_optional_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="run it"):
        rd.require_rows(spark, str(tmp_path / "none"), "run it")
    empty = str(tmp_path / "empty")
    empty_table(spark, "funnel_daily").write.parquet(empty)
    with pytest.raises(ValueError, match="run it"):
        rd.require_rows(spark, empty, "run it")
    got = rd.read_optional(spark, str(tmp_path / "none"), "top_brands")
    assert got.isEmpty() and got.schema == table_schema("top_brands")
    assert all(empty_table(spark, name).isEmpty() for name in TABLES)


def test_records(spark, tmp_path):
    record = spark.createDataFrame(
        [(1, True, "0.5", "text", None, (3, 4))],
        "n BIGINT, flag BOOLEAN, half STRING, name STRING, nothing DOUBLE, m STRUCT<a: BIGINT, b: BIGINT>",
    )
    path = str(tmp_path / "record")
    wr.write_record(record, path)
    text = json.loads(next(Path(path).glob("*.json")).read_text())
    assert text == {"n": 1, "flag": True, "half": "0.5", "name": "text", "nothing": None, "m": {"a": 3, "b": 4}}
    back = rd.read_record(spark, path).first()
    assert (back.n, back.flag, back.half, back.name) == (1.0, 1.0, 0.5, "text")
    assert tuple(back.m) == (3, 4)
    (tmp_path / "indented.json").write_text(json.dumps(text, indent=2))
    assert rd.read_record(spark, str(tmp_path / "indented.json")).first().n == 1.0
    csv_path = str(tmp_path / "csv")
    wr.write_metric_csv(record.drop("nothing"), csv_path)
    lines = next(Path(csv_path).glob("*.csv")).read_text().splitlines()
    assert lines[0] == "metric,value" and "flag,true" in lines and len(lines) == 6


def test_small_table_is_one_file(spark, tmp_path):
    df = spark.range(1000, numPartitions=8).groupBy("id").count()
    out = str(tmp_path / "small")
    wr.write_table(df, out)
    assert len(list(Path(out).glob("*.parquet"))) == 1
    wr.write_table(df.limit(3), out)
    assert spark.read.parquet(out).count() == 3


def test_bucketed_features_join_without_their_shuffle(spark):
    df = spark.range(1000).selectExpr("cast(id as string) AS user_session", "id AS x")
    wr.write_bucketed(df, "bucketed_features", 4)
    other = df.selectExpr("user_session", "x + 1 AS y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_features").join(other, "user_session")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_features")


def test_scratch_follows_the_setting(spark, monkeypatch):
    assert scratch.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch.scratch_path(spark, "x") != scratch.scratch_path(spark, "x")
    kept = scratch.stored(spark.range(10).toDF("n"), "n")
    assert kept.count() == 10 and kept.columns == ["n"]
