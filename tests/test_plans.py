from __future__ import annotations

import json
from pathlib import Path

import pytest
from shop_checks import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from shopflow.operators.rollups import funnel_daily
from shopflow.operators.events import reportable_events
from shopflow.plans import export, propensity, stages
from shopflow.schema import TABLES
from shopflow.sources import writers as wr
from workload import views as v

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """All stages, one after the other, from raw CSV to the exported report."""
    root = tmp_path_factory.mktemp("run")
    at = {n: str(root / n) for n in ("raw", "events", "features", "train", "test", "model", "metrics", "report")}
    v.raw_behaviour(spark, DIR).write.option("header", True).csv(at["raw"])
    out = {"summary": stages.ingest(spark, at["raw"], at["events"]).first()}
    out["features"] = stages.build_features(spark, at["events"], at["features"]).first()
    propensity.train(spark, at["features"], at["train"], at["test"], at["model"])
    record = propensity.evaluate(spark, at["train"], at["test"], at["model"])
    wr.write_record(record, at["metrics"])
    out["record"] = record.first()
    out["report"] = export.export_report(
        spark, at["events"], at["features"], at["metrics"], at["model"], at["report"]
    )
    return at, out


def test_ingest_summary(spark, run):
    at, out = run
    assert out["summary"].input_rows == 1000
    assert out["summary"].output_rows == spark.read.parquet(at["events"]).count() < 1000
    with pytest.raises(AnalysisException):
        stages.ingest(spark, at["raw"], at["events"])


def test_features_summary(spark, run):
    at, out = run
    features = spark.read.parquet(at["features"])
    assert out["features"].row_count == features.count()
    assert 0 < out["features"].positive_rate < 1


def test_split_sets_are_disjoint_and_whole(spark, run):
    at, _ = run
    train, test = spark.read.parquet(at["train"]), spark.read.parquet(at["test"])
    assert train.count() + test.count() == spark.read.parquet(at["features"]).count()
    assert train.agg(F.max("session_date")).first()[0] < test.agg(F.min("session_date")).first()[0]
    assert "num_purchases" not in train.columns


def test_evaluation_record(spark, run):
    at, out = run
    record = out["record"]
    cells = record.confusion_matrix
    assert record.split_method == "time-based" and record.evaluation_set == "test"
    assert cells.tn + cells.fp + cells.fn + cells.tp == spark.read.parquet(at["test"]).count()
    assert len(record.features_used) == 11 and "num_purchases" not in record.features_used
    assert 0 < record.auc <= 1


def test_report_files(spark, run):
    at, out = run
    for name in TABLES:
        if name != "session_features":
            table = spark.read.parquet(f"{at['report']}/{name}")
            assert not table.isEmpty(), name
            assert sorted(table.columns) == sorted(c.split(" ")[0] for c in TABLES[name].split(", "))
    for name in ("kpis", "propensity_kpis", "propensity_drivers", "model_metrics"):
        line = next(Path(f"{at['report']}/{name}").glob("*.json")).read_text().splitlines()[0]
        assert json.loads(line)
    metrics = next(Path(f"{at['report']}/model_metrics").glob("*.json")).read_text()
    assert json.loads(metrics)["suspiciously_perfect_metrics"] in (0.0, 1.0)


def test_report_equals_the_direct_operators(spark, run):
    at, out = run
    events = reportable_events(spark.read.parquet(at["events"]))
    assert rows(spark.read.parquet(f"{at['report']}/funnel_daily")) == rows(funnel_daily(events))
    kpis = spark.read.json(f"{at['report']}/kpis").first()
    assert kpis.total_events == events.count()


def test_report_of_some_days(spark, run):
    at, _ = run
    events, features = spark.read.parquet(at["events"]), spark.read.parquet(at["features"])
    report = export.build_report(spark, events, features, None, "2024-01-10", "2024-01-12")
    days = {r[0] for r in report.tables["funnel_daily"].select(F.day("event_date")).collect()}
    assert days == {10, 11, 12}
    assert report.tables["propensity_daily"].isEmpty()
    assert report.records["propensity_kpis"].first().available is False
    assert report.records["propensity_drivers"].first().source == "feature_correlation"


def test_inputs_are_checked_before_anything_is_written(spark, run, tmp_path):
    at, _ = run
    out = str(tmp_path / "never")
    with pytest.raises(ValueError, match="after"):
        export.export_report(spark, at["events"], at["features"], at["metrics"], at["model"], out, start="2024-02-01", end="2024-01-01")
    with pytest.raises(FileNotFoundError):
        export.export_report(spark, at["events"], out, at["metrics"], at["model"], out)
    assert not Path(out).exists()
    before = {p: p.stat().st_mtime_ns for p in Path(at["report"]).rglob("*") if p.is_file()}
    with pytest.raises(FileExistsError, match="funnel_daily"):
        export.export_report(spark, at["events"], at["features"], at["metrics"], at["model"], at["report"])
    assert before == {p: p.stat().st_mtime_ns for p in Path(at["report"]).rglob("*") if p.is_file()}


def test_random_method(spark, run, tmp_path):
    at, _ = run
    paths = [str(tmp_path / n) for n in ("train", "test", "model")]
    propensity.train(spark, at["features"], *paths, method="random")
    record = propensity.evaluate(spark, *paths, method="random").first()
    assert record.split_method == "random"
    total = spark.read.parquet(paths[0]).count() + spark.read.parquet(paths[1]).count()
    assert total == spark.read.parquet(at["features"]).count()
