"""Literal frames for what the derived tables do not hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline import catalog
from ledgerline.functions.geo import haversine_km
from ledgerline.operators import checks, evaluation, gate_log, incremental, silver
from ledgerline.plans import audits
from ledgerline.sources import events, tables
from ledgerline.streaming.ingest import load_new_files
from ledgerline.streaming.transform import transform_new_rows

DATA = "/root/testdata/sf0.001"
ROW = "k string, v int, _ingested_at string, _source_file string"


def test_upsert_replaces_and_keeps_the_last_of_a_batch(spark):
    target = spark.createDataFrame([("a", 1, "1", "f"), ("b", 1, "1", "f")], ROW)
    batch = spark.createDataFrame([("b", 2, "2", "f"), ("b", 3, "3", "f"), ("b", 4, "3", "e"), ("c", 5, "2", "f"), (None, 6, "2", "f"), (None, 7, "2", "f")], ROW)
    out = incremental.upsert(target, batch, "k").collect()
    assert sorted(((r.k, r.v) for r in out), key=str) == sorted([("a", 1), ("b", 3), ("c", 5), (None, 6), (None, 7)], key=str)
    assert sorted(r.v for r in incremental.upsert(target, batch.where("k = 'b'"), "k", keep=("v",)).collect()) == [1, 1]
    with pytest.raises(ValueError):
        incremental.upsert(target, batch.withColumn("v", F.col("v").cast("long")), "k")


def test_snapshot_closes_opens_and_leaves(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, name string, other int")
    one = incremental.snapshot(None, frame([("a", "x", 1), ("b", None, 1), ("c", "z", 1)]), "k", ("name",), "2024-01-01")
    two = incremental.snapshot(one, frame([("a", "y", 1), ("b", None, 2), ("d", "w", 1)]), "k", ("name",), "2024-02-01")
    assert sorted((r.k, r.name or "", r.other, r.valid_to is None) for r in two.collect()) == [("a", "x", 1, False), ("a", "y", 1, True), ("b", "", 1, True), ("c", "z", 1, True), ("d", "w", 1, True)]
    assert incremental.snapshot(two, frame([("a", "y", 1)]), "k", ("name",), "2024-03-01").count() == two.count()


def test_large_amounts_are_quarantined(spark):
    bad = "transaction_id string, card_id string, amount double, currency string, event_time string, event_type string"
    rows = spark.createDataFrame([("t", "c", 1e12, "SGD", "2024-01-01T00:00:00", "AUTH"), ("t", "c", 1.0, "SGD", "2024-01-01T00:00:00", "AUTH")], bad)
    assert [r.r for r in rows.select(silver.reasons().alias("r")).collect()] == [["AMOUNT_OVERFLOW"], []]


def test_antipodes_have_a_distance(spark):
    points = spark.createDataFrame([(lat / 7, lon / 3) for lat in range(-600, 600, 37) for lon in range(-500, 500, 41)], "a double, o double")
    out = points.select(haversine_km(F.col("a"), F.col("o"), -F.col("a"), F.col("o") + 180).alias("d")).collect()
    assert all(r.d == pytest.approx(math.pi * 6371, abs=1) for r in out)


def test_data_tests_fail_on_what_they_look_for(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 3, "y"), (None, 4, "q")], "k string, n int, v string")
    out = checks.run_suite({
        "unique": ("error", checks.unique(rows, "k")), "not_null": ("error", checks.not_null(rows, "k")), "accepted": ("warn", checks.accepted_values(rows, "v", ("x", "y"))),
        "relationships": ("warn", checks.relationships(rows, "v", rows.where("n = 1"), "v")), "rule": ("error", checks.fails(rows, F.col("v") != "x")), "disjoint": ("error", checks.disjoint(rows.where("n = 1"), rows.where("n = 2"), "k")),
    })
    assert {r.test: (r.severity, r.failures, r.passed) for r in out.collect()} == {
        "unique": ("error", 1, False), "not_null": ("error", 2, False), "accepted": ("warn", 1, False), "relationships": ("warn", 2, False), "rule": ("error", 2, False), "disjoint": ("error", 1, False),
    }


def test_gate_log(spark):
    assert gate_log.read_or_empty(spark, "no_such_log").count() == 0
    verdict = spark.createDataFrame([("a", float("nan"), True, False), ("b", 2.0, False, False)], "expectation string, observed double, passed boolean, overall_success boolean")
    gate_log.append_verdict(verdict, "gate_log", "2024-01-01 00:00:00")
    gate_log.append_verdict(verdict.where("passed").withColumn("overall_success", F.lit(True)), "gate_log", "2024-01-02 00:00:00")
    log = gate_log.read_or_empty(spark, "gate_log")
    assert [(str(r.checked_at)[:10], r.success, r.failed) for r in gate_log.history(log).collect()] == [("2024-01-02", True, 0), ("2024-01-01", False, 1)]
    assert [(r.expectation, r.observed) for r in gate_log.latest(log).collect()] == [("a", None)]
    built = []
    assert not gate_log.gated(verdict, lambda: built.append(1)) and gate_log.gated(verdict.where("passed"), lambda: built.append(2)) and built == [2]


def test_forest_finds_outliers(spark):
    rng = np.random.default_rng(1)
    rows = [(f"t{i}", *(float(v) for v in rng.normal(0 if i % 100 else 9, 1, 9)), *[True] * 5) for i in range(1500)]
    schema = "transaction_id string, " + ", ".join(f"{c} double" for c in evaluation.NUMERIC) + ", " + ", ".join(f"{c} boolean" for c in evaluation.BOOLEAN)
    df = spark.createDataFrame(rows, schema)
    nodes = evaluation.fit(df, trees=30)
    out = evaluation.score(df, nodes).withColumn("odd", F.substring("transaction_id", 2, 9).cast("int") % 100 == 0).cache()
    assert nodes.select("tree").distinct().count() == 30
    worst = {r.odd for r in out.orderBy(F.desc("anomaly_score")).limit(15).collect()}
    assert worst == {True} and out.where("anomaly_score < 0 or anomaly_score > 1").count() == 0
    cut = evaluation.cutoff(out, 0.01)
    assert out.where(F.col("anomaly_score") >= cut).count() == pytest.approx(15, abs=1)
    with pytest.raises(ValueError):
        evaluation.vector(df.drop("amount"))


def test_model_queries(spark):
    scores = catalog.QUERIES["anomaly_scores"](spark, DATA)
    assert scores.where("anomaly_score is null").count() == 0 and scores.count() == catalog.QUERIES["velocity_features"](spark, DATA).count()
    out = {r.strategy: r for r in catalog.QUERIES["threshold_sweep"](spark, DATA).collect()}
    assert len(out) == 7 and all(r.tp + r.fn == out["share_10_per_mille"].tp + out["share_10_per_mille"].fn for r in out.values())
    both = {r.strategy: r for r in catalog.QUERIES["hybrid_confusion"](spark, DATA).collect()}
    assert both["combined_flag"].recall >= max(both["any_rule"].recall, both["model_flag"].recall)


def test_intervals_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:59:59"), ("b", "2024-01-01 01:00:00"), ("c", "2024-01-01 01:30:00"), ("d", "2024-01-01 02:00:00")], "id string, event_time string").withColumn("timestamp", F.col("event_time").cast("timestamp"))
    part = tables.between(rows, "2024-01-01 01:00:00", "2024-01-01 02:00:00")
    path = str(tmp_path / "batches")
    assert not tables.write_interval(part.where("false"), path, "01") and not (tmp_path / "batches").exists()
    assert tables.write_interval(rows.where("id = 'a'"), path, "00")
    assert tables.write_interval(part, path, "01") and tables.write_interval(part, path, "01")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_tables_are_refreshed(spark):
    df = spark.range(3)
    assert tables.materialise(spark, {"refreshed": df})["refreshed"].count() == 3
    assert tables.overwrite_table(df.where("id > 0"), "refreshed").count() == 2
    assert tables.view(df, "seen").count() == 3


def test_stream_loads_files_once_and_transforms_them(spark, tmp_path):
    bronze = events.bronze(spark, DATA).drop("_ingested_at", "_source_file").cache()
    source, loaded, out = (str(tmp_path / d) for d in ("in", "bronze", "silver"))
    bronze.where("event_type = 'AUTH'").write.parquet(source)
    for _ in range(2):
        load_new_files(spark, source, loaded, str(tmp_path / "ledger"))
    rows = events.read_events(spark, loaded)
    assert rows.count() == bronze.where("event_type = 'AUTH'").count()
    stream = lambda: spark.readStream.schema(spark.read.parquet(loaded).schema).parquet(loaded)
    transform_new_rows(stream(), out, str(tmp_path / "state"), catalog.AS_OF)
    bronze.where("coalesce(event_type, '') <> 'AUTH'").write.mode("append").parquet(source)
    load_new_files(spark, source, loaded, str(tmp_path / "ledger"))
    transform_new_rows(stream(), out, str(tmp_path / "state"), catalog.AS_OF)
    whole = spark.read.parquet(loaded)
    assert whole.count() == bronze.count()
    for name, df in (("authorizations", silver.authorizations(whole)), ("settlements", silver.settlements(whole)), ("quarantine", silver.quarantine(whole, catalog.AS_OF))):
        assert spark.read.parquet(f"{out}/{name}").count() == df.count()


def test_audits(spark):
    flags = spark.createDataFrame([("a", 1, "x", True), ("b", 1, "x", False), ("c", 0, None, False)], "transaction_id string, is_fraud int, fraud_type string, model_flag boolean")
    types = spark.createDataFrame([("x",), ("y",)], "fraud_type string")
    assert sorted(tuple(r) for r in audits.model_recall(flags, types).collect()) == [("x", 2, 0.5), ("y", 0, None)]
    assert [r.n for r in audits.lenient_numbers(spark.createDataFrame([("1.5",), ("bad",), (None,)], "n string"), "n").collect()] == [1.5, None, None]
    sample = catalog.QUERIES["scored_sample"](spark, DATA)
    assert sample.where("is_fraud = 0").count() <= 1000 and sample.where("is_fraud = 1").count() > 0
