"""Cut windows, exact splits and quantiles, topic slices, stored models, streams, and publishing."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline import catalog
from ledgerline.operators import evaluation, gate_log, merchants, model, quantiles, velocity, velocity_cut
from ledgerline.plans import publish
from ledgerline.sources import topic
from ledgerline.sources.events import bronze
from ledgerline.sources.tables import stored
from ledgerline.streaming import merge
from ledgerline.streaming.score import score_stream

AUTHS = "transaction_id string, card_id_hash string, event_time timestamp, amount decimal(12,2), country string, lat double, lon double, channel string, mcc string, auth_code string, card_present boolean, is_fraud tinyint, fraud_type string"


def auths_of(spark, n, cards, seconds, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = datetime(2024, 1, 1) + timedelta(seconds=rng.choice([rng.randrange(seconds), rng.randrange(seconds) // 86400 * 86400, 3600 * (rng.randrange(seconds) // 3600)]))
        rows.append((f"t{i}", rng.choice(cards), t, i % 900 + 0, rng.choice(["SG", "US", "GB", None]), rng.uniform(-60, 60), rng.uniform(-170, 170), "POS", "5411", "00", rng.random() < 0.5, 0, None))
    schema = AUTHS.replace("amount decimal(12,2)", "amount int")
    return spark.createDataFrame(rows, schema).withColumn("amount", F.col("amount").cast("decimal(12,2)"))


def rows_of(df):
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("bucket", [600, 86400, 10**7])
def test_cut_windows_give_the_same_rows(spark, bucket):
    df = stored(auths_of(spark, 400, ["a", "b", None], 4 * 86400))
    assert rows_of(velocity_cut.card_velocity_features(df, bucket)) == rows_of(velocity.card_velocity_features(df))
    assert velocity_cut.card_velocity_features(df.limit(0), bucket).count() == 0


def test_a_hot_card_is_spread(spark):
    """One card of 200,000 rows: no task holds more than a small part, and the sums are right."""
    rows = spark.range(200_000).select(
        F.concat(F.lit("t"), "id").alias("transaction_id"), F.lit("hot").alias("card_id_hash"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("event_time"), F.lit(1).cast("decimal(12,2)").alias("amount"),
        F.when(F.col("id") % 2 == 0, "SG").otherwise("US").alias("country"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit("POS").alias("channel"), F.lit("5411").alias("mcc"), F.lit("00").alias("auth_code"), F.lit(True).alias("card_present"), F.lit(0).cast("tinyint").alias("is_fraud"), F.lit(None).cast("string").alias("fraud_type"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = stored(velocity_cut.card_velocity_features(rows).withColumn("task", F.spark_partition_id()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out.groupBy("task").count().agg(F.max("count")).first()[0] < 40_000
    late = out.where("txn_count_24h = 1440 and txn_count_1h = 60 and distinct_countries_24h = 2 and minutes_since_last_txn = 1 and amount_sum_24h = 1440 and has_history").count()
    assert late == 200_000 - 1440


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    for values in ([5.0] * 3000, list(rng.normal(size=3000)), [0.0, 1e300, -1e300, *[1.0] * 2000], [7.0], list(np.exp(rng.normal(size=2000) * 8))):
        df = stored(spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double"))
        shares = (0.0, 0.013, 0.5, 0.98, 1.0)
        got = quantiles.exact_quantiles(df, "x", shares, bins=16, few=50)
        assert np.allclose(got, np.quantile(np.array(values), shares), rtol=1e-12)
    assert quantiles.exact_quantiles(df.limit(0), "x", (0.5,)) == [None]


def test_split_sizes_are_exact(spark):
    rows = [(f"t{i}", i % 10 == 0) for i in range(997)] + [(None, True)] * 5 + [("t1", False)] * 7 + [("u", None)] * 3
    df = spark.createDataFrame(rows, "transaction_id string, is_fraud boolean")
    got = {(r["is_fraud"], r["split"]): r["count"] for r in quantiles.stratified_split(df, "is_fraud").groupBy("is_fraud", "split").count().collect()}
    for label in (True, False, None):
        n = sum(r[1] is label for r in rows)
        assert got.get((label, "test"), 0) == math.ceil(n / 4) and got.get((label, "train"), 0) == n - math.ceil(n / 4)
    a, b = (quantiles.stratified_split(d, "is_fraud").where("split = 'train'").select("transaction_id") for d in (df, df.repartition(3)))
    assert rows_of(a) == rows_of(b)
    assert quantiles.stratified_split(df.limit(0), "is_fraud").count() == 0


def test_neighbouring_slices_share_and_miss_nothing(spark):
    rng = random.Random(1)
    rows = [(i % 3, i // 3, datetime(2024, 1, 1) + timedelta(hours=rng.randrange(100)), None, str(i)) for i in range(300)]
    log = spark.createDataFrame(rows, "partition int, offset long, timestamp timestamp, key string, value string")
    days = [f"2024-01-0{d} 00:00:00" for d in range(1, 8)]
    slices = [topic.topic_slice(log, a, b) for a, b in zip(days, days[1:])]
    found = [r["value"] for s in slices for r in s.collect()]
    assert len(found) == len(set(found))
    first, end = topic.offsets_at(log, days[0]).collect(), topic.offsets_at(log, days[-1]).collect()
    assert sum(r["offset"] for r in end) - sum(r["offset"] for r in first) == len(found) == 300
    # A start is where the first message of that time stands; messages after it come along whatever their time.
    assert topic.topic_slice(log, "2024-01-02 00:00:00", "2030-01-01 00:00:00").where("timestamp < timestamp '2024-01-02'").count() > 0


def test_as_of_pass_for_many_versions(spark):
    rng = random.Random(2)
    day = lambda k: datetime(2024, 1, 1) + timedelta(hours=k)
    history = []
    for m in ("a", "b"):
        cuts = sorted(rng.sample(range(2000), 60))
        history += [(m, f"{m}{i}", day(s), day(e) if e else None) for i, (s, e) in enumerate(zip(cuts, [*cuts[1:], None])) if i % 7]
    versions = spark.createDataFrame(history, "merchant_id string, merchant_name string, valid_from timestamp, valid_to timestamp")
    rows = [(f"t{i}", rng.choice(["a", "b", "c", None]), day(rng.randrange(2100))) for i in range(500)] + [("x", "a", None), ("t1", "a", day(5))]
    auths = spark.createDataFrame(rows, "transaction_id string, merchant_id string, event_time timestamp")
    columns = ["transaction_id", "merchant_id", "event_time", "version_name", "valid_from", "valid_to"]
    for bucket in (3600, 86400, 10**9):
        assert rows_of(merchants.as_of_pass(auths, versions, bucket).select(columns)) == rows_of(merchants.as_of(auths, versions).select(columns))


def features_of(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"t{i}", *map(float, np.abs(rng.normal(size=9)) * (40 if i % 50 == 0 else 1)), True, False, False, False, True, int(i % 50 == 0), "velocity" if i % 50 == 0 else None) for i in range(n)]
    schema = "transaction_id string, " + ", ".join(f"{c} double" for c in evaluation.NUMERIC) + ", " + ", ".join(f"{c} boolean" for c in evaluation.BOOLEAN) + ", is_fraud int, fraud_type string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "m")
    made = model.train(stored(features_of(spark, 400)), "v1", trees=30)
    model.save(made, path)
    return path, made


def test_a_stored_model_scores_like_the_one_that_was_trained(spark, saved):
    path, made = saved
    again = model.load(spark, path)
    assert (again.version, again.features, again.cutoff, again.sample) == ("v1", model.FEATURES, made.cutoff, 256)
    df = features_of(spark, 100, 1)
    assert rows_of(model.scored(df, made).drop("scored_at")) == rows_of(model.scored(df, again).drop("scored_at"))
    model.save(model.Model(made.nodes, "v2", made.features[::-1], 0.5, 7, {}), path)
    assert model.load(spark, path).version == "v2" and model.load(spark, path, "v1").cutoff == made.cutoff
    with pytest.raises(ValueError, match="reads"):
        model.scored(df, model.load(spark, path, "v2"))
    with pytest.raises(ValueError, match="no model"):
        model.load(spark, path, "v9")


def test_trees_of_small_training_sets(spark):
    few = model.train(stored(features_of(spark, 20)), "few", trees=20)
    assert few.sample == 20
    mean = model.scored(features_of(spark, 20), few).agg(F.avg("anomaly_score")).first()[0]
    assert 0.3 < mean < 0.6


def test_contract_rejects_and_errors(spark):
    df = features_of(spark, 4).withColumn("amount", F.when(F.col("transaction_id") == "t1", None).when(F.col("transaction_id") == "t2", float("nan")).otherwise(F.col("amount")))
    df = df.withColumn("has_history", F.when(F.col("transaction_id") != "t1", True))
    assert {r["transaction_id"]: r["rejected_for"] for r in model.rejected(df).collect()} == {"t1": ["amount", "has_history"], "t2": ["amount"]}
    assert model.accepted(df).count() == 2
    for wrong in (df.drop("amount"), df.withColumn("amount", F.lit("9")), df.withColumn("is_online", F.lit(1.0))):
        with pytest.raises(ValueError, match="features"):
            model.accepted(wrong)


def test_rules_at_their_bounds(spark, saved):
    path, made = saved
    for field, rule, at, above in (("txn_count_1h", "velocity", 2.0, 3.0), ("implied_speed_kmh", "geo", 1500.0, 1500.01), ("amount_vs_avg_24h_ratio", "amount", 15.0, 15.01)):
        clean = features_of(spark, 2).withColumns({"txn_count_1h": F.lit(0.0), "implied_speed_kmh": F.lit(0.0), "amount_vs_avg_24h_ratio": F.lit(1.0)})
        out = model.scored(clean.withColumn(field, F.when(F.col("transaction_id") == "t0", at).otherwise(above)), made).orderBy("transaction_id").collect()
        assert [[r[f"rule_{n}"] for n in ("velocity", "geo", "amount")] for r in out] == [[False] * 3, [n == rule for n in ("velocity", "geo", "amount")]]


def test_stream_scores_equal_batch_scores(spark, saved, tmp_path):
    path, made = saved
    df = features_of(spark, 60, 3).withColumn("minutes_since_last_txn", F.when(F.col("transaction_id") != "t7", F.col("minutes_since_last_txn")))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        score_stream(read(), path, str(tmp_path / "out"), str(tmp_path / "check"), "v1")
    got = spark.read.parquet(str(tmp_path / "out/scored")).drop("batch", "scored_at")
    assert rows_of(got) == rows_of(model.scored(model.accepted(df), made).drop("scored_at"))
    assert [r["rejected_for"] for r in spark.read.parquet(str(tmp_path / "out/rejected")).collect()] == [["minutes_since_last_txn"]]


def test_promotion_asks_each_fraud_type(spark):
    rows = [("velocity", 1, True)] * 9 + [("velocity", 1, False)] + [("geo_impossible", 1, False)] * 3 + [("geo_impossible", 1, True)] * 2 + [(None, 0, True)] + [(None, 0, False)] * 5
    df = spark.createDataFrame(rows, "fraud_type string, is_fraud int, any_rule boolean")
    assert model.promotion(df, "any_rule").first().asDict() == {"strategy": "any_rule", "overall_precision": 11 / 12, "recall_velocity": 0.9, "recall_geo_impossible": 0.4, "promoted": False}
    better = df.withColumn("any_rule", F.col("any_rule") | (F.col("fraud_type") == "geo_impossible"))
    assert model.promotion(better, "any_rule").first()["promoted"]
    assert not model.promotion(better.where("fraud_type <> 'geo_impossible'"), "any_rule").first()["promoted"]


def test_merges_can_run_again(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, seen int, v int"
    one, two = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], schema), spark.createDataFrame([("a", 2, 5), ("c", 2, 2), ("c", 2, 2)], schema)
    for number, batch in ((0, one), (1, two), (1, two)):
        merge.merge_batch(batch, number, path, "k", ("seen",))
    want = [("a", 1, 5), ("b", 1, 1), ("c", 2, 2)]
    assert sorted(map(tuple, merge.head(spark, path).collect())) == want
    # A version that was not completed does not count.
    (tmp_path / "t/version=7").mkdir()
    assert merge.versions(spark, path) == [0, 1]
    for number in (2, 3):
        merge.merge_batch(one.limit(0), number, path, "k")
    merge.prune(spark, path)
    assert merge.versions(spark, path) == [2, 3] and sorted(map(tuple, merge.head(spark, path).collect())) == want


def test_publish_shows_runs_that_pass_and_only_those(spark, tmp_path):
    root, rows = str(tmp_path / "lake"), stored(bronze(spark, "/root/testdata/sf0.001"))
    with pytest.raises(ValueError, match="nothing"):
        publish.published(spark, root, "features")
    bad = rows.withColumn("is_fraud", F.lit(1).cast("tinyint"))
    failed = publish.publish(bad, root, "bad", "2024-01-31 00:00:00", f"{root}/log")
    assert not failed.passed and failed.logged and publish.pointer(spark, root) is None
    share = F.when(F.col("transaction_id").isNotNull() & (F.xxhash64("transaction_id") % 100 == 0), 1).otherwise(0).cast("tinyint")
    good = rows.where("fraud_type is null").withColumn("is_fraud", share).withColumn("lat", F.lit(1.0)).withColumn("lon", F.lit(1.0))
    done = publish.publish(good, root, "first", "2024-02-01 00:00:00", f"{root}/log")
    log = gate_log.read_log(spark, f"{root}/log")
    assert done.passed, log.where("checked_at = timestamp '2024-02-01' and not passed").collect()
    n = publish.published(spark, root, "features").count()
    later = publish.publish(bad, root, "worse", "2024-02-02 00:00:00", f"{root}/log")
    assert not later.passed and publish.pointer(spark, root) == "first" and publish.published(spark, root, "features").count() == n > 0
    assert log.count() >= 14 and gate_log.history(gate_log.read_log(spark, f"{root}/log")).count() == 3
    again = publish.publish(good.withColumn("merchant_name", F.lit("New")), root, "second", "2024-02-03 00:00:00", f"{root}/log")
    assert again.passed and publish.published(spark, root, "merchants").where("valid_to is not null").count() > 0


def test_an_unwritable_log_leaves_the_verdict(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    rows = spark.createDataFrame([("a", 1.0, True, True)], "expectation string, observed double, passed boolean, overall_success boolean")
    assert gate_log.append_once(rows, str(tmp_path / "file/log"), "2024-01-01 00:00:00") is False
    for _ in range(2):
        assert gate_log.append_once(rows, str(tmp_path / "log"), "2024-01-01 00:00:00")
    assert gate_log.read_log(spark, str(tmp_path / "log")).count() == 1


def test_reports_come_in_order(spark):
    from ledgerline.plans import reports

    recon = spark.createDataFrame([("A", False, True)] * 2 + [("B", True, True)] * 5 + [("C", True, False)] * 2, "recon_status string, is_break boolean, is_matured boolean").repartition(3)
    assert [r["recon_status"] for r in reports.distribution(recon).collect()] == ["B", "A", "C"]
    at = [datetime(2024, 1, d) for d in (3, 1, 2, 1)]
    a, s = (spark.createDataFrame([(t, k, t) for t in at], "event_time timestamp, event_type string, _ingested_at timestamp") for k in ("AUTH", "SETTLEMENT"))
    assert [(r["day"], r["event_type"]) for r in reports.daily_volume(a, s).collect()] == [(f"2024-01-0{d}", k) for d in (1, 2, 3) for k in ("AUTH", "SETTLEMENT")]
    assert [r["day"] for r in reports.daily_quarantine(a, s, a).collect()] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    log = spark.createDataFrame([(at[0], e, 1.0, True, True) for e in "cab"] + [(at[1], "z", 1.0, True, True)], gate_log.SCHEMA)
    assert [r["expectation"] for r in gate_log.latest(log).collect()] == ["a", "b", "c"]


SMALL = "/root/testdata/sf0.001"


def test_walks_of_complete_trees_end_where_plain_ones_do():
    rng = np.random.default_rng(5)
    # A leaf at depth 1, others at 3, and a tree of one leaf.
    feature, cut = np.array([0, -1, 1, 2, -1, -1, -1]), np.array([0.5, 0, 0.4, 0.3, 0, 0, 0])
    left, right, length = np.array([1, -1, 3, 4, -1, -1, -1]), np.array([2, -1, 6, 5, -1, -1, -1]), np.array([0, 1.0, 0, 0, 3.0, 3.5, 2.0])
    features, cuts, ends, deep = evaluation.complete(feature, cut, left, right, length)
    assert deep == 3 and len(features) == 7 and len(ends) == 8
    for x in rng.random((200, 3)):
        at = 0
        while feature[at] >= 0:
            at = left[at] if x[feature[at]] <= cut[at] else right[at]
        i = 0
        for _ in range(deep):
            i = 2 * i + 1 + (not x[features[i]] <= cuts[i])
        assert ends[i - 7] == length[at]
    assert evaluation.complete(feature[1:2], cut[1:2], left[1:2], right[1:2], length[1:2])[2:] == (np.array([1.0]), 0)


def test_scored_rows_are_scored_once_and_features_derived_once(spark, monkeypatch):
    calls, plain = [], evaluation.score
    monkeypatch.setattr(evaluation, "score", lambda *a: (calls.append(1), plain(*a))[1])
    out = catalog.QUERIES["recent_flagged"](spark, SMALL)
    assert len(calls) == 1 and not [f for f in out.inputFiles() if "events.parquet" in f]


def test_suites_read_stored_tables(spark):
    for name in ("data_tests", "column_tests"):
        assert not [f for f in catalog.QUERIES[name](spark, SMALL).inputFiles() if "events.parquet" in f]


def test_features_cut_by_time_derive_authorizations_once(spark):
    assert not [f for f in catalog.QUERIES["velocity_features_cut"](spark, SMALL).inputFiles() if "events.parquet" in f]
