"""Registered queries and the DuckDB SQL that gives the same rows.

Times are given as microseconds, money as doubles, and computed doubles rounded to six places,
so that both engines' values compare exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks, evaluation, gate, incremental, merchants, model, quantiles, reconcile, silver, velocity, velocity_cut
from .plans import audits, publish, reports, roundtrips
from .sources.events import bronze, decode, duckdb_bronze, encode
from .sources.tables import between, shared_folder, stored
from .sources.topic import log_of, topic_slice
from .streaming import merge

AS_OF = "2024-01-31 00:00:00"


def flat(df: DataFrame) -> DataFrame:
    """The frame with portable types."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "timestamp":
            c = F.unix_micros(c)
        elif kind.startswith("decimal") or kind == "double":
            c = F.round(c.cast("double"), 6)
        elif kind.startswith("array"):
            c = F.array_join(c, ",")
        elif kind in ("tinyint", "int"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


class Tables:
    """The lakehouse's tables over one data folder, as lazy frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.of(bronze(spark, sf_dir))

    def of(self, events: DataFrame) -> None:
        self.bronze = events
        self.auths, self.settlements = silver.authorizations(self.bronze), silver.settlements(self.bronze)
        self.quarantine = silver.quarantine(self.bronze, AS_OF)
        self.recon = reconcile.reconcile(self.auths, self.settlements, AS_OF)
        self.features = velocity.card_velocity_features(self.auths)
        self.flags = velocity.rule_flags(self.features)

    def keep(self, *names: str) -> None:
        """Writes these tables once, in this order, and has those after them read what was written: for queries that
        read a table several times, which would derive it each time."""
        for name in names:
            kept = stored(getattr(self, name), name)
            if name == "bronze":
                self.of(kept)
            setattr(self, name, kept)
            if name in ("auths", "settlements"):
                self.recon = reconcile.reconcile(self.auths, self.settlements, AS_OF)
            if name == "auths":
                self.features = velocity.card_velocity_features(self.auths)
            if name in ("auths", "features"):
                self.flags = velocity.rule_flags(self.features)


def incremental_load(t: Tables) -> DataFrame:
    """Silver after the first batch, then the rows above its watermark merged in."""
    old = F.col("_source_file") == "batch_1.parquet"
    # The target has the first batch, marked by other amounts, and early versions of some later rows.
    money = F.when(old, F.col("amount") + 5).otherwise(F.col("amount") + 1).cast("decimal(12,2)")
    first = t.auths.where(old | (F.col("country") == "SG")).withColumns({"amount": money, "_ingested_at": F.least("_ingested_at", F.lit("2024-01-16").cast("timestamp"))})
    new = incremental.newer(t.auths, first)
    return incremental.upsert(first, new.unionByName(new.where("country = 'SG'")), "transaction_id").select("transaction_id", "amount", "_source_file")


def quarantine_reasons(t: Tables) -> DataFrame:
    return t.quarantine.select(F.explode("quarantine_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def not_dropped(t: Tables) -> DataFrame:
    """Bronze rows with an id that reached none of the three tables, by three anti-joins."""
    left = t.bronze.where("transaction_id is not null").select("transaction_id")
    for other in (t.auths, t.settlements, t.quarantine):
        left = left.join(other.select("transaction_id"), "transaction_id", "left_anti")
    return left.agg(F.count("*").alias("dropped"))


def orphans_in_quarantine(t: Tables) -> DataFrame:
    """Orphan settlements: whether their authorization is in quarantine."""
    q = t.quarantine.where("transaction_id is not null").select(F.col("transaction_id").alias("q_id")).distinct()
    o = t.recon.where("recon_status = 'ORPHAN_SETTLEMENT'").select(F.col("recon_key").alias("transaction_id")).join(t.settlements.select("transaction_id", "auth_transaction_id"), "transaction_id")
    return o.join(q, F.col("auth_transaction_id") == F.col("q_id"), "left").groupBy(F.col("q_id").isNotNull().alias("auth_quarantined")).agg(F.count("*").alias("n"))


def scored(t: Tables) -> DataFrame:
    """All rows with scores and flags, by a model that was trained on the train split, stored, and read again. The features are written once."""
    t.features = evaluation.split(t.features)
    t.keep("features")
    spark = t.features.sparkSession
    path = shared_folder(spark, "model")
    trained, scores = model.train_and_score(t.features, F.col("split") == "train", "1")
    model.save(trained, path)
    return model.flagged(scores, model.load(spark, path))


def fraud_types(t: Tables) -> DataFrame:
    return t.features.where("is_fraud = 1").select("fraud_type").distinct()


def of_types(t: Tables, report) -> DataFrame:
    """A report on the flagged rows by the fraud types of all authorizations, which stand in the features that `scored` keeps."""
    flags = flagged(t)
    return report(flags, fraud_types(t))


def recent(t: Tables) -> DataFrame:
    rows = sampled(t).drop("run")
    return model.recent_flagged(rows, t.features)


def tested(t: Tables, suite, *first) -> DataFrame:
    """A suite over tables that are each written once, as its tests read them many times."""
    t.keep("bronze", "auths", "settlements", "quarantine", "recon", "features")
    history = stored(merchants.merchant_history(t.auths), "history")
    return suite(*[getattr(t, name) for name in first], t.auths, t.settlements, t.quarantine, t.recon, t.features, history)


def flagged(t: Tables) -> DataFrame:
    """The test split with rule, model and combined flags."""
    return scored(t).where("split = 'test'")


def hybrid(t: Tables) -> DataFrame:
    """Confusion of rules, model and both on the test split, and whether each may be promoted."""
    flags, names = flagged(t), ["any_rule", "model_flag", "combined_flag"]
    floor = [model.promotion(flags, n).select("strategy", "promoted") for n in names]
    return reports.confusion_of(flags, names).join(floor[0].unionByName(floor[1]).unionByName(floor[2]), "strategy")


def sampled(t: Tables) -> DataFrame:
    return model.provenance(audits.scored_sample(flagged(t)))


def keyed_quarantine(t: Tables) -> DataFrame:
    """Quarantine kept up by a stream in two batches, the second of which runs twice: keys stay single, and as first quarantined."""
    spark = t.bronze.sparkSession
    inbox, table, checkpoint = (shared_folder(spark, f"quarantine-{n}") for n in ("inbox", "table", "checkpoint"))
    first, all_ = t.quarantine.where("_source_file = 'batch_1.parquet'"), silver.quarantine(t.bronze, "2024-02-15 00:00:00")
    for batch in (first, all_):
        batch.write.mode("append").parquet(inbox)
        merge.keep_up(spark.readStream.schema(batch.schema).parquet(inbox), table, "quarantine_key", checkpoint, ("quarantined_at",))
    merge.merge_batch(all_, merge.versions(spark, table)[-1], table, "quarantine_key", ("quarantined_at",))
    return merge.head(spark, table).select("quarantine_key", "quarantined_at")


def published_run(t: Tables) -> DataFrame:
    """Built, gated and published tables: how many rows each has, whether the run passed, and whether readers see it."""
    spark = t.bronze.sparkSession
    root = shared_folder(spark, "publish")
    done = publish.publish(t.bronze, root, "first", AS_OF, f"{root}/log")
    seen = publish.pointer(spark, root) == "first"
    rows = [spark.read.parquet(f"{root}/runs/first/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name in publish.TABLES]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("table", "n", F.lit(done.passed).alias("passed"), F.lit(seen).alias("published"))


def topic_log(t: Tables) -> DataFrame:
    """Bronze as a log of six partitions: the card's messages in the order of event ids, stamped when they came in, but
    those of every seventh event a day late, so that timestamps are not in order."""
    number = F.regexp_extract("transaction_id", "([0-9]+)", 1).cast("long")
    rows = t.bronze.where("transaction_id is not null and card_id is not null and event_type = 'AUTH'")
    stamp = F.when(number % 7 == 0, F.col("_ingested_at") + F.make_dt_interval(days=F.lit(1))).otherwise(F.col("_ingested_at"))
    return log_of(rows.select(F.col("card_id").alias("key"), F.col("transaction_id").alias("value"), stamp.alias("timestamp"), F.struct(number, "transaction_id").alias("position")), F.regexp_extract("key", "([0-9]+)", 1).cast("long") % 6)


SHARES = (0.01, 0.25, 0.5, 0.75, 0.9, 0.98, 0.99)
MEASURED = ("amount", "amount_vs_avg_24h_ratio", "implied_speed_kmh", "minutes_since_last_txn", "txn_count_24h")

SPARK = {
    "interval_files": lambda t: roundtrips.interval_files(t.bronze),
    "loaded_once": lambda t: roundtrips.loaded_once(t.bronze),
    "named_tables": lambda t: roundtrips.named_tables(t.recon),
    "gate_history": lambda t: roundtrips.logged_gates(gate.gate(t.recon, t.features))[0],
    "gate_latest": lambda t: roundtrips.logged_gates(gate.gate(t.recon, t.features))[1],
    "gate_described": lambda t: roundtrips.described(gate.gate(t.recon, t.features)),
    "flagged_display": lambda t: roundtrips.display(t.flags),
    "lenient_numbers": lambda t: audits.lenient_numbers(t.bronze.select("transaction_id", F.coalesce("auth_code", "currency").alias("code"), F.translate(F.substring("transaction_id", 2, 9), "_", "x").alias("number")), "code", "number"),
    "velocity_features_cut": lambda t: velocity_cut.card_velocity_features(stored(t.auths, "auths")),
    "merchant_as_of_pass": lambda t: merchants.as_of_pass(t.auths, merchants.merchant_history(t.auths)).select("transaction_id", "merchant_id", "version_name"),
    "topic_slice": lambda t: topic_slice(topic_log(t), "2024-01-16", "2024-01-17").select("partition", "offset", F.col("key").alias("card"), F.col("value").alias("transaction_id")),
    "stratified_split": lambda t: quantiles.stratified_split(t.features, "is_fraud").select("transaction_id", "is_fraud", "split"),
    "feature_quantiles": lambda t: quantiles.quantile_rows(stored(t.features.select(*MEASURED)), MEASURED, SHARES),
    "bronze_events": lambda t: t.bronze,
    "silver_authorizations": lambda t: t.auths,
    "silver_settlements": lambda t: t.settlements,
    "quarantine": lambda t: t.quarantine,
    "quarantine_reasons": quarantine_reasons,
    "reconciliation": lambda t: t.recon,
    "velocity_features": lambda t: t.features,
    "rule_flags": lambda t: t.flags.select("transaction_id", "rule_velocity", "rule_geo", "rule_amount", "any_rule", "rules_fired"),
    "merchants_current": lambda t: merchants.merchants_current(t.auths),
    "merchant_history": lambda t: merchants.merchant_history(t.auths),
    "merchant_as_of": lambda t: merchants.as_of(t.auths, merchants.merchant_history(t.auths)).select("transaction_id", "merchant_id", "version_name"),
    "quality_gate": lambda t: gate.gate(t.recon, t.features),
    "recon_distribution": lambda t: reports.distribution(t.recon),
    "break_summary": lambda t: reports.break_summary(t.recon),
    "recall_by_type": lambda t: reports.recall_by_type(t.flags),
    "rule_confusion": lambda t: reports.confusion(t.flags),
    "daily_volume": lambda t: reports.daily_volume(t.auths, t.settlements),
    "daily_quarantine": lambda t: reports.daily_quarantine(t.auths, t.settlements, t.quarantine),
    "latest_flagged": lambda t: reports.latest_flagged(t.flags),
    "incremental_load": incremental_load,
    "no_rows_dropped": not_dropped,
    "orphans_in_quarantine": orphans_in_quarantine,
    "incremental_empty_target": lambda t: incremental.newer(t.auths, t.auths.where("false")).select("transaction_id"),
    "data_tests": lambda t: tested(t, checks.suite, "bronze"),
    "fraud_rate_by_split": lambda t: evaluation.rate_by_split(evaluation.split(t.features)),
    "train_medians": lambda t: evaluation.medians(evaluation.split(t.features).where("split = 'train'")),
    "imputed_features": lambda t: evaluation.impute(t.features, evaluation.medians(evaluation.split(t.features).where("split = 'train'"))).select("transaction_id", *evaluation.NUMERIC),
    "recall_long": lambda t: evaluation.recall_long(t.flags),
    "anomaly_scores": lambda t: scored(t).select("transaction_id", "split", "anomaly_score"),
    "threshold_sweep": lambda t: evaluation.sweep(flagged(t)),
    "hybrid_confusion": hybrid,
    "scored_sample": lambda t: sampled(t).drop("run"),
    "recent_flagged": recent,
    "recall_three_ways": lambda t: of_types(t, model.recall_three_ways),
    "rule_promotion": lambda t: model.promotion(t.flags, "any_rule"),
    "column_tests": lambda t: tested(t, checks.column_suite),
    "keyed_quarantine": keyed_quarantine,
    "published_run": published_run,
    "model_recall": lambda t: of_types(t, audits.model_recall),
    "settlement_drift": lambda t: audits.settlement_drift(t.auths, t.settlements),
    "speed_audit": lambda t: audits.speed_audit(t.auths),
    "defects_by_file": lambda t: audits.defects_by_file(t.quarantine),
    "merchant_drift": lambda t: audits.merchant_drift(merchants.merchant_history(t.auths)),
    "labelled_breaks": lambda t: audits.labelled_breaks(t.recon),
    "interval_slice": lambda t: decode(encode(between(t.bronze, "2024-01-10", "2024-01-20", "_ingested_at"))).select("transaction_id", "event_time", "amount", "currency"),
}


#: Another way to the same rows.
SAME = {"velocity_features_cut": "velocity_features"}


def registered(build):
    return lambda spark, sf_dir: flat(build(Tables(spark, sf_dir)))


QUERIES = {name: registered(build) for name, build in SPARK.items()}

#: The same tables in DuckDB.
_COMMON = "merchant_id, merchant_name, mcc, mcc_description, cast(amount as decimal(12,2)) as amount, currency, country"
_REASONS = """list_filter([
  case when transaction_id is null then 'NULL_TRANSACTION_ID' end, case when card_id is null then 'NULL_CARD_ID' end,
  case when amount is null or amount <= 0 then 'NONPOSITIVE_AMOUNT' end,
  case when currency is null or currency not in ('SGD','MYR','IDR','THB','USD','GBP','AUD') then 'UNKNOWN_CURRENCY' end,
  case when try_cast(event_time as timestamp) is null then 'UNPARSEABLE_EVENT_TIME' end,
  case when event_type is null or event_type not in ('AUTH','SETTLEMENT') then 'UNKNOWN_EVENT_TYPE' end,
  case when amount is not null and try_cast(amount as decimal(12,2)) is null then 'AMOUNT_OVERFLOW' end], lambda v: v is not null)"""
_CTES = {
    "bronze": duckdb_bronze(),
    "checked": f"select *, {_REASONS} as rs from bronze",
    "auths": f"select transaction_id, event_type, try_cast(event_time as timestamp) as event_time, sha256(card_id) as card_id_hash, {_COMMON}, lat, lon, channel, pos_entry_mode, card_present, auth_code, _ingested_at, _source_file, is_fraud, fraud_type from checked where event_type = 'AUTH' and len(rs) = 0",
    "settlements": f"select transaction_id, event_type, try_cast(event_time as timestamp) as event_time, auth_transaction_id, sha256(card_id) as card_id_hash, {_COMMON}, _ingested_at, _source_file, is_fraud, fraud_type from checked where event_type = 'SETTLEMENT' and len(rs) = 0",
    "quarantine": "select * from checked where len(rs) > 0",
    "recon0": f"""select a.transaction_id as auth_transaction_id, s.transaction_id as settlement_transaction_id, coalesce(a.transaction_id, s.transaction_id) as recon_key,
      coalesce(a.card_id_hash, s.card_id_hash) as card_id_hash, a.amount as auth_amount, s.amount as settlement_amount, s.amount - a.amount as amount_diff,
      cast(s.amount - a.amount as double) / nullif(a.amount, 0) as amount_diff_pct, a.event_time as auth_time, s.event_time as settlement_time,
      date_sub('minute', a.event_time, s.event_time) as settlement_lag_minutes, a.auth_code, s.auth_transaction_id as of_auth,
      a.event_time is not null and a.event_time <= timestamp '{AS_OF}' - interval 10080 minutes as is_matured
      from auths a full outer join settlements s on a.transaction_id = s.auth_transaction_id""",
    "recon1": """select *, abs(amount_diff) > 1 and abs(amount_diff_pct) > 0.10 as pct, abs(amount_diff) > 100 as over_, case
      when auth_transaction_id is not null and auth_code <> '00' then 'AUTH_DECLINED'
      when auth_transaction_id is not null and settlement_transaction_id is not null and ((abs(amount_diff) > 1 and abs(amount_diff_pct) > 0.10) or abs(amount_diff) > 100) then 'AMOUNT_MISMATCH'
      when auth_transaction_id is not null and settlement_transaction_id is not null then 'MATCHED'
      when auth_transaction_id is not null and is_matured then 'AUTH_NO_SETTLEMENT' when auth_transaction_id is not null then 'PENDING_SETTLEMENT' else 'ORPHAN_SETTLEMENT' end as recon_status from recon0""",
    "recon": """select *, recon_status in ('AMOUNT_MISMATCH','AUTH_NO_SETTLEMENT','ORPHAN_SETTLEMENT') as is_break, case
      when recon_status = 'AMOUNT_MISMATCH' and pct and over_ then 'PCT_AND_CEILING' when recon_status = 'AMOUNT_MISMATCH' and pct then 'PCT_EXCEEDED' when recon_status = 'AMOUNT_MISMATCH' then 'CEILING_EXCEEDED'
      when recon_status = 'AUTH_NO_SETTLEMENT' then 'SETTLEMENT_TIMEOUT' when recon_status = 'ORPHAN_SETTLEMENT' then 'NO_MATCHING_AUTH' end as break_reason from recon1""",
    "win": """select *, count(*) over h - 1 as n1, count(*) over d - 1 as n24, sum(amount) over d - amount as s24, count(*) over e - 1 as n, count(distinct country) over b as countries,
      lag(u) over r as prev, lag(case when card_present then u end ignore nulls) over r as pu, lag(case when card_present then lat end ignore nulls) over r as plat, lag(case when card_present then lon end ignore nulls) over r as plon,
      lag(case when card_present then is_fraud end ignore nulls) over r as pfraud, lag(case when card_present then _source_file end ignore nulls) over r as pfile
      from (select *, cast(floor(epoch(event_time)) as bigint) as u from auths)
      window h as (partition by card_id_hash order by u range between 3600 preceding and current row), d as (partition by card_id_hash order by u range between 86400 preceding and current row),
      e as (partition by card_id_hash order by u range between unbounded preceding and current row), b as (partition by card_id_hash order by u range between 86400 preceding and 1 preceding), r as (partition by card_id_hash order by u, event_time, transaction_id)""",
    "feats": """select *, case when n24 > 0 then cast(s24 as double) / n24 end as avg24, case when card_present and pu is not null then
      2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))) / nullif((u - pu) / 3600.0, 0) end as speed from win""",
    "flags": """select *, coalesce(n1 > 2, false) as rule_velocity, coalesce(speed > 1500, false) as rule_geo, coalesce(cast(amount as double) / nullif(avg24, 0) > 15, false) as rule_amount from feats""",
    "merch": "select * from (select *, row_number() over (partition by merchant_id order by event_time desc, transaction_id desc) as rn from auths where merchant_id is not null) where rn = 1",
    "merch1": "select * from (select *, row_number() over (partition by merchant_id order by event_time desc, transaction_id desc) as rn from auths where merchant_id is not null and _source_file = 'batch_1.parquet') where rn = 1",
    "hist": """select o.merchant_id, o.merchant_name, o.mcc, o.mcc_description, o.country, timestamp '2024-01-16' as valid_from,
        case when n.merchant_id is not null and (n.merchant_name is distinct from o.merchant_name or n.mcc is distinct from o.mcc) then timestamp '2024-02-01' end as valid_to from merch1 o left join merch n using (merchant_id)
      union all select n.merchant_id, n.merchant_name, n.mcc, n.mcc_description, n.country, timestamp '2024-02-01', null from merch n left join merch1 o using (merchant_id)
        where o.merchant_id is null or n.merchant_name is distinct from o.merchant_name or n.mcc is distinct from o.mcc""",
}
_MONEY = "round(cast(amount as double), 6) as amount"


def duck(select: str) -> str:
    return "with " + ",\n".join(f"{name} as ({sql})" for name, sql in _CTES.items()) + "\n" + select


_ANY = "(rule_velocity or rule_geo or rule_amount)"
_FIRED = "coalesce(nullif(concat_ws(', ', case when rule_velocity then 'velocity' end, case when rule_geo then 'geo' end, case when rule_amount then 'amount' end), ''), '-')"
_METRICS = {
    "recon_row_count": ("cast(count(*) as double) from recon", "o >= 1"),
    "recon_status_invalid_count": ("cast(count(*) filter (recon_status not in ('AUTH_DECLINED','AMOUNT_MISMATCH','MATCHED','AUTH_NO_SETTLEMENT','PENDING_SETTLEMENT','ORPHAN_SETTLEMENT')) as double) from recon", "o = 0"),
    "matched_share_of_matured": ("sum(case when is_matured and recon_status = 'MATCHED' then 1 else 0 end) / nullif(cast(sum(case when is_matured then 1 else 0 end) as double), 0) from recon", "o between 0.6 and 0.98"),
    "orphan_settlement_share": ("sum(case when recon_status = 'ORPHAN_SETTLEMENT' then 1 else 0 end) / nullif(cast(count(*) as double), 0) from recon", "o >= 0 and o < 0.03"),
    "fraud_rate": ("avg(cast(is_fraud as double)) from feats", "o between 0.005 and 0.05"),
    "p99_implied_speed_kmh_nonfraud": ("quantile_disc(case when is_fraud = 0 then speed end, 0.99) from feats", "o >= 0 and o < 900"),
    "velocity_inversion_count": ("cast(sum(case when n24 < n1 then 1 else 0 end) as double) from feats", "o = 0"),
}
_GATE = " union all ".join(f"select '{k}' as expectation, o, o is null or ({test}) as passed from (select {m.replace(' from ', ' as o from ', 1) if ' from ' in m else m + ' as o'})" for k, (m, test) in _METRICS.items())
_CONFUSION = " union all ".join(f"select '{k}' as strategy, {v} as f, is_fraud = 1 as y from flags" for k, v in (("rule_velocity", "rule_velocity"), ("rule_geo", "rule_geo"), ("rule_amount", "rule_amount"), ("any_rule", _ANY)))

_TESTS = {
    "unique_transaction_id": "select transaction_id from auths where transaction_id is not null group by 1 having count(*) > 1",
    "not_null_card_id_hash": "select 1 from auths where card_id_hash is null",
    "accepted_currency": "select 1 from auths where currency not in ('SGD','MYR','IDR','THB','USD','GBP','AUD')",
    "accepted_recon_status": "select 1 from recon where recon_status not in ('AUTH_DECLINED','AMOUNT_MISMATCH','MATCHED','AUTH_NO_SETTLEMENT','PENDING_SETTLEMENT','ORPHAN_SETTLEMENT')",
    "settlement_has_authorization": "select 1 from settlements s where auth_transaction_id is not null and not exists (select 1 from auths a where a.transaction_id = s.auth_transaction_id)",
    "break_reason_iff_break": "select 1 from recon where is_break <> (break_reason is not null)",
    "declined_is_no_break": "select 1 from recon where recon_status = 'AUTH_DECLINED' and is_break",
    "matched_within_ceiling": "select 1 from recon where recon_status = 'MATCHED' and abs(amount_diff) > 100",
    "no_bronze_row_dropped": "select 1 from bronze b where transaction_id is not null and transaction_id not in (select transaction_id from auths union all select transaction_id from settlements union all select transaction_id from quarantine where transaction_id is not null)",
    "no_history_no_recency": "select 1 from feats where n = 0 and (prev is not null or avg24 is not null)",
    "normal_speed_within_ceiling": "select 1 from feats where is_fraud = 0 and speed > 900 and pfraud = 0 and pfile = _source_file",
    "one_open_version": "select merchant_id from hist where valid_to is null group by 1 having count(*) > 1",
    "quarantine_disjoint": "select distinct q.transaction_id from quarantine q join (select transaction_id from auths union all select transaction_id from settlements) s using (transaction_id)",
    "hourly_count_excludes_self": "select 1 from feats join (select card_id_hash, count(*) as total from feats group by 1) using (card_id_hash) where n1 >= total",
    "daily_not_less_than_hourly": "select 1 from feats where n24 < n1",
}
_WARN = ("settlement_has_authorization", "normal_speed_within_ceiling")
_SUITE = " union all ".join(f"select '{k}' as test, '{'warn' if k in _WARN else 'error'}' as severity, count(*) as failures, count(*) = 0 as passed from ({v})" for k, v in _TESTS.items())
_SPLIT = "(select *, (u - prev) / 60.0 as minutes, case when cast('0x' || substr(md5(concat(transaction_id, ':42')), 1, 8) as bigint) < 3221225472 then 'train' else 'test' end as split from feats)"
_MEDIANS = f"(select median(minutes) as m1, median(avg24) as m2 from {_SPLIT} where split = 'train')"

_KEY = "sha256(concat_ws('||', coalesce(transaction_id, ''), coalesce(event_type, ''), coalesce(event_time, ''), coalesce(card_id, ''), coalesce(merchant_id, ''), coalesce(cast(amount as varchar), ''), coalesce(currency, ''), coalesce(_source_file, '')))"
_FILLED = {
    "authorizations": ("auths", ("transaction_id", "event_time", "card_id_hash")), "settlements": ("settlements", ("transaction_id", "event_time", "card_id_hash", "auth_transaction_id")),
    "reconciliation": ("recon", ("recon_key", "recon_status")), "features": ("feats", ("transaction_id", "card_id_hash", "event_time")), "merchants": ("hist", ("merchant_id", "valid_from")),
}
_CURRENCY = "('SGD','MYR','IDR','THB','USD','GBP','AUD')"
_COLUMN_TESTS = {f"not_null_{n}_{c}": f"select 1 from {t} where {c} is null" for n, (t, columns) in _FILLED.items() for c in columns} | {
    "not_null_quarantine_quarantine_key": f"select 1 from quarantine where {_KEY} is null", "not_null_quarantine_quarantine_reasons": "select 1 from quarantine where rs is null", "not_null_quarantine_quarantined_at": "select 1 from quarantine where false",
    "accepted_authorizations_currency": f"select 1 from auths where currency not in {_CURRENCY}", "accepted_authorizations_channel": "select 1 from auths where channel not in ('POS','ONLINE','ATM','CONTACTLESS')",
    "accepted_settlements_currency": f"select 1 from settlements where currency not in {_CURRENCY}", "accepted_reconciliation_recon_status": "select 1 from recon where recon_status not in ('AUTH_DECLINED','AMOUNT_MISMATCH','MATCHED','AUTH_NO_SETTLEMENT','PENDING_SETTLEMENT','ORPHAN_SETTLEMENT')",
    "unique_quarantine_quarantine_key": f"select {_KEY} as k from quarantine group by 1 having count(*) > 1", "known_settlements_auth_transaction_id": _TESTS["settlement_has_authorization"],
} | {f"unique_{n}_{c}": f"select {c} from {t} where {c} is not null group by 1 having count(*) > 1" for n, t, c in (("authorizations", "auths", "transaction_id"), ("settlements", "settlements", "transaction_id"), ("reconciliation", "recon", "recon_key"), ("features", "feats", "transaction_id"))}

ORACLES = {
    "bronze_events": duck("select * replace (round(lat, 6) as lat, round(lon, 6) as lon, round(amount, 6) as amount, cast(is_fraud as bigint) as is_fraud, epoch_us(_ingested_at) as _ingested_at) from bronze"),
    "silver_authorizations": duck(f"select * replace (round(lat, 6) as lat, round(lon, 6) as lon, {_MONEY}, epoch_us(event_time) as event_time, cast(is_fraud as bigint) as is_fraud, epoch_us(_ingested_at) as _ingested_at) from auths"),
    "silver_settlements": duck(f"select * replace ({_MONEY}, epoch_us(event_time) as event_time, cast(is_fraud as bigint) as is_fraud, epoch_us(_ingested_at) as _ingested_at) from settlements"),
    "quarantine": duck(f"select * exclude (rs, card_id) replace (round(amount, 6) as amount, round(lat, 6) as lat, round(lon, 6) as lon, cast(is_fraud as bigint) as is_fraud, epoch_us(_ingested_at) as _ingested_at), array_to_string(rs, ',') as quarantine_reasons, epoch_us(timestamp '{AS_OF}') as quarantined_at, sha256(card_id) as card_id_hash, sha256(concat_ws('||', coalesce(transaction_id, ''), coalesce(event_type, ''), coalesce(event_time, ''), coalesce(card_id, ''), coalesce(merchant_id, ''), coalesce(cast(amount as varchar), ''), coalesce(currency, ''), coalesce(_source_file, ''))) as quarantine_key from quarantine"),
    "quarantine_reasons": duck("select reason, count(*) as n from (select unnest(rs) as reason from quarantine) group by 1"),
    "reconciliation": duck("select recon_key, auth_transaction_id, settlement_transaction_id, card_id_hash, round(cast(auth_amount as double), 6) as auth_amount, round(cast(settlement_amount as double), 6) as settlement_amount, round(cast(amount_diff as double), 6) as amount_diff, round(amount_diff_pct, 6) as amount_diff_pct, epoch_us(auth_time) as auth_time, epoch_us(settlement_time) as settlement_time, settlement_lag_minutes, recon_status, is_break, break_reason, is_matured from recon"),
    "velocity_features": duck(f"select transaction_id, card_id_hash, epoch_us(event_time) as event_time, {_MONEY}, n1 as txn_count_1h, n24 as txn_count_24h, round(cast(s24 as double), 6) as amount_sum_24h, round(avg24, 6) as amount_avg_24h, round(cast(amount as double) / nullif(avg24, 0), 6) as amount_vs_avg_24h_ratio, countries as distinct_countries_24h, round((u - prev) / 60.0, 6) as minutes_since_last_txn, round(speed, 6) as implied_speed_kmh, card_present as is_card_present, channel = 'ONLINE' as is_online, mcc in ('5967','5732','4511') as is_high_risk_mcc, auth_code <> '00' as was_declined, n > 0 as has_history, cast(is_fraud as bigint) as is_fraud, fraud_type from feats"),
    "rule_flags": duck(f"select transaction_id, rule_velocity, rule_geo, rule_amount, {_ANY} as any_rule, {_FIRED} as rules_fired from flags"),
    "merchants_current": duck("select merchant_id, merchant_name, mcc, mcc_description, country, epoch_us(event_time) as last_seen_at from merch"),
    "merchant_history": duck("select * replace (epoch_us(valid_from) as valid_from, epoch_us(valid_to) as valid_to) from hist"),
    "merchant_as_of_pass": duck("select a.transaction_id, a.merchant_id, h.merchant_name as version_name from auths a left join hist h on a.merchant_id = h.merchant_id and a.event_time >= h.valid_from and (h.valid_to is null or a.event_time < h.valid_to)"),
    "rule_promotion": duck(f"""select 'any_rule' as strategy, round(p, 6) as overall_precision, round(v, 6) as recall_velocity, round(g, 6) as recall_geo_impossible, coalesce(p >= 0.05 and v >= 0.5 and g >= 0.5, false) as promoted from (select sum(case when a and is_fraud = 1 then 1.0 else 0.0 end) / nullif(sum(case when a then 1 else 0 end), 0) as p,
      avg(case when a then 1.0 else 0.0 end) filter (is_fraud = 1 and fraud_type = 'velocity') as v, avg(case when a then 1.0 else 0.0 end) filter (is_fraud = 1 and fraud_type = 'geo_impossible') as g from (select *, {_ANY} as a from flags))"""),
    "column_tests": duck(" union all ".join(f"select '{n}' as test, '{'warn' if n.startswith('known') else 'error'}' as severity, count(*) as failures, count(*) = 0 as passed from ({q})" for n, q in _COLUMN_TESTS.items())),
    "keyed_quarantine": duck(f"select {_KEY} as quarantine_key, epoch_us(min(case when _source_file = 'batch_1.parquet' then timestamp '{AS_OF}' else timestamp '2024-02-15' end)) as quarantined_at from quarantine group by 1"),
    "published_run": duck(f"select *, (select min(passed) from ({_GATE})) as passed, (select min(passed) from ({_GATE})) as published from (select 'authorizations' as \"table\", count(*) as n from auths union all select 'settlements', count(*) from settlements union all select 'quarantine', count(*) from quarantine union all select 'reconciliation', count(*) from recon union all select 'features', count(*) from feats)"),
    "interval_files": duck("select case when _ingested_at < timestamp '2024-01-20' then 'i1' else 'i3' end as interval, count(*) as n, cast(sum(cast(round(amount * 100) as bigint)) as bigint) as cents, false as empty_written from bronze group by 1"),
    "loaded_once": duck("select event_type, count(*) as n, count(distinct transaction_id) as ids from bronze group by 1"),
    "named_tables": duck("select recon_status, count(*) as n, cast(sum(case when is_break then 1 else 0 end) as bigint) as breaks from recon group by 1"),
    "gate_history": duck(f"select epoch_us(timestamp '2024-02-03') as checked_at, min(passed) as success, cast(sum(case when passed then 0 else 1 end) as bigint) as failed from ({_GATE}) union all select epoch_us(timestamp '2024-02-02'), false, cast(sum(case when passed and expectation <> 'recon_row_count' then 0 else 1 end) as bigint) from ({_GATE})"),
    "gate_latest": duck(f"select epoch_us(timestamp '2024-02-03') as checked_at, expectation, round(o, 6) as observed, passed, min(passed) over () as overall_success from ({_GATE})"),
    "gate_described": duck(f"select expectation, round(o, 6) as observed, passed, min(passed) over () as overall_success, case expectation {' '.join(f"when '{k}' then '{v}'" for k, v in roundtrips.MEANINGS.items())} end as description from ({_GATE})"),
    "flagged_display": duck(f"select transaction_id, substr(card_id_hash, 1, 12) as card, {_MONEY}, case when rule_velocity then 'Yes' else 'No' end as rule_velocity, case when rule_geo then 'Yes' else 'No' end as rule_geo, case when rule_amount then 'Yes' else 'No' end as rule_amount, {_FIRED} as rules_fired, coalesce(fraud_type, '-') as fraud_type from flags where {_ANY} order by event_time desc, transaction_id desc limit 50"),
    "lenient_numbers": duck("select transaction_id, round(try_cast(coalesce(auth_code, currency) as double), 6) as code, round(try_cast(replace(substr(transaction_id, 2, 9), '_', 'x') as double), 6) as number from bronze"),
    "topic_slice": duck("""select partition, "offset", card, transaction_id from (select *, coalesce(min(case when ts >= timestamp '2024-01-16' then "offset" end) over p, max("offset") over p + 1) as lo, coalesce(min(case when ts >= timestamp '2024-01-17' then "offset" end) over p, max("offset") over p + 1) as hi
      from (select *, row_number() over (partition by partition order by number, transaction_id) - 1 as "offset" from (select card_id as card, transaction_id, cast(regexp_extract(card_id, '([0-9]+)', 1) as bigint) % 6 as partition, cast(regexp_extract(transaction_id, '([0-9]+)', 1) as bigint) as number, case when number % 7 = 0 then _ingested_at + interval 1 day else _ingested_at end as ts
        from bronze where transaction_id is not null and card_id is not null and event_type = 'AUTH')) window p as (partition by partition)) where "offset" >= lo and "offset" < hi"""),
    "stratified_split": duck("select transaction_id, cast(is_fraud as bigint) as is_fraud, case when nth <= of_label - cast(ceil(round(of_label * 0.25, 9)) as bigint) then 'train' else 'test' end as split from (select *, row_number() over (partition by is_fraud order by cast('0x' || substr(md5(concat(transaction_id, ':42')), 1, 8) as bigint), transaction_id) as nth, count(*) over (partition by is_fraud) as of_label from feats)"),
    "feature_quantiles": duck("select feature, share, round(v, 6) as value from (" + " union all ".join(f"select '{c}' as feature, cast({s} as double) as share, quantile_cont({x}, {s}) as v from feats" for c, x in (("amount", "cast(amount as double)"), ("amount_vs_avg_24h_ratio", "cast(amount as double) / nullif(avg24, 0)"), ("implied_speed_kmh", "speed"), ("minutes_since_last_txn", "(u - prev) / 60.0"), ("txn_count_24h", "cast(n24 as double)")) for s in SHARES) + ")"),
    "merchant_as_of": duck("select a.transaction_id, a.merchant_id, h.merchant_name as version_name from auths a left join hist h on a.merchant_id = h.merchant_id and a.event_time >= h.valid_from and (h.valid_to is null or a.event_time < h.valid_to)"),
    "quality_gate": duck(f"select expectation, round(o, 6) as observed, passed, min(passed) over () as overall_success from ({_GATE})"),
    "recon_distribution": duck("select recon_status, is_break, is_matured, count(*) as n from recon group by all"),
    "break_summary": duck("select count(*) as total, cast(sum(case when is_break then 1 else 0 end) as bigint) as breaks, round(sum(case when is_break then 1 else 0 end) / cast(count(*) as double), 6) as break_rate from recon"),
    "recall_by_type": duck(f"select fraud_type, count(*) as n, round(avg(case when {_ANY} then 1.0 else 0.0 end), 6) as rules_recall from flags where is_fraud = 1 group by 1"),
    "rule_confusion": duck(f"select *, round(tp / nullif(cast(tp + fp as double), 0), 6) as precision, round(tp / nullif(cast(tp + fn as double), 0), 6) as recall, round(fp / nullif(cast(fp + tn as double), 0), 6) as fpr from (select strategy, count(*) filter (f and y) as tp, count(*) filter (f and not y) as fp, count(*) filter (not f and y) as fn, count(*) filter (not f and not y) as tn from ({_CONFUSION}) group by 1)"),
    "daily_volume": duck("select cast(cast(event_time as date) as varchar) as day, event_type, count(*) as n from (select event_time, event_type from auths union all select event_time, event_type from settlements) group by 1, 2"),
    "daily_quarantine": duck("select day, coalesce(c, 0) as clean, coalesce(b, 0) as quarantined, round(coalesce(b, 0) / cast(coalesce(b, 0) + coalesce(c, 0) as double), 6) as quarantine_rate from (select cast(cast(_ingested_at as date) as varchar) as day, count(*) as c from (select _ingested_at from auths union all select _ingested_at from settlements) group by 1) x full outer join (select cast(cast(_ingested_at as date) as varchar) as day, count(*) as b from quarantine group by 1) y using (day)"),
    "latest_flagged": duck(f"select transaction_id, substr(card_id_hash, 1, 12) as card, {_FIRED} as rules_fired, coalesce(fraud_type, '-') as fraud_type from flags where {_ANY} order by event_time desc, transaction_id desc limit 50"),
    "incremental_load": duck("select transaction_id, round(cast(case when _source_file = 'batch_1.parquet' then amount + 5 else amount end as double), 6) as amount, _source_file from auths"),
    "no_rows_dropped": duck("select count(*) as dropped from bronze b where transaction_id is not null and transaction_id not in (select transaction_id from auths) and transaction_id not in (select transaction_id from settlements) and transaction_id not in (select transaction_id from quarantine where transaction_id is not null)"),
    "orphans_in_quarantine": duck("select q.transaction_id is not null as auth_quarantined, count(*) as n from recon r left join (select distinct transaction_id from quarantine) q on r.of_auth = q.transaction_id where r.recon_status = 'ORPHAN_SETTLEMENT' group by 1"),
    "incremental_empty_target": duck("select transaction_id from auths"),
    "data_tests": duck(_SUITE),
    "fraud_rate_by_split": duck(f"select split, is_fraud, count(*) as n, round(count(*) / sum(count(*)) over (partition by split), 6) as share from (select split, cast(is_fraud as bigint) as is_fraud from {_SPLIT}) group by 1, 2"),
    "train_medians": duck(f"select round(m1, 6) as minutes_since_last_txn, round(m2, 6) as amount_avg_24h from {_MEDIANS}"),
    "imputed_features": duck(f"select transaction_id, round(cast(amount as double), 6) as amount, cast(n1 as double) as txn_count_1h, cast(n24 as double) as txn_count_24h, round(coalesce(cast(s24 as double), 0.0), 6) as amount_sum_24h, round(coalesce(avg24, m2), 6) as amount_avg_24h, round(coalesce(cast(amount as double) / nullif(avg24, 0), 1.0), 6) as amount_vs_avg_24h_ratio, round(coalesce(minutes, m1), 6) as minutes_since_last_txn, cast(countries as double) as distinct_countries_24h, round(coalesce(speed, 0.0), 6) as implied_speed_kmh from {_SPLIT} cross join {_MEDIANS}"),
    "recall_long": duck(f"select fraud_type, s as strategy, round(avg(case when f then 1.0 else 0.0 end), 6) as recall from (select fraud_type, unnest(['rule_velocity', 'rule_geo', 'rule_amount', 'any_rule']) as s, unnest([rule_velocity, rule_geo, rule_amount, {_ANY}]) as f from flags where is_fraud = 1) group by 1, 2"),
    "settlement_drift": duck("select mcc, band, n, round(n / sum(n) over (partition by mcc), 6) as share from (select a.mcc, case when s.amount = a.amount then 'exact' when abs(s.amount - a.amount) * 20 <= a.amount then 'small' when s.amount > a.amount then 'tip' else 'below' end as band, count(*) as n from auths a join settlements s on s.auth_transaction_id = a.transaction_id where a.auth_code = '00' group by 1, 2)"),
    "speed_audit": duck("""select transaction_id, c <> country as cross_country, round(km, 3) as km, round(hours, 4) as hours from (select *, 2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(lat - y) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * pow(sin(radians(lon - x) / 2), 2)))) as km, (epoch_us(event_time) - epoch_us(was)) / 3.6e9 as hours
      from (select *, lag(country) over w as c, lag(lat) over w as y, lag(lon) over w as x, lag(card_present) over w as cp, lag(event_time) over w as was from auths window w as (partition by card_id_hash order by event_time, transaction_id)))
      where was is not null and (c <> country or (cp and card_present)) and km > 900 * hours"""),
    "defects_by_file": duck("select _source_file, reason, count(*) as n from (select _source_file, unnest(rs) as reason from quarantine) group by 1, 2"),
    "merchant_drift": duck("select * from (select merchant_id, count(*) as versions, coalesce(min(merchant_name) <> max(merchant_name), false) as merchant_name_changed, coalesce(min(mcc) <> max(mcc), false) as mcc_changed from hist group by 1) where merchant_name_changed or mcc_changed"),
    "labelled_breaks": duck("select recon_status, case when is_break then 'Break' else 'Clean' end as outcome, case when is_matured then 'Matured' else 'Pending maturity' end as maturity, count(*) as n from recon group by all"),
    "interval_slice": duck("select transaction_id, event_time, round(amount, 6) as amount, currency from bronze where _ingested_at >= timestamp '2024-01-10' and _ingested_at < timestamp '2024-01-20'"),
}
ORACLES |= {name: ORACLES[other] for name, other in SAME.items()}
