"""The Bronze event table, derived from `events` by SQL (FIXTURES.md), in Spark's dialect and DuckDB's."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The event record's schema, in file order.
EVENT_SCHEMA = (
    "transaction_id string, event_type string, event_time string, auth_transaction_id string, card_id string, "
    "merchant_id string, merchant_name string, mcc string, mcc_description string, amount double, currency string, "
    "country string, lat double, lon double, channel string, pos_entry_mode string, card_present boolean, "
    "auth_code string, is_fraud tinyint, fraud_type string"
)

BRONZE_SQL = r"""
with m as (select *, case when event_id % 67 = 5 and event_id % 3 = 1 then (user_id+3) % 7 else user_id % 7 end + 7 * (event_id % 6) as mi, event_id % 401 as dk,
   cast(round(value * 100) as bigint) * case when event_id % 41 = 1 then 30 when event_id % 67 = 5 and event_id % 3 = 2 then 20 else 1 end as cents,
   case when ts < timestamp '2024-01-16 00:00:00' then 1 else 2 end as bt from events),
mm as (select *, mi % 7 as ci, mi % 10 as ki, event_id % 20 as ch,
   case when event_id % 25 = 3 then '51' else '00' end as ac from m),
j as (select mm.*, cents / 100.0D as amt, c.country as cc, c.cur, c.la + (mi % 5) * 0.05 as la2, c.lo as lo2, k.mcc as mc, k.descr as md,
   case when event_id % 67 = 5 then 1 else 0 end as fr,
   case when event_id % 67 = 5 then case event_id % 3 when 0 then 'velocity' when 1 then 'geo_impossible' else 'amount_anomaly' end end as ft,
   concat('Merchant ', mi, case when bt = 2 and mi % 10 = 0 then ' v2' else '' end) as mname
   from mm join (values (0,'SG','SGD',1.35D,103.82D),(1,'MY','MYR',3.14D,101.69D),(2,'ID','IDR',-6.20D,106.85D),(3,'TH','THB',13.75D,100.50D),(4,'US','USD',40.71D,-74.01D),(5,'GB','GBP',51.51D,-0.13D),(6,'AU','AUD',-33.87D,151.21D)) c(i,country,cur,la,lo) on c.i = ci
   join (values (0,'5411','Grocery Stores'),(1,'5812','Restaurants'),(2,'5541','Gas Stations'),(3,'5999','Retail Misc'),(4,'4111','Transport/Commuter'),(5,'5732','Electronics'),(6,'7011','Hotels'),(7,'4511','Airlines'),(8,'5967','Direct Marketing (high fraud MCC)'),(9,'6011','ATM Cash Withdrawal')) k(i,mcc,descr) on k.i = ki)
select case when dk=0 then null else concat('t',event_id) end as transaction_id,
  case when dk=5 then 'REVERSAL' else 'AUTH' end as event_type,
  case when dk=4 then '2026-13-45 99:99:99' else date_format(ts,"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'") end as event_time,
  cast(null as string) as auth_transaction_id,
  case when dk=1 then null else concat('card_',user_id) end as card_id,
  concat('m_',mi) as merchant_id, mname as merchant_name, mc as mcc, md as mcc_description,
  case when dk=2 then 0.0D when dk=6 then -amt else amt end as amount,
  case when dk in (3,6) then 'XXX' else cur end as currency, cc as country, la2 as lat, lo2 as lon,
  case when ch<9 then 'POS' when ch<15 then 'ONLINE' when ch<17 then 'ATM' else 'CONTACTLESS' end as channel,
  case when ch<9 then 'CHIP' when ch<15 then 'ECOMMERCE' when ch<17 then 'CHIP' else 'CONTACTLESS' end as pos_entry_mode,
  (ch<9 or ch>=15) as card_present, ac as auth_code, cast(fr as tinyint) as is_fraud, ft as fraud_type,
  case bt when 1 then timestamp '2024-01-16 00:00:00' else timestamp '2024-02-01 00:00:00' end as _ingested_at, concat('batch_',bt,'.parquet') as _source_file from j
union all
select concat('s',event_id),'SETTLEMENT',date_format(ts + make_dt_interval(0, cast(2 + event_id % 47 as int), 0, 0),"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"),concat('t',event_id),concat('card_',user_id),concat('m_',mi),mname,mc,md,
  cast(floor(cents * (100 + case event_id % 10 when 0 then 15 when 1 then 3 when 2 then -3 else 0 end) / 100.0D) as bigint) / 100.0D,cur,cc,null,null,null,null,null,null,cast(fr as tinyint),ft,
  case bt when 1 then timestamp '2024-01-16 00:00:00' else timestamp '2024-02-01 00:00:00' end, concat('batch_',bt,'.parquet') from j where event_id % 20 <> 13 and ac='00'
union all
select concat('o',event_id),'SETTLEMENT',date_format(ts + make_dt_interval(0, cast(2 + event_id % 47 as int), 0, 0),"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"),concat('x',event_id),concat('card_',user_id),concat('m_',mi),mname,mc,md,amt,cur,cc,null,null,null,null,null,null,cast(0 as tinyint),cast(null as string),
  case bt when 1 then timestamp '2024-01-16 00:00:00' else timestamp '2024-02-01 00:00:00' end, concat('batch_',bt,'.parquet') from j where event_id % 200 = 7
union all
select concat('v',event_id,'_',n),'AUTH',date_format(ts + make_dt_interval(0,0,0,cast(10*n as decimal(18,6))),"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"),null,concat('card_',user_id),concat('m_',mi),mname,mc,md,amt,cur,cc,la2,lo2,'ONLINE','ECOMMERCE',false,'00',cast(1 as tinyint),'velocity',
  case bt when 1 then timestamp '2024-01-16 00:00:00' else timestamp '2024-02-01 00:00:00' end, concat('batch_',bt,'.parquet') from j cross join (values (1),(2),(3),(4),(5),(6)) b(n) where event_id % 67 = 5 and event_id % 3 = 0
"""


def duckdb_bronze() -> str:
    """BRONZE_SQL in DuckDB's dialect."""
    out = BRONZE_SQL.replace("cast(null as string)", "cast(null as varchar)")
    out = re.sub(r"(-?\d+\.\d+)D", r"(\1::double)", out)
    out = out.replace("""date_format(""", "strftime(").replace("""\"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'\"""", "'%Y-%m-%dT%H:%M:%S.%f+00:00'")
    out = re.sub(r"make_dt_interval\(0, cast\((.*?) as int\), 0, 0\)", r"to_hours(cast(\1 as bigint))", out)
    return out.replace("make_dt_interval(0,0,0,cast(10*n as decimal(18,6)))", "to_seconds(10*n)")


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.sql(BRONZE_SQL.replace("from events", "from {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Parquet batches under the declared schema."""
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def decode(messages: DataFrame) -> DataFrame:
    """Events from message bodies (column value, JSON)."""
    return messages.selectExpr(f"from_json(cast(value as string), '{EVENT_SCHEMA}') as e").select("e.*")


def encode(events: DataFrame) -> DataFrame:
    """(key, value): the card as key, the event as JSON with its nulls."""
    return events.selectExpr("cast(card_id as binary) as key", "to_json(struct(*), map('ignoreNullFields', 'false')) as value")
