"""Card features with no card in one task: time is cut into buckets, and sums carry over the borders.

The sliding windows are running sums of signed events: a row enters at its time and leaves when
the window has passed it, so that each count costs the same however many rows a window holds. A
running sum over a card is the sum within its bucket of time plus what all buckets before came to. Those
totals have one row for each card and bucket; only they are ordered by card. The last card-present
row, the last row of all and the neighbours of a country are carried in the same way.

A card with very many rows in one bucket needs a shorter one: results do not depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .velocity import features_of

HOUR, DAY = 3600, 86400


def before_buckets(df: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """For each keys and bucket: `totals` over the bucket, made running over all earlier buckets of the keys.
    A total is a sum, or else (a struct, whose first field orders it) the greatest before."""
    per = df.groupBy(*keys, "bucket").agg(*[c.alias(name) for name, c in totals.items()])
    order = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    kinds = dict(per.dtypes)
    carried = [(F.max(name) if kinds[name].startswith("struct") else F.sum(name)).over(order).alias(name) for name in totals]
    return per.select(*keys, "bucket", *carried)


def country_events(rows: DataFrame, bucket: int) -> DataFrame:
    """(card, t, d): when a country comes into the day before (d 1) and when it is out of it again (-1)."""
    keys = ["card_id_hash", "country"]
    per = rows.groupBy(*keys, "bucket").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    order = Window.partitionBy(*keys).orderBy("bucket")
    ends = per.select(*keys, "bucket", F.lag("hi").over(order).alias("hi"), F.lead("lo").over(order).alias("lo"))
    own = Window.partitionBy(*keys, "bucket").orderBy("u")
    near = rows.join(ends, [*keys, "bucket"]).withColumns({"was": F.coalesce(F.lag("u").over(own), F.col("hi")), "next": F.coalesce(F.lead("u").over(own), F.col("lo"))})
    enters = F.when(F.col("was").isNull() | (F.col("u") > F.col("was") + DAY), F.struct((F.col("u") + 1).alias("t"), F.lit(1).alias("d")))
    leaves = F.when(F.col("next").isNull() | (F.col("next") > F.col("u") + DAY), F.struct((F.col("u") + DAY + 1).alias("t"), F.lit(-1).alias("d")))
    return near.select("card_id_hash", F.explode(F.array_compact(F.array(enters, leaves))).alias("e")).select("card_id_hash", "e.t", "e.d")


def card_velocity_features(auths: DataFrame, bucket: int = DAY) -> DataFrame:
    """The rows of velocity.card_velocity_features. Rows without a card share one, as there; a null event_time is refused by Silver."""
    rows = auths.withColumn("card_id_hash", F.coalesce("card_id_hash", F.lit(""))).withColumn("u", F.unix_timestamp("event_time"))
    rows = rows.withColumn("bucket", F.floor(F.col("u") / bucket))
    whole = F.struct(*[F.col(c) for c in auths.columns], "u").alias("row")
    none, zero, money = F.lit(None), F.lit(0), F.lit(0).cast(dict(auths.dtypes)["amount"])
    kind = rows.select(whole).schema["row"].dataType
    event = lambda card, t, n1, n24, s24, d, row: [card, t.alias("t"), n1.alias("n1"), n24.alias("n24"), s24.alias("s24"), d.alias("d"), row.alias("row")]
    card, u, minus = F.col("card_id_hash"), F.col("u"), F.lit(-1)
    here = rows.select(*event(card, u, F.lit(1), F.lit(1), F.col("amount"), zero, whole))
    gone = rows.select("card_id_hash", F.explode(F.array(F.struct((u + HOUR + 1).alias("t"), minus.alias("n1"), zero.alias("n24"), money.alias("s24")), F.struct((u + DAY + 1).alias("t"), zero.alias("n1"), minus.alias("n24"), (-F.col("amount")).cast(money_type(auths)).alias("s24")))).alias("e"))
    gone = gone.select(*event(card, F.col("e.t"), F.col("e.n1"), F.col("e.n24"), F.col("e.s24"), zero, none.cast(kind)))
    land = country_events(rows.select("card_id_hash", "country", "u", "bucket").where("country is not null"), bucket)
    land = land.select(*event(card, F.col("t"), zero, zero, money, F.col("d"), none.cast(kind)))
    events = here.unionByName(gone).unionByName(land).withColumn("bucket", F.floor(F.col("t") / bucket))

    real = F.col("row").isNotNull()
    at = F.struct(F.col("t").alias("o"), F.col("row.event_time").alias("e"), F.col("row.transaction_id").alias("i"))
    present = F.when(real & F.col("row.card_present"), F.struct(at.alias("at"), F.col("row.u"), F.col("row.lat"), F.col("row.lon")))
    last = F.when(real, F.struct(F.col("t").alias("u")))
    sums = {f"b_{c}": F.sum(c) for c in ("n1", "n24", "s24", "d")} | {"b_n": F.sum(real.cast("int")), "b_present": F.max(present), "b_last": F.max(last)}
    carried = before_buckets(events, ["card_id_hash"], sums)
    both = events.join(carried, ["card_id_hash", "bucket"])
    running = Window.partitionBy("card_id_hash", "bucket").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("card_id_hash", "bucket").orderBy("t", F.col("row").isNotNull(), "row.event_time", "row.transaction_id").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.sum(c).over(running) + F.coalesce(f"b_{c}", F.lit(0))
    out = both.withColumns({
        "n1_": total("n1") - 1, "n24_": total("n24") - 1, "s24_": total("s24") - F.col("row.amount"), "countries": total("d"),
        "n": F.sum(real.cast("int")).over(running) + F.coalesce("b_n", F.lit(0)) - 1,
        "p": F.coalesce(F.last(present, ignorenulls=True).over(order), F.col("b_present")), "l": F.coalesce(F.last(last, ignorenulls=True).over(order), F.col("b_last")),
    })
    out = out.where(real).select("row.*", F.col("n1_").alias("n1"), F.col("n24_").alias("n24"), F.col("s24_").alias("s24"), "n", "countries", F.col("l.u").alias("prev"), F.col("p.u").alias("p_u"), F.col("p.lat").alias("p_lat"), F.col("p.lon").alias("p_lon"))
    return features_of(out.withColumn("card_id_hash", F.nullif("card_id_hash", F.lit(""))))


def money_type(auths: DataFrame) -> str:
    return dict(auths.dtypes)["amount"]
