"""Incremental upkeep: watermark filter, keyed upsert, schema check, and type-2 history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newer(source: DataFrame, target: DataFrame, column: str = "_ingested_at") -> DataFrame:
    """Rows above the target's high watermark; all rows if the target is empty."""
    mark = target.agg(F.coalesce(F.max(column), F.lit("1970-01-01").cast("timestamp")).alias("mark"))
    return source.crossJoin(F.broadcast(mark)).where(F.col(column) > F.col("mark")).drop("mark")


def upsert(target: DataFrame, source: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Source rows replace target rows of the same key; columns in `keep` stay as they were. Of rows
    that share a key in the source the last ingested goes in (then by file, then by row hash); null
    keys are all kept."""
    if target.schema.simpleString() != source.schema.simpleString():
        raise ValueError("schema drift")
    names = source.columns
    order = F.struct(*[c for c in ("_ingested_at", "_source_file") if c in names], F.xxhash64(*names))
    last = source.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*names), order).alias("row")).select("row.*")
    source = last.unionByName(source.where(F.col(key).isNull()))
    if keep:
        old = target.select(key, *[F.col(c).alias(f"old_{c}") for c in keep])
        kept = source.join(old, key, "left")
        source = kept.withColumns({c: F.coalesce(f"old_{c}", c) for c in keep}).select(*source.columns)
    return target.join(source, key, "left_anti").select(*target.columns).unionByName(source)


def snapshot(history: DataFrame | None, current: DataFrame, key: str, checked: tuple[str, ...], now: str) -> DataFrame:
    """Type-2 history: a change of `checked` (null-safe) closes the open version and opens a new
    one; new keys open one; keys that are gone stay open. One full outer join on the key."""
    at = F.lit(now).cast("timestamp")
    fresh = current.withColumns({"valid_from": at, "valid_to": F.lit(None).cast("timestamp")})
    if history is None:
        return fresh
    same = F.lit(True)
    for c in checked:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    opened = history.where("valid_to is null").alias("o")
    pair = opened.join(fresh.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    had, has = F.col("o.valid_from").isNotNull(), F.col("n.valid_from").isNotNull()
    ends = F.when(had & has & ~same, at)
    old = F.when(had, F.struct(*[F.col(f"o.{c}") if c != "valid_to" else ends.alias(c) for c in history.columns]))
    new = F.when(has & (~had | ~same), F.struct(*[F.col(f"n.{c}") for c in history.columns]))
    rows = pair.select(F.explode(F.array_compact(F.array(old, new))).alias("row")).select("row.*")
    return history.where("valid_to is not null").unionByName(rows)
