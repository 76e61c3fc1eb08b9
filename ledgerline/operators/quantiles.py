"""Exact, linearly interpolated quantiles by histogram refinement, and exact splits by hash thresholds.

Neither sorts the data. A quantile's rank is narrowed to one bin of a histogram, then of a finer one over that bin,
until its rows have one value or are few; each round is one aggregation that sends BINS rows at most for each bin open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, FEW = 4096, 4096


def exact_quantiles(df: DataFrame, column: str, shares: tuple[float, ...], bins: int = BINS, few: int = FEW) -> list[float | None]:
    """The quantiles of a numeric column at `shares`, interpolated between neighbouring ranks; nulls
    and NaN do not count, and without values all are None. Pass a stored frame: each round reads the column once."""
    x = F.col(column).cast("double")
    values = df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x))
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(shares)
    ranks = sorted({r for s in shares for r in (int(s * (n - 1)), min(n - 1, int(s * (n - 1)) + 1))})
    found: dict[int, float] = {}
    # (least value, greatest value, rows below, rows) of the bins that hold a rank not found yet.
    open_ = [(low, high, 0, n)]
    while open_:
        done = [b for b in open_ if b[0] == b[1]]
        found |= {r: lo for lo, _, below, k in done for r in ranks if below <= r < below + k}
        open_ = [b for b in open_ if b[0] != b[1]]
        small = [b for b in open_ if b[3] <= few]
        if small:
            inside = [(F.col("x") >= lo) & (F.col("x") <= hi) for lo, hi, _, _ in small]
            rows = values.where(any_of(inside)).toPandas()["x"].sort_values().to_numpy()
            for lo, hi, below, k in small:
                own = rows[(rows >= lo) & (rows <= hi)]
                found |= {r: float(own[r - below]) for r in ranks if below <= r < below + k}
        open_ = [b for b in open_ if b[3] > few]
        if not open_:
            break
        bracket = F.coalesce(*[F.when((F.col("x") >= lo) & (F.col("x") <= hi), i) for i, (lo, hi, _, _) in enumerate(open_)])
        part = F.coalesce(*[F.when(F.col("b") == i, F.least(F.lit(bins - 1), F.floor((F.col("x") / 2 - lo / 2) / (hi / 2 - lo / 2) * bins))) for i, (lo, hi, _, _) in enumerate(open_)])
        got = values.withColumn("b", bracket).where("b is not null").groupBy("b", part.alias("part")).agg(F.count("*").alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b", "part").collect()
        narrower, below, now = [], 0, None
        for r in got:
            if r["b"] != now:
                now, below = r["b"], open_[r["b"]][2]
            if any(below <= rank < below + r["k"] for rank in ranks):
                narrower.append((r["lo"], r["hi"], below, r["k"]))
            below += r["k"]
        open_ = narrower
    out = []
    for s in shares:
        at = s * (n - 1)
        a, b = found[int(at)], found[min(n - 1, int(at) + 1)]
        out.append(a + (b - a) * (at - int(at)) if a != b else a)
    return out


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def quantile_rows(df: DataFrame, columns: tuple[str, ...], shares: tuple[float, ...]) -> DataFrame:
    """(feature, share, value) for each column and share."""
    rows = [(c, s, v) for c in columns for s, v in zip(shares, exact_quantiles(df, c, shares))]
    return df.sparkSession.createDataFrame(rows, "feature string, share double, value double")


def hash32(key: str, seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.col(key), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("long")


def stratified_split(df: DataFrame, label: str, key: str = "transaction_id", ratio: float = 0.75, seed: int = 42) -> DataFrame:
    """df with `split`: of each label's n rows those with the least hashes are train, n minus the rest's
    share rounded up; the others test. Sizes are exact for each label, and no sort goes over all rows: the threshold is
    found by two histograms over 16 bits of the hash each, and only rows at the threshold itself are ranked, by key. Null keys hash as one and
    null labels are a label; which of wholly equal keys go to train is open, their number is not."""
    h = F.coalesce(hash32(key, seed), F.lit(0))
    rows = df.withColumns({"_h": h, "_label": F.col(label).cast("string")})
    sizes = rows.groupBy("_label").agg(F.count("*").alias("_n")).select("_label", (F.col("_n") - F.ceil(F.round(F.col("_n") * (1 - ratio), 9))).alias("_want"))
    high = narrowed(rows.withColumn("_part", F.col("_h").bitwiseAND(0xFFFF0000)), sizes)
    inner = rows.join(F.broadcast(high), same("_label")).where(F.col("_h").bitwiseAND(0xFFFF0000) == F.col("_at")).drop("_l")
    low = narrowed(inner.withColumn("_part", F.col("_h")).drop("_at", "_want"), high.select(F.col("_l").alias("_label"), "_want"))
    bound = rows.join(F.broadcast(low), same("_label")).drop("_l")
    clear = bound.where("_h <> _at").withColumn("split", F.when(F.col("_h") < F.col("_at"), "train").otherwise("test"))
    rank = F.row_number().over(Window.partitionBy("_label").orderBy(key))
    edge = bound.where("_h = _at").withColumn("_rank", rank).withColumn("split", F.when(F.col("_rank") <= F.col("_want"), "train").otherwise("test"))
    return clear.select(*df.columns, "split").unionByName(edge.select(*df.columns, "split"))


def same(label: str) -> Column:
    return F.col(label).eqNullSafe(F.col("_l"))


def narrowed(rows: DataFrame, want: DataFrame) -> DataFrame:
    """(_l, _at, _want): for each label the _part in which its wanted-th least row stands, and how many of that part are wanted."""
    per = rows.groupBy("_label", "_part").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy("_label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = want.select(F.col("_label").alias("_l"), "_want")
    found = per.withColumn("_before", before).join(F.broadcast(w), same("_label"))
    # Nothing wanted: the first part, and none of it.
    hit = (F.col("_before") < F.greatest("_want", F.lit(1))) & (F.greatest("_want", F.lit(1)) <= F.col("_before") + F.col("_k"))
    return found.where(hit).select("_l", F.col("_part").alias("_at"), (F.col("_want") - F.col("_before")).alias("_want"))
