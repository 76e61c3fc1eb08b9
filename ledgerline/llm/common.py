"""Small helpers that all operators of this subpackage share.

Rows are identified by content where an operator must find them again: doc_id may be null
or repeated, so ``row_key`` pairs it with a hash of the text. Identical rows share a key
and get identical results.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python worker at once; texts may be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20
#: Words of 64 bits of the bitmap of `maybe_among`.
BITMAP = 1 << 17


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches small enough for very long texts: bounded by rows
    and, where Spark can, by bytes. Smaller settings of the caller stay."""
    spark = df.sparkSession
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not 0 < size_in_bytes(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return spark


def size_in_bytes(setting: str) -> int:
    """A count or size setting as a number: "10000", "64m", "-1"."""
    found = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", setting.strip().lower())
    return int(found[1]) << " kmgt".index(found[2] or " ") * 10 if found else 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without that setting a
    session on one machine gets a temporary folder; a cluster is an error, since its executors
    would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and
    gives Catalyst real sizes, so that it broadcasts a side only below its threshold."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Removes staged folders whose rows nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """`staged`, but the folders go at the end of the block, except those of keep=True, which
    hold what a lazy result still reads (the owner of the shared folder clears those)."""
    paths: list[str] = []

    def write(df: DataFrame, name: str = "step", keep: bool = False) -> DataFrame:
        out = staged(df, name)
        if not keep:
            paths.append(out.inputFiles()[0].rsplit("/", 1)[0] if out.inputFiles() else "")
        return out

    try:
        yield write
    finally:
        forget(spark, [p for p in paths if p])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(*values: str | Column) -> Column:
    """64-bit key of a row's content, nulls told apart from empty strings."""
    columns = [F.col(v) if isinstance(v, str) else v for v in values]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def crc_mod(name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fixed folds of the labelled operators. A null id
    has the remainder of the empty string, 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(modulus)).cast("int")


def hash_fraction(seed: int, *cols: Column) -> Column:
    """Uniform in [0, 1), a function of the values alone: the same on reruns and for any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / float(1 << 40)


def bounded_rates(rows: DataFrame, by: str, cap: int) -> Column:
    """For each value of `by` the rate of rows to take so that about `cap` are (give or take
    sampling error). The counts of the values go through the driver; `by` is a label with few."""
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(by).eqNullSafe(F.lit(value)), F.lit(min(1.0, cap / n))).otherwise(rate)
    return rate


def maybe_among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key may be in the first column of ids: a prefilter that loses none and lets a
    few others pass, so that a join that follows shuffles little else. What is broadcast is a
    bitmap of BITMAP words of 64 bits at most, whatever the number of ids; more ids only let more pass."""
    h = F.xxhash64(F.col(ids.columns[0]))
    slot, bit = free_name(rows, "slot"), free_name(rows, "bits")
    bits = ids.groupBy(h.bitwiseAND(BITMAP - 1).alias(slot)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))).alias(bit))
    own = F.xxhash64(F.col(key))
    held = F.call_function("shiftright", F.col(bit), F.shiftrightunsigned(own, 58).cast("int")).bitwiseAND(1) == 1
    near = rows.withColumn(free_name(rows, "own"), own.bitwiseAND(BITMAP - 1))
    near = near.join(F.broadcast(bits), F.col(free_name(rows, "own")) == F.col(slot)).where(held)
    return near.select(*rows.columns)


def free_name(df: DataFrame, stem: str = "x") -> str:
    """A column name that the frame does not have, whatever case its names are in."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
