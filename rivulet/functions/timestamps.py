"""Event-time extraction and what to do with invalid (negative or null) times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators import scan
from rivulet.operators.windows import BLOCK_OFFSETS


def _invalid(ts: Column) -> Column:
    return ts.isNull() | (ts < 0)


def fail_on_invalid(df: DataFrame, ts: Column | None = None) -> DataFrame:
    ts = F.col("ts") if ts is None else ts
    return df.withColumn("ts", F.when(_invalid(ts), F.raise_error(F.concat(F.lit("invalid timestamp: "), F.coalesce(ts.cast("string"), F.lit("null"))))).otherwise(ts).cast("long"))


def skip_invalid(df: DataFrame, ts: Column | None = None) -> DataFrame:
    ts = F.col("ts") if ts is None else ts
    return df.withColumn("ts", ts).where(~_invalid(F.col("ts")))


def partition_time_if_invalid(df: DataFrame, ts: Column | None = None, partition: str = "partition") -> DataFrame:
    """Invalid times become the largest valid time so far of the partition; before any valid one the record goes."""
    ts = F.col("ts") if ts is None else ts
    valid = F.when(~_invalid(ts), ts)
    rows = scan.running(df.withColumn("ts", valid), [partition], ["offset"], F.floor(F.col("offset") / F.lit(BLOCK_OFFSETS)), __newest=("max", F.col("ts")))
    return rows.withColumn("ts", F.coalesce("ts", "__newest")).drop("__newest").where(F.col("ts").isNotNull())


def wall_clock(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.unix_millis(F.current_timestamp()))


def from_field(df: DataFrame, field: Column) -> DataFrame:
    return df.withColumn("ts", field.cast("long"))


def log_append_time(df: DataFrame, create: str, append: str, use_append: bool) -> DataFrame:
    return df.withColumn("ts", F.col(append if use_append else create))
