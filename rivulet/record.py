"""The log-record model.

Streams are DataFrames with key, value, ts (event time, milliseconds since the epoch, a long) and offset (arrival order
within a partition); records of a log also have topic, partition and headers. Milliseconds as whole numbers make window
arithmetic exact and independent of the session's time zone.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADERS = "array<struct<key: string, value: binary>>"
STREAM_COLUMNS = ("key", "value", "ts", "offset")


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, if the path exists there; else it must be shipped with the job."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def millis(ts: Column) -> Column:
    """Milliseconds since the epoch of a timestamp with or without time zone; microseconds are cut off."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts) / F.lit(1000)).cast("long")


def duration(value: int | float | str) -> int:
    """Milliseconds of a number (milliseconds) or of a text such as '5 seconds', '2 hours', '1 day'."""
    if isinstance(value, (int, float)):
        return int(value)
    units = {"millisecond": 1, "ms": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}
    number, unit = value.split()
    if (unit := unit.rstrip("s") if unit != "ms" else unit) not in units:
        raise ValueError(f"unknown unit of time: {value}")
    return int(float(number) * units[unit])


def header(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log: key user_id, value struct(event_type, value, props), topic by type, four partitions."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("events-"), "event_type").alias("topic"),
        F.pmod("user_id", F.lit(4)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        millis(F.col("ts")).alias("ts"),
        F.array(header("type", F.col("event_type"))).cast(HEADERS).alias("headers"),
        F.col("user_id").alias("key"),
        F.struct("event_type", "value", "props").alias("value"),
    )


def stream(df: DataFrame, key: Column, value: Column, ts: Column, offset: Column) -> DataFrame:
    return df.select(key.alias("key"), value.alias("value"), ts.alias("ts"), offset.alias("offset"))
