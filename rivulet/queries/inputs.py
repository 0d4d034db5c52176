"""Streams and tables that the registered queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.record import HEADERS, header, millis, table

DAY, HOUR = 86_400_000, 3_600_000
FIRST = 1_704_067_200_000  # 2024-01-01


def events(spark, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("key"),
        F.col("event_type").alias("value"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        millis(F.col("ts")).alias("ts"),
        F.col("event_id").alias("offset"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        "props",
        F.concat(F.lit("events-"), "event_type").alias("topic"),
    )


def with_nulls_key() -> Column:
    return F.when(F.col("offset") % 17 != 0, F.col("key"))


def with_nulls(spark, d: str) -> DataFrame:
    return events(spark, d).withColumns({"key": with_nulls_key(), "value": F.when(F.col("offset") % 13 != 0, F.col("value"))})


#: Records that arrive out of order among each other; a prime, so that offsets stay different.
MIXED = 1_000_003


def disordered(spark, d: str) -> DataFrame:
    """The events out of order within runs of MIXED records, at any number of them."""
    at = F.col("offset")
    return events(spark, d).withColumn("offset", F.floor(at / F.lit(MIXED)) * MIXED + at % MIXED * 7919 % MIXED)


def records(spark, d: str) -> DataFrame:
    """A log with headers and a struct value (event_type, cents, props); every thirteenth is a tombstone."""
    e = events(spark, d)
    value = F.struct(F.col("value").alias("event_type"), "cents", "props")
    return e.select("topic", "partition", "offset", "ts", F.array(header("type", F.col("value")), header("user", F.col("key").cast("string"))).cast(HEADERS).alias("headers"), "key", F.when(F.col("offset") % 13 != 0, value).alias("value"))


def orders_log(spark, d: str) -> DataFrame:
    """Orders as updates of their customer: value the status (null for every eleventh), cents the price."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("value"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), millis(F.col("o_orderdate")).alias("ts"), F.col("o_orderkey").alias("offset"))


def customers(spark, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(0).cast("long").alias("ts"), F.col("c_custkey").alias("offset"), F.col("c_nationkey").alias("nation"))


#: The same tables in SQL.
ORDERS = """o AS (SELECT o_custkey AS key, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS value, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, epoch_us(o_orderdate) // 1000 AS ts, o_orderkey AS "offset" FROM orders),
latest AS (SELECT * FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY "offset" DESC) = 1) WHERE value IS NOT NULL)
"""
