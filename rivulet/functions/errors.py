"""Deserialization, processing and delivery errors: fail, continue, or set aside with the reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parsed(df: DataFrame, column: str, kind: StructType, on_error: str = "continue") -> tuple[DataFrame, DataFrame]:
    """(good, dead letters) of JSON text in a column. Good rows have the parsed value; dead letters the raw text and a reason.

    on_error: `continue` sets bad rows aside, `fail` makes the first one an error. Null text is a null value, not an error.
    """
    corrupt = "__corrupt"
    wide = StructType([*kind.fields]).add(corrupt, "string")
    out = df.withColumn("__p", F.from_json(F.col(column), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}))
    bad = F.col(column).isNotNull() & (F.col("__p").isNull() | F.col(f"__p.{corrupt}").isNotNull())
    value = F.when(F.col(column).isNotNull(), F.struct(*(F.col(f"__p.{f}").alias(f) for f in kind.names)))
    if on_error == "fail":
        value = F.when(bad, F.raise_error(F.concat(F.lit("cannot parse: "), F.col(column)))).otherwise(value)
        return out.withColumn(column, value).drop("__p"), df.where(F.lit(False)).withColumn("reason", F.lit(""))
    good = out.where(~bad).withColumn(column, value).drop("__p")
    return good, out.where(bad).drop("__p").withColumn("reason", F.lit("malformed JSON"))


def tolerated(df: DataFrame, check: Column, reason: str, tolerance: str = "all") -> tuple[DataFrame, DataFrame]:
    """(good, dead letters) by a check that good rows meet; with tolerance `none` a bad row is an error."""
    ok = F.coalesce(check, F.lit(False))
    if tolerance == "none":
        return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit(reason)).cast("boolean"))), df.where(F.lit(False)).withColumn("reason", F.lit(reason))
    return df.where(ok), df.where(~ok).withColumn("reason", F.lit(reason))


def processed(df: DataFrame, value: Callable[[Column], Column], fallback: str = "continue") -> tuple[DataFrame, DataFrame]:
    """(good, dead letters) of a computation of the value that gives null where it fails (a try_ function).

    `continue` sets records aside whose value can't be computed, `fail` makes the first one an error.
    """
    out = df.withColumn("__v", value(F.col("value")))
    bad = F.col("value").isNotNull() & F.col("__v").isNull()
    if fallback == "fail":
        out = out.withColumn("__v", F.when(bad, F.raise_error(F.concat(F.lit("cannot process: "), F.col("value").cast("string")))).otherwise(F.col("__v")))
        return out.withColumn("value", F.col("__v")).drop("__v"), df.where(F.lit(False)).withColumn("reason", F.lit(""))
    return out.where(~bad).withColumn("value", F.col("__v")).drop("__v"), out.where(bad).drop("__v").withColumn("reason", F.lit("the value can't be computed"))


def delivering(write: Callable[[DataFrame, int], None], on_error: Callable[[Exception, int], str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink with a handler that says `continue` or `fail` for a batch that can't be delivered."""

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            write(batch, batch_id)
        except Exception as e:
            if on_error(e, batch_id) != "continue":
                raise

    return run
