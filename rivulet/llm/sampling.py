"""Which rows a classifier may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 3, 1


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id's text mod 3 is 1; a null id is not, but isn't learned from either."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def learnable(key: Column) -> Column:
    return key.isNotNull() & ~held_out(key)


def bounded_sample(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """At most `most` rows, about as many of each label, by the smallest hashes of their keys.

    If there are more labels than `most`, the most frequent ones have one row each. A hash threshold from the label's
    count comes first, so that no task gathers a frequent label's rows.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.orderBy(F.desc("n"), label).limit(most).collect()
    each = max(1, most // max(1, len(counts)))
    bounds = [(r[label], min(2.0, (each * 1.5 + 30) / r["n"])) for r in counts]  # at most `most` rows
    bounds = rows.sparkSession.createDataFrame(bounds, f"__label {rows.schema[label].dataType.simpleString()}, __bound double")
    unit = (F.xxhash64(key, F.lit("sample")).bitwiseAND(F.lit((1 << 31) - 1))) / F.lit(float(1 << 31))
    kept = rows.join(F.broadcast(bounds), (F.col(label) == F.col("__label")) & (unit < F.col("__bound")))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(unit, key))
    return kept.withColumn("__rank", rank).where(F.col("__rank") <= each).drop("__rank", "__label", "__bound")
