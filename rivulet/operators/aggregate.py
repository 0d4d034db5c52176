"""Grouped and co-grouped aggregation of streams.

Built-in aggregates combine before the shuffle, so a frequent key sends one row a task. An ordered fold with arbitrary
steps must see a key's values in one place and in order; it is there for reducers that no built-in aggregate expresses.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accepted(df: DataFrame, values_too: bool = True) -> DataFrame:
    """Without null keys; without null values too if the aggregation is not windowed."""
    df = df.where(F.col("key").isNotNull())
    return df.where(F.col("value").isNotNull()) if values_too else df


def count(df: DataFrame, by: Sequence[str] = ("key",), name: str = "count", values_too: bool = True) -> DataFrame:
    return accepted(df, values_too).groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def aggregate(df: DataFrame, aggs: dict[str, Column], by: Sequence[str] = ("key",), values_too: bool = True) -> DataFrame:
    """Built-in aggregates by key; combined before the shuffle."""
    return accepted(df, values_too).groupBy(*by).agg(*(c.alias(n) for n, c in aggs.items()))


def fold(df: DataFrame, zero: Column, step: Callable[[Column, Column], Column], by: Sequence[str] = ("key",), name: str = "value", finish: Callable[[Column], Column] | None = None, values_too: bool = True) -> DataFrame:
    """An ordered fold over a key's values by offset. The first argument of step is the accumulator, of zero's type."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"])
    out = F.aggregate(ordered, zero, step, finish) if finish else F.aggregate(ordered, zero, step)
    return accepted(df, values_too).groupBy(*by).agg(out.alias(name))


def reduce(df: DataFrame, step: Callable[[Column, Column], Column], by: Sequence[str] = ("key",), name: str = "value", values_too: bool = True) -> DataFrame:
    """An ordered reduction: the first value seeds."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"])
    return accepted(df, values_too).groupBy(*by).agg(ordered.alias("__all")).select(*by, F.aggregate(F.slice("__all", 2, F.greatest(F.size("__all"), F.lit(1))), F.get("__all", F.lit(0)), step).alias(name))


def changelog(df: DataFrame, aggs: dict[str, Column], by: Sequence[str] = ("key",), values_too: bool = True) -> DataFrame:
    """Every intermediate result: one row for each accepted record, in arrival order of its key."""
    upto = Window.partitionBy(*by).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    return accepted(df, values_too).select(*by, "offset", "ts", *(c.over(upto).alias(n) for n, c in aggs.items()))


def cached(changelog_: DataFrame, commit: int, by: Sequence[str] = ("key",)) -> DataFrame:
    """What a caching store forwards of a changelog: a key's last update of each `commit` offsets. Maxima combine before the shuffle."""
    rest = [c for c in changelog_.columns if c not in by]
    last = changelog_.groupBy(*by, F.floor(F.col("offset") / F.lit(commit)).alias("__commit")).agg(F.max_by(F.struct(*rest), "offset").alias("__r"))
    return last.select(*by, "__r.*")


def list_values(df: DataFrame, by: Sequence[str] = ("key",)) -> DataFrame:
    """A list-value store: a key's values in order of offset; a null value deletes the list so far.

    A key's list is one row, as it is in such a store.
    """
    keyed = df.where(F.col("key").isNotNull())
    cut = keyed.where("value IS NULL").groupBy(*by).agg(F.max("offset").alias("__cut"))
    left = keyed.where("value IS NOT NULL").join(cut, list(by), "left").where(F.col("__cut").isNull() | (F.col("offset") > F.col("__cut")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"])
    return left.groupBy(*by).agg(ordered.alias("value"))


def cogroup(streams: dict[str, DataFrame], aggs: dict[str, Callable[[Callable[[Column], Column]], Column]], by: Sequence[str] = ("key",), values_too: bool = True) -> DataFrame:
    """Several streams into one accumulator.

    aggs maps a result to (source name, aggregate of a column): the column is null for rows of other streams, which
    built-in aggregates skip. One pass over the tagged union, one shuffle.
    """
    tagged = None
    for name, df in streams.items():
        part = accepted(df, values_too).withColumn("__source", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)

    def of(name: str) -> Callable[[Column], Column]:
        return lambda c: F.when(F.col("__source") == name, c)

    return tagged.groupBy(*by).agg(*(make(of).alias(n) for n, make in aggs.items()))
