"""Stateless stream operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true; null is not."""
    return df.where(predicate)


def keep_not(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate isn't true: null is kept."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def map_pairs(df: DataFrame, key: Column, value: Column) -> DataFrame:
    return df.withColumns({"key": key, "value": value})


def map_values(df: DataFrame, value: Column) -> DataFrame:
    return df.withColumn("value", value)


def select_key(df: DataFrame, key: Column) -> DataFrame:
    return df.withColumn("key", key)


def flat_map(df: DataFrame, pairs: Column) -> DataFrame:
    """pairs: array of struct(key, value); one row each, none for an empty or null array."""
    return df.withColumn("__pair", F.explode(pairs)).withColumns({"key": F.col("__pair.key"), "value": F.col("__pair.value")}).drop("__pair")


def flat_map_values(df: DataFrame, values: Column) -> DataFrame:
    return df.withColumn("__value", F.explode(values)).withColumn("value", F.col("__value")).drop("__value")


def peek(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """Rows pass through; the metrics are known once they have been consumed."""
    seen = Observation(name)
    return df.observe(seen, *metrics), seen


def print_line(label: str, key: str = "key", value: str = "value") -> Column:
    """The printed form `[label]: key, value`."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.concat(F.lit(f"[{label}]: "), text(key), F.lit(", "), text(value))


class Branches:
    """First match wins: each row goes to the first branch whose predicate is true, else to the default, else nowhere."""

    def __init__(self, df: DataFrame, prefix: str = ""):
        self.df, self.prefix = df, prefix
        self.branches: list[tuple[str, Column | None, Callable[[DataFrame], DataFrame | None] | None, bool]] = []

    def branch(self, predicate: Column, name: str | None = None, function: Callable | None = None, consumer: Callable | None = None) -> Branches:
        """A function's result takes the branch's place; a consumer, or a function that returns None, leaves no entry."""
        self.branches.append((name or str(len(self.branches) + 1), predicate, function or consumer, consumer is not None))
        return self

    def _tagged(self, default: bool) -> DataFrame:
        tag = None
        for i, (_, p, _, _) in enumerate(self.branches):
            tag = F.when(p, i) if tag is None else tag.when(p, i)
        tag = F.lit(None).cast("int") if tag is None else tag
        return self.df.withColumn("__branch", F.coalesce(tag, F.lit(-1)) if default else tag)

    def _collect(self, tagged: DataFrame, rest: tuple | None) -> dict[str, DataFrame]:
        out = {}
        for i, (name, _, f, consumes) in [*enumerate(self.branches), *([(-1, rest)] if rest else [])]:
            part = tagged.where(F.col("__branch") == i).drop("__branch")
            if f:
                part = f(part)
                if consumes or part is None:
                    continue
            out[self.prefix + name] = part
        return out

    def no_default(self) -> dict[str, DataFrame]:
        return self._collect(self._tagged(False), None)

    def default(self, name: str = "0", function: Callable | None = None) -> dict[str, DataFrame]:
        return self._collect(self._tagged(True), (name, None, function, False))

    def labelled(self, column: str = "branch", default: str | None = None) -> DataFrame:
        """All branches in one pass: the branch's name as a column; unmatched rows go unless default names them."""
        tag = F.lit(None).cast("string")
        for name, p, _, _ in reversed(self.branches):
            tag = F.when(p, self.prefix + name).otherwise(tag)
        out = self.df.withColumn(column, F.coalesce(tag, F.lit(default)) if default else tag)
        return out if default else out.where(F.col(column).isNotNull())


def merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all streams, in no order."""
    for x in others:
        first = first.unionByName(x, allowMissingColumns=True)
    return first


def repartition(df: DataFrame, partitions: int | None = None, by: Sequence[str] = ("key",), keep_null_keys: bool = False) -> DataFrame:
    """An explicit shuffle by key; rows with a null key go unless a join downstream tolerates them."""
    df = df if keep_null_keys else df.where(F.col("key").isNotNull())
    return df.repartition(partitions, *by) if partitions else df.repartition(*by)
