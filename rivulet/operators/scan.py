"""Running aggregates over long histories in blocks.

A window over a whole history is one task's work. Here the history is cut into blocks: each block's total is aggregated
(combining before the shuffle), the totals of the blocks before are carried into each block, and the window runs inside
blocks only. So the longest work of a task is a block, and what is scanned in one piece is one row a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOTAL = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


def _joined(kind: str, before: Column, here: Column) -> Column:
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(before, here)  # both skip nulls
    if kind == "last":
        return F.coalesce(here, before)
    return F.coalesce(before + here, before, here)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], block: Column, **out: tuple[str, Column]) -> DataFrame:
    """df with running values up to and with each row: out maps a column to (max, min, sum, count or last, a column).

    block: a number that doesn't fall in the given order. last is the last value that isn't null. Rows need non-null
    `by` columns. Each row is shuffled once, to its block.
    """
    cut = df.withColumn("__block", block)
    place = F.struct(*order)
    totals = {n: F.max_by(c, F.when(c.isNotNull(), place)) if kind == "last" else _TOTAL[kind](c) for n, (kind, c) in out.items()}
    each = cut.groupBy(*by, "__block").agg(*(c.alias(f"__{n}") for n, c in totals.items()))
    past = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = {n: F.last(f"__{n}", ignorenulls=True) if kind == "last" else (F.sum if kind == "count" else _TOTAL[kind])(f"__{n}") for n, (kind, _) in out.items()}
    before = each.select(*by, "__block", *(c.over(past).alias(f"__{n}") for n, c in carried.items()))
    inside = Window.partitionBy(*by, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = {n: F.last(c, ignorenulls=True) if kind == "last" else _TOTAL[kind](c) for n, (kind, c) in out.items()}
    both = cut.join(before, [*by, "__block"]).select(*df.columns, *(f"__{n}" for n in out), *(c.over(inside).alias(f"__own_{n}") for n, c in own.items()))
    return both.select(*df.columns, *(_joined(kind, F.col(f"__{n}"), F.col(f"__own_{n}")).alias(n) for n, (kind, _) in out.items()))
