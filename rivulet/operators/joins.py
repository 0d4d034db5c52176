"""Joins: stream-stream, stream-table, table-table, global and foreign-key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators import scan
from rivulet.record import duration


@dataclass(frozen=True)
class JoinWindows:
    """A right record joins if its time is in [left - before, left + after]; either may be negative, but not cross."""

    before: int
    after: int
    grace: int = 0

    def __post_init__(self):
        for f in ("before", "after", "grace"):
            object.__setattr__(self, f, duration(getattr(self, f)))
        if -self.before > self.after:
            raise ValueError("the window's start is after its end")
        if self.grace < 0:
            raise ValueError("grace must not be negative")

    @classmethod
    def of(cls, difference: int | str, grace: int | str = 0) -> JoinWindows:
        if duration(difference) < 0:
            raise ValueError("the time difference must not be negative")
        return cls(duration(difference), duration(difference), grace)


def _sides(left: DataFrame, right: DataFrame, null_values: bool) -> tuple[DataFrame, DataFrame]:
    names = {c: f"__r_{c}" for c in right.columns}
    return (left, right.withColumnsRenamed(names)) if null_values else (left.where("value IS NOT NULL"), right.where("value IS NOT NULL").withColumnsRenamed(names))


def _matched(left: DataFrame, right: DataFrame, w: JoinWindows, how: str) -> DataFrame:
    """Left rows joined to right rows in the window.

    Time is cut into buckets of the window's length; a right row stands in each bucket whose left rows it may join (two
    at most), so the join is an equi-join on key and bucket and a frequent key is spread over time.
    """
    width = max(1, w.before + w.after)
    own = F.floor(F.col("ts") / F.lit(width))
    lo, hi = (F.floor((F.col("__r_ts") + by) / F.lit(width)) for by in (-w.after, w.before))
    l = left.withColumn("__b", own)  # noqa: E741
    r = right.withColumn("__rb", F.explode(F.sequence(lo, hi)))
    within = F.col("__r_ts").between(F.col("ts") - w.before, F.col("ts") + w.after)
    return l.join(r, (F.col("key") == F.col("__r_key")) & (F.col("__b") == F.col("__rb")) & within, how).drop("__b", "__rb")


def _result(joined: DataFrame, value: Column) -> DataFrame:
    """key, value, ts: the joiner sees columns value and right_value; the time is the later one's."""
    joined = joined.withColumn("right_value", F.col("__r_value"))
    return joined.select(F.coalesce("key", "__r_key").alias("key"), value.alias("value"), F.greatest("ts", "__r_ts").alias("ts"))


def stream_stream(left: DataFrame, right: DataFrame, windows: JoinWindows, value: Column, how: str = "inner") -> DataFrame:
    """how: inner, left or outer. Inner drops null keys and values; left and outer keep unmatched rows, null keys too."""
    left, right = _sides(left, right, null_values=False)
    if how == "inner":
        return _result(_matched(left, right, windows, "inner"), value)
    out = _result(_matched(left, right, windows, "left"), value)
    if how == "left":
        return out
    if how != "outer":
        raise ValueError(f"unknown join: {how}")
    # right rows without a partner: the mirrored window
    mirrored = JoinWindows(windows.after, windows.before, windows.grace)
    back_l = right.select(*(F.col(c).alias(c.removeprefix("__r_")) for c in right.columns))
    back_r = left.select(*(F.col(c).alias(f"__r_{c}") for c in left.columns))
    alone = _matched(back_l, back_r, mirrored, "left_anti")
    renamed = alone.select(*(F.col(c).alias(f"__r_{c}") for c in alone.columns if not c.startswith("__")))
    nulls = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns]
    return out.unionByName(_result(renamed.select("*", *nulls), value))


def stream_table(stream: DataFrame, table: DataFrame, value: Column, how: str = "inner") -> DataFrame:
    """Each stream record with its key's row of a finished table; the record's time is kept. value sees value and table_value.

    Left keeps records without a match and with a null key; records with a null value go.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join: {how}")
    t = table.select(F.col("key").alias("__t_key"), F.col("value").alias("table_value"))
    joined = stream.where("value IS NOT NULL").join(t, F.col("key") == F.col("__t_key"), how)
    return joined.select("key", value.alias("value"), *(c for c in ("ts", "offset") if c in stream.columns))


def stream_global(stream: DataFrame, table: DataFrame, mapped_key: Column, value: Column, how: str = "inner") -> DataFrame:
    """A join on a mapped key with a replicated table; a null mapped key matches nothing.

    Whether the table is small enough to be replicated is the planner's decision at run time, when its size in bytes is
    known (spark.sql.adaptive.autoBroadcastJoinThreshold); a larger one is joined by a shuffle.
    """
    t = table.select(F.col("key").alias("__t_key"), F.col("value").alias("table_value"))
    joined = stream.where("value IS NOT NULL").withColumn("__m", mapped_key).join(t, F.col("__m") == F.col("__t_key"), how)
    return joined.select("key", value.alias("value"), *(c for c in ("ts", "offset") if c in stream.columns))


def stream_as_of(stream: DataFrame, versioned: DataFrame, value: Column, how: str = "inner", block: int | str = "7 days") -> DataFrame:
    """Each stream record with its key's value as of the record's time, from updates (key, value, ts, offset).

    Updates and records are sorted together, an update before a record of the same time, and the last update is carried
    forward: no range join. A key's history is cut into blocks of time, so a frequent key is spread over them. A null
    update deletes.
    """
    # an update without a value is still an update: its struct isn't null
    u = versioned.where("key IS NOT NULL").select("key", F.col("ts"), F.struct(F.col("value")).alias("__u"), F.lit(0).alias("__kind"), F.col("offset").alias("__o"))
    keep = [c for c in stream.columns if c not in ("key", "ts")]
    s = stream.where("value IS NOT NULL").select("key", "ts", F.struct(*keep).alias("__s"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__o"))
    both = u.unionByName(s.where("key IS NOT NULL"), allowMissingColumns=True)
    found = scan.running(both, ["key"], ["ts", "__kind", "__o"], F.floor(F.col("ts") / F.lit(duration(block))), __last=("last", F.col("__u"))).where("__kind = 1")
    found = found.withColumn("table_value", F.col("__last.value"))
    if how == "left":
        found = found.unionByName(s.where("key IS NULL"), allowMissingColumns=True)
    else:
        found = found.where("table_value IS NOT NULL")
    return found.select("key", "ts", "__s.*", "table_value").select("key", value.alias("value"), "ts", *(c for c in keep if c == "offset"))


def table_table(left: DataFrame, right: DataFrame, value: Column, how: str = "inner") -> DataFrame:
    """Two finished tables (key, value, ts) on their keys; the later time."""
    r = right.select(F.col("key").alias("__r_key"), F.col("value").alias("__r_value"), F.col("ts").alias("__r_ts"))
    return _result(left.join(r, F.col("key") == F.col("__r_key"), {"outer": "full"}.get(how, how)), value)


def foreign_key(left: DataFrame, right: DataFrame, extractor: Column, value: Column, how: str = "inner") -> DataFrame:
    """A left table's extracted key against a right table's key; left keeps rows whose key is null or unknown."""
    r = right.select(F.col("key").alias("__r_key"), F.col("value").alias("right_value"))
    joined = left.where("value IS NOT NULL").withColumn("__fk", extractor).join(r, F.col("__fk") == F.col("__r_key"), how)
    return joined.select("key", value.alias("value"))
