"""Changelog tables: the latest value for each key, by offset; null values delete."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.walk import walk
from rivulet.record import duration

#: What a versioned put returns: for the newest version, and for one that came too late.
NO_END, REJECTED = -1, -(2**63)


def latest(df: DataFrame, by: Sequence[str] = ("key",), tombstones: bool = False) -> DataFrame:
    """The last row of each non-null key by offset; deleted keys are left out unless tombstones are wanted.

    A maximum of a struct combines before the shuffle, so a frequently updated key costs one row a task.
    """
    for c in by:
        df = df.where(F.col(c).isNotNull())
    rest = [c for c in df.columns if c not in by and c != "offset"]
    out = df.groupBy(*by).agg(F.max_by(F.struct("offset", *rest), "offset").alias("__r")).select(*by, "__r.*")
    return out if tombstones else out.where(F.col("value").isNotNull())


def changes(df: DataFrame, by: Sequence[str] = ("key",)) -> DataFrame:
    """Every update as a change: new_value, old_value (null at first or after a delete), in offset order of the key."""
    order = Window.partitionBy(*by).orderBy("offset")
    return df.where(F.col("key").isNotNull()).select(*by, "ts", "offset", F.col("value").alias("new_value"), F.lag("value").over(order).alias("old_value"))


def keep(table: DataFrame, predicate: Column) -> DataFrame:
    """Filter after the latest value is known: a key whose last value fails is gone, whatever it was before."""
    return table.where(predicate)


def map_values(table: DataFrame, value: Column) -> DataFrame:
    """Null stays null."""
    return table.withColumn("value", F.when(F.col("value").isNotNull(), value))


def transform_values(table: DataFrame, value: Column) -> DataFrame:
    """The value from key and value, null values included: the table must still have its tombstones."""
    return table.withColumn("value", value)


def regroup(table: DataFrame, key: Column, value: Column) -> DataFrame:
    """The table under another, possibly repeated key."""
    return table.withColumns({"__k": key, "__v": value}).drop("key", "value").withColumnsRenamed({"__k": "key", "__v": "value"})


def signed(changes_: DataFrame, key: Column, value: Column) -> DataFrame:
    """Changes as additions (sign 1, of the new value) and subtractions (sign -1, of the old): key, value, sign.

    key and value are computed from a column named value.
    """
    plus = changes_.where("new_value IS NOT NULL").withColumn("value", F.col("new_value")).withColumn("sign", F.lit(1))
    minus = changes_.where("old_value IS NOT NULL").withColumn("value", F.col("old_value")).withColumn("sign", F.lit(-1))
    both = plus.unionByName(minus)
    return both.select(key.alias("key"), value.alias("value"), "sign", "ts", "offset")


def aggregate_signed(rows: DataFrame, sums: dict[str, Column], by: Sequence[str] = ("key",)) -> DataFrame:
    """Adder and subtractor as one signed sum; groups that all members have left are gone."""
    out = rows.where(F.col("key").isNotNull()).groupBy(*by).agg(F.sum("sign").alias("__n"), *(F.sum(F.col("sign") * c).alias(n) for n, c in sums.items()))
    return out.where("__n > 0").drop("__n")


def fold_changes(changes_: DataFrame, key: Column, value: Column, zero: object, add: Callable[[object, object], object], subtract: Callable[[object, object], object], kind: str) -> DataFrame:
    """key, value: an aggregate of a regrouped table with a user's adder and subtractor, in order of offset.

    changes_: new_value, old_value, offset; key and value are computed from a column named value. Of an update whose
    group stays, the old value is subtracted before the new one is added. A group is gone when its members are.
    """
    rows = signed(changes_, key, value)

    def visit(k: tuple, records: Iterator[dict]) -> Iterator[tuple]:
        at, n = zero, 0
        for r in records:
            at, n = (add if r["sign"] > 0 else subtract)(at, r["value"]), n + r["sign"]
        if n:
            yield (*k, at)

    return walk(rows.where(F.col("key").isNotNull()), ["key"], ["offset", "sign"], visit, f"key {rows.schema['key'].dataType.simpleString()}, value {kind}")


def reduce_changes(changes_: DataFrame, key: Column, value: Column, add: Callable[[object, object], object], subtract: Callable[[object, object], object], kind: str) -> DataFrame:
    """The same without a zero: the first value of a group is its aggregate."""
    return fold_changes(changes_, key, value, None, lambda a, v: v if a is None else add(a, v), subtract, kind)


def put(store: DataFrame, updates: DataFrame, by: Sequence[str] = ("key",)) -> DataFrame:
    """A key-value store after puts (by, value, ts, offset) in order of offset: the last put of a key counts, null deletes."""
    last = latest(updates, by, tombstones=True).select(store.columns)
    return store.join(last.select(*by), list(by), "left_anti").unionByName(last.where(F.col("value").isNotNull()))


def put_if_absent(store: DataFrame, updates: DataFrame, by: Sequence[str] = ("key",)) -> DataFrame:
    """After puts that only take effect where a key has no value: of several, the first that isn't null."""
    rest = [c for c in updates.columns if c not in by and c != "offset"]
    first = updates.where(F.col("value").isNotNull() & F.col(by[0]).isNotNull()).groupBy(*by).agg(F.min_by(F.struct("offset", *rest), "offset").alias("__r")).select(*by, "__r.*")
    return store.unionByName(first.join(store.select(*by), list(by), "left_anti").select(store.columns))


def delete(store: DataFrame, keys: DataFrame, by: Sequence[str] = ("key",)) -> DataFrame:
    return store.join(keys.select(*by), list(by), "left_anti")


def versioned_puts(updates: DataFrame, grace: int | str) -> DataFrame:
    """key, ts, offset, valid_to: what each put into a versioned store returns, in order of arrival.

    valid_to is the time of the next version that the store holds then, NO_END if it holds none, and REJECTED for a put
    older than the largest time of the key so far less the grace. Null values are versions too: they end the one before.
    """
    grace = duration(grace)

    def visit(key: tuple, records: Iterator[dict]) -> Iterator[tuple]:
        held: list[int] = []
        for r in records:
            ts = r["ts"]
            if held and ts < held[-1] - grace:
                yield (*key, ts, r["offset"], REJECTED)
                continue
            i = bisect_right(held, ts)
            yield (*key, ts, r["offset"], held[i] if i < len(held) else NO_END)
            if bisect_left(held, ts) == i:
                insort(held, ts)
            del held[: max(0, bisect_left(held, held[-1] - grace) - 1)]  # no accepted put falls before them

    kind = updates.schema["key"].dataType.simpleString()
    return walk(updates.where(F.col("key").isNotNull()).select("key", "ts", "offset"), ["key"], ["offset"], visit, f"key {kind}, ts long, offset long, valid_to long")


def least_recent_evicted(updates: DataFrame, most: int, partition: Sequence[str] = ("partition",)) -> DataFrame:
    """An LRU store of at most `most` keys a partition, after all updates: the keys updated last, less the deleted ones."""
    if most < 1:
        raise ValueError("the store must hold at least one key")
    last = updates.where(F.col("key").isNotNull()).groupBy(*partition, "key").agg(F.max_by(F.struct("offset", "value", "ts"), "offset").alias("__r")).select(*partition, "key", "__r.*")
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc("offset")))
    return last.where(F.col("value").isNotNull()).withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def versions(df: DataFrame, by: Sequence[str] = ("key",)) -> DataFrame:
    """A versioned table: each version is valid from its ts to the next one's; the last has no end.

    Of several updates with one timestamp the last by offset counts; a tombstone ends the version before it.
    """
    one = df.where(F.col("key").isNotNull()).groupBy(*by, "ts").agg(F.max_by(F.struct("offset", "value"), "offset").alias("__r"))
    order = Window.partitionBy(*by).orderBy("ts")
    out = one.select(*by, F.col("ts").alias("valid_from"), F.lead("ts").over(order).alias("valid_to"), F.col("__r.value").alias("value"), F.col("__r.offset").alias("offset"))
    return out.where(F.col("value").isNotNull())


def as_of(versioned: DataFrame, at: int) -> DataFrame:
    return versioned.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def compact(log: DataFrame, low: int | None = None, keep_tombstones_after: int | None = None, by: Sequence[str] = ("key",)) -> DataFrame:
    """The latest record of each key; tombstones go, but those not older than a timestamp; offsets under low stay as they are."""
    tail = log if low is None else log.where(F.col("offset") < low)
    kept = latest(tail, by, tombstones=True)
    kept = kept.where(F.col("value").isNotNull() | (F.col("ts") >= (keep_tombstones_after if keep_tombstones_after is not None else 2**62)))
    return kept if low is None else kept.unionByName(log.where(F.col("offset") >= low).select(*kept.columns))


def retain_segments(df: DataFrame, retention: int | str, segment: int | str) -> DataFrame:
    """Rows of the segments that a segmented store keeps: whole segments go, once all of their times are too old."""
    segment = duration(segment)
    number = lambda ts: F.floor(ts / F.lit(segment))
    newest = df.agg(F.max("ts").alias("__newest"))
    return df.join(F.broadcast(newest), number(F.col("ts")) >= number(F.col("__newest") - duration(retention))).drop("__newest")


def retain(df: DataFrame, retention: int) -> DataFrame:
    """Rows not older than the stream's time less the retention."""
    newest = df.agg(F.max("ts").alias("__newest"))
    return df.join(F.broadcast(newest), F.col("ts") >= F.col("__newest") - retention).drop("__newest")
