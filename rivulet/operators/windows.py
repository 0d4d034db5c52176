"""Event-time windows: tumbling, hopping, unlimited, custom, sliding, session; lateness and final results.

Time windows are [start, end), aligned to the epoch, with no negative start. Sliding and session windows include both
ends. All times are milliseconds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators import scan
from rivulet.operators.suppress import Buffer, suppressed
from rivulet.operators.walk import walk
from rivulet.record import duration

#: Offsets of a log partition that one task scans in order.
BLOCK_OFFSETS = 1 << 20


@dataclass(frozen=True)
class TimeWindows:
    size: int
    advance: int = 0
    grace: int = 0

    def __post_init__(self):
        object.__setattr__(self, "size", duration(self.size))
        object.__setattr__(self, "advance", duration(self.advance) or self.size)
        object.__setattr__(self, "grace", duration(self.grace))
        if self.size <= 0:
            raise ValueError("a window's size must be over 0")
        if not 0 < self.advance <= self.size:
            raise ValueError("the advance must be over 0 and at most the size")
        if self.grace < 0:
            raise ValueError("grace must not be negative")

    def windows_for(self, ts: int) -> list[tuple[int, int]]:
        first = max(0, ts - self.size + self.advance) // self.advance * self.advance
        return [(s, s + self.size) for s in range(first, ts + 1, self.advance)]

    def assign(self, df: DataFrame) -> DataFrame:
        """One row for each window of each record; a tumbling window needs no row generator."""
        last = F.floor(F.col("ts") / F.lit(self.advance)).cast("long") * self.advance
        if self.advance == self.size:
            out = df.withColumn("window_start", last)
        else:
            first = F.floor(F.greatest(F.lit(0), F.col("ts") - self.size + self.advance) / F.lit(self.advance)).cast("long") * self.advance
            out = df.withColumn("window_start", F.explode(F.sequence(first, last, F.lit(self.advance).cast("long"))))
        return out.withColumn("window_end", F.col("window_start") + self.size)


@dataclass(frozen=True)
class UnlimitedWindows:
    """One window from start on; earlier records are dropped; it never closes."""

    start: int = 0

    def __post_init__(self):
        if self.start < 0:
            raise ValueError("the start must not be negative")

    def assign(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("ts") >= self.start).withColumns({"window_start": F.lit(self.start).cast("long"), "window_end": F.lit(2**63 - 1)})


@dataclass(frozen=True)
class CustomWindows:
    """windows: from the ts column to an array of struct(start, end)."""

    windows: Callable[[Column], Column]
    grace: int = 0

    def assign(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("__w", F.explode(self.windows(F.col("ts"))))
        return out.withColumns({"window_start": F.col("__w.start"), "window_end": F.col("__w.end")}).drop("__w")


@dataclass(frozen=True)
class SlidingWindows:
    """Windows ending at, or starting just after, a record; both ends inclusive."""

    difference: int
    grace: int = 0

    def __post_init__(self):
        object.__setattr__(self, "difference", duration(self.difference))
        object.__setattr__(self, "grace", duration(self.grace))
        if self.difference < 0 or self.grace < 0:
            raise ValueError("time difference and grace must not be negative")

    def assign(self, df: DataFrame, by: Sequence[str] = ("key",)) -> DataFrame:
        """Records joined to the windows that hold them.

        Starts are dealt into buckets of the window's length; a record looks into its own and the one before, so the
        join is an equi-join on key and bucket, and a frequent key spreads over its buckets.
        """
        d, width = self.difference, self.difference + 1
        starts = df.select(*by, F.explode(F.array(F.greatest(F.lit(0), F.col("ts") - d), F.col("ts") + 1)).alias("window_start")).distinct()
        starts = starts.withColumn("__bucket", F.floor(F.col("window_start") / F.lit(width)))
        own = F.floor(F.col("ts") / F.lit(width))
        records = df.withColumn("__bucket", F.explode(F.array(own, own - 1)))
        inside = F.col("ts").between(F.col("window_start"), F.col("window_start") + d)
        return records.join(starts, [*by, "__bucket"]).where(inside).withColumn("window_end", F.col("window_start") + d).drop("__bucket")


@dataclass(frozen=True)
class SessionWindows:
    """Records at most gap apart share a session; its ends are its first and last record."""

    gap: int
    grace: int = 0

    def __post_init__(self):
        object.__setattr__(self, "gap", duration(self.gap))
        object.__setattr__(self, "grace", duration(self.grace))
        if self.gap <= 0 or self.grace < 0:
            raise ValueError("the gap must be over 0 and grace not negative")

    def aggregate(self, df: DataFrame, aggs: dict[str, Column], by: Sequence[str] = ("key",)) -> DataFrame:
        """Built-in session windows merge partial sessions on the map side.

        The ends are aggregates, not parts of the grouping window: a filter on the latter would be moved below the
        aggregation, to each record's own window, and cut sessions off.
        """
        at = F.session_window(F.timestamp_millis(F.col("ts")), f"{self.gap} milliseconds")
        ends = [F.min("ts").cast("long").alias("window_start"), F.max("ts").cast("long").alias("window_end")]
        return df.groupBy(*by, at.alias("__s")).agg(*ends, *(c.alias(n) for n, c in aggs.items())).select(*by, "window_start", "window_end", *aggs)

    def assign(self, df: DataFrame, by: Sequence[str] = ("key",)) -> DataFrame:
        """Each record with its session, for aggregates that need the records."""
        order = Window.partitionBy(*by).orderBy("ts", "offset")
        new = F.coalesce((F.col("ts") - F.lag("ts").over(order) > self.gap).cast("int"), F.lit(0))
        marked = df.withColumn("__new", new).withColumn("__n", F.sum("__new").over(order))
        each = Window.partitionBy(*by, "__n")
        return marked.withColumns({"window_start": F.min("ts").over(each), "window_end": F.max("ts").over(each)}).drop("__new", "__n")


def windowed(df: DataFrame, windows, aggs: dict[str, Column], by: Sequence[str] = ("key",)) -> DataFrame:
    """by, window_start, window_end and the aggregates; null keys are dropped, null values reach the aggregates."""
    df = df.where(F.col("key").isNotNull())
    if isinstance(windows, SessionWindows):
        return windows.aggregate(df, aggs, by)
    assigned = windows.assign(df, by) if isinstance(windows, SlidingWindows) else windows.assign(df)
    return assigned.groupBy(*by, "window_start", "window_end").agg(*(c.alias(n) for n, c in aggs.items()))


def with_stream_time(df: DataFrame, partition: Sequence[str] = ("partition",), block: int = BLOCK_OFFSETS) -> DataFrame:
    """The running maximum of ts by arrival, the record's own included: exactly what a record-at-a-time operator sees.

    A partition is scanned in blocks of so many offsets, each with the maximum of those before it.
    """
    return scan.running(df, partition, ["offset"], F.floor(F.col("offset") / F.lit(block)), stream_time=("max", F.col("ts")))


def drop_late(df: DataFrame, windows: TimeWindows | SlidingWindows | CustomWindows, partition: Sequence[str] = ("partition",)) -> DataFrame:
    """Records with their windows that were open on arrival: window_end > stream_time - grace.

    A sliding window begins at or after a record that was not late itself, and counts a record only if it was still open
    when the record came.
    """
    timed, closed = with_stream_time(df, partition), F.col("stream_time") - windows.grace
    if isinstance(windows, SlidingWindows):
        timed = timed.where(F.col("key").isNotNull() & (F.col("ts") + windows.difference > closed))
    return windows.assign(timed).where(F.col("window_end") > closed)


def late_sessions(df: DataFrame, windows: SessionWindows, partition: Sequence[str] = ("partition",)) -> DataFrame:
    """key, window_start, window_end, count of sessions from records in order of arrival.

    A record is late if the session that it would be in ends before stream_time - grace - gap; it is dropped then.
    """
    gap, grace = windows.gap, windows.grace

    def visit(key: tuple, records: Iterator[dict]) -> Iterator[tuple]:
        held: list[tuple[int, int, int]] = []
        for r in records:
            ts = r["ts"]
            touched = [s for s in held if s[0] - gap <= ts <= s[1] + gap]
            start, end = min([ts, *(s[0] for s in touched)]), max([ts, *(s[1] for s in touched)])
            if end < r["stream_time"] - grace - gap:
                continue
            held = [s for s in held if s not in touched]
            done = [s for s in held if s[1] < r["stream_time"] - grace - 2 * gap]  # no accepted record can reach them
            yield from ((key[0], *s) for s in done)
            held = [*(s for s in held if s not in done), (start, end, 1 + sum(s[2] for s in touched))]
        yield from ((key[0], *s) for s in held)

    rows = with_stream_time(df, partition).where(F.col("key").isNotNull()).select("key", "ts", "offset", "stream_time")
    return walk(rows, ["key"], ["offset"], visit, f"key {df.schema['key'].dataType.simpleString()}, window_start long, window_end long, count long")


def fold_sessions(df: DataFrame, windows: SessionWindows, zero: object, add: Callable[[object, dict], object], merge: Callable[[object, object], object], kind: str) -> DataFrame:
    """key, window_start, window_end, value: sessions with a user's accumulator in order of arrival.

    add takes an accumulator and a record; merge joins the accumulators of two sessions that a record connects, the
    earlier one first. kind is the accumulator's SQL type. For built-in aggregates `windowed` combines before the shuffle.
    """
    gap = windows.gap

    def visit(key: tuple, records: Iterator[dict]) -> Iterator[tuple]:
        held: list[tuple] = []
        for r in records:
            ts = r["ts"]
            touched = sorted((s for s in held if s[0] - gap <= ts <= s[1] + gap), key=lambda s: s[0])
            value = touched[0][2] if touched else zero
            for s in touched[1:]:
                value = merge(value, s[2])
            held = [*(s for s in held if s not in touched), (min([ts, *(s[0] for s in touched)]), max([ts, *(s[1] for s in touched)]), add(value, r))]
        yield from ((key[0], *s) for s in held)

    return walk(df.where(F.col("key").isNotNull()), ["key"], ["offset"], visit, f"key {df.schema['key'].dataType.simpleString()}, window_start long, window_end long, value {kind}")


def final_only(windowed_df: DataFrame, stream_time: Column, grace: int) -> DataFrame:
    """Results of windows that have closed: window_end <= stream_time - grace."""
    return windowed_df.where(F.col("window_end") <= stream_time - grace)


def trailing(df: DataFrame, difference: int, aggs: dict[str, Column], by: Sequence[str] = ("key",)) -> DataFrame:
    """For each record the aggregate over its own trailing window, both ends inclusive."""
    over = Window.partitionBy(*by).orderBy("ts").rangeBetween(-duration(difference), 0)
    return df.select(*df.columns, *(c.over(over).alias(n) for n, c in aggs.items()))


def suppress_until_limit(updates: DataFrame, limit: int, by: Sequence[str] = ("key",)) -> DataFrame:
    """Updates (by, value, ts, offset) held for limit after a key's first pending one: the last update within it is sent.

    Later updates replace the held value but don't restart the time; what is held at the end is sent too. A key's updates
    are walked in order of time, so memory holds one update.
    """
    limit, rest = duration(limit), [c for c in updates.columns if c not in by and c != "offset"]

    def visit(key: tuple, records: Iterator[dict]) -> Iterator[tuple]:
        start = last = None
        for r in records:
            if start is not None and r["ts"] >= start + limit:
                yield (*key, last["offset"], start, *(last[c] for c in rest))
                start = None
            # of updates held together the one with the largest offset counts
            if start is None or r["offset"] > last["offset"]:
                last = r
            start = r["ts"] if start is None else start
        yield (*key, last["offset"], start, *(last[c] for c in rest))

    kind = lambda c: f"`{c}` {updates.schema[c].dataType.simpleString()}"
    schema = ", ".join([*map(kind, by), kind("offset"), "held_from long", *map(kind, rest)])
    return walk(updates.where(F.col("key").isNotNull()), by, ["ts", "offset"], visit, schema)


def suppress_records(updates: DataFrame, most: int) -> DataFrame:
    """A buffer of at most `most` keys that sends the oldest early when full, over a stream of updates."""
    return suppressed(updates, 2**61, Buffer(most)).select("key", "value", "ts", "offset")
