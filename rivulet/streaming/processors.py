"""Custom stateful processors on transformWithState: sessions with updates, held updates, latest values, punctuation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class SessionUpdates(StatefulProcessor):
    """Counts by session, sent at every change: sessions that grow or merge are withdrawn (count null) and the larger one is sent."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getListState("sessions", "start long, end long, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [tuple(s) for s in self.sessions.get()] if self.sessions.exists() else []
        out = []
        for r in sorted(rows, key=lambda r: r["offset"]):
            touched = [s for s in held if s[0] - self.gap <= r["ts"] <= s[1] + self.gap]
            start, end = min([r["ts"], *(s[0] for s in touched)]), max([r["ts"], *(s[1] for s in touched)])
            n = 1 + sum(s[2] for s in touched)
            out += [(s[0], s[1], None) for s in touched if s[:2] != (start, end)]
            held = [*(s for s in held if s not in touched), (start, end, n)]
            out.append((start, end, n))
        self.sessions.put(sorted(held))
        for start, end, n in out:
            yield Row(key=key[0], window_start=start, window_end=end, count=n)

    def close(self) -> None:
        pass


def session_updates(df: DataFrame, gap: int) -> DataFrame:
    """Streams have no built-in session aggregate that sends every change."""
    out = "key long, window_start long, window_end long, count long"
    return df.where(F.col("key").isNotNull()).groupBy("key").transformWithState(SessionUpdates(gap), out, "Update", "None")


class HeldUpdates(StatefulProcessor):
    """The last update within a limit after a key's first pending one; later ones replace it but don't restart the timer."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "value string, ts long, due long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r["offset"]):
            if self.pending.exists():
                due = self.pending.get()[2]
                if r["ts"] >= due:  # time has run out within this batch
                    value, ts, _ = self.pending.get()
                    self.handle.deleteTimer(due)
                    yield Row(key=key[0], value=value, ts=ts)
                    due = r["ts"] + self.limit
                    self.handle.registerTimer(due)
            else:
                due = r["ts"] + self.limit
                self.handle.registerTimer(due)
            self.pending.update((r["value"], r["ts"], due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.pending.exists():
            value, ts, _ = self.pending.get()
            self.pending.clear()
            yield Row(key=key[0], value=value, ts=ts)

    def close(self) -> None:
        pass


def held_updates(df: DataFrame, limit: int) -> DataFrame:
    """df: key, value (text), ts, offset, event_time with a watermark."""
    return df.groupBy("key").transformWithState(HeldUpdates(limit), "key long, value string, ts long", "Append", "EventTime")


class LatestValue(StatefulProcessor):
    """A changelog table: each accepted update as (old, new); updates by offset, equal values too."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value string, offset long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.value.get()[0] if self.value.exists() else None
        last = None
        for r in sorted(rows, key=lambda r: r["offset"]):
            yield Row(key=key[0], new_value=r["value"], old_value=old, offset=r["offset"])
            old, last = r["value"], r["offset"]
        if old is None:
            self.value.clear()
        else:
            self.value.update((old, last))

    def close(self) -> None:
        pass


def table_changes(df: DataFrame) -> DataFrame:
    return df.where(F.col("key").isNotNull()).groupBy("key").transformWithState(LatestValue(), "key long, new_value string, old_value string, offset long", "Update", "None")


class Punctuated(StatefulProcessor):
    """Counts by key, sent whenever event time passes a multiple of the interval since the key's first record."""

    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, first = (self.count.get()[0], False) if self.count.exists() else (0, True)
        times = [r["ts"] for r in rows]
        self.count.update((n + len(times),))
        if first:
            self.handle.registerTimer(min(times) + self.interval)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        due = expiredTimerInfo.getExpiryTimeInMs()
        self.handle.registerTimer(due + (max(0, now - due) // self.interval + 1) * self.interval)  # missed ones are skipped
        yield Row(key=key[0], at=due, count=self.count.get()[0])

    def close(self) -> None:
        pass


def punctuated_counts(df: DataFrame, interval: int) -> DataFrame:
    return df.groupBy("key").transformWithState(Punctuated(interval), "key long, at long, count long", "Append", "EventTime")
