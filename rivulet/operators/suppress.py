"""Suppression: updates of a table are held in a buffer in order of time, and only some are sent on.

The buffer belongs to a partition of the log and sees its updates as they arrive. An update of a key that is held takes
the held one's place but not its time. An update is sent when the stream's time has passed its own by the wait; a buffer
over its limits sends its oldest early, or fails.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators.walk import walk
from rivulet.record import duration


class BufferFull(RuntimeError):
    pass


@dataclass(frozen=True)
class Buffer:
    """Most records and bytes (of keys and values as text) held; what happens beyond: `emit` the oldest early, or `shut_down`."""

    records: int | None = None
    bytes: int | None = None
    full: str = "emit"

    def __post_init__(self):
        if any(x is not None and x < 1 for x in (self.records, self.bytes)):
            raise ValueError("the buffer must hold at least one record")
        if self.full not in ("emit", "shut_down"):
            raise ValueError(f"unknown behaviour of a full buffer: {self.full}")


class TimeOrdered:
    """The buffer itself: one update a key, in order of the time of the key's first held update."""

    def __init__(self) -> None:
        self.held: dict[tuple, list] = {}
        self.order: list[tuple] = []
        self.size, self.turn = 0, count()

    def put(self, key: tuple, time: int, row: dict, size: int) -> None:
        if key in self.held:
            entry = self.held[key]
            self.size += size - entry[2]
            entry[1:] = [row, size]
            return
        self.held[key] = [time, row, size]
        self.size += size
        heapq.heappush(self.order, (time, next(self.turn), key))

    def prior(self, key: tuple) -> dict | None:
        return self.held[key][1] if key in self.held else None

    def least(self) -> int | None:
        return self.order[0][0] if self.order else None

    def oldest(self) -> dict:
        _, row, size = self.held.pop(heapq.heappop(self.order)[2])
        self.size -= size
        return row


def suppressed(updates: DataFrame, wait: int | str, buffer: Buffer = Buffer(), time: Column | None = None, by: Sequence[str] = ("key",), partition: Sequence[str] = ("partition",), drop_tombstones: bool = False) -> DataFrame:
    """Of updates (by, value, ts, offset, partition, ...) those that leave the buffer before the log ends, as they were.

    time: by which an update waits (its ts; a window's end for final results). drop_tombstones leaves out null values,
    as final results of windows do. Rows with a null key go. Updates without a partition column are one partition.
    """
    wait, at = duration(wait), F.col("ts") if time is None else time
    rows = updates.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by))
    rows = rows if all(p in rows.columns for p in partition) else rows.withColumn("__partition", F.lit(0))
    parts = list(partition) if all(p in updates.columns for p in partition) else ["__partition"]
    width = F.octet_length(F.concat_ws("", *(F.col(c).cast("string") for c in by), F.col("value").cast("string")))
    kept, schema = updates.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in updates.schema.fields)

    def visit(_: tuple, own: Iterator[dict]) -> Iterator[tuple]:
        held, now = TimeOrdered(), None
        for r in own:
            now = r["ts"] if now is None else max(now, r["ts"])
            held.put(tuple(r[c] for c in by), r["__time"], r, r["__size"])
            while held.order and held.least() <= now - wait:
                yield from sent(held.oldest())
            while held.order and (buffer.records is not None and len(held.held) > buffer.records or buffer.bytes is not None and held.size > buffer.bytes):
                if buffer.full == "shut_down":
                    raise BufferFull(f"the buffer holds {len(held.held)} records of {held.size} bytes")
                yield from sent(held.oldest())

    def sent(r: dict) -> list[tuple]:
        return [] if drop_tombstones and r["value"] is None else [tuple(r[c] for c in kept)]

    return walk(rows.withColumns({"__time": at.cast("long"), "__size": width.cast("long")}), parts, ["offset"], visit, schema)
