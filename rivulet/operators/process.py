"""User processors: code that sees one record at a time, with state, timers and forwarding, over batch and streaming frames.

State and timers belong to a key. Stream time is the largest time that the key has seen, wall-clock time the machine's.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rivulet.operators.walk import walk

STREAM_TIME, WALL_CLOCK = "stream", "wall"


class Processor:
    """Subclass and override process; init and close are called before the first and after the last record of a key."""

    #: Names of the stores that the processor uses; others are an error.
    stores: Sequence[str] = ("value",)

    def init(self, context: Context) -> None:
        pass

    def process(self, context: Context, record: dict) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class FixedKeyProcessor(Processor):
    """May not forward another key than its record's."""


@dataclass
class Context:
    key: object
    processor: Processor
    state: dict = field(default_factory=dict)
    stream_time: int | None = None
    record: dict | None = None
    timers: list = field(default_factory=list)
    out: list = field(default_factory=list)
    started: bool = False

    def start(self) -> None:
        self.started = True
        self.processor.init(self)

    def get(self, store: str = "value") -> object:
        self._known(store)
        return self.state.get(store)

    def put(self, value: object, store: str = "value") -> None:
        """None deletes."""
        self._known(store)
        if value is None:
            self.state.pop(store, None)
        else:
            self.state[store] = value

    def put_if_absent(self, value: object, store: str = "value") -> object:
        """The value from before, if there is one, which then stays."""
        before = self.get(store)
        if before is None:
            self.put(value, store)
        return before

    def _known(self, store: str) -> None:
        if store not in self.processor.stores:
            raise KeyError(f"the processor isn't connected to a store {store!r}")

    @property
    def system_time(self) -> int:
        return time.time_ns() // 1_000_000

    @property
    def metadata(self) -> tuple:
        """(topic, partition, offset) of the record, as far as it has them."""
        r = self.record or {}
        return r.get("topic"), r.get("partition"), r.get("offset")

    def forward(self, value: object, key: object = None, ts: int | None = None, child: str | None = None) -> None:
        """To all children, or to one by its name (the column child)."""
        if key is not None and key != self.key and isinstance(self.processor, FixedKeyProcessor):
            raise ValueError("a fixed-key processor can't change the key")
        self.out.append((self.key if key is None else key, value, ts if ts is not None else (self.record or {}).get("ts", self.stream_time), child))

    def schedule(self, interval: int, punctuate: Callable[[Context, int], None], kind: str = STREAM_TIME) -> Callable[[], None]:
        """Calls punctuate(context, time) each interval from now on; punctuations that time jumps over are skipped. Returns its end."""
        now = self.system_time if kind == WALL_CLOCK else self.stream_time
        timer = [kind, interval, now + interval, punctuate]
        self.timers.append(timer)
        return lambda: self.timers.remove(timer)

    def punctuate(self, kind: str, now: int) -> None:
        for timer in [t for t in self.timers if t[0] == kind and t[2] <= now]:
            due = timer[2] + (now - timer[2]) // timer[1] * timer[1]
            timer[2] = due + timer[1]
            timer[3](self, due)

    def see(self, record: dict) -> None:
        """Timers that the record's time makes due come before it."""
        ts = record.get("ts")
        if ts is not None:
            self.stream_time = ts if self.stream_time is None else max(self.stream_time, ts)
        self.record = record
        if not self.started:
            self.start()
        self.punctuate(STREAM_TIME, self.stream_time or 0)
        self.punctuate(WALL_CLOCK, self.system_time)
        self.processor.process(self, record)


def process(df: DataFrame, make: Callable[[], Processor], value: str = "string", key: str | None = None) -> DataFrame:
    """key, value, ts, child: what the processors forward. value and key are SQL types of what they forward.

    Records without a key go. One processor is made for each key; a key's records come in order of their offset.
    """
    kind = key or df.schema["key"].dataType.simpleString()

    def visit(k: tuple, records: Iterator[dict]) -> Iterator[tuple]:
        context = Context(k[0], make())
        for r in records:
            context.see(r)
            yield from context.out
            context.out.clear()
        context.processor.close()
        yield from context.out

    return walk(df.where(F.col("key").isNotNull()), ["key"], ["offset"], visit, f"key {kind}, value {value}, ts long, child string")


class _Streamed(StatefulProcessor):
    """A processor over a stream: state is kept as JSON text between batches; wall-clock timers also fire without records."""

    def __init__(self, make: Callable[[], Processor], columns: list[str]):
        self.make, self.columns = make, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("saved", "state string, time long, wall long")

    def _context(self, key: tuple) -> Context:
        import json

        context = Context(key[0], self.make())
        if self.saved.exists():
            state, at, _ = self.saved.get()
            context.state, due = json.loads(state)
            context.stream_time = at
            context.start()  # timers are scheduled again, for their old times
            for timer, x in zip(context.timers, due, strict=False):
                timer[2] = x
        return context

    def _keep(self, context: Context) -> Iterator:
        import json

        from pyspark.sql import Row

        wall = min((t[2] for t in context.timers if t[0] == WALL_CLOCK), default=None)
        before = self.saved.get()[2] if self.saved.exists() else None
        if wall != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if wall is not None:
                self.handle.registerTimer(wall)
        self.saved.update((json.dumps([context.state, [t[2] for t in context.timers]]), context.stream_time, wall))
        return (Row(key=k, value=v, ts=t, child=c) for k, v, t, c in context.out)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        context = self._context(key)
        for r in sorted(rows, key=lambda r: r["offset"]):
            context.see({c: r[c] for c in self.columns})
        return self._keep(context)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        context = self._context(key)
        context.punctuate(WALL_CLOCK, timerValues.getCurrentProcessingTimeInMs())
        return self._keep(context)

    def close(self) -> None:
        pass


def process_stream(df: DataFrame, make: Callable[[], Processor], value: str = "string", key: str | None = None, wall_clock: bool = False) -> DataFrame:
    """The same over a streaming frame. State must be values that JSON can hold.

    With wall_clock, wall-clock timers fire without records too; such a stream runs until it is stopped.
    """
    kind = key or df.schema["key"].dataType.simpleString()
    grouped = df.where(F.col("key").isNotNull()).groupBy("key")
    return grouped.transformWithState(_Streamed(make, df.columns), f"key {kind}, value {value}, ts long, child string", "Update", "ProcessingTime" if wall_clock else "None")
