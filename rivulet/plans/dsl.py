"""The fluent API: streams, tables, grouped and windowed streams over the operators.

Everything is a lazy DataFrame; a Stream or Table only adds what the planner can't know: whether the key has changed since
the last shuffle by key, and the grace of the windows upstream.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators import aggregate, joins, process, stateless, suppress, tables, windows
from rivulet.plans.stores import Stores
from rivulet.record import duration


def named(name: str | None) -> str | None:
    """A name of a node or store: letters, digits, `.`, `_` and `-`, at most 249 of them, not `.` or `..`."""
    if name is not None and (not re.fullmatch(r"[A-Za-z0-9._-]{1,249}", name) or name in (".", "..")):
        raise ValueError(f"not a name: {name!r}")
    return name


@dataclass(frozen=True)
class Grouping:
    """Options of a grouping: its name (of the shuffle), and into how many partitions it shuffles."""

    name: str | None = None
    partitions: int | None = None

    def __post_init__(self):
        named(self.name)


@dataclass(frozen=True)
class Materialized:
    """Options of an aggregate's store: its name and registry, how long windows are kept, records between two commits.

    A caching store forwards only the last update of a key of each commit.
    """

    name: str | None = None
    stores: Stores | None = None
    retention: int | str | None = None
    commit: int | None = None

    def __post_init__(self):
        named(self.name)
        if (self.name is None) != (self.stores is None):
            raise ValueError("a store needs a name and a registry")

    def kept(self, df: DataFrame, newest: DataFrame | None) -> DataFrame:
        if self.retention is not None and newest is not None and "window_end" in df.columns:
            df = df.join(F.broadcast(newest)).where(F.col("window_end") > F.col("__newest") - duration(self.retention)).drop("__newest")
        return self.stores.add(self.name, df) if self.stores is not None else df


@dataclass(frozen=True)
class Joining:
    """Options of a join: its name, and the grace for which records are held before they join."""

    name: str | None = None
    grace: int | str = 0

    def __post_init__(self):
        named(self.name)


def _newest(df: DataFrame) -> DataFrame:
    """One row: the stream's time."""
    return df.agg(F.max("ts").alias("__newest"))


def _longest(*graces: int | None) -> int | None:
    """The grace that a node inherits: the longest of its parents'."""
    return max((g for g in graces if g is not None), default=None)


@dataclass(frozen=True)
class Stream:
    df: DataFrame
    key_changed: bool = False
    grace: int | None = None
    newest: DataFrame | None = None

    def _with(self, df: DataFrame, key_changed: bool | None = None) -> Stream:
        return replace(self, df=df, key_changed=self.key_changed if key_changed is None else key_changed)

    def filter(self, predicate: Column) -> Stream:
        return self._with(stateless.keep(self.df, predicate))

    def filter_not(self, predicate: Column) -> Stream:
        return self._with(stateless.keep_not(self.df, predicate))

    def map(self, key: Column, value: Column) -> Stream:
        return self._with(stateless.map_pairs(self.df, key, value), True)

    def map_values(self, value: Column) -> Stream:
        return self._with(stateless.map_values(self.df, value))

    def flat_map(self, pairs: Column) -> Stream:
        return self._with(stateless.flat_map(self.df, pairs), True)

    def flat_map_values(self, values: Column) -> Stream:
        return self._with(stateless.flat_map_values(self.df, values))

    def select_key(self, key: Column) -> Stream:
        return self._with(stateless.select_key(self.df, key), True)

    def peek(self, name: str, *metrics: Column) -> Stream:
        return self._with(stateless.peek(self.df, name, *metrics)[0])

    def transform(self, f: Callable[[DataFrame], DataFrame], key_changed: bool = True) -> Stream:
        """Any function of the frame, such as record transforms."""
        return self._with(f(self.df), key_changed)

    def intercept(self, *interceptors: Callable[[DataFrame], DataFrame]) -> Stream:
        """Interceptors in order, each seeing what the one before it returns; one that fails to be applied is skipped, as it may not break the stream."""
        df = self.df
        for f in interceptors:
            try:
                df = f(df)
            except Exception:  # the contract of an interceptor
                continue
        return self._with(df)

    def process(self, make: Callable[[], process.Processor], value: str = "string", key: str | None = None) -> Stream:
        """A user's processors, one for each key; the column child names the child that a record goes to."""
        return Stream(process.process(self.df, make, value, key), True, self.grace).numbered(self.df)

    def process_values(self, make: Callable[[], process.FixedKeyProcessor], value: str = "string") -> Stream:
        """Processors that can't change the key."""
        if not issubclass(make if isinstance(make, type) else type(make()), process.FixedKeyProcessor):
            raise TypeError("processValues needs a FixedKeyProcessor")
        return Stream(process.process(self.df, make, value), self.key_changed, self.grace).numbered(self.df)

    def numbered(self, source: DataFrame) -> Stream:
        return replace(self, newest=_newest(source)) if "ts" in source.columns else self

    def foreach(self, sink: Callable[[DataFrame], object]) -> object:
        """A terminal side effect on the whole frame."""
        return sink(self.df)

    def split(self, prefix: str = "") -> stateless.Branches:
        return stateless.Branches(self.df, prefix)

    def merge(self, *others: Stream) -> Stream:
        merged = stateless.merge(self.df, *(o.df for o in others))
        return Stream(merged, self.key_changed or any(o.key_changed for o in others), _longest(self.grace, *(o.grace for o in others)))

    def repartition(self, partitions: int | None = None) -> Stream:
        return self._with(stateless.repartition(self.df, partitions), False)

    def to_table(self) -> Table:
        return Table(tables.latest(self.df))

    def group_by_key(self, grouping: Grouping = Grouping()) -> Grouped:
        return Grouped(self._dealt(self.df, grouping))

    def group_by(self, key: Column, grouping: Grouping = Grouping()) -> Grouped:
        return Grouped(self._dealt(stateless.select_key(self.df, key), grouping))

    @staticmethod
    def _dealt(df: DataFrame, grouping: Grouping) -> DataFrame:
        return stateless.repartition(df, grouping.partitions) if grouping.partitions else df

    def join(self, other: Stream | Table | GlobalTable | VersionedTable, value: Column, how: str = "inner", within: joins.JoinWindows | None = None, key: Column | None = None, joining: Joining = Joining()) -> Stream:
        """value sees value and right_value (of a stream) or table_value (of a table).

        With a grace, records later than it are dropped before they join a versioned table.
        """
        if isinstance(other, Stream):
            if within is None:
                raise ValueError("a join of streams needs a window")
            return Stream(joins.stream_stream(self.df, other.df, within, value, how), grace=_longest(within.grace, self.grace, other.grace))
        if isinstance(other, VersionedTable) and duration(joining.grace):
            timed = windows.with_stream_time(self.df).where(F.col("ts") >= F.col("stream_time") - duration(joining.grace)).drop("stream_time")
            return self._with(joins.stream_as_of(timed, other.updates, value, how))
        if isinstance(other, GlobalTable):
            return self._with(joins.stream_global(self.df, other.df, F.col("key") if key is None else key, value, how))
        if isinstance(other, VersionedTable):
            return self._with(joins.stream_as_of(self.df, other.updates, value, how))
        return self._with(joins.stream_table(self.df, other.df, value, how))


@dataclass(frozen=True)
class Grouped:
    df: DataFrame

    def count(self, name: str = "count", materialized: Materialized = Materialized()) -> Table:
        return Table(materialized.kept(aggregate.count(self.df, name=name), None))

    def aggregate(self, changelog: bool = False, materialized: Materialized = Materialized(), **aggs: Column) -> Table:
        """With changelog every update; a caching store then forwards the last one of a key of each commit."""
        out = (aggregate.changelog if changelog else aggregate.aggregate)(self.df, aggs)
        if changelog and materialized.commit:
            out = aggregate.cached(out, materialized.commit)
        return Table(materialized.kept(out, None))

    def reduce(self, step: Callable[[Column, Column], Column]) -> Table:
        return Table(aggregate.reduce(self.df, step))

    def fold(self, zero: Column, step: Callable[[Column, Column], Column]) -> Table:
        return Table(aggregate.fold(self.df, zero, step))

    def windowed_by(self, spec) -> Windowed:
        return Windowed(self.df, spec)


@dataclass(frozen=True)
class Windowed:
    df: DataFrame
    spec: object
    final: bool = False
    late_by: tuple[str, ...] | None = None

    def emit_on_close(self) -> Windowed:
        """Only windows that the stream's time has closed."""
        if isinstance(self.spec, windows.UnlimitedWindows):
            raise ValueError("an unlimited window never closes")
        return replace(self, final=True)

    def dropping_late(self, *partition: str) -> Windowed:
        """Exactly the records that a record-at-a-time operator accepts; partition: where arrival order holds."""
        if isinstance(self.spec, windows.UnlimitedWindows):
            raise ValueError("no record is late for an unlimited window")
        return replace(self, late_by=partition or ("partition",))

    def count(self, name: str = "count", materialized: Materialized = Materialized()) -> Table:
        if self.late_by and isinstance(self.spec, windows.SessionWindows):
            return self._made(windows.late_sessions(self.df, self.spec, self.late_by).withColumnRenamed("count", name), materialized)
        return self.aggregate(materialized, **{name: F.count(F.lit(1))})

    def aggregate(self, materialized: Materialized = Materialized(), **aggs: Column) -> Table:
        if self.late_by and isinstance(self.spec, windows.SessionWindows):
            raise ValueError("sessions without late records can be counted, or folded by windows.fold_sessions")
        if self.late_by:
            open_ = windows.drop_late(self.df.where(F.col("key").isNotNull()), self.spec, self.late_by)
            out = open_.groupBy("key", "window_start", "window_end").agg(*(c.alias(n) for n, c in aggs.items()))
        else:
            out = windows.windowed(self.df, self.spec, aggs)
        return self._made(out, materialized)

    def reduce(self, step: Callable[[Column, Column], Column], name: str = "value") -> Table:
        """An ordered reduction of each window's values; null keys and values go."""
        assigned = self._assigned()
        return self._made(aggregate.reduce(assigned, step, ("key", "window_start", "window_end"), name), Materialized())

    def fold(self, zero: Column, step: Callable[[Column, Column], Column], name: str = "value") -> Table:
        return self._made(aggregate.fold(self._assigned(), zero, step, ("key", "window_start", "window_end"), name), Materialized())

    def fold_sessions(self, zero: object, add: Callable, merge: Callable, kind: str) -> Table:
        """A user's accumulator and merger for sessions."""
        if not isinstance(self.spec, windows.SessionWindows):
            raise ValueError("only sessions merge")
        return self._made(windows.fold_sessions(self.df, self.spec, zero, add, merge, kind), Materialized())

    def _assigned(self) -> DataFrame:
        rows = self.df.where(F.col("key").isNotNull())
        return windows.drop_late(rows, self.spec, self.late_by) if self.late_by else self.spec.assign(rows)

    def _made(self, out: DataFrame, materialized: Materialized) -> Table:
        newest = _newest(self.df)
        if self.final:
            gap = self.spec.gap if isinstance(self.spec, windows.SessionWindows) else 0  # a session can still grow by its gap
            out = windows.final_only(out.join(F.broadcast(newest)), F.col("__newest"), self.spec.grace + gap).drop("__newest")
        return Table(materialized.kept(out, newest), grace=getattr(self.spec, "grace", None), newest=newest)


@dataclass(frozen=True)
class Table:
    """newest: the time of the stream that a windowed table comes from, one row."""

    df: DataFrame
    grace: int | None = None
    newest: DataFrame | None = None

    def filter(self, predicate: Column) -> Table:
        return replace(self, df=tables.keep(self.df, predicate))

    def map_values(self, value: Column) -> Table:
        return replace(self, df=tables.map_values(self.df, value))

    def group_by(self, key: Column, value: Column) -> Grouped:
        return Grouped(tables.regroup(self.df, key, value))

    def join(self, other: Table, value: Column, how: str = "inner", foreign_key: Column | None = None) -> Table:
        if foreign_key is not None:
            return Table(joins.foreign_key(self.df, other.df, foreign_key, value, how), _longest(self.grace, other.grace))
        return Table(joins.table_table(self.df, other.df, value, how), _longest(self.grace, other.grace))

    def to_stream(self, key: Column | None = None) -> Stream:
        """The table's rows as records: its last updates, or all of them if it is a changelog (Grouped.aggregate(changelog=True))."""
        return Stream(self.df if key is None else self.df.withColumn("key", key), key_changed=key is not None, grace=self.grace, newest=self.newest)

    def suppress_until_close(self) -> Table:
        """Final results of a windowed table: windows that end at or before the stream's time less the grace, without tombstones.

        The time is that of the records the table was made of, not of its windows; without a window upstream it is an error.
        """
        if self.grace is None or self.newest is None:
            raise ValueError("no windowed operator upstream")
        closed = self.df.join(F.broadcast(self.newest)).where(F.col("window_end") <= F.col("__newest") - self.grace).drop("__newest")
        return replace(self, df=closed.where(F.col("value").isNotNull()) if "value" in closed.columns else closed)

    def suppress_until_limit(self, wait: int | str, buffer: suppress.Buffer = suppress.Buffer(), by: tuple[str, ...] = ("key",)) -> Table:
        """Updates (a changelog with value, ts and offset) that leave a buffer of the given limits."""
        return replace(self, df=suppress.suppressed(self.df, wait, buffer, by=by))


@dataclass(frozen=True)
class GlobalTable:
    df: DataFrame


@dataclass(frozen=True)
class VersionedTable:
    updates: DataFrame

    @property
    def df(self) -> DataFrame:
        return tables.versions(self.updates)


def stream(df: DataFrame) -> Stream:
    return Stream(df)


def table(changelog: DataFrame) -> Table:
    return Table(tables.latest(changelog))


def global_table(changelog: DataFrame) -> GlobalTable:
    return GlobalTable(tables.latest(changelog))


def versioned_table(changelog: DataFrame) -> VersionedTable:
    return VersionedTable(changelog)
