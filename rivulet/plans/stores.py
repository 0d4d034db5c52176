"""Named stores and the queries on them.

A store is a frame under a name: key-value (key, value, ts), window (key, window_start, window_end, value), session (the
same), or versioned (key, valid_from, valid_to, value). Queries are objects; the registry compiles them to filters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.operators import tables


@dataclass(frozen=True)
class KeyQuery:
    key: object
    with_timestamp: bool = False


@dataclass(frozen=True)
class RangeQuery:
    lower: object = None
    upper: object = None
    descending: bool = False
    with_timestamp: bool = False


@dataclass(frozen=True)
class PrefixQuery:
    prefix: str


@dataclass(frozen=True)
class VersionedKeyQuery:
    key: object
    as_of: int | None = None


@dataclass(frozen=True)
class MultiVersionedKeyQuery:
    key: object
    start: int | None = None
    end: int | None = None
    descending: bool = False


@dataclass(frozen=True)
class WindowKeyQuery:
    """A key's windows whose start is in [start, end]."""

    key: object
    start: int
    end: int


@dataclass(frozen=True)
class WindowRangeQuery:
    """All windows whose start is in [start, end], or a key's sessions."""

    start: int | None = None
    end: int | None = None
    key: object = None


class Position(dict):
    """{topic: {partition: offset}}: how far a store has read."""

    def merge(self, other: Position) -> Position:
        out = Position({t: dict(p) for t, p in self.items()})
        for t, parts in other.items():
            for p, o in parts.items():
                out.setdefault(t, {})[p] = max(o, out.get(t, {}).get(p, o))
        return out

    def reached(self, bound: Position) -> bool:
        return all(self.get(t, {}).get(p, -1) >= o for t, parts in bound.items() for p, o in parts.items())


@dataclass(frozen=True)
class Request:
    store: str
    query: object
    partitions: tuple[int, ...] | None = None
    bound: Position = field(default_factory=Position)


class NotUpToBound(RuntimeError):
    """The store has not read as far as the request wants."""


@dataclass(frozen=True)
class Result:
    """What a partition, or with partition None a global store, answers: rows, or the reason why not."""

    partition: int | None
    rows: DataFrame | None = None
    failure: str | None = None
    position: Position = field(default_factory=Position)


#: Reasons of failures.
UNKNOWN_QUERY, NOT_PRESENT, NOT_UP_TO_BOUND, DOES_NOT_EXIST = "UNKNOWN_QUERY_TYPE", "NOT_PRESENT", "NOT_UP_TO_BOUND", "DOES_NOT_EXIST"


class Stores:
    def __init__(self) -> None:
        self._frames: dict[str, tuple[DataFrame, Position]] = {}

    def add(self, name: str, df: DataFrame, position: Position | None = None) -> DataFrame:
        """Also a temporary view of that name, so that SQL reaches it."""
        self._frames[name] = (df, position or Position())
        df.createOrReplaceTempView(name)
        return df

    def frame(self, name: str) -> DataFrame:
        return self._frames[name][0]

    def entries(self, name: str) -> int:
        return self._frames[name][0].count()

    def run(self, request: Request) -> DataFrame:
        if request.store not in self._frames:
            raise KeyError(f"no store is named {request.store}")
        df, position = self._frames[request.store]
        if not position.reached(request.bound):
            raise NotUpToBound(request.store)
        if request.partitions is not None:
            df = df.where(F.col("partition").isin(list(request.partitions)))
        return compiled(df, request.query)


    def results(self, request: Request) -> list[Result]:
        """One result for each partition asked for, with a reason for each that can't answer; else one for the whole store."""
        if request.store not in self._frames:
            return [Result(p, failure=NOT_PRESENT) for p in request.partitions or (None,)]
        df, position = self._frames[request.store]
        out = []
        for p in request.partitions or (None,):
            bound = Position({t: {q: o for q, o in parts.items() if p is None or q == p} for t, parts in request.bound.items()})
            try:
                if p is not None and "partition" not in df.columns:
                    out.append(Result(p, failure=DOES_NOT_EXIST, position=position))
                elif not position.reached(bound):
                    out.append(Result(p, failure=NOT_UP_TO_BOUND, position=position))
                else:
                    out.append(Result(p, compiled(df if p is None else df.where(F.col("partition") == p), request.query), position=position))
            except TypeError:
                out.append(Result(p, failure=UNKNOWN_QUERY, position=position))
        return out

    def composite(self, names: list[str]) -> DataFrame:
        """Several stores' rows as one read-only store."""
        out = self.frame(names[0])
        for n in names[1:]:
            out = out.unionByName(self.frame(n), allowMissingColumns=True)
        return out

    def put(self, name: str, updates: DataFrame) -> DataFrame:
        """The store after puts in order of offset; null deletes."""
        return self.add(name, tables.put(self.frame(name), updates), self._frames[name][1])

    def put_if_absent(self, name: str, updates: DataFrame) -> DataFrame:
        return self.add(name, tables.put_if_absent(self.frame(name), updates), self._frames[name][1])

    def delete(self, name: str, keys: DataFrame) -> DataFrame:
        return self.add(name, tables.delete(self.frame(name), keys), self._frames[name][1])


def compiled(df: DataFrame, q: object) -> DataFrame:
    key = F.col("key")
    if isinstance(q, KeyQuery):
        return df.where(key == q.key).select("key", "value", *(["ts"] if q.with_timestamp else []))
    if isinstance(q, RangeQuery):
        out = df if q.lower is None else df.where(key >= q.lower)
        out = out if q.upper is None else out.where(key <= q.upper)
        return out.select("key", "value", *(["ts"] if q.with_timestamp else [])).orderBy(F.desc("key") if q.descending else "key")
    if isinstance(q, PrefixQuery):
        return df.where(key.cast("string").startswith(q.prefix)).select("key", "value").orderBy("key")
    if isinstance(q, VersionedKeyQuery):
        own = df.where(key == q.key)
        return own.where(F.col("valid_to").isNull()) if q.as_of is None else tables.as_of(own, q.as_of)
    if isinstance(q, MultiVersionedKeyQuery):
        out = df.where(key == q.key)
        out = out if q.end is None else out.where(F.col("valid_from") <= q.end)
        out = out if q.start is None else out.where(F.col("valid_to").isNull() | (F.col("valid_to") > q.start))
        return out.orderBy(F.desc("valid_from") if q.descending else "valid_from")
    if isinstance(q, WindowKeyQuery):
        return df.where((key == q.key) & F.col("window_start").between(q.start, q.end)).orderBy("window_start")
    if isinstance(q, WindowRangeQuery):
        if q.key is not None:
            return df.where(key == q.key).orderBy("window_start")
        return df.where(F.col("window_start").between(q.start, q.end)).orderBy("window_start", "key")
    raise TypeError(f"unknown query: {type(q).__name__}")


def sessions_of(df: DataFrame, key: object, earliest_end: int, latest_start: int) -> DataFrame:
    """A key's sessions that end at or after, and start at or before, the given times."""
    return df.where((F.col("key") == key) & (F.col("window_end") >= earliest_end) & (F.col("window_start") <= latest_start)).orderBy("window_start")
