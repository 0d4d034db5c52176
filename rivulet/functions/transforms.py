"""Single-record transforms. Each takes a record frame (topic, partition, offset, ts, headers, key, value) and returns one.

`on` is "key" or "value". A null target passes unchanged unless stated otherwise. Unknown fields are errors when the plan is
made, since a frame's schema is known then.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, DecimalType, MapType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

from rivulet.functions import fieldpath
from rivulet.record import HEADERS

Transform = Callable[[DataFrame], DataFrame]


def _fields(df: DataFrame, on: str) -> StructType:
    kind = df.schema[on].dataType
    if not isinstance(kind, StructType):
        raise ValueError(f"{on} has no fields")
    return kind


def _rebuilt(df: DataFrame, on: str, columns: Sequence[Column]) -> DataFrame:
    return df.withColumn(on, F.when(F.col(on).isNotNull(), F.struct(*columns)))


def _child(on: str, name: str) -> Column:
    return F.col(on).getField(name)


#: Type names of the schema model -> SQL types.
TYPES = {"int8": "byte", "int16": "short", "int32": "int", "int64": "long", "float32": "float", "float64": "double", "boolean": "boolean", "string": "string", "bytes": "binary"}


def cast(spec: dict[str, str] | str, on: str = "value") -> Transform:
    """Field types by name, or one type for the whole target."""

    def run(df: DataFrame) -> DataFrame:
        if isinstance(spec, str):
            return df.withColumn(on, F.col(on).cast(TYPES[spec]))
        fields = _fields(df, on)
        if unknown := set(spec) - set(fields.names):
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        return _rebuilt(df, on, [(_child(on, n).cast(TYPES[spec[n]]) if n in spec else _child(on, n)).alias(n) for n in fields.names])

    return run


def drop_headers(names: Sequence[str]) -> Transform:
    return lambda df: df.withColumn("headers", F.filter("headers", lambda h: ~h["key"].isin(list(names))))


def insert_header(name: str, literal: str) -> Transform:
    return lambda df: df.withColumn("headers", F.array_append(F.coalesce("headers", F.array().cast(HEADERS)), F.struct(F.lit(name).alias("key"), F.lit(literal).cast("binary").alias("value"))))


def header_from(fields: Sequence[str], headers: Sequence[str], operation: str = "copy", on: str = "value") -> Transform:
    """Fields copied or moved to headers of the given names."""
    if len(fields) != len(headers):
        raise ValueError("fields and headers must be as many")
    if operation not in ("copy", "move"):
        raise ValueError(f"unknown operation: {operation}")

    def run(df: DataFrame) -> DataFrame:
        names = _fields(df, on).names
        added = F.array(*(F.struct(F.lit(h).alias("key"), _child(on, f).cast("string").cast("binary").alias("value")) for f, h in zip(fields, headers, strict=True)))
        out = df.withColumn("headers", F.when(F.col(on).isNull(), F.col("headers")).otherwise(F.concat(F.coalesce("headers", F.array().cast(HEADERS)), added.cast(HEADERS))))
        return out if operation == "copy" else _rebuilt(out, on, [_child(on, n).alias(n) for n in names if n not in fields])

    return run


def extract_field(path: str, on: str = "value", version: str = "V1") -> Transform:
    def run(df: DataFrame) -> DataFrame:
        steps = fieldpath.parse(path, version)
        kind = df.schema[on].dataType
        if fieldpath.type_of(kind, steps) is None:
            raise ValueError(f"Unknown field: {path}")
        return df.withColumn(on, fieldpath.get(F.col(on), kind, steps))

    return run


def filter_records(predicate: Column, negate: bool = False) -> Transform:
    """Drops the records that the predicate holds for (negate: the others)."""
    p = F.coalesce(predicate, F.lit(False))
    return lambda df: df.where(p if negate else ~p)


def flatten(delimiter: str = ".", on: str = "value") -> Transform:
    """Nested structs become fields of joined names; arrays and maps stay."""

    def leaves(kind: StructType, column: Column, prefix: str) -> list[Column]:
        out = []
        for f in kind.fields:
            name = prefix + f.name
            inner = column.getField(f.name)
            out += leaves(f.dataType, inner, name + delimiter) if isinstance(f.dataType, StructType) else [inner.alias(name)]
        return out

    return lambda df: _rebuilt(df, on, leaves(_fields(df, on), F.col(on), ""))


def hoist(field: str, on: str = "value") -> Transform:
    """The whole target becomes a struct's one field, null included."""
    return lambda df: df.withColumn(on, F.struct(F.col(on).alias(field)))


def insert_field(on: str = "value", topic: str | None = None, partition: str | None = None, offset: str | None = None, timestamp: str | None = None, static: tuple[str, str] | None = None) -> Transform:
    """Record attributes and a fixed text as fields, under the given names; a null target stays null."""

    def run(df: DataFrame) -> DataFrame:
        new = [(n, F.col(c)) for n, c in ((topic, "topic"), (partition, "partition"), (offset, "offset"), (timestamp, "ts")) if n]
        new += [(static[0], F.lit(static[1]))] if static else []
        names = [n for n in _fields(df, on).names if n not in {x for x, _ in new}]
        return _rebuilt(df, on, [*(_child(on, n).alias(n) for n in names), *(c.alias(n) for n, c in new)])

    return run


def _blank(kind: DataType) -> Column:
    if isinstance(kind, StringType):
        return F.lit("")
    if isinstance(kind, BooleanType):
        return F.lit(False)
    if isinstance(kind, NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return F.lit("1970-01-01").cast(kind)
    if isinstance(kind, ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, BinaryType):
        return F.lit(b"")
    raise ValueError(f"cannot mask {kind.simpleString()}")


def mask(fields: Sequence[str], replacement: str | None = None, on: str = "value") -> Transform:
    """Fields become their type's zero or empty value, or a replacement (numbers and texts only); null stays null."""

    def run(df: DataFrame) -> DataFrame:
        out = []
        for f in _fields(df, on).fields:
            c = _child(on, f.name)
            if f.name in fields:
                if replacement is not None and not isinstance(f.dataType, (NumericType, StringType, DecimalType)):
                    raise ValueError(f"cannot mask {f.dataType.simpleString()} with a replacement")
                new = F.lit(replacement).cast(f.dataType) if replacement is not None else _blank(f.dataType)
                c = F.when(c.isNotNull(), new)
            out.append(c.alias(f.name))
        return _rebuilt(df, on, out)

    return run


def regex_router(regex: str, replacement: str) -> Transform:
    """A topic that the expression matches as a whole is replaced ($1 for groups); others stay."""
    full = f"^(?:{regex})$"
    return lambda df: df.withColumn("topic", F.when(F.col("topic").rlike(full), F.regexp_replace("topic", full, replacement)).otherwise(F.col("topic")))


def replace_fields(include: Sequence[str] = (), exclude: Sequence[str] = (), renames: dict[str, str] | None = None, on: str = "value") -> Transform:
    """Exclusion wins over inclusion; no inclusion means all; what is left is renamed."""
    renames = renames or {}

    def run(df: DataFrame) -> DataFrame:
        names = [n for n in _fields(df, on).names if n not in exclude and (not include or n in include)]
        return _rebuilt(df, on, [_child(on, n).alias(renames.get(n, n)) for n in names])

    return run


def set_schema_metadata(name: str | None = None, version: int | None = None, on: str = "value") -> Transform:
    if name is None and version is None:
        raise ValueError("give a schema name or version")

    def run(df: DataFrame) -> DataFrame:
        meta = dict(df.schema[on].metadata)
        meta |= {"schema.name": name} if name is not None else {}
        meta |= {"schema.version": version} if version is not None else {}
        return df.withMetadata(on, meta)

    return run


def timestamp_convert(target: str, field: str | None = None, pattern: str = "yyyy-MM-dd HH:mm:ss", on: str = "value", unit: str = "milliseconds") -> Transform:
    """Between string, unix (a long in the unit), Date, Time (milliseconds of the day) and Timestamp, in UTC."""
    scale = {"seconds": 1_000_000, "milliseconds": 1_000, "microseconds": 1}[unit]

    def micros(c: Column, kind: DataType) -> Column:
        if isinstance(kind, StringType):
            c, kind = F.to_timestamp_ntz(c, F.lit(pattern)), TimestampNTZType()
        if isinstance(kind, TimestampType):
            return F.unix_micros(c)
        if isinstance(kind, DateType):
            return F.unix_date(c).cast("long") * 86_400_000_000
        if isinstance(kind, TimestampNTZType):
            return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c)
        return c.cast("long") * scale

    def made(us: Column) -> Column:
        ntz = F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
        day = F.floor(us / F.lit(86_400_000_000))
        made_ = {
            "string": lambda: F.date_format(ntz, pattern),
            "unix": lambda: F.floor(us / F.lit(scale)).cast("long"),
            "Date": lambda: F.date_from_unix_date(day.cast("int")),
            "Time": lambda: F.floor((us - day * 86_400_000_000) / F.lit(1000)).cast("int"),
            "Timestamp": lambda: ntz,
        }
        if target not in made_:
            raise ValueError(f"unknown target type: {target}")
        return made_[target]()

    def run(df: DataFrame) -> DataFrame:
        if field is None:
            return df.withColumn(on, made(micros(F.col(on), df.schema[on].dataType)))
        fields = _fields(df, on)
        return _rebuilt(df, on, [(made(micros(_child(on, f.name), f.dataType)) if f.name == field else _child(on, f.name)).alias(f.name) for f in fields.fields])

    return run


def timestamp_router(topic_format: str = "${topic}-${timestamp}", pattern: str = "yyyyMMdd") -> Transform:
    """The topic from its name and the record's time (UTC); a record without a time is an error."""
    ntz = F.timestamp_add("MILLISECOND", F.col("ts"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    stamp = F.when(F.col("ts").isNull(), F.raise_error(F.lit("a record has no timestamp"))).otherwise(F.date_format(ntz, pattern))
    new = F.replace(F.replace(F.lit(topic_format), F.lit("${topic}"), F.col("topic")), F.lit("${timestamp}"), stamp)
    return lambda df: df.withColumn("topic", new)


def value_to_key(fields: Sequence[str]) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        if missing := set(fields) - set(_fields(df, "value").names):
            raise ValueError(f"Field does not exist: {sorted(missing)}")
        return df.withColumn("key", F.struct(*(_child("value", f).alias(f) for f in fields)))

    return run


def has_header(name: str) -> Column:
    return F.exists(F.coalesce("headers", F.array().cast(HEADERS)), lambda h: h["key"] == name)


def is_tombstone() -> Column:
    return F.col("value").isNull()


def topic_matches(regex: str) -> Column:
    return F.col("topic").rlike(f"^(?:{regex})$")


def chain(df: DataFrame, *stages: Transform | tuple[Transform, Column] | tuple[Transform, Column, bool]) -> DataFrame:
    """Stages in order. A stage with a predicate applies to the rows it holds for (or, negated, to the others).

    A guarded stage must keep the schema (or drop rows), as both parts are one frame afterwards.
    """
    for stage in stages:
        if callable(stage):
            df = stage(df)
            continue
        run, predicate, negate = (*stage, False)[:3]
        p = F.coalesce(predicate, F.lit(False))
        p = ~p if negate else p
        df = run(df.where(p)).unionByName(df.where(~p))
    return df
