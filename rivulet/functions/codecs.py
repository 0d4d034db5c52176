"""Converters and serdes between typed columns and bytes; JSON with a schema envelope; schema projection."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructField, StructType, TimestampNTZType, TimestampType

#: Schema-model names of the SQL types, in the order of numeric widening.
NAMES = {"byte": "int8", "short": "int16", "int": "int32", "bigint": "int64", "float": "float", "double": "double", "boolean": "boolean", "string": "string", "binary": "bytes", "tinyint": "int8", "smallint": "int16"}
WIDENING = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType)
WIDTHS = {"short": 2, "int": 4, "long": 8}


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once a row, however often use names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def encode_number(c: Column, kind: str) -> Column:
    """Big-endian two's complement bytes of a short, int or long."""
    return F.unhex(digits(c, kind))


def digits(c: Column, kind: str) -> Column:
    """encode_number's bytes in hexadecimal."""
    return F.right(F.lpad(F.hex(c.cast("long")), 16, "0"), F.lit(2 * WIDTHS[kind]))


def decode_number(c: Column, kind: str) -> Column:
    """The number of big-endian bytes; another length is an error, null stays null."""
    width = WIDTHS[kind]
    return F.when(F.octet_length(c) != width, F.raise_error(F.lit(f"not {width} bytes"))).otherwise(of_digits(F.hex(c), kind))


def of_digits(c: Column, kind: str) -> Column:
    """The number of decode_number's bytes in hexadecimal: -10 asks for a signed number, the shifts carry the sign up."""
    away = 64 - 8 * WIDTHS[kind]
    return F.shiftright(F.shiftleft(F.conv(c, 16, -10).cast("long"), away), away).cast(kind)


def encode_float(c: Column, kind: str = "double") -> Column:
    """Big-endian IEEE 754 bytes of a float or double. No built-in function gives a number's bits, so batches go through Arrow."""
    form, width = (">f4", 4) if kind == "float" else (">f8", 8)

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        raw = x.to_numpy(dtype=float).astype(form).tobytes()
        return pd.Series([raw[i : i + width] for i in range(0, len(raw), width)])

    return F.when(c.isNotNull(), run(F.coalesce(c.cast("double"), F.lit(0.0))))


def decode_float(c: Column, kind: str = "double") -> Column:
    """The number of big-endian bytes; another length is an error, null stays null."""
    form, width = (">f4", 4) if kind == "float" else (">f8", 8)

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(np.frombuffer(b"".join(bytes(v) for v in x), form).astype(float))

    right = F.when(F.octet_length(c) != width, F.raise_error(F.lit(f"not {width} bytes"))).otherwise(c)
    return F.when(c.isNotNull(), run(F.coalesce(right, F.lit(bytes(width)))))


def windowed_key(key: Column, start: Column) -> Column:
    """A windowed key's bytes: the inner key and the window's start in eight bytes; the end follows from the window's size."""
    return F.concat(key, encode_number(start, "long"))


def windowed_key_parts(c: Column, size: int) -> Column:
    """struct(key, window_start, window_end)."""
    n = F.octet_length(c)
    start = decode_number(F.substring(c, n - 7, F.lit(8)), "long")
    return F.struct(F.substring(c, F.lit(1), n - 8).alias("key"), start.alias("window_start"), (start + size).alias("window_end"))


def session_key(key: Column, start: Column, end: Column) -> Column:
    """A session key's bytes: the inner key, the session's end and its start."""
    return F.concat(key, encode_number(end, "long"), encode_number(start, "long"))


def encode_boolean(c: Column) -> Column:
    return F.when(c, F.lit(b"\x01")).when(~c, F.lit(b"\x00"))


def decode_boolean(c: Column) -> Column:
    return F.when(F.hex(c) == "01", True).when(F.hex(c) == "00", False).when(c.isNotNull(), F.raise_error(F.lit("not a boolean")))


def encode_string(c: Column, charset: str = "UTF-8") -> Column:
    return F.encode(c.cast("string"), charset)


def decode_string(c: Column, charset: str = "UTF-8") -> Column:
    return F.decode(c, charset)


def encode_list(c: Column) -> Column:
    """An array of ints as bytes: number of nulls, their places, number of items, the items that aren't null, all four bytes wide."""
    four = lambda x: digits(x, "int")
    joined = lambda a: F.array_join(F.transform(a, four), "")

    def written(a: Column) -> Column:
        nulls = F.filter(F.transform(a, lambda x, i: F.when(x.isNull(), i)), lambda i: i.isNotNull())
        return F.when(a.isNotNull(), F.unhex(once(nulls, lambda n: F.concat(four(F.size(n)), joined(n), four(F.size(a)), joined(F.filter(a, lambda x: x.isNotNull()))))))

    return once(c, written)


def decode_list(c: Column) -> Column:
    """encode_list's array: the bytes are cut into numbers once, and the runs of items between nulls put together."""

    def spread(size: Column, nulls: Column, items: Column) -> Column:
        """items with a null before each place in nulls, which are in order and less than size."""
        n = F.size(nulls)
        begin = lambda k: F.when(k > 0, F.get(nulls, k - 1) - k + 1).otherwise(0)
        end = lambda k: F.when(k < n, F.get(nulls, k) - k).otherwise(size - n)
        null = F.array(F.lit(None).cast("int"))
        run = lambda k: F.concat(F.slice(items, begin(k) + 1, end(k) - begin(k)), F.when(k < n, null).otherwise(F.array().cast("array<int>")))
        return F.flatten(F.transform(F.sequence(F.lit(0), n), run))

    def read(w: Column) -> Column:
        n = F.greatest(F.get(w, F.lit(0)), F.lit(0))
        size = F.coalesce(F.get(w, n + 1), F.raise_error(F.lit("not 4 bytes")).cast("int"))
        places = lambda size: F.array_sort(F.array_distinct(F.filter(F.slice(w, 2, n), lambda p: (p >= 0) & (p < size))))
        items = lambda size, nulls: F.slice(w, n + 3, size - F.size(nulls))
        whole = lambda size, nulls, a: F.when(F.size(a) < size - F.size(nulls), F.raise_error(F.lit("not 4 bytes"))).otherwise(spread(size, nulls, a))
        some = lambda s: once(places(s), lambda nulls: once(items(s, nulls), lambda a: whole(s, nulls, a)))
        return once(size, lambda s: F.when(s > 0, some(s)).otherwise(F.array().cast("array<int>")))

    def numbers(h: Column) -> Column:
        """The whole numbers of eight digits; the rest doesn't count."""
        n = F.floor(F.length(h) / F.lit(8)).cast("int")
        of = lambda i: of_digits(F.substring(h, i * 8 + 1, F.lit(8)), "int")
        return F.when(n < 2, F.raise_error(F.lit("not 4 bytes"))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), of))

    return once(F.hex(c), lambda h: F.when(h.isNotNull(), once(numbers(h), read)))


def encode_uuid(c: Column) -> Column:
    """A UUID's bytes: its text in ASCII, as serialised; another text is an error."""
    form = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    return F.when(c.isNull(), F.lit(None)).when(c.rlike(form), F.encode(F.lower(c), "UTF-8")).otherwise(F.raise_error(F.lit("not a UUID")).cast("binary"))


def decode_uuid(c: Column) -> Column:
    text = F.decode(c, "UTF-8")
    form = r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    return F.when(c.isNull(), F.lit(None)).when(F.lower(text).rlike(form), F.lower(text)).otherwise(F.raise_error(F.lit("not a UUID")))


def encode_bytes(c: Column) -> Column:
    """Bytes are their own serialised form."""
    return c.cast("binary")


def decode_bytes(c: Column) -> Column:
    return c.cast("binary")


def encode_void(c: Column) -> Column:
    """Only null can be serialised, as null."""
    return F.when(c.isNotNull(), F.raise_error(F.lit("not void")).cast("binary"))


def decode_void(c: Column) -> Column:
    return F.when(c.isNotNull(), F.raise_error(F.lit("not void")))


#: Converters of header values, as of keys and values, by name: (to bytes, from bytes).
CONVERTERS = {
    "short": (lambda c: encode_number(c, "short"), lambda c: decode_number(c, "short")),
    "int": (lambda c: encode_number(c, "int"), lambda c: decode_number(c, "int")),
    "long": (lambda c: encode_number(c, "long"), lambda c: decode_number(c, "long")),
    "boolean": (encode_boolean, decode_boolean),
    "string": (encode_string, decode_string),
    "bytes": (encode_bytes, decode_bytes),
    "uuid": (encode_uuid, decode_uuid),
}


def to_header(headers: Column, name: str, value: Column, converter: str = "string") -> Column:
    """headers with one more, its value converted to bytes."""
    one = F.struct(F.lit(name).alias("key"), CONVERTERS[converter][0](value).alias("value"))
    return F.array_append(F.coalesce(headers, F.array().cast("array<struct<key: string, value: binary>>")), one)


def from_header(headers: Column, name: str, converter: str = "string") -> Column:
    """The value of the last header of that name; null if there is none."""
    own = F.filter(headers, lambda h: h["key"] == name)
    return F.when(F.size(own) > 0, CONVERTERS[converter][1](F.get(own, F.size(own) - 1)["value"]))


def decimal_bytes(c: Column, scale: int) -> Column:
    """A decimal's unscaled number as base64 of its shortest big-endian two's complement bytes, for up to 18 digits."""
    n = (c.cast(f"decimal(38,{scale})") * F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast("long")
    size = F.lit(8)
    for width in range(7, 0, -1):
        low, high = -(1 << (8 * width - 1)), (1 << (8 * width - 1)) - 1
        size = F.when(n.between(low, high), width).otherwise(size)
    return F.base64(F.unhex(F.right(F.lpad(F.hex(n), 16, "0"), 2 * size)))


def decimal_of_bytes(c: Column, scale: int) -> Column:
    raw = F.hex(F.unbase64(c))
    negative = F.conv(F.substring(raw, 1, 2), 16, 10).cast("int") >= 128
    wide = F.lpad(raw, 16, "0")
    wide = F.when(negative, F.lpad(raw, 16, "F")).otherwise(wide)
    return (decode_number(F.unhex(wide), "long").cast("decimal(38,0)") / F.lit(10**scale).cast("decimal(38,0)")).cast(f"decimal(18,{scale})")


def decimal_json(c: Column, scale: int, form: str = "base64") -> Column:
    """A decimal in JSON: its bytes in base64 (a string), or a plain number."""
    if form not in ("base64", "numeric"):
        raise ValueError(f"unknown form of decimals: {form}")
    return F.concat(F.lit('"'), decimal_bytes(c, scale), F.lit('"')) if form == "base64" else c.cast(f"decimal(38,{scale})").cast("string")


def decimal_of_json(text: Column, scale: int, form: str = "base64") -> Column:
    return decimal_of_bytes(F.regexp_replace(text, '"', ""), scale) if form == "base64" else text.cast(f"decimal(18,{scale})")


def envelope_schema(kind: DataType, optional: bool = True, name: str | None = None) -> dict:
    """The `schema` part of a JSON envelope for a type."""
    out: dict
    if isinstance(kind, StructType):
        out = {"type": "struct", "fields": [envelope_schema(f.dataType, f.nullable) | {"field": f.name} for f in kind.fields]}
    elif isinstance(kind, ArrayType):
        out = {"type": "array", "items": envelope_schema(kind.elementType, kind.containsNull)}
    elif isinstance(kind, MapType):
        out = {"type": "map", "keys": envelope_schema(kind.keyType, False), "values": envelope_schema(kind.valueType, kind.valueContainsNull)}
    elif isinstance(kind, DecimalType):
        out = {"type": "bytes", "name": "Decimal", "parameters": {"scale": str(kind.scale)}}
    elif isinstance(kind, DateType):
        out = {"type": "int32", "name": "Date"}
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        out = {"type": "int64", "name": "Timestamp"}
    else:
        out = {"type": NAMES[kind.simpleString()]}
    out["optional"] = optional
    return out | ({"name": name} if name else {})


def spark_type(schema: dict) -> DataType:
    """The type of an envelope's `schema` part."""
    plain = {"int8": ByteType, "int16": ShortType, "int32": IntegerType, "int64": LongType, "float": FloatType, "double": DoubleType, "boolean": BooleanType, "string": StringType, "bytes": BinaryType}
    if schema["type"] == "struct":
        return StructType([StructField(f["field"], spark_type(f), f.get("optional", False)) for f in schema["fields"]])
    if schema["type"] == "array":
        return ArrayType(spark_type(schema["items"]), schema["items"].get("optional", False))
    if schema["type"] == "map":
        return MapType(spark_type(schema["keys"]), spark_type(schema["values"]), schema["values"].get("optional", False))
    if (name := schema.get("name", "").rpartition(".")[2]) in ("Date", "Timestamp", "Decimal"):
        return {"Date": DateType(), "Timestamp": TimestampType()}.get(name) or DecimalType(38, int(schema["parameters"]["scale"]))
    return plain[schema["type"]]()


def to_envelope(df: DataFrame, column: str) -> Column:
    """JSON text {"schema": ..., "payload": ...}; a null value is a null payload."""
    schema = json.dumps(envelope_schema(df.schema[column].dataType, df.schema[column].nullable), separators=(",", ":"))
    return F.concat(F.lit(f'{{"schema":{schema},"payload":'), F.coalesce(F.to_json(column), F.lit("null")), F.lit("}"))


def from_envelope(text: Column, kind: StructType) -> Column:
    return F.from_json(F.get_json_object(text, "$.payload"), kind)


class ProjectionError(ValueError):
    pass


def project(column: Column, source: DataType, target: DataType, defaults: dict[str, object] | None = None, path: str = "") -> Column:
    """A value of one schema as another: numbers widen only; a missing or optional field needs a default if the target requires it.

    defaults: by dotted path of the target.
    """
    defaults = defaults or {}
    if isinstance(source, StructType) and isinstance(target, StructType):
        out = []
        for f in target.fields:
            at = f"{path}.{f.name}".lstrip(".")
            if f.name not in source.names:
                if at not in defaults and not f.nullable:
                    raise ProjectionError(f"required field {at} has no default")
                out.append(F.lit(defaults.get(at)).cast(f.dataType).alias(f.name))
                continue
            have = source[f.name]
            if have.nullable and not f.nullable and at not in defaults:
                raise ProjectionError(f"optional field {at} can't become required without a default")
            c = project(column.getField(f.name), have.dataType, f.dataType, defaults, at)
            out.append((F.coalesce(c, F.lit(defaults[at]).cast(f.dataType)) if at in defaults and not f.nullable else c).alias(f.name))
        return F.when(column.isNotNull(), F.struct(*out))
    if type(source) in WIDENING and type(target) in WIDENING:
        if WIDENING.index(type(source)) > WIDENING.index(type(target)):
            raise ProjectionError(f"{path or 'value'}: {source.simpleString()} doesn't widen to {target.simpleString()}")
        return column.cast(target)
    if isinstance(source, ArrayType) and isinstance(target, ArrayType):
        return F.transform(column, lambda x: project(x, source.elementType, target.elementType, defaults, f"{path}[]"))
    if isinstance(source, MapType) and isinstance(target, MapType):
        return F.transform_values(column, lambda _, v: project(v, source.valueType, target.valueType, defaults, f"{path}{{}}"))
    if source != target:
        raise ProjectionError(f"{path or 'value'}: {source.simpleString()} is not {target.simpleString()}")
    return column
