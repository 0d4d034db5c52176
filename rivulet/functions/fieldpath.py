"""Field paths: V1 is a literal name; V2 is dotted, with backticks around names that hold dots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, StructType


def parse(path: str, version: str = "V1") -> list[str]:
    """Steps of a path. In V2 a name may stand in backticks, in which `\\`` is a backtick; a backtick left open is an error."""
    if version.upper() == "V1":
        return [path]
    steps, i, n = [], 0, len(path)
    while i <= n:
        if i < n and path[i] == "`":
            name, i = [], i + 1
            while True:
                if i >= n:
                    raise ValueError(f"incomplete backtick pair in {path!r}")
                if path[i] == "\\" and i + 1 < n and path[i + 1] == "`":
                    name.append("`")
                    i += 2
                elif path[i] == "`" and (i + 1 == n or path[i + 1] == "."):
                    i += 1
                    break
                else:
                    name.append(path[i])
                    i += 1
            steps.append("".join(name))
            i += 1
            if i > n:
                break
        else:
            end = path.find(".", i)
            end = n if end < 0 else end
            steps.append(path[i:end])
            i = end + 1
    return steps


def type_of(kind: DataType, steps: list[str]) -> DataType | None:
    """The type at a path, or None if there is no such field."""
    for s in steps:
        if isinstance(kind, StructType) and s in kind.names:
            kind = kind[s].dataType
        elif isinstance(kind, MapType):
            kind = kind.valueType
        else:
            return None
    return kind


def get(root: Column, kind: DataType, steps: list[str]) -> Column:
    for s in steps:
        root, kind = (root[F.lit(s)] if isinstance(kind, MapType) else root.getField(s)), type_of(kind, [s])
    return root
