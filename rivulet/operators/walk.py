"""An ordered walk: each key's records one after another through Python code, for what no expression can say.

Records of a key are dealt to one task and sorted there, and the code sees them as a stream, so memory holds the code's
own state for one key, never the key's history. Batches travel as Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rivulet.record import importable

#: Rows of an Arrow batch that goes back to the JVM.
ROWS = 5000


def walk(df: DataFrame, by: Sequence[str], order: Sequence[str], visit: Callable[[tuple, Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """visit(key, records) yields rows of the schema; records are dicts by column, in the order given.

    Rows with a null in `by` are a key like any other: leave them out before if they shouldn't be.
    """
    importable(df.sparkSession)
    names, at = df.columns, [df.columns.index(c) for c in by]
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made = (x for key, own in groupby(rows, lambda r: tuple(r[i] for i in at)) for x in visit(key, (dict(zip(names, r, strict=True)) for r in own)))
        while part := list(islice(made, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), out, strict=True)], schema=out)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
