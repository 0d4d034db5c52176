"""Structured Streaming twins of the batch operators.

Batch operators reproduce record-at-a-time lateness exactly; streams use watermarks, which advance once a micro-batch, so
a stream may accept a record that a record-at-a-time operator would drop, never the reverse within one batch.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from rivulet.operators.joins import JoinWindows
from rivulet.operators.windows import SessionWindows, TimeWindows
from rivulet.record import importable
from rivulet.sources import files


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the folder that driver and executors share; only local mode may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{root or tempfile.gettempdir() + '/checkpoints'}/rivulet-streams/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_made() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended; the folder's owner then clears it
            return


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's setting is put back after."""
    importable(spark)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def read(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def with_time(df: DataFrame, grace: int) -> DataFrame:
    """event_time with a watermark of the grace."""
    return df.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", f"{grace} milliseconds")


def windowed(df: DataFrame, spec: TimeWindows | SessionWindows, aggs: dict[str, Column], by: tuple[str, ...] = ("key",)) -> DataFrame:
    """A windowed aggregate: `update` mode sends each change, `append` only final results, `complete` everything each time."""
    timed = with_time(df.where(F.col("key").isNotNull()), spec.grace)
    if isinstance(spec, SessionWindows):
        # as in SessionWindows.aggregate: a filter on the grouping window would cut sessions off
        at = F.session_window("event_time", f"{spec.gap} milliseconds")
        ends = [F.min(F.unix_millis("event_time")).alias("window_start"), F.max(F.unix_millis("event_time")).alias("window_end")]
        return timed.where("ts >= 0").groupBy(*by, at.alias("__w")).agg(*ends, *(c.alias(n) for n, c in aggs.items())).select(*by, "window_start", "window_end", *aggs)
    at = F.window("event_time", f"{spec.size} milliseconds", f"{spec.advance} milliseconds")
    out = timed.groupBy(*by, at.alias("__w")).agg(*(c.alias(n) for n, c in aggs.items()))
    out = out.select(*by, F.unix_millis("__w.start").alias("window_start"), F.unix_millis("__w.end").alias("window_end"), *aggs)
    return out.where("window_start >= 0")


def joined(left: DataFrame, right: DataFrame, w: JoinWindows, value: Column, how: str = "inner") -> DataFrame:
    """A windowed join of two streams: the window bounds the state on both sides, with the grace as watermark."""
    l = with_time(left, w.grace)  # noqa: E741
    r = with_time(right, w.grace).withColumnsRenamed({c: f"__r_{c}" for c in [*right.columns, "event_time"]})
    within = (F.col("__r_event_time") >= F.col("event_time") - F.expr(f"INTERVAL {w.before} MILLISECONDS")) & (F.col("__r_event_time") <= F.col("event_time") + F.expr(f"INTERVAL {w.after} MILLISECONDS"))
    kinds = {"inner": "inner", "left": "leftOuter", "outer": "fullOuter"}
    # a full outer join of streams would pair null keys by itself
    out = l.join(r, (F.col("key") == F.col("__r_key")) & F.col("key").isNotNull() & within, kinds[how]).withColumn("right_value", F.col("__r_value"))
    return out.select(F.coalesce("key", "__r_key").alias("key"), value.alias("value"), F.greatest("ts", "__r_ts").alias("ts"))


def collect(df: DataFrame, mode: str = "append", checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns what its sink holds: Parquet in the shared folder, a folder a batch.

    A repeated batch replaces its own folder, so each takes effect once. In `complete` mode the last batch is the result.
    With a checkpoint and path of an earlier run, the stream goes on from there.
    """
    spark = df.sparkSession
    path, checkpoint = path or scratch(spark, "sink"), checkpoint or scratch(spark, "checkpoint")
    to_batches(df, files.exactly_once(path), checkpoint, mode)
    return written(spark, path, df.schema, mode)


def written(spark: SparkSession, path: str, schema, mode: str = "append") -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    out = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])  # a number of a folder, not of rows
    return out.drop("batch")


def to_batches(df: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there into a foreachBatch sink; with an idempotent sink each record takes effect once."""
    df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def supervised(start: Callable[[], StreamingQuery], on_error: Callable[[Exception, int], str], most: int = 3) -> int:
    """Runs a query to its end; on failure the handler says `restart` (from its checkpoint) or `stop`. Returns the restarts."""
    for restarts in range(most + 1):
        try:
            start().awaitTermination()
            return restarts
        except Exception as e:
            if restarts == most or on_error(e, restarts) != "restart":
                raise
    return most
