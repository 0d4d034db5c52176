"""Queries that run as streams over the stored events and must agree with the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions import errors
from rivulet.operators import joins, process
from rivulet.operators.windows import TimeWindows
from rivulet.plans.registry import query
from rivulet.queries.events import NULLED, TWO, _pair, _two
from rivulet.queries.inputs import DAY, HOUR, events
from rivulet.queries.processing import CHANGED, COUNTED, Changes, DailyCounts
from rivulet.sources import files
from rivulet.streaming import processors, run


def _stored(e, parts: int = 4, files: int = 4) -> str:
    """The records in order of their offset, a few parts written one after another, each in some files: a file source reads the oldest first."""
    path, most = run.scratch(e.sparkSession, "events"), e.agg(F.max("offset")).first()[0] + 1
    for i in range(parts):
        part = e.where((F.col("offset") >= most * i // parts) & (F.col("offset") < most * (i + 1) // parts))
        part.repartition(files, "key").write.mode("append").parquet(path)
    return path


def _stream(spark, d, parts: int = 4, files: int = 4):
    e = events(spark, d).select("key", "value", "cents", "ts", "offset")
    return run.read(spark, _stored(e, parts, files), e.schema, files)


@query(f"SELECT key, ts // {DAY} * {DAY} AS window_start, ts // {DAY} * {DAY} + {DAY} AS window_end, count(*) AS count FROM e GROUP BY ALL")
def stream_tumbling(spark, d):
    return run.collect(run.windowed(_stream(spark, d), TimeWindows(DAY, grace=DAY), {"count": F.count(F.lit(1))}), "complete")


@query("SELECT key, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM e GROUP BY key")
def stream_totals(spark, d):
    s = _stream(spark, d)
    return run.collect(s.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")), "complete")


@query('SELECT key, value AS new_value, lag(value) OVER (PARTITION BY key ORDER BY "offset") AS old_value, "offset" FROM e')
def stream_table_changes(spark, d):
    with run.rocksdb(spark):
        return run.collect(processors.table_changes(_stream(spark, d, 2)), "update")


@query(f"""WITH s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts, "offset") AS sid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, "offset") > {6 * HOUR} THEN 1 ELSE 0 END AS new FROM e))
SELECT key, min(ts) AS window_start, max(ts) AS window_end, count(*) AS count FROM s GROUP BY key, sid""")
def stream_session_updates(spark, d):
    """All updates of the stream, then the last one of each session that was not merged into a larger one."""
    with run.rocksdb(spark):
        sent = run.collect(processors.session_updates(_stream(spark, d, 2), 6 * HOUR), "update")
    last = sent.groupBy("key", "window_start", "window_end").agg(F.max("count").alias("count"), F.max(F.col("count").isNull()).alias("gone"))
    return last.where("NOT gone").drop("gone")


# --- joins of streams


def _ended(side):
    """A stream of a side, and at its end a record so late in time that everything before it is known to be over.

    The record has a key, as a join may leave out those without one before time is read from them.
    """
    spark, at = side.sparkSession, side.agg(F.max("ts").alias("ts"), F.max("offset").alias("offset")).first()
    end = spark.createDataFrame([(-1, "end", at.ts + 10 * DAY, at.offset + 1)], side.schema)
    path = _stored(side, 2)
    end.coalesce(1).write.mode("append").parquet(path)
    return run.read(spark, path, side.schema)


def _joined(spark, d, how, nulls):
    left, right = (_ended(x) for x in _two(spark, d, nulls))
    with run.rocksdb(spark):
        out = run.collect(run.joined(left, right, joins.JoinWindows.of("1 hour", DAY), _pair(), how))
    return out.where("value NOT LIKE '%end%'")


@query(f"""WITH {TWO} SELECT c.key, c."offset" || '|' || p."offset" AS value, greatest(c.ts, p.ts) AS ts FROM c JOIN p ON c.key = p.key AND p.ts BETWEEN c.ts - {HOUR} AND c.ts + {HOUR}""")
def stream_join_inner(spark, d):
    return _joined(spark, d, "inner", False)


@query(f"""WITH {NULLED} SELECT l.key, l."offset" || '|' || coalesce(CAST(r."offset" AS VARCHAR), 'null') AS value, greatest(l.ts, coalesce(r.ts, l.ts)) AS ts FROM l LEFT JOIN r ON l.key = r.key AND r.ts BETWEEN l.ts - {HOUR} AND l.ts + {HOUR}""")
def stream_join_left(spark, d):
    """Records without a partner are sent once the watermark has passed the window and its grace; null keys too."""
    return _joined(spark, d, "left", True)


@query(f"""WITH {NULLED} SELECT coalesce(l.key, r.key) AS key, coalesce(CAST(l."offset" AS VARCHAR), 'null') || '|' || coalesce(CAST(r."offset" AS VARCHAR), 'null') AS value, greatest(coalesce(l.ts, r.ts), coalesce(r.ts, l.ts)) AS ts FROM l FULL JOIN r ON l.key = r.key AND r.ts BETWEEN l.ts - {HOUR} AND l.ts + {HOUR}""")
def stream_join_outer(spark, d):
    return _joined(spark, d, "outer", True)


# --- user processors on streams


@query(CHANGED)
def stream_process(spark, d):
    with run.rocksdb(spark):
        return run.collect(process.process_stream(_stream(spark, d, 2), Changes), "update")


@query(f"SELECT key, value, CAST(ts AS BIGINT) AS ts FROM ({COUNTED})")
def stream_punctuated(spark, d):
    with run.rocksdb(spark):
        return run.collect(process.process_stream(_stream(spark, d, 2), DailyCounts, "long"), "update").drop("child")


# --- failures and restarts


@query("SELECT key, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM e GROUP BY key")
def stream_restart(spark, d):
    """A stream that ends halfway and goes on from its checkpoint: the totals' state is restored."""
    e = events(spark, d).select("key", "value", "cents", "ts", "offset")
    half, checkpoint, sink = e.agg(F.max("offset")).first()[0] // 2, run.scratch(spark, "checkpoint"), run.scratch(spark, "sink")
    path = _stored(e.where(F.col("offset") < half), 1)
    totals = lambda: run.read(spark, path, e.schema).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    run.collect(totals(), "complete", checkpoint, sink)
    e.where(F.col("offset") >= half).write.mode("append").parquet(path)
    return run.collect(totals(), "complete", checkpoint, sink)


@query("SELECT value, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM e GROUP BY value")
def stream_exactly_once(spark, d):
    """A sink that fails after it has written a batch: the restarted query repeats the batch, which replaces itself."""
    source, checkpoint, sink = _stream(spark, d), run.scratch(spark, "checkpoint"), run.scratch(spark, "sink")
    write, failed = files.exactly_once(sink), []

    def fragile(batch, batch_id):
        write(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise OSError("lost after the write")

    restarts = run.supervised(lambda: source.writeStream.foreachBatch(fragile).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), lambda e, n: "restart")
    assert restarts == 1
    return run.written(spark, sink, source.schema).groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("SELECT value, count(*) AS n FROM e GROUP BY value")
def stream_delivery_errors(spark, d):
    """A batch that the first sink can't take goes to a second one; the handler says to continue."""
    source, checkpoint, sink, dead = _stream(spark, d), run.scratch(spark, "checkpoint"), run.scratch(spark, "sink"), run.scratch(spark, "dead")
    write, aside = files.exactly_once(sink), files.exactly_once(dead)

    def picky(batch, batch_id):
        if batch_id == 1:
            aside(batch, batch_id)
            raise OSError("full")
        write(batch, batch_id)

    run.to_batches(source, errors.delivering(picky, lambda e, i: "continue"), checkpoint)
    both = run.written(spark, sink, source.schema).unionByName(run.written(spark, dead, source.schema))
    return both.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
