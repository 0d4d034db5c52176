"""Queries: final results, buffers, processors, stores that are written, options, placement, converters, handlers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions import codecs, errors, fieldpath, timestamps
from rivulet.functions import transforms as smt
from rivulet.operators import aggregate, process, stateless, suppress, tables, windows
from rivulet.plans import dsl, stores, topology
from rivulet.plans.registry import query
from rivulet.queries.events import LATE, MINUTE, ORDERS, REC, SESSIONS
from rivulet.queries.inputs import DAY, FIRST, HOUR, customers, disordered, events, orders_log, records, with_nulls
from rivulet.sources import log

# --- final results and buffers


@query(f"WITH {LATE} SELECT key, ws AS window_start, ws + {DAY} AS window_end, count(*) AS count FROM t WHERE ws + {DAY} > st - {3 * DAY} AND ws + {DAY} <= (SELECT max(ts) FROM a) - {3 * DAY} GROUP BY ALL")
def suppress_until_close(spark, d):
    """Final results of disordered records with grace: no window that is still open."""
    counted = dsl.stream(disordered(spark, d)).group_by_key().windowed_by(windows.TimeWindows(DAY, grace=3 * DAY)).dropping_late().count()
    return counted.suppress_until_close().df


@query(f"""WITH t AS (SELECT *, max(ts) OVER (PARTITION BY partition ORDER BY "offset") AS st FROM a), r AS (SELECT * FROM t WHERE ts + {6 * HOUR} > st - {10 * DAY}),
s AS (SELECT DISTINCT key, greatest(0, ts - {6 * HOUR}) AS ws FROM r UNION SELECT DISTINCT key, ts + 1 FROM r)
SELECT s.key, ws AS window_start, ws + {6 * HOUR} AS window_end, count(*) AS count FROM s JOIN r ON r.key = s.key AND r.ts BETWEEN ws AND ws + {6 * HOUR} AND ws + {6 * HOUR} > r.st - {10 * DAY} GROUP BY ALL""")
def sliding_late(spark, d):
    return dsl.stream(disordered(spark, d)).group_by_key().windowed_by(windows.SlidingWindows("6 hours", grace=10 * DAY)).dropping_late().count().df


@query(f"""WITH s AS (SELECT DISTINCT key, greatest(0, ts - {6 * HOUR}) AS ws FROM e UNION SELECT DISTINCT key, ts + 1 FROM e)
SELECT e.key, ws AS window_start, ws + {6 * HOUR} AS window_end, count(*) AS count FROM s JOIN e ON e.key = s.key AND e.ts BETWEEN ws AND ws + {6 * HOUR} WHERE ws + {6 * HOUR} <= (SELECT max(ts) FROM e) - {2 * DAY} GROUP BY ALL""")
def sliding_final_only(spark, d):
    return dsl.stream(events(spark, d)).group_by_key().windowed_by(windows.SlidingWindows("6 hours", grace=2 * DAY)).emit_on_close().count().df


@query()
def session_late(spark, d):
    """Sessions of disordered records; which records are late depends on the sessions that are open then."""
    return dsl.stream(disordered(spark, d)).group_by_key().windowed_by(windows.SessionWindows("6 hours", grace=5 * DAY)).dropping_late().count().df


@query("WITH " + SESSIONS.format(gap=6 * HOUR, source="e") + " SELECT key, min(ts) AS window_start, max(ts) AS window_end, CAST(sum(cents) AS BIGINT) AS value FROM s GROUP BY key, sid")
def session_merger(spark, d):
    """A user's accumulator; disordered records connect sessions, whose accumulators are merged."""
    spec = dsl.stream(disordered(spark, d)).group_by_key().windowed_by(windows.SessionWindows("6 hours"))
    return spec.fold_sessions(0, lambda a, r: a + r["cents"], lambda a, b: a + b, "long").df


@query(f"WITH w AS (SELECT key, ts // {DAY} * {DAY} AS ws, value, \"offset\" FROM e) SELECT key, ws AS window_start, ws + {DAY} AS window_end, string_agg(value[1:1], '' ORDER BY \"offset\") AS value FROM w GROUP BY key, ws")
def windowed_fold(spark, d):
    return dsl.stream(events(spark, d)).group_by_key().windowed_by(windows.TimeWindows(DAY)).fold(F.lit(""), lambda acc, v: F.concat(acc, F.substring(v, 1, 1))).df


@query(f"""WITH RECURSIVE u AS (SELECT partition, key, cents, ts, "offset", min("offset") OVER (PARTITION BY partition ORDER BY ts RANGE BETWEEN {12 * HOUR} FOLLOWING AND UNBOUNDED FOLLOWING) AS sent FROM e),
q AS (SELECT u.*, row_number() OVER (PARTITION BY partition, key ORDER BY "offset") AS i FROM u),
r AS (SELECT partition, key, i, i AS run, sent FROM q WHERE i = 1 UNION ALL SELECT q.partition, q.key, q.i, CASE WHEN q."offset" > r.sent THEN q.i ELSE r.run END, CASE WHEN q."offset" > r.sent THEN q.sent ELSE r.sent END FROM r JOIN q ON q.partition = r.partition AND q.key = r.key AND q.i = r.i + 1)
SELECT key, max_by(cents, "offset") AS value, max_by(ts, "offset") AS ts, max("offset") AS "offset" FROM r JOIN (SELECT partition, key, i, cents, ts, "offset" FROM q) USING (partition, key, i) WHERE sent IS NOT NULL GROUP BY partition, key, run""")
def suppress_buffer(spark, d):
    """Updates wait in a partition's buffer until its time has passed them by; what still waits at the end isn't sent."""
    updates = events(spark, d).select("key", F.col("cents").alias("value"), "ts", "offset", "partition")
    return suppress.suppressed(updates, "12 hours").drop("partition")


@query("""WITH f AS (SELECT key, "offset", cents, ts, partition, row_number() OVER (PARTITION BY partition ORDER BY "offset") AS n, max("offset") OVER (PARTITION BY partition) AS most FROM e)
SELECT key, cents AS value, ts, "offset" FROM f WHERE "offset" < most""")
def suppress_full_buffer(spark, d):
    """Each record a key of its own, and room for one: every record but the last is sent early."""
    e = events(spark, d)
    updates = e.select("key", F.col("cents").alias("value"), "ts", "offset", "partition")
    return suppress.suppressed(updates, 1000 * DAY, suppress.Buffer(records=1), by=("offset",)).drop("partition")


@query('WITH t AS (SELECT key, "offset", ts, CASE WHEN value = \'error\' THEN NULL ELSE value END AS value, partition FROM e), m AS (SELECT partition, max(ts) AS most FROM t GROUP BY partition) SELECT key, value, ts, "offset" FROM t JOIN m USING (partition) WHERE value IS NOT NULL AND ts <= most')
def suppress_tombstones(spark, d):
    """Nothing waits, and tombstones aren't sent."""
    t = events(spark, d).select("key", F.when(F.col("value") != "error", F.col("value")).alias("value"), "ts", "offset", "partition")
    return suppress.suppressed(t, 0, drop_tombstones=True).drop("partition")


# --- processors


class Changes(process.Processor):
    """Forwards a record whose value isn't the key's last one; to a child by its kind."""

    def process(self, context: process.Context, record: dict) -> None:
        if record["value"] != context.get():
            context.forward(record["value"], child="errors" if record["value"] == "error" else "others")
        context.put(record["value"])


class Largest(process.FixedKeyProcessor):
    stores = ("largest",)

    def process(self, context: process.Context, record: dict) -> None:
        best = max(context.get("largest") or 0, record["cents"])
        context.put(best, "largest")
        context.forward(best)


class DailyCounts(process.Processor):
    """Counts, sent whenever the key's time passes a multiple of a day since its first record."""

    def init(self, context: process.Context) -> None:
        context.schedule(DAY, lambda c, at: c.forward(c.get(), ts=at))

    def process(self, context: process.Context, record: dict) -> None:
        context.put((context.get() or 0) + 1)


CHANGED = """SELECT key, value, ts, CASE WHEN value = 'error' THEN 'errors' ELSE 'others' END AS child FROM (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY "offset") AS before FROM e) WHERE before IS DISTINCT FROM value"""
COUNTED = f"""SELECT key, n - 1 AS value, first + floor((ts - first) / {DAY}) * {DAY} AS ts FROM
(SELECT key, ts, first_value(ts) OVER w AS first, lag(ts) OVER w AS before, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY key ORDER BY "offset"))
WHERE before IS NOT NULL AND floor((ts - first) / {DAY}) > floor((before - first) / {DAY})"""


@query(CHANGED)
def process_changes(spark, d):
    return dsl.stream(events(spark, d)).process(Changes).df


@query('SELECT key, CAST(max(cents) OVER (PARTITION BY key ORDER BY "offset") AS BIGINT) AS value, ts FROM e')
def process_values(spark, d):
    return dsl.stream(events(spark, d)).process_values(Largest, "long").df.drop("child")


@query(f"SELECT key, value, CAST(ts AS BIGINT) AS ts FROM ({COUNTED})")
def process_punctuated(spark, d):
    return dsl.stream(events(spark, d)).process(DailyCounts, "long").df.drop("child")


@query("SELECT child, count(*) AS n FROM (" + CHANGED + ") GROUP BY child")
def process_children(spark, d):
    """A processor in the graph API, its two children, and a decorator of all processors."""
    t = topology.Topology(wrapper=lambda name, f: lambda *a, **k: f(*a, **k))
    t.add_source("events", lambda: events(spark, d)).add_processor("changes", lambda e: process.process(e, Changes), "events")
    for child in ("errors", "others"):
        t.add_processor(child, lambda x, child=child: x.where(F.col("child") == child), "changes")
    t.add_processor("counted", lambda a, b: a.unionByName(b).groupBy("child").agg(F.count(F.lit(1)).alias("n")), "errors", "others")
    return t.frame("counted")


# --- stores


@query(f"WITH {ORDERS}, p AS (SELECT c_custkey AS key, c_mktsegment AS value FROM customer) SELECT coalesce(u.key, p.key) AS key, CASE WHEN u.key IS NULL THEN p.value ELSE u.value END AS value FROM p FULL JOIN (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY \"offset\" DESC) = 1) u ON u.key = p.key WHERE u.key IS NULL OR u.value IS NOT NULL")
def store_put(spark, d):
    """Customers' segments overwritten by the status of their last order; a null deletes."""
    s = stores.Stores()
    s.add("state", customers(spark, d).select("key", "value", "ts", "offset"))
    return s.put("state", orders_log(spark, d).select("key", "value", "ts", "offset")).select("key", "value")


@query(f"WITH {ORDERS}, p AS (SELECT c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_mktsegment = 'BUILDING') SELECT * FROM p UNION ALL SELECT key, value FROM (SELECT * FROM o WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY \"offset\") = 1) WHERE key NOT IN (SELECT key FROM p)")
def store_put_if_absent(spark, d):
    s = stores.Stores()
    s.add("state", customers(spark, d).where("value = 'BUILDING'").select("key", "value", "ts", "offset"))
    return s.put_if_absent("state", orders_log(spark, d).select("key", "value", "ts", "offset")).select("key", "value")


@query(f"WITH {ORDERS} SELECT key, value FROM latest WHERE key NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def store_delete(spark, d):
    s = stores.Stores()
    s.add("state", tables.latest(orders_log(spark, d)))
    return s.delete("state", customers(spark, d).where("value = 'MACHINERY'")).select("key", "value")


@query(f"""WITH u AS (SELECT key, ts, "offset" FROM a), p AS (SELECT *, max(ts) OVER (PARTITION BY key ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u)
SELECT p.key, p.ts, p."offset", CASE WHEN p.ts < p.before - {8 * DAY} THEN -9223372036854775808 ELSE coalesce((SELECT min(q.ts) FROM u AS q WHERE q.key = p.key AND q."offset" < p."offset" AND q.ts > p.ts), -1) END AS valid_to FROM p""")
def versioned_puts(spark, d):
    """What puts into a versioned store return: the next version's time, none, or rejected as too late."""
    return tables.versioned_puts(disordered(spark, d), 8 * DAY)


@query('SELECT partition, key, value FROM (SELECT * FROM (SELECT * FROM n WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY partition, key ORDER BY "offset" DESC) = 1) WHERE value IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY partition ORDER BY "offset" DESC) <= 10')
def lru_store(spark, d):
    return tables.least_recent_evicted(with_nulls(spark, d), 10).select("partition", "key", "value")


@query('WITH c AS (SELECT key, max("offset") AS cut FROM n WHERE key IS NOT NULL AND value IS NULL GROUP BY key) SELECT key, string_agg(value, \',\' ORDER BY "offset") AS value, count(*) AS n FROM n LEFT JOIN c USING (key) WHERE key IS NOT NULL AND value IS NOT NULL AND (cut IS NULL OR "offset" > cut) GROUP BY key')
def list_store(spark, d):
    out = aggregate.list_values(with_nulls(spark, d))
    return out.select("key", F.array_join("value", ",").alias("value"), F.size("value").cast("long").alias("n"))


@query('SELECT partition, count(*) AS n FROM (SELECT partition, key FROM e WHERE partition IN (1, 3) GROUP BY ALL) GROUP BY partition')
def iq_by_partition(spark, d):
    """One result for each partition; a partition that hasn't read far enough answers with the reason."""
    s = stores.Stores()
    position = stores.Position({"events": {0: 10, 1: 10, 2: 1, 3: 5}}).merge(stores.Position({"events": {3: 10}}))
    s.add("latest", tables.latest(events(spark, d)), position)
    asked = s.results(stores.Request("latest", stores.RangeQuery(), (1, 2, 3), stores.Position({"events": {1: 9, 2: 9, 3: 10}})))
    assert [(r.partition, r.failure) for r in asked] == [(1, None), (2, stores.NOT_UP_TO_BOUND), (3, None)]
    answered = [r.rows.select(F.lit(r.partition).alias("partition")) for r in asked if r.rows is not None]
    return answered[0].unionByName(answered[1]).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


@query('SELECT value, count(*) AS n FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY partition, key ORDER BY "offset" DESC) = 1) GROUP BY value')
def iq_composite(spark, d):
    """The stores of all partitions as one."""
    s = stores.Stores()
    for p in range(4):
        s.add(f"latest-{p}".replace("-", "_"), tables.latest(events(spark, d).where(F.col("partition") == p)))
    return s.composite([f"latest_{p}" for p in range(4)]).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT e.key, e.value || '/' || g.value AS value, \"offset\" FROM e JOIN (SELECT n_nationkey AS key, upper(n_name) AS value FROM nation) g ON g.key = e.key")
def global_store(spark, d):
    """A global store that a processor of its own fills, read by another."""
    from rivulet.record import table

    t = topology.Topology().add_source("events", lambda: events(spark, d))
    t.add_source("nations", lambda: table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("value")))
    t.add_processor("upper", lambda n: n.withColumn("value", F.upper("value")), "nations")
    t.add_processor("named", lambda e, names: e.join(names.withColumnRenamed("value", "name"), "key").select("key", F.concat_ws("/", "value", "name").alias("value"), "offset"), "events")
    t.add_store("names", lambda: t.frame("upper"), "named")
    return t.frame("named")


# --- options of the fluent API


@query(f"SELECT key, ts // {DAY} * {DAY} AS window_start, ts // {DAY} * {DAY} + {DAY} AS window_end, count(*) AS count FROM e WHERE ts // {DAY} * {DAY} + {DAY} > (SELECT max(ts) FROM e) - {10 * DAY} AND ts // {DAY} * {DAY} <= {FIRST + 25 * DAY} GROUP BY ALL")
def materialized_windows(spark, d):
    """A named store that keeps ten days of windows, then asked for a range of them."""
    s = stores.Stores()
    dsl.stream(events(spark, d)).group_by_key(dsl.Grouping("by-user")).windowed_by(windows.TimeWindows(DAY)).count(materialized=dsl.Materialized("daily", s, retention="10 days"))
    return s.run(stores.Request("daily", stores.WindowRangeQuery(0, FIRST + 25 * DAY)))


@query('SELECT key, "offset", n, cents FROM (SELECT key, "offset", count(*) OVER w AS n, CAST(sum(cents) OVER w AS BIGINT) AS cents FROM e WINDOW w AS (PARTITION BY key ORDER BY "offset")) QUALIFY row_number() OVER (PARTITION BY key, "offset" // 200 ORDER BY "offset" DESC) = 1')
def cached_changelog(spark, d):
    """A caching store forwards a key's last update of each commit."""
    out = dsl.stream(events(spark, d)).group_by_key().aggregate(True, dsl.Materialized(commit=200), n=F.count(F.lit(1)), cents=F.sum("cents"))
    return out.df.drop("ts")


@query(f"SELECT value AS key, count(*) AS count FROM e WHERE ts >= {FIRST + 3 * DAY} GROUP BY value")
def grouped_options(spark, d):
    consumed = log.Consumed(reset="by_duration", since=FIRST + 3 * DAY, name="events")
    return dsl.stream(consumed.read(events(spark, d))).group_by(F.col("value"), dsl.Grouping("by-type", 4)).count().df


@query('SELECT "offset", CAST(json_extract(props, \'$.k\') AS BIGINT) AS ts, CAST(key AS VARCHAR) AS key FROM e')
def consumed_options(spark, d):
    consumed = log.Consumed(timestamp=F.get_json_object("props", "$.k").cast("long"), key=lambda c: c.cast("string"))
    return consumed.read(events(spark, d)).select("offset", "ts", "key")


@query(f"""WITH v AS (SELECT * FROM e WHERE value = 'purchase'), s AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY partition ORDER BY "offset") AS st FROM a WHERE value = 'click') WHERE ts >= st - {10 * DAY})
SELECT s.key, s."offset", s.cents || '|' || v.cents AS value FROM s ASOF JOIN v ON s.key = v.key AND s.ts >= v.ts""")
def joined_with_grace(spark, d):
    text = lambda df, k: df.where(F.col("value") == k).select("key", "ts", "offset", "partition", F.col("cents").cast("string").alias("value"))
    prices = dsl.versioned_table(text(events(spark, d), "purchase").drop("partition"))
    clicks = dsl.stream(text(disordered(spark, d), "click"))
    return clicks.join(prices, F.concat_ws("|", "value", "table_value"), joining=dsl.Joining("priced", "10 days")).df.select("key", "offset", "value")


@query("SELECT key, 'seen' AS seen, count(*) AS n FROM e WHERE value <> 'error' GROUP BY key")
def intercepted(spark, d):
    """Interceptors in order; one that fails is skipped."""
    s = dsl.stream(events(spark, d)).intercept(lambda df: df.where("value <> 'error'"), lambda df: df.select("nope"), lambda df: df.withColumn("seen", F.lit("seen")))
    return s.df.groupBy("key", "seen").agg(F.count(F.lit(1)).alias("n"))


# --- stateless rows that had no query


@query('SELECT key, value, "offset" FROM e')
def peek_through(spark, d):
    return dsl.stream(events(spark, d)).peek("peeked", F.count(F.lit(1)).alias("n")).df.select("key", "value", "offset")


@query("SELECT value, count(*) AS n FROM e GROUP BY value")
def foreach_sink(spark, d):
    """A terminal side effect: the sink writes the records, and the query reads what it wrote."""
    from rivulet.streaming.run import scratch

    path = scratch(spark, "foreach")
    dsl.stream(events(spark, d)).foreach(lambda df: df.select("value").write.parquet(path))
    return spark.read.parquet(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'foo-' || CASE value WHEN 'click' THEN 'bar' WHEN 'view' THEN '2' ELSE '0' END AS branch, count(*) AS n FROM e WHERE value NOT IN ('purchase', 'error') GROUP BY 1")
def branched_functions(spark, d):
    """A named branch, one with a function, two that leave no entry (a consumer; a function that returns none), a default."""
    b = stateless.Branches(events(spark, d), "foo-").branch(F.col("value") == "click", "bar").branch(F.col("value") == "view", function=lambda x: x)
    b = b.branch(F.col("value") == "purchase", consumer=lambda x: None).branch(F.col("value") == "error", function=lambda x: None)
    out = [df.select(F.lit(name).alias("branch")) for name, df in sorted(b.default().items())]
    return stateless.merge(*out).groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


@query('SELECT key, value FROM (SELECT * FROM n WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY "offset" DESC) = 1) WHERE value IS NOT NULL')
def to_table(spark, d):
    return dsl.stream(with_nulls(spark, d)).to_table().df.select("key", "value")


@query('SELECT value AS key, "offset", count(*) OVER (PARTITION BY value ORDER BY "offset") AS n FROM e')
def to_stream(spark, d):
    """All of a table's updates as records, under another key."""
    updates = dsl.stream(events(spark, d)).group_by(F.col("value")).aggregate(True, n=F.count(F.lit(1)))
    return updates.to_stream(F.col("key")).df.select("key", "offset", "n")


@query("SELECT value AS key, CAST(sum(cents) AS BIGINT) AS value FROM (SELECT * FROM (SELECT o_custkey AS key, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS value, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) WHERE value IS NOT NULL) GROUP BY value", prelude=False)
def table_fold_changes(spark, d):
    """A user's adder and subtractor over the changes of a regrouped table."""
    o = orders_log(spark, d)
    updates = o.withColumn("value", F.when(F.col("value").isNotNull(), F.struct(F.col("value").alias("status"), "cents")))
    return tables.fold_changes(tables.changes(updates), F.col("value.status"), F.col("value.cents"), 0, lambda a, v: a + v, lambda a, v: a - v, "long")


@query("SELECT value AS key, CAST(sum(cents) AS BIGINT) AS value FROM (SELECT * FROM (SELECT o_custkey AS key, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS value, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) WHERE value IS NOT NULL) GROUP BY value", prelude=False)
def table_reduce_changes(spark, d):
    o = orders_log(spark, d)
    updates = o.withColumn("value", F.when(F.col("value").isNotNull(), F.struct(F.col("value").alias("status"), "cents")))
    return tables.reduce_changes(tables.changes(updates), F.col("value.status"), F.col("value.cents"), lambda a, v: a + v, lambda a, v: a - v, "long")


@query(f"SELECT key, value, ts FROM e WHERE ts // {5 * DAY} >= ((SELECT max(ts) FROM e) - {9 * DAY}) // {5 * DAY}")
def segment_retention(spark, d):
    return tables.retain_segments(events(spark, d), 9 * DAY, 5 * DAY).select("key", "value", "ts")


# --- placement


#: The hash in SQL, of the eight bytes of a long; m is masked to 32 bits.
MURMUR = """w AS (SELECT *, lpad(to_hex(key), 16, '0') AS x FROM e),
b AS (SELECT *, CAST('0x' || x[7:8] || x[5:6] || x[3:4] || x[1:2] AS BIGINT) AS w0, CAST('0x' || x[15:16] || x[13:14] || x[11:12] || x[9:10] AS BIGINT) AS w1 FROM w),
k0 AS (SELECT *, (w0 * 1540483477) & 4294967295 AS a FROM b), k1 AS (SELECT *, (xor(a, a >> 24) * 1540483477) & 4294967295 AS a2, (w1 * 1540483477) & 4294967295 AS c FROM k0),
k2 AS (SELECT *, (xor(c, c >> 24) * 1540483477) & 4294967295 AS c2, xor((xor(2538058380, 8) * 1540483477) & 4294967295, a2) AS h FROM k1),
k3 AS (SELECT *, xor((h * 1540483477) & 4294967295, c2) AS h2 FROM k2), k4 AS (SELECT *, (xor(h2, h2 >> 13) * 1540483477) & 4294967295 AS h3 FROM k3),
placed AS (SELECT *, (xor(h3, h3 >> 15) & 2147483647) % 7 AS p FROM k4)"""


@query(f"WITH {MURMUR} SELECT key, CAST(p AS INTEGER) AS partition, count(*) AS n FROM placed GROUP BY ALL")
def default_partition(spark, d):
    """Records where the default partitioner places their serialised keys."""
    at = log.partition_of(codecs.encode_number(F.col("key"), "long"), 7)
    counted = events(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"))  # a key has one place
    return counted.select("key", at.alias("partition"), "n")


@query(f"WITH {MURMUR} SELECT key, CAST(p AS INTEGER) AS partition, count(DISTINCT ts // {DAY}) AS windows FROM placed GROUP BY ALL")
def windowed_partition(spark, d):
    """All windows of a key go where the key goes."""
    start = (F.floor(F.col("ts") / DAY) * DAY).cast("long")
    held = events(spark, d).select("key", start.alias("w")).distinct()
    whole = codecs.windowed_key(codecs.encode_number(F.col("key"), "long"), F.col("w"))
    return held.select("key", log.windowed_partition_of(whole, 7).alias("partition"), "w").groupBy("key", "partition").agg(F.count("w").alias("windows"))


@query('SELECT CAST("offset" % 7 AS INTEGER) AS partition, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM e GROUP BY 1')
def round_robin(spark, d):
    return log.round_robin(events(spark, d), 7).groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("""SELECT topic || ':' || chr(9) || 'CreateTime:' || ts || chr(9) || key || chr(9) || value AS line FROM e ORDER BY "offset" LIMIT 25""")
def console_logging(spark, d):
    """The logging formatter, and a bound on the messages that are printed."""
    return log.console_lines(events(spark, d), formatter="logging", most=25)


# --- transforms, converters, times and handlers that had no query


@query(f"WITH {REC} SELECT topic, count(*) AS n FROM (SELECT CASE WHEN event_type = 'click' THEN 'marked' ELSE topic END AS topic FROM r) GROUP BY topic")
def smt_has_header(spark, d):
    r = smt.chain(records(spark, d), smt.drop_headers(["type"]))
    r = r.withColumn("headers", F.when(F.col("topic") == "events-click", F.array_append("headers", F.struct(F.lit("mark").alias("key"), F.lit(b"1").alias("value")))).otherwise(F.col("headers")))
    return smt.chain(r, (smt.regex_router(".*", "marked"), smt.has_header("mark"))).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query(f'WITH {REC} SELECT "offset", CASE WHEN alive THEN cents END AS cents, CASE WHEN alive THEN event_type END AS dotted FROM r')
def smt_nested_path(spark, d):
    """A path of names, and a name that itself holds a dot."""
    r = records(spark, d)
    value = F.when(F.col("value").isNotNull(), F.struct(F.struct(F.col("value.cents").alias("cents")).alias("money"), F.col("value.event_type").alias("event.type")))
    r = r.select("offset", value.alias("value"))
    kind = r.schema["value"].dataType
    return r.select("offset", fieldpath.get(F.col("value"), kind, fieldpath.parse("money.cents", "V2")).alias("cents"), fieldpath.get(F.col("value"), kind, fieldpath.parse("`event.type`", "V2")).alias("dotted"))


@query('SELECT "offset", key AS user_id, CAST(cents AS BIGINT) AS cents, value FROM e')
def header_converters(spark, d):
    e = events(spark, d).withColumn("headers", F.array().cast("array<struct<key: string, value: binary>>"))
    for name, c, kind in (("user", "key", "long"), ("cents", "cents", "long"), ("type", "value", "string")):
        e = e.withColumn("headers", codecs.to_header(F.col("headers"), name, F.col(c), kind))
    h = F.col("headers")
    return e.select("offset", codecs.from_header(h, "user", "long").alias("user_id"), codecs.from_header(h, "cents", "long").alias("cents"), codecs.from_header(h, "type").alias("value"))


@query("SELECT \"offset\", CAST(cents - 3000 AS DECIMAL(18, 2)) / 100 AS base64_amount, CAST(cents AS DECIMAL(18, 2)) / 100 AS numeric_amount, lower(md5(CAST(\"offset\" AS VARCHAR))[1:8] || '-' || md5(CAST(\"offset\" AS VARCHAR))[9:12] || '-' || md5(CAST(\"offset\" AS VARCHAR))[13:16] || '-' || md5(CAST(\"offset\" AS VARCHAR))[17:20] || '-' || md5(CAST(\"offset\" AS VARCHAR))[21:32]) AS id FROM e")
def codec_more(spark, d):
    """Decimals as base64 and as numbers in JSON, UUIDs, and void."""
    e = events(spark, d)
    amount = lambda c: (c.cast("decimal(18,2)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")
    h = F.md5(F.col("offset").cast("string").cast("binary"))
    text = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    back = lambda c, form: codecs.decimal_of_json(codecs.decimal_json(c, 2, form), 2, form).cast("double")
    out = e.select("offset", back(amount(F.col("cents") - 3000), "base64").alias("base64_amount"), back(amount(F.col("cents")), "numeric").alias("numeric_amount"), codecs.decode_uuid(codecs.encode_uuid(text)).alias("id"), codecs.decode_void(codecs.encode_void(F.lit(None).cast("string"))).alias("nothing"))
    return out.where("nothing IS NULL").drop("nothing")


@query('SELECT "offset", ts FROM e')
def ts_fail_on_invalid(spark, d):
    return timestamps.fail_on_invalid(events(spark, d)).select("offset", "ts")


@query('SELECT "offset", true AS recent FROM e')
def ts_wall_clock(spark, d):
    return timestamps.wall_clock(events(spark, d)).select("offset", F.col("ts").between(F.unix_millis(F.current_timestamp()) - MINUTE, F.unix_millis(F.current_timestamp()) + MINUTE).alias("recent"))


@query('SELECT "offset", ts + 1000 AS ts FROM e')
def ts_log_append(spark, d):
    return timestamps.log_append_time(events(spark, d).withColumn("appended", F.col("ts") + 1000), "ts", "appended", True).select("offset", "ts")


@query("SELECT CASE WHEN value IN ('click', 'view') THEN 'dead' ELSE 'good' END AS side, count(*) AS n FROM e GROUP BY 1")
def processing_errors(spark, d):
    """A computation that fails for some values, which are set aside."""
    text = F.when(F.col("value").isin("click", "view"), F.lit("none")).otherwise(F.col("cents").cast("string"))
    good, dead = errors.processed(events(spark, d).withColumn("value", text), lambda v: v.try_cast("long"))
    return good.select(F.lit("good").alias("side")).unionByName(dead.select(F.lit("dead").alias("side"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
