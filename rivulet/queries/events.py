"""Queries: windows, lateness, joins, interactive queries, record transforms, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from rivulet.functions import codecs
from rivulet.functions import transforms as smt
from rivulet.operators import aggregate, joins, tables, windows
from rivulet.plans import dsl, stores
from rivulet.plans.registry import query
from rivulet.queries.inputs import DAY, FIRST, HOUR, ORDERS, customers, disordered, events, orders_log, records, with_nulls, with_nulls_key
from rivulet.record import table

MINUTE = 60_000


# --- windows


@query(f"""SELECT coalesce(c_mktsegment, 'UNKNOWN') AS region, ts // {DAY} * {DAY} AS window_start, ts // {DAY} * {DAY} + {DAY} AS window_end, count(*) AS count
FROM e LEFT JOIN customer ON c_custkey = key * 11 GROUP BY ALL""")
def pageview_region_window(spark, d):
    """Views joined to their user's profile, re-keyed by region, counted by day."""
    views = dsl.stream(events(spark, d)).select_key(F.col("key") * 11)
    by_region = views.join(dsl.table(customers(spark, d)), F.coalesce("table_value", F.lit("UNKNOWN")), "left").map(F.col("value"), F.lit(1))
    out = by_region.group_by_key().windowed_by(windows.TimeWindows(DAY)).count()
    return out.df.withColumnRenamed("key", "region")


@query(f"SELECT key, ts // {DAY} * {DAY} AS window_start, ts // {DAY} * {DAY} + {DAY} AS window_end, count(*) AS count FROM n WHERE key IS NOT NULL GROUP BY ALL")
def tumbling_count(spark, d):
    return windows.windowed(with_nulls(spark, d), windows.TimeWindows("1 day"), {"count": F.count(F.lit(1))})


@query(f"""SELECT key, w AS window_start, w + {6 * HOUR} AS window_end, CAST(sum(cents) AS BIGINT) AS cents, count(value) AS n_values FROM n,
LATERAL (SELECT unnest(generate_series((ts - {4 * HOUR}) // {2 * HOUR} * {2 * HOUR}, ts, {2 * HOUR})) AS w) WHERE key IS NOT NULL AND w >= 0 GROUP BY ALL""")
def hopping_sum(spark, d):
    return windows.windowed(with_nulls(spark, d), windows.TimeWindows("6 hours", "2 hours"), {"cents": F.sum("cents"), "n_values": F.count("value")})


@query(f"SELECT key, {FIRST + 5 * DAY} AS window_start, 9223372036854775807 AS window_end, count(*) AS count, min(value) AS least FROM e WHERE ts >= {FIRST + 5 * DAY} GROUP BY key")
def unlimited_count(spark, d):
    return windows.windowed(events(spark, d), windows.UnlimitedWindows(FIRST + 5 * DAY), {"count": F.count(F.lit(1)), "least": F.min("value")})


@query(f"""SELECT key, w * {DAY} AS window_start, (w + 7) * {DAY} AS window_end, count(*) AS count FROM (SELECT key, (ts // {DAY} + 3) // 7 * 7 - 3 AS w FROM e) GROUP BY ALL""")
def custom_window(spark, d):
    """Calendar weeks from Monday on: the epoch was a Thursday."""
    week = windows.CustomWindows(lambda ts: F.array(F.struct(((F.floor((F.floor(ts / DAY) + 3) / 7) * 7 - 3) * DAY).cast("long").alias("start"), ((F.floor((F.floor(ts / DAY) + 3) / 7) * 7 + 4) * DAY).cast("long").alias("end"))))
    return windows.windowed(events(spark, d), week, {"count": F.count(F.lit(1))})


@query(f"""WITH s AS (SELECT DISTINCT key, greatest(0, ts - {6 * HOUR}) AS ws FROM e UNION SELECT DISTINCT key, ts + 1 FROM e)
SELECT e.key, ws AS window_start, ws + {6 * HOUR} AS window_end, count(*) AS count FROM s JOIN e ON e.key = s.key AND e.ts BETWEEN ws AND ws + {6 * HOUR} GROUP BY ALL""")
def sliding_count(spark, d):
    return windows.windowed(events(spark, d), windows.SlidingWindows("6 hours"), {"count": F.count(F.lit(1))})


@query(f"""SELECT key, "offset", count(*) OVER w AS n, CAST(sum(cents) OVER w AS BIGINT) AS total FROM e WINDOW w AS (PARTITION BY key ORDER BY ts RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)""")
def sliding_trailing(spark, d):
    return windows.trailing(events(spark, d), 6 * HOUR, {"n": F.count(F.lit(1)), "total": F.sum("cents")}).select("key", "offset", "n", "total")


SESSIONS = """s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts, "offset") AS sid FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, "offset") > {gap} THEN 1 ELSE 0 END AS new FROM {source} WHERE key IS NOT NULL))"""


@query("WITH " + SESSIONS.format(gap=6 * HOUR, source="n") + " SELECT key, min(ts) AS window_start, max(ts) AS window_end, count(*) AS count FROM s GROUP BY key, sid")
def session_count(spark, d):
    return windows.windowed(with_nulls(spark, d), windows.SessionWindows("6 hours"), {"count": F.count(F.lit(1))})


@query("WITH " + SESSIONS.format(gap=2 * HOUR, source="e") + " SELECT key, min(ts) AS window_start, max(ts) AS window_end, CAST(sum(cents) AS BIGINT) AS cents, max(value) AS last_value FROM s GROUP BY key, sid")
def session_sum(spark, d):
    return windows.windowed(events(spark, d), windows.SessionWindows("2 hours"), {"cents": F.sum("cents"), "last_value": F.max("value")})


@query("WITH " + SESSIONS.format(gap=2 * HOUR, source="e") + ' SELECT key, "offset", min(ts) OVER w AS window_start, max(ts) OVER w AS window_end FROM s WINDOW w AS (PARTITION BY key, sid)')
def session_members(spark, d):
    return windows.SessionWindows("2 hours").assign(events(spark, d)).select("key", "offset", "window_start", "window_end")


@query(f"SELECT key, ts // {DAY} * {DAY} AS window_start, count(*) FILTER (WHERE value = 'click') AS clicks, count(*) FILTER (WHERE value = 'view') AS views FROM e WHERE value IN ('click', 'view') GROUP BY ALL")
def cogroup_windowed(spark, d):
    e = windows.TimeWindows(DAY).assign(events(spark, d))
    return aggregate.cogroup({"c": e.where("value = 'click'"), "v": e.where("value = 'view'")}, {"clicks": lambda of: F.count(of("c")(F.lit(1))), "views": lambda of: F.count(of("v")(F.lit(1)))}, by=("key", "window_start"), values_too=False)


@query("WITH " + SESSIONS.format(gap=6 * HOUR, source="(SELECT * FROM e WHERE value IN ('click', 'view'))") + " SELECT key, min(ts) AS window_start, max(ts) AS window_end, count(*) FILTER (WHERE value = 'click') AS clicks, count(*) FILTER (WHERE value = 'view') AS views FROM s GROUP BY key, sid")
def cogroup_session(spark, d):
    """Sessions run over all streams of the group."""
    e = windows.SessionWindows("6 hours").assign(events(spark, d).where("value IN ('click', 'view')"))
    return aggregate.cogroup({"c": e.where("value = 'click'"), "v": e.where("value = 'view'")}, {"clicks": lambda of: F.count(of("c")(F.lit(1))), "views": lambda of: F.count(of("v")(F.lit(1)))}, by=("key", "window_start", "window_end"), values_too=False)


@query(f"""WITH b AS (SELECT * FROM e WHERE value IN ('click', 'view')), s AS (SELECT DISTINCT key, greatest(0, ts - {2 * HOUR}) AS ws FROM b UNION SELECT DISTINCT key, ts + 1 FROM b)
SELECT b.key, ws AS window_start, count(*) FILTER (WHERE value = 'click') AS clicks, count(*) FILTER (WHERE value = 'view') AS views FROM s JOIN b ON b.key = s.key AND b.ts BETWEEN ws AND ws + {2 * HOUR} GROUP BY ALL""")
def cogroup_sliding(spark, d):
    e = windows.SlidingWindows("2 hours").assign(events(spark, d).where("value IN ('click', 'view')"))
    return aggregate.cogroup({"c": e.where("value = 'click'"), "v": e.where("value = 'view'")}, {"clicks": lambda of: F.count(of("c")(F.lit(1))), "views": lambda of: F.count(of("v")(F.lit(1)))}, by=("key", "window_start"), values_too=False)


LATE = f"""t AS (SELECT *, max(ts) OVER (PARTITION BY partition ORDER BY "offset") AS st, ts // {DAY} * {DAY} AS ws FROM a)"""


@query(f"WITH {LATE} SELECT key, ws AS window_start, ws + {DAY} AS window_end, count(*) AS count FROM t WHERE ws + {DAY} > st - {5 * DAY} GROUP BY ALL")
def late_drop_count(spark, d):
    return dsl.stream(disordered(spark, d)).group_by_key().windowed_by(windows.TimeWindows(DAY, grace=5 * DAY)).dropping_late().count().df


@query(f"SELECT key, ts // {DAY} * {DAY} AS window_start, ts // {DAY} * {DAY} + {DAY} AS window_end, count(*) AS count FROM e WHERE ts // {DAY} * {DAY} + {DAY} <= (SELECT max(ts) FROM e) - {2 * DAY} GROUP BY ALL")
def window_final_only(spark, d):
    return dsl.stream(events(spark, d)).group_by_key().windowed_by(windows.TimeWindows(DAY, grace=2 * DAY)).emit_on_close().count().df


@query(f"""WITH RECURSIVE u AS (SELECT key, ts, "offset", cents, row_number() OVER (PARTITION BY key ORDER BY ts, "offset") AS i FROM e),
r AS (SELECT key, i, ts AS held FROM u WHERE i = 1 UNION ALL SELECT u.key, u.i, CASE WHEN u.ts >= r.held + {DAY} THEN u.ts ELSE r.held END FROM r JOIN u ON u.key = r.key AND u.i = r.i + 1)
SELECT u.key, held AS held_from, max(u."offset") AS "offset", arg_max(cents, u."offset") AS cents FROM r JOIN u USING (key, i) GROUP BY u.key, held""")
def suppress_time_limit(spark, d):
    updates = events(spark, d).select("key", F.col("cents").alias("value"), "ts", "offset")
    return windows.suppress_until_limit(updates, DAY).select("key", "held_from", "offset", F.col("value").alias("cents"))


# --- joins

TWO = """c AS (SELECT * FROM e WHERE value = 'click'), p AS (SELECT * FROM e WHERE value = 'purchase')"""


def _two(spark, d, nulls=False):
    """The streams of clicks and of purchases, whole; with nulls some of their keys are unknown."""
    e = events(spark, d)
    if nulls:
        e = e.withColumn("key", with_nulls_key())
    side = lambda v: e.where(F.col("value") == v).select("key", F.col("offset").cast("string").alias("value"), "ts", "offset")
    return side("click"), side("purchase")


def _pair():
    return F.concat(F.coalesce("value", F.lit("null")), F.lit("|"), F.coalesce("right_value", F.lit("null")))


@query(f"""WITH {TWO} SELECT c.key, c."offset" || '|' || p."offset" AS value, greatest(c.ts, p.ts) AS ts FROM c JOIN p ON c.key = p.key AND p.ts BETWEEN c.ts - {2 * HOUR} AND c.ts + {2 * HOUR}""")
def ss_inner(spark, d):
    left, right = _two(spark, d)
    return joins.stream_stream(left, right, joins.JoinWindows.of("2 hours"), _pair())


NULLED = """l AS (SELECT * FROM n WHERE topic = 'events-click'), r AS (SELECT * FROM n WHERE topic = 'events-purchase')"""


@query(f"""WITH {NULLED} SELECT l.key, l."offset" || '|' || coalesce(CAST(r."offset" AS VARCHAR), 'null') AS value, greatest(l.ts, coalesce(r.ts, l.ts)) AS ts FROM l LEFT JOIN r ON l.key = r.key AND r.ts BETWEEN l.ts - {HOUR} AND l.ts + {HOUR}""")
def ss_left(spark, d):
    left, right = _two(spark, d, nulls=True)
    return joins.stream_stream(left, right, joins.JoinWindows.of("1 hour"), _pair(), "left")


@query(f"""WITH {NULLED} SELECT coalesce(l.key, r.key) AS key, coalesce(CAST(l."offset" AS VARCHAR), 'null') || '|' || coalesce(CAST(r."offset" AS VARCHAR), 'null') AS value, greatest(coalesce(l.ts, r.ts), coalesce(r.ts, l.ts)) AS ts FROM l FULL JOIN r ON l.key = r.key AND r.ts BETWEEN l.ts - {HOUR} AND l.ts + {HOUR}""")
def ss_outer(spark, d):
    left, right = _two(spark, d, nulls=True)
    return joins.stream_stream(left, right, joins.JoinWindows.of("1 hour"), _pair(), "outer")


@query(f"""WITH {TWO} SELECT c.key, c."offset" || '|' || p."offset" AS value, greatest(c.ts, p.ts) AS ts FROM c JOIN p ON c.key = p.key AND p.ts BETWEEN c.ts + {HOUR} AND c.ts + {6 * HOUR}""")
def ss_asymmetric(spark, d):
    left, right = _two(spark, d)
    return joins.stream_stream(left, right, joins.JoinWindows(-HOUR, 6 * HOUR), _pair())


@query(f"""WITH {TWO} SELECT c.key, c."offset" || '|' || p."offset" AS value, greatest(c.ts, p.ts) AS ts FROM c JOIN c AS p ON c.key = p.key AND p.ts BETWEEN c.ts - {HOUR} AND c.ts + {HOUR}""")
def self_join(spark, d):
    left, _ = _two(spark, d)
    return joins.stream_stream(left, left, joins.JoinWindows.of("1 hour"), _pair())


@query('SELECT key, value || \'@\' || c_mktsegment AS value, "offset" FROM n JOIN customer ON c_custkey = key WHERE value IS NOT NULL')
def st_inner(spark, d):
    return joins.stream_table(with_nulls(spark, d), customers(spark, d), F.concat_ws("@", "value", "table_value")).select("key", "value", "offset")


@query('SELECT key, value || \'@\' || coalesce(c_mktsegment, \'none\') AS value, "offset" FROM n LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = \'BUILDING\') ON c_custkey = key WHERE value IS NOT NULL')
def st_left(spark, d):
    return joins.stream_table(with_nulls(spark, d), customers(spark, d).where("value = 'BUILDING'"), F.concat_ws("@", "value", F.coalesce("table_value", F.lit("none"))), "left").select("key", "value", "offset")


@query("""WITH v AS (SELECT * FROM e WHERE value = 'purchase'), s AS (SELECT * FROM e WHERE value = 'click')
SELECT s.key, s."offset", s.cents || '|' || v.cents AS value FROM s ASOF JOIN v ON s.key = v.key AND s.ts >= v.ts""")
def st_asof(spark, d):
    e = events(spark, d).select("key", "ts", "offset", F.col("cents").cast("string").alias("value"), F.col("value").alias("kind"))
    s, v = (e.where(F.col("kind") == k).drop("kind") for k in ("click", "purchase"))
    return joins.stream_as_of(s, v, F.concat_ws("|", "value", "table_value")).select("key", "offset", "value")


@query(f"""WITH v AS (SELECT * FROM e WHERE value = 'purchase'), s AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY partition ORDER BY "offset") AS st FROM a WHERE value = 'click') WHERE ts >= st - {10 * DAY})
SELECT s.key, s."offset", s.cents || '|' || coalesce(CAST(v.cents AS VARCHAR), 'null') AS value FROM s ASOF LEFT JOIN v ON s.key = v.key AND s.ts >= v.ts""")
def st_asof_grace(spark, d):
    """Records held for a grace period join in time order; those later than it are dropped."""
    kind = lambda df, k: df.where(F.col("value") == k).select("key", "ts", "offset", "partition", F.col("cents").cast("string").alias("value"))
    s = windows.with_stream_time(kind(disordered(spark, d), "click")).where(F.col("ts") >= F.col("stream_time") - 10 * DAY).drop("stream_time", "partition")
    return joins.stream_as_of(s, kind(events(spark, d), "purchase").drop("partition"), F.concat_ws("|", "value", F.coalesce("table_value", F.lit("null"))), "left").select("key", "offset", "value")


@query("SELECT key, value || '>' || n_name AS value, \"offset\" FROM e JOIN nation ON n_nationkey = key % 30")
def global_inner(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("value"))
    return joins.stream_global(events(spark, d), n, F.col("key") % 30, F.concat_ws(">", "value", "table_value")).select("key", "value", "offset")


@query("SELECT key, value || '>' || coalesce(n_name, 'none') AS value, \"offset\" FROM n LEFT JOIN nation ON n_nationkey = key % 30 WHERE value IS NOT NULL")
def global_left(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("value"))
    return joins.stream_global(with_nulls(spark, d), n, F.col("key") % 30, F.concat_ws(">", "value", F.coalesce("table_value", F.lit("none"))), "left").select("key", "value", "offset")


TABLES = ORDERS + """, x AS (SELECT * FROM latest), y AS (SELECT c_custkey AS key, c_mktsegment AS value, 0 AS ts FROM customer WHERE c_mktsegment <> 'BUILDING')"""


def _tables(spark, d):
    """Customers' last orders, and the customers outside one segment: either has keys that the other lacks."""
    return tables.latest(orders_log(spark, d)), customers(spark, d).where("value <> 'BUILDING'")


@query(f"WITH {TABLES} SELECT x.key, x.value || '|' || y.value AS value, greatest(x.ts, y.ts) AS ts FROM x JOIN y ON x.key = y.key")
def tt_inner(spark, d):
    return joins.table_table(*_tables(spark, d), _pair())


@query(f"WITH {TABLES} SELECT x.key, x.value || '|' || coalesce(y.value, 'null') AS value, x.ts FROM x LEFT JOIN y ON x.key = y.key")
def tt_left(spark, d):
    return joins.table_table(*_tables(spark, d), _pair(), "left")


@query(f"WITH {TABLES} SELECT coalesce(x.key, y.key) AS key, coalesce(x.value, 'null') || '|' || coalesce(y.value, 'null') AS value, coalesce(x.ts, y.ts) AS ts FROM x FULL JOIN y ON x.key = y.key")
def tt_outer(spark, d):
    return joins.table_table(*_tables(spark, d), _pair(), "outer")


@query("SELECT l_orderkey * 10 + l_linenumber AS key, l_quantity || '|' || p_brand AS value FROM (SELECT * FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1) JOIN part ON p_partkey = l_partkey", prelude=False)
def fk_inner(spark, d):
    return joins.foreign_key(*_lines(spark, d), F.col("part"), F.concat_ws("|", "value", "right_value"))


@query("SELECT l_orderkey * 10 + l_linenumber AS key, l_quantity || '|' || coalesce(p_brand, 'none') AS value FROM (SELECT * FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1) LEFT JOIN (SELECT * FROM part WHERE p_brand <> 'Brand#13') ON p_partkey = l_partkey AND l_quantity < 45", prelude=False)
def fk_left(spark, d):
    left, right = _lines(spark, d)
    """Large lines name no part, and parts of one brand are unknown."""
    return joins.foreign_key(left, right.where("value <> 'Brand#13'"), F.when(F.col("value").cast("double") < 45, F.col("part")), F.concat_ws("|", "value", F.coalesce("right_value", F.lit("none"))), "left")


def _lines(spark, d):
    """Returned lines by their number, the one with the largest keys if several have it; parts."""
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    lines = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("offset"), F.col("l_quantity").cast("string").alias("value"), F.col("l_partkey").alias("part"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("value"))
    return tables.latest(lines), parts


# --- interactive queries


def _store(spark, d, name):
    make = {
        "latest_orders": lambda: tables.latest(orders_log(spark, d)),
        "order_versions": lambda: tables.versions(orders_log(spark, d)),
        "daily_counts": lambda: windows.windowed(events(spark, d), windows.TimeWindows(DAY), {"value": F.count(F.lit(1))}),
        "user_sessions": lambda: windows.windowed(events(spark, d), windows.SessionWindows(6 * HOUR), {"value": F.count(F.lit(1))}),
    }
    s = stores.Stores()
    s.add(name, make[name]())
    return s


def _asked(spark, d, name, q):
    return _store(spark, d, name).run(stores.Request(name, q))


@query(f"WITH {ORDERS} SELECT key, value, ts FROM latest WHERE key = 40")
def iq_key(spark, d):
    return _asked(spark, d, "latest_orders", stores.KeyQuery(40, with_timestamp=True))


@query(f"WITH {ORDERS} SELECT key, value FROM latest WHERE key BETWEEN 100 AND 200")
def iq_range_desc(spark, d):
    return _asked(spark, d, "latest_orders", stores.RangeQuery(100, 200, descending=True))


@query(f"WITH {ORDERS} SELECT key, value FROM latest WHERE CAST(key AS VARCHAR) LIKE '12%'")
def iq_prefix(spark, d):
    return _asked(spark, d, "latest_orders", stores.PrefixQuery("12"))


VERSIONS = ORDERS + """, v AS (SELECT * FROM (SELECT key, ts AS valid_from, lead(ts) OVER (PARTITION BY key ORDER BY ts) AS valid_to, value, "offset" FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY key, ts ORDER BY "offset" DESC) = 1)) WHERE value IS NOT NULL)"""
MID = 850_000_000_000


@query(f"WITH {VERSIONS} SELECT key, valid_from, valid_to, value FROM v WHERE valid_from <= {MID} AND (valid_to IS NULL OR valid_to > {MID})")
def versioned_as_of(spark, d):
    return tables.as_of(tables.versions(orders_log(spark, d)), MID).drop("offset")


@query(f"WITH {VERSIONS} SELECT key, valid_from, valid_to, value FROM v WHERE key = 41 AND valid_from <= {MID} AND (valid_to IS NULL OR valid_to > {MID})")
def iq_asof(spark, d):
    return _asked(spark, d, "order_versions", stores.VersionedKeyQuery(41, MID)).drop("offset")


@query(f"WITH {VERSIONS} SELECT key, valid_from, valid_to, value FROM v WHERE key = 41 AND valid_from <= {MID + 1000 * DAY} AND (valid_to IS NULL OR valid_to > {MID})")
def iq_versions(spark, d):
    return _asked(spark, d, "order_versions", stores.MultiVersionedKeyQuery(41, MID, MID + 1000 * DAY)).drop("offset")


@query(f"SELECT key, ts // {DAY} * {DAY} AS window_start, ts // {DAY} * {DAY} + {DAY} AS window_end, count(*) AS value FROM e WHERE key = 8 AND ts // {DAY} * {DAY} BETWEEN {FIRST + 2 * DAY} AND {FIRST + 9 * DAY} GROUP BY ALL")
def iq_window(spark, d):
    return _asked(spark, d, "daily_counts", stores.WindowKeyQuery(8, FIRST + 2 * DAY, FIRST + 9 * DAY))


@query(f"SELECT key, ts // {DAY} * {DAY} AS window_start, ts // {DAY} * {DAY} + {DAY} AS window_end, count(*) AS value FROM e WHERE ts // {DAY} * {DAY} BETWEEN {FIRST + 3 * DAY} AND {FIRST + 4 * DAY} GROUP BY ALL")
def iq_window_range(spark, d):
    return _asked(spark, d, "daily_counts", stores.WindowRangeQuery(FIRST + 3 * DAY, FIRST + 4 * DAY))


@query("WITH " + SESSIONS.format(gap=6 * HOUR, source="e") + f", t AS (SELECT key, min(ts) AS window_start, max(ts) AS window_end, count(*) AS value FROM s GROUP BY key, sid) SELECT * FROM t WHERE key = 5 AND window_end >= {FIRST + 5 * DAY} AND window_start <= {FIRST + 8 * DAY}")
def iq_sessions(spark, d):
    return stores.sessions_of(_store(spark, d, "user_sessions").frame("user_sessions"), 5, FIRST + 5 * DAY, FIRST + 8 * DAY)


# --- record transforms

REC = """r AS (SELECT topic, partition, "offset", ts, key, value AS event_type, cents, props, "offset" % 13 <> 0 AS alive FROM e)"""


@query(f'WITH {REC} SELECT "offset", CASE WHEN alive THEN CAST(cents AS VARCHAR) END AS cents FROM r')
def smt_cast(spark, d):
    return smt.cast({"cents": "string"})(records(spark, d)).select("offset", "value.cents")


@query(f"WITH {REC} SELECT \"offset\", 'type' AS name, event_type AS value FROM r")
def smt_drop_headers(spark, d):
    out = smt.drop_headers(["user"])(records(spark, d))
    return out.select("offset", F.explode("headers").alias("h")).select("offset", F.col("h.key").alias("name"), F.col("h.value").cast("string").alias("value"))


@query(f'WITH {REC} SELECT "offset", CASE WHEN alive THEN event_type END AS value FROM r')
def smt_extract_field(spark, d):
    return smt.extract_field("event_type")(records(spark, d)).select("offset", "value")


@query(f'WITH {REC} SELECT "offset", event_type FROM r WHERE alive')
def smt_filter_tombstone(spark, d):
    return smt.filter_records(smt.is_tombstone())(records(spark, d)).select("offset", "value.event_type")


@query(f'WITH {REC} SELECT "offset", CASE WHEN alive THEN event_type END AS event, CASE WHEN alive THEN cents END AS cents FROM r')
def smt_flatten(spark, d):
    r = records(spark, d).withColumn("value", F.when(F.col("value").isNotNull(), F.struct(F.struct("value.event_type", F.struct("value.cents").alias("money")).alias("a"))))
    out = smt.flatten("_")(r)
    return out.select("offset", F.col("value.a_event_type").alias("event"), F.col("value.a_money_cents").alias("cents"))


@query(f"WITH {REC} SELECT \"offset\", CASE WHEN alive THEN 3 ELSE 2 END AS n_headers, CASE WHEN alive THEN CAST(cents AS VARCHAR) END AS moved FROM r")
def smt_header_from(spark, d):
    out = smt.header_from(["cents"], ["price"], "move")(records(spark, d))
    return out.select("offset", F.size("headers").alias("n_headers"), F.get(F.filter("headers", lambda h: h["key"] == "price"), F.lit(0))["value"].cast("string").alias("moved"))


@query(f'WITH {REC} SELECT "offset", key AS user_id FROM r')
def smt_hoist(spark, d):
    return smt.hoist("user_id", "key")(records(spark, d)).select("offset", "key.user_id")


@query(f"WITH {REC} SELECT \"offset\", CASE WHEN alive THEN topic END AS topic, CASE WHEN alive THEN partition END AS part, CASE WHEN alive THEN ts END AS time, CASE WHEN alive THEN 'my-instance-id' END AS instance FROM r")
def smt_insert_field(spark, d):
    out = smt.insert_field(topic="t", partition="p", timestamp="time", static=("instance", "my-instance-id"))(records(spark, d))
    return out.select("offset", F.col("value.t").alias("topic"), F.col("value.p").alias("part"), F.col("value.time").alias("time"), F.col("value.instance").alias("instance"))


@query(f"WITH {REC} SELECT \"offset\", 'v1' AS added FROM r")
def smt_insert_header(spark, d):
    out = smt.insert_header("version", "v1")(records(spark, d))
    return out.select("offset", F.element_at("headers", -1)["value"].cast("string").alias("added"))


@query(f"WITH {REC} SELECT \"offset\", CASE WHEN alive THEN '' END AS event_type, CASE WHEN alive THEN 0 END AS cents, CASE WHEN alive THEN props END AS props FROM r")
def smt_mask(spark, d):
    return smt.mask(["event_type", "cents"])(records(spark, d)).select("offset", "value.event_type", "value.cents", "value.props")


@query("SELECT CASE WHEN value IN ('click', 'view') THEN value || '-stream' ELSE topic END AS topic, count(*) AS n FROM e GROUP BY 1")
def smt_regex_router(spark, d):
    return smt.regex_router("events-(click|view)", "$1-stream")(records(spark, d)).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query(f'WITH {REC} SELECT "offset", CASE WHEN alive THEN event_type END AS kind, CASE WHEN alive THEN cents END AS cents FROM r')
def smt_replace(spark, d):
    out = smt.replace_fields(include=["event_type", "cents", "props"], exclude=["props"], renames={"event_type": "kind"})(records(spark, d))
    return out.select("offset", "value.*")


@query("SELECT topic || '-' || strftime(make_timestamp(ts * 1000), '%Y%m%d') AS topic, count(*) AS n FROM e GROUP BY 1")
def smt_timestamp_router(spark, d):
    return smt.timestamp_router()(records(spark, d)).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REC} SELECT \"offset\", strftime(make_timestamp(ts * 1000), '%Y-%m-%d %H:%M:%S') AS text, ts % {DAY} AS time_of_day, ts // 1000 * 1000 AS back FROM r WHERE alive")
def smt_timestamp_convert(spark, d):
    """The time as text, as time of day, and as the number that the text stands for, field by field in one pass."""
    ts = F.col("ts")
    r = records(spark, d).where("value IS NOT NULL").withColumn("value", F.struct(ts.alias("text"), ts.alias("time_of_day"), ts.alias("back")))
    out = smt.chain(r, smt.timestamp_convert("string", "text"), smt.timestamp_convert("Time", "time_of_day"), smt.timestamp_convert("string", "back"), smt.timestamp_convert("unix", "back"))
    return out.select("offset", "value.text", F.col("value.time_of_day").cast("long").alias("time_of_day"), "value.back")


@query(f'WITH {REC} SELECT event_type, cents, count(*) AS n FROM r WHERE alive GROUP BY ALL')
def smt_value_to_key(spark, d):
    out = smt.value_to_key(["event_type", "cents"])(records(spark, d).where("value IS NOT NULL"))
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key.*", "n")


@query("SELECT topic, count(*) AS n FROM (SELECT CASE WHEN value = 'click' THEN 'events-click' ELSE 'other' END AS topic FROM e WHERE \"offset\" % 13 <> 0) GROUP BY topic")
def smt_chain_predicate(spark, d):
    out = smt.chain(records(spark, d), smt.filter_records(smt.is_tombstone()), (smt.regex_router(".*", "other"), smt.topic_matches("events-click"), True))
    return out.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT value, count(*) AS n FROM e GROUP BY value")
def smt_schema_metadata(spark, d):
    out = smt.set_schema_metadata("event", 2)(records(spark, d))
    assert out.schema["value"].metadata == {"schema.name": "event", "schema.version": 2}
    return out.groupBy(F.col("headers")[0]["value"].cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query(f'WITH {REC} SELECT "offset", CASE WHEN alive THEN event_type END AS event_type, CASE WHEN alive THEN cents END AS cents FROM r')
def json_envelope(spark, d):
    r = records(spark, d)
    kind = r.schema["value"].dataType
    text = r.select("offset", codecs.to_envelope(r, "value").alias("json"))
    return text.select("offset", codecs.from_envelope(F.col("json"), kind).alias("value")).select("offset", "value.event_type", "value.cents")


@query(f'WITH {REC} SELECT "offset", CASE WHEN alive THEN CAST(cents AS DOUBLE) END AS cents, CASE WHEN alive THEN event_type END AS event_type, CASE WHEN alive THEN \'none\' END AS note FROM r')
def schema_project(spark, d):
    r = records(spark, d)
    target = StructType([StructField("cents", DoubleType()), StructField("event_type", StringType()), StructField("note", StringType(), False)])
    return r.select("offset", codecs.project(F.col("value"), r.schema["value"].dataType, target, {"note": "none"}).alias("v")).select("offset", "v.*")


@query("SELECT \"offset\", lpad(lower(to_hex(cents)), 16, '0') AS bytes, -cents AS negated FROM e")
def codec_numbers(spark, d):
    e = events(spark, d)
    return e.select("offset", F.lower(F.hex(codecs.encode_number(F.col("cents"), "long"))).alias("bytes"), codecs.decode_number(codecs.encode_number(-F.col("cents"), "long"), "long").alias("negated"))


@query("SELECT \"offset\", CAST(cents AS INTEGER) AS first, key AS third FROM e")
def codec_list(spark, d):
    e = events(spark, d)
    items = F.array(F.col("cents").cast("int"), F.lit(None).cast("int"), F.col("key").cast("int"))
    return e.select("offset", codecs.decode_list(codecs.encode_list(items)).alias("x")).select("offset", F.col("x")[0].alias("first"), F.col("x")[2].cast("long").alias("third"))
