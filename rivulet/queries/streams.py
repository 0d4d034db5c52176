"""Queries: sources, stateless operators, aggregation, tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions import codecs, errors, timestamps
from rivulet.operators import aggregate, stateless, tables
from rivulet.plans import topology
from rivulet.plans.registry import query
from rivulet.queries.inputs import FIRST, HOUR, ORDERS, customers, disordered, events, orders_log, records, with_nulls
from rivulet.record import table
from rivulet.sources import files, log
from rivulet.streaming.run import scratch

# --- sources and sinks


@query('SELECT topic, key, value, "offset" FROM e WHERE topic IN (\'events-click\', \'events-view\')')
def subscribe_topics(spark, d):
    return log.subscribe(events(spark, d), ["events-click", "events-view"]).select("topic", "key", "value", "offset")


@query("SELECT topic, count(*) AS n FROM e WHERE regexp_full_match(topic, 'events-(c|p).*') GROUP BY topic")
def subscribe_pattern(spark, d):
    return log.subscribe(events(spark, d), pattern="events-(c|p).*").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT topic, count(*) AS n FROM e WHERE topic <> 'events-error' GROUP BY topic")
def topic_filter(spark, d):
    return log.topic_filter(events(spark, d), "events-.*", "events-err.*").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query(f'SELECT topic, partition, count(*) AS n, min("offset") AS first_offset FROM e WHERE ts >= {FIRST + 10 * 24 * HOUR} GROUP BY ALL')
def offset_reset_duration(spark, d):
    return log.reset(events(spark, d), "by_duration", FIRST + 10 * 24 * HOUR).groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("first_offset"))


@query('SELECT topic, partition, min("offset") AS earliest, max("offset") + 1 AS latest, arg_max("offset", (ts, -"offset")) AS max_timestamp FROM e GROUP BY ALL')
def offset_specs(spark, d):
    return log.offset_specs(events(spark, d))


@query(f'SELECT topic, partition, min("offset") AS "offset" FROM e WHERE ts >= {FIRST + 12 * 24 * HOUR} GROUP BY ALL')
def offsets_for_times(spark, d):
    return log.offsets_for_times(events(spark, d), FIRST + 12 * 24 * HOUR)


@query("""SELECT topic, partition, end_ - coalesce(committed, begin_) AS lag FROM
(SELECT topic, partition, max("offset") + 1 AS end_, min("offset") AS begin_ FROM e GROUP BY ALL)
LEFT JOIN (SELECT topic, partition, CAST(floor(avg("offset")) AS BIGINT) AS committed FROM e WHERE partition < 3 GROUP BY ALL) USING (topic, partition)""")
def consumer_lag(spark, d):
    e = events(spark, d)
    return log.lag(e, e.where("partition < 3").groupBy("topic", "partition").agg(F.floor(F.avg("offset")).cast("long").alias("committed")))


@query('SELECT key, value, "offset" FROM e WHERE partition <> 1 OR "offset" >= 5000')
def seek_position(spark, d):
    e = events(spark, d)
    at = e.where("partition = 1").select("topic", "partition").distinct().withColumn("position", F.lit(5000))
    return log.seek(e, at).select("key", "value", "offset")


@query('SELECT partition, count(*) AS n FROM e WHERE partition IN (0, 3) GROUP BY partition')
def assign_pause(spark, d):
    return log.assign(events(spark, d), [0, 2, 3], paused=[2]).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


@query('SELECT p AS partition, count(*) AS n FROM e, LATERAL (SELECT unnest(CASE WHEN value = \'error\' THEN [0, 1, 2, 3] WHEN value = \'view\' THEN [] ELSE [partition] END) AS p) GROUP BY p')
def multicast_partition(spark, d):
    e = events(spark, d)
    to = F.when(F.col("value") == "error", F.array(*(F.lit(i) for i in range(4)))).when(F.col("value") == "view", F.array().cast("array<int>")).otherwise(F.array("partition"))
    return log.multicast(e, to).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'eu.' || topic AS topic, count(*) AS n FROM e GROUP BY topic")
def mirror_topics(spark, d):
    return log.mirrored(events(spark, d), "eu").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT topic, partition, "offset" AS up, 2 * "offset" AS down FROM e WHERE "offset" % 10 = 0)
SELECT e.topic, e.partition, e."offset", s.down + CASE WHEN e."offset" > s.up THEN 1 ELSE 0 END AS downstream
FROM e ASOF JOIN s ON e.topic = s.topic AND e.partition = s.partition AND e."offset" >= s.up WHERE e."offset" % 7 = 3""")
def offset_translation(spark, d):
    e = events(spark, d)
    syncs = e.where("offset % 10 = 0").select("topic", "partition", F.col("offset").alias("upstream"), (2 * F.col("offset")).alias("downstream"))
    return log.translate_offsets(e.where("offset % 7 = 3").select("topic", "partition", "offset"), syncs)


@query('SELECT partition, count(*) AS n, min("offset") AS low FROM e WHERE "offset" >= CASE partition WHEN 0 THEN 1000 WHEN 2 THEN 4000 ELSE 0 END GROUP BY partition')
def delete_records(spark, d):
    return log.delete_before(events(spark, d), {0: 1000, 2: 4000}).groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("low"))


@query('SELECT key, value, "offset" FROM e WHERE ("offset" // 10) % 5 <> 0')
def read_committed(spark, d):
    e = events(spark, d).withColumn("transaction", F.floor(F.col("offset") / 10))
    return log.read_committed(e, e.where("transaction % 5 = 0").select("transaction")).select("key", "value", "offset")


@query("""SELECT 'CreateTime:' || ts || chr(9) || 'Partition:' || partition || chr(9) || 'Offset:' || "offset" || chr(9) || coalesce(CAST(key AS VARCHAR), 'null') || chr(9) || coalesce(value, 'null') AS line FROM n""")
def console_lines(spark, d):
    return log.console_lines(with_nulls(spark, d), partition=True, offset=True)


@query("""SELECT key AS user_id, value, CAST("offset" AS VARCHAR) AS header FROM e""")
def line_reader(spark, d):
    lines = events(spark, d).select(F.concat(F.lit("o:"), "offset", F.lit("\t"), "key", F.lit("\t"), "value").alias("value"))
    return log.parse_lines(lines).select(F.col("key").cast("long").alias("user_id"), "value", F.col("headers")[0]["value"].cast("string").alias("header"))


@query("""SELECT kind, count(*) AS n, count(value) AS n_values FROM
(SELECT CASE WHEN i % 100 < 60 THEN 'sequential' WHEN i % 100 < 90 THEN 'constant' ELSE 'null' END AS kind, CASE WHEN i % 100 < 90 THEN 1 END AS value FROM range(5000) t(i)) GROUP BY kind""", prelude=False)
def generator_mix(spark, d):
    return log.generate_mix(spark, 5000, [("sequential", 60), ("constant", 30), ("null", 10)]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"))


@query("SELECT i AS \"offset\", lpad(upper(to_hex(i)), 16, '0') AS value FROM range(1000) t(i)", prelude=False)
def generator_sequential(spark, d):
    return log.generate(spark, 1000)


@query("SELECT 'verifiable' AS topic, i AS \"offset\", i * 1000 AS ts, CAST(i AS VARCHAR) AS value FROM range(100) t(i)", prelude=False)
def verifiable_source(spark, d):
    spark.dataSource.register(files.SequenceSource)
    return spark.read.format("sequence").option("rows", "100").load()


@query("SELECT value AS topic, count(*) AS n, sum(cents) AS cents FROM e GROUP BY value")
def topic_router(spark, d):
    path = scratch(spark, "topics")
    files.to_topics(events(spark, d).select(F.col("value").alias("topic"), "cents"), path)
    return files.read_topics(spark, path).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query('SELECT value, count(*) AS n FROM e GROUP BY value')
def file_lines(spark, d):
    path = scratch(spark, "lines")
    files.write_lines(events(spark, d), path)
    return files.read_lines(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


# --- stateless


@query("SELECT key, value, cents FROM e WHERE value = 'purchase' AND cents > 5000")
def filter_events(spark, d):
    return stateless.keep(events(spark, d), (F.col("value") == "purchase") & (F.col("cents") > 5000)).select("key", "value", "cents")


@query('SELECT key, value, "offset" FROM n WHERE NOT coalesce(value = \'click\', false)')
def filter_not_nulls(spark, d):
    return stateless.keep_not(with_nulls(spark, d), F.col("value") == "click").select("key", "value", "offset")


@query('SELECT value AS key, CAST(key AS VARCHAR) || value AS value, "offset" FROM e')
def map_pairs(spark, d):
    return stateless.map_pairs(events(spark, d), F.col("value"), F.concat(F.col("key").cast("string"), "value")).select("key", "value", "offset")


@query('SELECT key, length(value) AS value, "offset" FROM e')
def map_values(spark, d):
    return stateless.map_values(events(spark, d), F.length("value")).select("key", "value", "offset")


@query("""SELECT key * 10 + i AS key, value, "offset" FROM e, LATERAL (SELECT unnest(range(key % 4)) AS i)""")
def flat_map(spark, d):
    pairs = F.transform(F.slice(F.sequence(F.lit(0), F.lit(3)), F.lit(1), (F.col("key") % 4).cast("int")), lambda i: F.struct((F.col("key") * 10 + i).alias("key"), F.col("value").alias("value")))
    return stateless.flat_map(events(spark, d), pairs).select("key", "value", "offset")


@query("SELECT doc_id AS key, unnest(string_split_regex(lower(text), '[^a-z]+')) AS value FROM documents", prelude=False)
def flat_map_words(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return stateless.flat_map_values(docs.withColumn("value", F.lit("")), F.split(F.lower("text"), "[^a-z]+")).select("key", "value")


@query('SELECT value AS key, value, "offset" FROM e')
def select_key(spark, d):
    return stateless.select_key(events(spark, d), F.col("value")).select("key", "value", "offset")


@query("SELECT '[clicks]: ' || coalesce(CAST(key AS VARCHAR), 'null') || ', ' || value AS line FROM n WHERE value = 'click'")
def print_lines(spark, d):
    return with_nulls(spark, d).where("value = 'click'").select(stateless.print_line("clicks").alias("line"))


@query("""SELECT b AS branch, count(*) AS n, sum("offset") AS s FROM (SELECT *, CASE WHEN "offset" % 2 = 0 THEN 'x-2' WHEN "offset" % 3 = 0 THEN 'x-3' ELSE 'x-0' END AS b FROM e) GROUP BY b""")
def branch_first_match(spark, d):
    b = stateless.Branches(events(spark, d), "x-").branch(F.col("offset") % 2 == 0, "2").branch(F.col("offset") % 3 == 0, "3")
    return b.labelled(default="x-0").groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.sum("offset").alias("s"))


@query("SELECT key, value FROM e WHERE value = 'click' UNION ALL SELECT key, value FROM e WHERE key < 10")
def merge_streams(spark, d):
    e = events(spark, d)
    return stateless.merge(e.where("value = 'click'"), e.where("key < 10")).select("key", "value")


@query("SELECT key, count(*) AS n FROM n WHERE key IS NOT NULL GROUP BY key")
def repartition_by_key(spark, d):
    return stateless.repartition(with_nulls(spark, d), 8).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


# --- aggregation


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[0-9\\pL_]+')) AS word FROM documents) GROUP BY word", prelude=False)
def word_count(spark, d):
    words = F.explode(F.split(F.lower("text"), r"[^0-9\p{L}_]+"))  # splitting is cheaper than matching every word
    return table(spark, d, "documents").select(words.alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT key, count(*) AS count FROM n WHERE key IS NOT NULL AND value IS NOT NULL GROUP BY key")
def count_by_key(spark, d):
    return aggregate.count(with_nulls(spark, d))


@query("SELECT key, max(cents) AS value FROM e GROUP BY key")
def reduce_max(spark, d):
    return aggregate.aggregate(events(spark, d), {"value": F.max("cents")})


@query("SELECT key, CAST(sum(length(value)) AS BIGINT) AS total, count(*) AS n, min(cents) AS least, max(cents) AS most, max(ts) AS ts FROM n WHERE key IS NOT NULL AND value IS NOT NULL GROUP BY key")
def aggregate_lengths(spark, d):
    return aggregate.aggregate(with_nulls(spark, d), {"total": F.sum(F.length("value")).cast("long"), "n": F.count(F.lit(1)), "least": F.min("cents"), "most": F.max("cents"), "ts": F.max("ts")})


@query("SELECT key, CAST(string_agg(value[1:1], '' ORDER BY \"offset\") AS VARCHAR) AS trail FROM n WHERE key IS NOT NULL AND value IS NOT NULL GROUP BY key")
def ordered_fold(spark, d):
    return aggregate.fold(with_nulls(spark, d), F.lit(""), lambda acc, v: F.concat(acc, F.substring(v, 1, 1)), name="trail")


@query("SELECT key, CAST(string_agg(value, '>' ORDER BY \"offset\") AS VARCHAR) AS value FROM e GROUP BY key")
def ordered_reduce(spark, d):
    return aggregate.reduce(events(spark, d), lambda a, b: F.concat(a, F.lit(">"), b))


@query('SELECT key, "offset", count(*) OVER w AS n, CAST(sum(cents) OVER w AS BIGINT) AS cents FROM n WHERE key IS NOT NULL AND value IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY "offset")')
def running_changelog(spark, d):
    return aggregate.changelog(with_nulls(spark, d), {"n": F.count(F.lit(1)), "cents": F.sum("cents")}).drop("ts")


@query("SELECT key, count(*) FILTER (WHERE value = 'click') AS clicks, CAST(coalesce(sum(cents) FILTER (WHERE value = 'purchase'), 0) AS BIGINT) AS spent FROM e WHERE value IN ('click', 'purchase') GROUP BY key")
def cogroup_clicks_purchases(spark, d):
    e = events(spark, d)
    return aggregate.cogroup({"c": e.where("value = 'click'"), "p": e.where("value = 'purchase'")}, {"clicks": lambda of: F.count(of("c")(F.lit(1))), "spent": lambda of: F.coalesce(F.sum(of("p")(F.col("cents"))), F.lit(0))})


@query("""SELECT nation, min(cents) AS least, max(cents) AS most, CAST(sum(cents) AS BIGINT) AS total, max(cents) - min(cents) AS dif, count(*) AS cnt, CAST(sum(cents) AS BIGINT) // count(*) AS average
FROM (SELECT c_nationkey AS nation, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY nation""", prelude=False)
def smoke_aggregates(spark, d):
    joined = orders_log(spark, d).join(customers(spark, d).select("key", "nation"), "key")
    return joined.groupBy("nation").agg(F.min("cents").alias("least"), F.max("cents").alias("most"), F.sum("cents").alias("total"), (F.max("cents") - F.min("cents")).alias("dif"), F.count(F.lit(1)).alias("cnt"), F.floor(F.sum("cents") / F.count(F.lit(1))).cast("long").alias("average"))


# --- tables


@query(f'WITH {ORDERS} SELECT key, value, cents, "offset" FROM latest')
def table_latest(spark, d):
    return tables.latest(orders_log(spark, d)).select("key", "value", "cents", "offset")


@query(f"WITH {ORDERS} SELECT key, value FROM latest WHERE value = 'O'")
def table_filter(spark, d):
    return tables.keep(tables.latest(orders_log(spark, d)), F.col("value") == "O").select("key", "value")


@query(f"WITH {ORDERS} SELECT key, value || '/' || cents AS value FROM latest")
def table_map_values(spark, d):
    return tables.map_values(tables.latest(orders_log(spark, d)), F.concat("value", F.lit("/"), F.col("cents").cast("string"))).select("key", "value")


@query(f"WITH {ORDERS} SELECT value AS key, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM latest GROUP BY value")
def table_regroup_count(spark, d):
    t = tables.regroup(tables.latest(orders_log(spark, d)), F.col("value"), F.col("cents"))
    return t.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("cents"))


@query(f"WITH {ORDERS} SELECT value AS key, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM latest GROUP BY value")
def table_agg_subtract(spark, d):
    o = orders_log(spark, d)
    updates = o.withColumn("value", F.when(F.col("value").isNotNull(), F.struct(F.col("value").alias("status"), "cents")))
    rows = tables.signed(tables.changes(updates), F.col("value.status"), F.col("value.cents"))
    return tables.aggregate_signed(rows, {"n": F.lit(1), "cents": F.col("value")}).select("key", F.col("n").cast("long").alias("n"), "cents")


@query(f"""WITH {ORDERS} SELECT key, "offset", value AS new_value, lag(value) OVER (PARTITION BY key ORDER BY "offset") AS old_value FROM o""")
def table_changes(spark, d):
    return tables.changes(orders_log(spark, d)).drop("ts")


@query(f'WITH {ORDERS} SELECT key, value, ts, "offset" FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY "offset" DESC) = 1 AND (value IS NOT NULL OR ts >= 800000000000)')
def compaction(spark, d):
    return tables.compact(orders_log(spark, d), keep_tombstones_after=800_000_000_000).select("key", "value", "ts", "offset")


@query(f"SELECT key, value, ts FROM e WHERE ts >= (SELECT max(ts) FROM e) - {48 * HOUR}")
def retention(spark, d):
    return tables.retain(events(spark, d), 48 * HOUR).select("key", "value", "ts")


@query(f"""WITH {ORDERS} SELECT key, key || ':' || coalesce(value, 'deleted') AS value FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY "offset" DESC) = 1""")
def table_transform_values(spark, d):
    t = tables.latest(orders_log(spark, d), tombstones=True)
    return tables.transform_values(t, F.concat_ws(":", "key", F.coalesce("value", F.lit("deleted")))).select("key", "value")


@query("SELECT value AS key, count(*) AS count FROM e WHERE value <> 'error' GROUP BY value")
def topology_counts(spark, d):
    """The low-level graph API."""
    t = topology.Topology().add_source("events", lambda: events(spark, d))
    t.add_processor("re-key", lambda e, ignored: stateless.select_key(e, F.col("value")).join(ignored, "key", "left_anti"), "events")
    t.add_store("ignored", lambda: spark.createDataFrame([("error",)], "key string"), "re-key")
    t.add_processor("count", aggregate.count, "re-key")
    return t.frame("count")


@query('SELECT "offset", key AS key, ts // 86400000 * 86400000 AS window_start, ts // 86400000 * 86400000 + 86400000 AS window_end, CAST(cents AS DOUBLE) / 4 AS number FROM e')
def codec_windowed(spark, d):
    e = events(spark, d)
    start = (F.floor(F.col("ts") / 86_400_000) * 86_400_000).cast("long")
    parts = codecs.windowed_key_parts(codecs.windowed_key(codecs.encode_number(F.col("key"), "long"), start), 86_400_000)
    out = e.select("offset", parts.alias("w"), codecs.decode_float(codecs.encode_float(F.col("cents") / 4)).alias("number"))
    return out.select("offset", codecs.decode_number(F.col("w.key"), "long").alias("key"), "w.window_start", "w.window_end", "number")


# --- timestamps and errors


@query('SELECT key, "offset", ts FROM e WHERE "offset" % 5 <> 0')
def ts_skip_invalid(spark, d):
    return timestamps.skip_invalid(events(spark, d).withColumn("ts", F.when(F.col("offset") % 5 == 0, -1).otherwise(F.col("ts")))).select("key", "offset", "ts")


@query("""SELECT * FROM (SELECT "offset", coalesce(CASE WHEN "offset" % 5 <> 0 THEN ts END, max(CASE WHEN "offset" % 5 <> 0 THEN ts END) OVER (PARTITION BY partition ORDER BY "offset")) AS ts FROM a) WHERE ts IS NOT NULL""")
def ts_partition_time(spark, d):
    e = disordered(spark, d)
    return timestamps.partition_time_if_invalid(e.withColumn("ts", F.when(F.col("offset") % 5 == 0, -1).otherwise(F.col("ts")))).select("offset", "ts")


@query('SELECT "offset", CAST(json_extract(props, \'$.k\') AS BIGINT) AS ts FROM e')
def ts_from_field(spark, d):
    return timestamps.from_field(events(spark, d), F.get_json_object("props", "$.k")).select("offset", "ts")


@query("""SELECT CASE WHEN "offset" % 6 = 0 THEN 'dead' ELSE 'good' END AS side, count(*) AS n, CAST(sum(CASE WHEN "offset" % 6 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END) AS BIGINT) AS k FROM e GROUP BY 1""")
def dead_letters(spark, d):
    from pyspark.sql.types import LongType, StructType

    raw = events(spark, d).withColumn("value", F.when(F.col("offset") % 6 == 0, F.concat(F.lit("{broken"), "props")).otherwise(F.col("props")))
    good, dead = errors.parsed(raw, "value", StructType().add("k", LongType()))
    return good.select(F.lit("good").alias("side"), F.col("value.k").alias("k")).unionByName(dead.select(F.lit("dead").alias("side"), F.lit(None).cast("long").alias("k"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@query("SELECT CASE WHEN cents > 100 THEN 'good' ELSE 'dead' END AS side, count(*) AS n FROM e GROUP BY 1")
def tolerated_errors(spark, d):
    good, dead = errors.tolerated(events(spark, d), F.col("cents") > 100, "too cheap")
    return good.select(F.lit("good").alias("side")).unionByName(dead.select(F.lit("dead").alias("side"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
