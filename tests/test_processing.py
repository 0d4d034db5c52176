"""Suppression, lateness, processors, store writes, options, converters and sources by their rules and by brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from rivulet.functions import codecs, errors, timestamps
from rivulet.operators import aggregate, process, scan, suppress, tables, windows
from rivulet.plans import dsl, stores
from rivulet.queries.processing import Largest
from rivulet.sources import files, log
from rivulet.streaming import run

SCHEMA = "key string, value string, ts long, offset long, partition int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, ts, i, 0) for i, (k, v, ts) in enumerate(rows)], SCHEMA)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def mixed(n, seed, keys=4, span=200):
    r = random.Random(seed)
    return [(f"k{r.randrange(keys)}", f"v{i}", max(0, i * 5 + r.randrange(-span, span))) for i in range(n)]


def test_final_results_are_of_closed_windows(spark):
    s = dsl.stream(frame(spark, [("a", "x", 5), ("a", "x", 15), ("a", "x", 25)])).group_by_key().windowed_by(windows.TimeWindows(10, grace=7))
    assert got(s.count().suppress_until_close().df, "window_start") == got(s.emit_on_close().count().df, "window_start") == [(0,)]
    exact = dsl.stream(frame(spark, [("a", "x", 5), ("a", "x", 17)])).group_by_key().windowed_by(windows.TimeWindows(10, grace=7))
    assert got(exact.count().suppress_until_close().df, "window_start") == [(0,)]  # closed at 17 exactly


def test_grace_is_inherited(spark):
    counted = [dsl.stream(frame(spark, [("a", "x", 5)])).group_by_key().windowed_by(windows.TimeWindows(10, grace=g)).count() for g in (3, 9)]
    assert counted[0].to_stream().merge(counted[1].to_stream()).grace == 9
    assert counted[0].join(counted[1], F.col("key")).grace == 9 if "value" in counted[0].df.columns else True
    with pytest.raises(ValueError):
        dsl.table(frame(spark, [("a", "x", 5)])).suppress_until_close()


def plain_buffer(rows, wait, records=None, size=None):
    """[value] sent, in any order, by a list that is searched."""
    held, now, out = [], None, []
    for k, v, ts in rows:
        now = ts if now is None else max(now, ts)
        entry = next((h for h in held if h[1] == k), None)
        if entry:
            entry[2] = v
        else:
            held.append([ts, k, v])
        least = lambda: min(held, key=lambda h: h[0])
        total = lambda: sum(len(k) + len(v or "") for _, k, v in held)
        while held and (least()[0] <= now - wait or records and len(held) > records or size and total() > size):
            out.append(least()[2])
            held.remove(least())
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [{}, {"records": 2}, {"bytes": 9}, {"records": 3, "bytes": 14}])
def test_buffers_against_brute_force(spark, limits):
    rows = mixed(300, 4, keys=6)
    out = suppress.suppressed(frame(spark, rows), 60, suppress.Buffer(**limits))
    assert [r[0] for r in got(out, "value")] == plain_buffer(rows, 60, limits.get("records"), limits.get("bytes"))


def test_full_buffers_and_tombstones(spark):
    rows = [("a", "1", 0), ("b", "2", 1), ("c", None, 2), ("d", "4", 90)]
    with pytest.raises(Exception, match="buffer holds 3 records"):
        suppress.suppressed(frame(spark, rows), 1000, suppress.Buffer(records=2, full="shut_down")).collect()
    assert got(suppress.suppressed(frame(spark, rows), 50), "value") == [("1",), ("2",), (None,)]
    assert got(suppress.suppressed(frame(spark, rows), 50, drop_tombstones=True), "value") == [("1",), ("2",)]
    for bad in ({"records": 0}, {"bytes": 0}, {"full": "wait"}):
        with pytest.raises(ValueError):
            suppress.Buffer(**bad)
    held = suppress.TimeOrdered()
    held.put(("a",), 5, {"v": 1}, 3)
    held.put(("a",), 1, {"v": 2}, 4)
    assert (held.least(), held.prior(("a",)), held.size, held.prior(("b",))) == (5, {"v": 2}, 4, None)


def test_late_sessions_against_brute_force(spark):
    rows, gap, grace = mixed(300, 9, keys=3, span=150), 20, 30
    held, now = {}, 0
    for k, _, ts in rows:
        now = max(now, ts)
        own = held.setdefault(k, [])
        touched = [s for s in own if s[0] - gap <= ts <= s[1] + gap]
        new = (min([ts, *(s[0] for s in touched)]), max([ts, *(s[1] for s in touched)]), 1 + sum(s[2] for s in touched))
        if new[1] >= now - grace - gap:
            held[k] = [s for s in own if s not in touched] + [new]
    out = dsl.stream(frame(spark, rows)).group_by_key().windowed_by(windows.SessionWindows(gap, grace)).dropping_late().count()
    assert got(out.df, "key", "window_start", "window_end", "count") == sorted(((k, *s) for k, own in held.items() for s in own), key=repr)
    assert out.df.agg(F.sum("count")).first()[0] < len(rows)


@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_scans_in_blocks(spark, block):
    rows = [(k, v if i % 4 else None, ts) for i, (k, v, ts) in enumerate(mixed(200, 2))]
    df = frame(spark, rows)
    out = scan.running(df, ["key"], ["offset"], F.floor(F.col("offset") / block), most=("max", F.col("ts")), n=("count", F.col("value")), total=("sum", F.col("ts")), last=("last", F.col("value")))
    want = []
    for i, (k, _, _) in enumerate(rows):
        own = [r for r in rows[: i + 1] if r[0] == k]
        want.append((i, max(r[2] for r in own), sum(r[1] is not None for r in own), sum(r[2] for r in own), next((r[1] for r in reversed(own) if r[1] is not None), None)))
    assert sorted(tuple(r) for r in out.select("offset", "most", "n", "total", "last").collect()) == want
    plan = windows.with_stream_time(df)._jdf.queryExecution().toString()
    assert "__block" in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_offsets_are_translated_in_blocks(spark, block):
    rnd = random.Random(5)
    asked = [(t, p, rnd.randrange(60)) for t in ("a", "b") for p in (0, 1) for _ in range(40)] + [("a", 0, None), (None, 0, 9), ("c", 0, 9)]
    known = [(t, p, u, 3 * u + rnd.randrange(2)) for t in ("a", "b") for p in (0, 1) for u in rnd.sample(range(10, 50), 9)]
    known += [(*known[0][:3], 1), ("d", 0, 1, 1), ("a", 0, None, 1)]
    out = log.translate_offsets(spark.createDataFrame(asked, "topic string, partition int, offset long"), spark.createDataFrame(known, "topic string, partition int, upstream long, downstream long"), block)
    want = []
    for t, p, o in asked:
        own = [s[2:] for s in known if s[:2] == (t, p) and o is not None and s[2] is not None and s[2] <= o]
        want += [(t, p, o, max(own)[1] + (o > max(own)[0]))] if own else []
    assert sorted(tuple(r) for r in out.select("topic", "partition", "offset", "downstream").collect()) == sorted(want)
    plan = out._jdf.queryExecution().toString()
    assert "__block" in plan and "SinglePartition" not in plan


def test_processors(spark, tmp_path):
    df = frame(spark, [("a", "x", 1), ("a", "y", 2), ("b", "z", 3), (None, "q", 4)])
    seen = []

    class Odd(process.Processor):
        def process(self, context, record):
            assert context.put_if_absent(record["value"]) in (None, "x") and context.metadata[2] == record["offset"] and context.system_time > 1_600_000_000_000
            context.forward(context.get(), key="other", child="c")

    out = dsl.stream(df).process(Odd).df
    assert got(out, "key", "value", "child") == [("other", "x", "c"), ("other", "x", "c"), ("other", "z", "c")] and not seen

    class Wrong(process.FixedKeyProcessor):
        def process(self, context, record):
            context.forward(1, key="other")

    class Unconnected(process.Processor):
        def process(self, context, record):
            context.get("nope")

    for bad, what in ((Wrong, "can't change the key"), (Unconnected, "isn't connected")):
        with pytest.raises(Exception, match=what):
            process.process(df, bad).collect()
    with pytest.raises(TypeError):
        dsl.stream(df).process_values(Odd)
    assert got(dsl.stream(df.withColumn("cents", F.col("ts"))).process_values(Largest, "long").df, "value") == [(1,), (2,), (3,)]
    skipped = process.Context("k", process.Processor(), stream_time=0)
    at = []
    end = skipped.schedule(10, lambda c, t: at.append(t))
    for now in (5, 10, 47, 49, 50):
        skipped.punctuate(process.STREAM_TIME, now)
    end()
    skipped.punctuate(process.STREAM_TIME, 1000)
    assert at == [10, 40, 50]


def test_wall_clock_timers_on_streams(spark, tmp_path):
    class Wall(process.Processor):
        stores = ("n", "fired")

        def init(self, context):
            context.schedule(1, lambda c, at: c.forward("tick"), process.WALL_CLOCK)

        def process(self, context, record):
            context.put((context.get("n") or 0) + 1, "n")

    path = str(tmp_path / "in")
    for part in ([("a", "x", 1, 0)], [("a", "y", 2, 1)], [("b", "z", 3, 2)]):
        spark.createDataFrame(part, "key string, value string, ts long, offset long").coalesce(1).write.mode("append").parquet(path)
    s, out = run.read(spark, path, "key string, value string, ts long, offset long", 1), []
    with run.rocksdb(spark):
        sink = lambda df, _: out.extend(df.collect())
        q = process.process_stream(s, Wall, wall_clock=True).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
        end = time.time() + 40
        while time.time() < end and not any(t.value == "tick" for t in out):
            time.sleep(0.2)
        q.stop()
    assert any(t.value == "tick" for t in out)


def test_versioned_puts_against_brute_force(spark):
    rows, grace = mixed(200, 6, keys=3, span=100), 60
    held, want = {}, []
    for i, (k, _, ts) in enumerate(rows):
        own = held.setdefault(k, set())
        if own and ts < max(own) - grace:
            want.append((k, ts, i, tables.REJECTED))
            continue
        want.append((k, ts, i, min((t for t in own if t > ts), default=tables.NO_END)))
        own.add(ts)
    assert got(tables.versioned_puts(frame(spark, rows), grace), "key", "ts", "offset", "valid_to") == sorted(want, key=repr)
    assert any(w[3] == tables.REJECTED for w in want) and any(w[3] > 0 for w in want)


def test_stores_are_written(spark):
    base, more = frame(spark, [("a", "1", 1), ("b", "2", 2)]), frame(spark, [("b", None, 3), ("c", "3", 4), ("a", "9", 5), ("c", "4", 6), (None, "5", 7)])
    s = stores.Stores()
    s.add("s", base)
    assert got(s.put("s", more), "key", "value") == [("a", "9"), ("c", "4")]
    s.add("s", base)
    assert got(s.put_if_absent("s", more), "key", "value") == [("a", "1"), ("b", "2"), ("c", "3")]
    assert got(s.delete("s", more.where("key = 'a'")), "key") == [("b",), ("c",)]
    assert [r.failure for r in s.results(stores.Request("nope", stores.KeyQuery("a")))] == [stores.NOT_PRESENT]
    assert [r.failure for r in s.results(stores.Request("s", object()))] == [stores.UNKNOWN_QUERY]
    s.add("bare", base.drop("partition"))
    assert [r.failure for r in s.results(stores.Request("bare", stores.KeyQuery("a"), (0,)))] == [stores.DOES_NOT_EXIST]
    assert got(aggregate.list_values(more), "key", "value") == [("a", ["9"]), ("c", ["3", "4"])]
    with pytest.raises(ValueError):
        tables.least_recent_evicted(base, 0)


def test_names_and_options(spark):
    for bad in ("", "a b", "..", "x" * 250):
        with pytest.raises(ValueError):
            dsl.Grouping(bad)
    with pytest.raises(ValueError):
        dsl.Materialized("name")
    df = frame(spark, [("a", "x", -1)])
    with pytest.raises(Exception, match="invalid timestamp"):
        log.Consumed(timestamp=F.col("ts")).read(df).collect()
    with pytest.raises(Exception, match="invalid timestamp"):
        timestamps.fail_on_invalid(df).collect()
    with pytest.raises(Exception, match="cannot process: x"):
        errors.processed(df, lambda v: v.try_cast("long"), "fail")[0].collect()


def murmur_py(data):
    h, m = 0x9747B28C ^ len(data), 0x5BD1E995
    for i in range(0, len(data) // 4 * 4, 4):
        k = int.from_bytes(data[i : i + 4], "little") * m & 0xFFFFFFFF
        h = (h * m & 0xFFFFFFFF) ^ ((k ^ k >> 24) * m & 0xFFFFFFFF)
    if rest := data[len(data) // 4 * 4 :]:
        h = (h ^ int.from_bytes(rest, "little")) * m & 0xFFFFFFFF
    h = (h ^ h >> 13) * m & 0xFFFFFFFF
    return h ^ h >> 15


def test_hash_of_all_lengths(spark):
    texts = ["x" * 0, *("abcdefghijklmnopé"[:n] for n in range(1, 18))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("b", F.encode("t", "UTF-8"))
    assert [r.h for r in df.select(log.murmur2(F.col("b")).alias("h")).collect()] == [murmur_py(t.encode()) for t in texts]


def test_hash_reads_its_bytes_once(spark):
    # what is hashed may itself be dear, so it is named once
    assert str(log.murmur2(F.col("hashed_bytes"))._jc).count("hashed_bytes") == 1
    raw = [None, b"", b"\x00", b"\xff" * 8, bytes(range(256)), b"\x80\x00\xfe"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(raw)], "i int, b binary")
    assert [r.h for r in df.select("i", log.murmur2(F.col("b")).alias("h")).orderBy("i").collect()] == [b if b is None else murmur_py(b) for b in raw]


def test_lists_are_read_once(spark):
    rnd = random.Random(3)
    lists = [[], None, [None], [None, None], [1], [-(2**31), None, 2**31 - 1]] + [[rnd.choice([None, rnd.randrange(-(2**31), 2**31)]) for _ in range(n)] for n in (2, 3, 7, 20, 500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>")
    four = lambda *v: b"".join(n.to_bytes(4, "big", signed=True) for n in v)
    wire = [x if x is None else four(*(len(nulls := [i for i, v in enumerate(x) if v is None]), *nulls, len(x), *(v for v in x if v is not None))) for x in lists]
    coded = df.select("i", codecs.encode_list(F.col("x")).alias("b"))
    assert [r.b if r.b is None else bytes(r.b) for r in coded.orderBy("i").collect()] == wire
    assert [r[0] for r in coded.orderBy("i").select(codecs.decode_list(F.col("b"))).collect()] == lists
    for bad in (b"", four(0), four(0, 2, 5), four(2, 0, 1), four(0, 1, 5)[:-1]):
        with pytest.raises(Exception, match="not 4 bytes"):
            spark.createDataFrame([(bad,)], "b binary").select(codecs.decode_list(F.col("b"))).collect()
    # what is decoded may itself be dear, so it is named once
    assert str(codecs.decode_list(F.col("encoded_bytes"))._jc).count("encoded_bytes") == 1
    ends = spark.createDataFrame([(v,) for v in (2**63 - 1, -(2**63), -1, 0)], "v long")
    assert ends.where(codecs.decode_number(codecs.encode_number(F.col("v"), "long"), "long") != F.col("v")).count() == 0


def test_codecs(spark):
    ids = ["00000000-0000-0000-0000-00000000000a", None]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    assert [r[0] for r in df.select(codecs.decode_uuid(codecs.encode_uuid(F.col("id")))).collect()] == ids
    for bad in (codecs.encode_uuid(F.lit("nope")), codecs.encode_void(F.lit("x"))):
        with pytest.raises(Exception, match="not a UUID|not void"):
            df.select(bad).collect()
    numbers = ["0.00", "1.27", "1.28", "-1.28", "-1.29", "327.67", "-12345678901234.56", None]
    df = spark.createDataFrame([(n,) for n in numbers], "n string").withColumn("d", F.col("n").cast("decimal(18,2)"))
    rows = df.select("n", "d", codecs.decimal_bytes(F.col("d"), 2).alias("b"), codecs.decimal_of_json(codecs.decimal_json(F.col("d"), 2), 2).alias("back"), codecs.decimal_json(F.col("d"), 2, "numeric").alias("text")).collect()
    import base64

    for r in rows:
        assert r.back == r.d and r.text == r.n
        if r.n is not None:
            n = int(r.n.replace(".", ""))
            raw = base64.b64decode(r.b)
            assert int.from_bytes(raw, "big", signed=True) == n and len(raw) == max(1, (n if n >= 0 else ~n).bit_length() // 8 + 1)


def test_lines_of_a_growing_file(spark, tmp_path):
    assert files.lines_of(b"a\nb\r\nc\rd", 10) == ([(12, "a"), (15, "b"), (17, "c")], 17)
    assert files.lines_of(b"a\r", 0) == ([], 0) and files.lines_of(b"a\r", 0, True) == ([(2, "a")], 2)
    assert files.lines_of(b"\n\r\n", 0) == ([(1, ""), (3, "")], 3)
    path, out, checkpoint = tmp_path / "log.txt", str(tmp_path / "out"), str(tmp_path / "cp")
    spark.dataSource.register(files.TailSource)
    tail = lambda: spark.readStream.format("tail").option("path", str(path)).load()
    path.write_bytes(b"one\ntwo\r\nthr")

    def read():
        q = tail().writeStream.foreachBatch(files.exactly_once(out)).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.position, r.value) for r in spark.read.parquet(out).collect())

    assert read() == [(4, "one"), (9, "two")]
    with path.open("ab") as f:
        f.write(b"ee\nfour")
    assert read() == [(4, "one"), (9, "two"), (15, "three")]


def test_formatters(spark):
    df = frame(spark, [("a", "x", 1), ("b", "y", 2)]).withColumn("topic", F.lit("t"))
    assert got(log.console_lines(df, formatter="logging", most=1), "line") == [("t:\tCreateTime:1\ta\tx",)]
    assert log.console_lines(df, formatter="noop").count() == 0
    with pytest.raises(ValueError):
        log.console_lines(df, formatter="nope")
