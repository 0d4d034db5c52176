"""Golden cases and properties of the operators."""

import pytest
from pyspark.sql import functions as F

from rivulet.functions import codecs, fieldpath, timestamps
from rivulet.functions import transforms as smt
from rivulet.operators import aggregate, joins, stateless, tables, windows
from rivulet.plans import dsl, stores
from rivulet.record import duration
from rivulet.sources import files, log


def frame(spark, rows, schema="key string, value string, ts long"):
    wide = [(*r, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(wide, schema + ", offset long")


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_window_arithmetic():
    assert windows.TimeWindows(12, 5).windows_for(21) == [(10, 22), (15, 27), (20, 32)]
    assert windows.TimeWindows(6, 5).windows_for(7) == [(5, 11)]
    assert windows.TimeWindows(12).windows_for(21) == [(12, 24)]
    assert windows.TimeWindows(12, 5).windows_for(0) == [(0, 12)]
    for bad in ((0,), (5, 6), (5, 5, -1)):
        with pytest.raises(ValueError):
            windows.TimeWindows(*bad)
    for kind, bad in ((windows.SlidingWindows, -1), (windows.SessionWindows, 0), (windows.UnlimitedWindows, -1)):
        with pytest.raises(ValueError):
            kind(bad)
    joins.JoinWindows(-5, 5)
    with pytest.raises(ValueError):
        joins.JoinWindows(-6, 5)
    assert duration("2 hours") == 7_200_000


def test_assign_is_windows_for(spark):
    df = spark.range(0, 40).select(F.col("id").alias("ts"))
    for w in (windows.TimeWindows(12, 5), windows.TimeWindows(7), windows.TimeWindows(6, 5)):
        want = sorted((ts, *x) for ts in range(40) for x in w.windows_for(ts))
        assert got(w.assign(df), "ts", "window_start", "window_end") == sorted(want, key=repr)


def test_sliding_documented_example(spark):
    df = frame(spark, [("A", "1", 8000), ("A", "2", 9200), ("A", "3", 12400)])
    out = windows.windowed(df, windows.SlidingWindows(5000), {"v": F.array_join(F.array_sort(F.collect_list("value")), ",")})
    assert got(out, "window_start", "window_end", "v") == sorted([(3000, 8000, "1"), (4200, 9200, "1,2"), (7400, 12400, "1,2,3"), (8001, 13001, "2,3"), (9201, 14201, "3")], key=repr)


def test_sessions(spark):
    one = windows.windowed(frame(spark, [("A", "x", 10), ("A", "x", 12), ("A", "x", 20)]), windows.SessionWindows(5), {"n": F.count(F.lit(1))})
    assert got(one, "window_start", "window_end", "n") == [(10, 12, 2), (20, 20, 1)]
    merged = windows.windowed(frame(spark, [("A", "x", 10), ("A", "x", 12), ("A", "x", 20), ("A", "x", 16)]), windows.SessionWindows(5), {"n": F.count(F.lit(1))})
    assert got(merged, "window_start", "window_end", "n") == [(10, 20, 4)]


def test_filters_do_not_cut_sessions(spark):
    """Of a session that holds 10, 14 and 18 a filter on its ends keeps all or nothing."""
    s = windows.windowed(frame(spark, [("A", "x", 10), ("A", "x", 14), ("A", "x", 18), ("A", "x", 40), ("B", "x", 12)]), windows.SessionWindows(5), {"n": F.count(F.lit(1))})
    assert got(stores.sessions_of(s, "A", 12, 15), "window_start", "window_end", "n") == [(10, 18, 3)]
    assert got(s.where("window_start >= 12"), "key", "window_start", "n") == [("A", 40, 1), ("B", 12, 1)]
    assert got(s.where("window_end <= 14"), "key", "window_end", "n") == [("B", 12, 1)]


def test_null_rules(spark):
    df = frame(spark, [("a", "x", 1), (None, "x", 1), ("a", None, 2)])
    assert got(aggregate.count(df), "key", "count") == [("a", 1)]
    assert got(windows.windowed(df, windows.TimeWindows(10), {"n": F.count(F.lit(1))}), "key", "n") == [("a", 2)]
    assert stateless.keep_not(df, F.col("value") == "x").count() == 1


def test_branches(spark):
    df = frame(spark, [(str(i), f"V{i}", 0) for i in range(-1, 8)]).withColumn("n", F.col("key").cast("int"))
    b = stateless.Branches(df).branch(F.col("n") % 2 == 0, "x2").branch(F.col("n") % 3 == 0, "x3").branch(F.col("n") % 5 == 0, "x5").no_default()
    assert {k: [r[0] for r in got(v, "value")] for k, v in b.items()} == {"x2": ["V0", "V2", "V4", "V6"], "x3": ["V3"], "x5": ["V5"]}
    names = stateless.Branches(df, "foo-").branch(F.lit(True), "bar").branch(F.lit(True), consumer=lambda x: None).branch(F.lit(True), function=lambda x: None).branch(F.lit(True), function=lambda x: x).default()
    assert sorted(names) == ["foo-0", "foo-4", "foo-bar"]


def test_clicks_per_region(spark):
    clicks = frame(spark, [("alice", 13, 1), ("bob", 4, 1), ("chao", 25, 1), ("bob", 19, 1), ("dave", 56, 1), ("eve", 78, 1), ("alice", 40, 1), ("fang", 99, 1)], "key string, value long, ts long")
    regions = frame(spark, [("alice", "asia", 0), ("bob", "americas", 0), ("chao", "asia", 0), ("dave", "europe", 0), ("alice", "europe", 0), ("eve", "americas", 0), ("fang", "asia", 0)])
    joined = dsl.stream(clicks).join(dsl.table(regions), F.struct(F.coalesce("table_value", F.lit("UNKNOWN")).alias("region"), "value"), "left")
    out = joined.map(F.col("value.region"), F.col("value.value")).group_by_key().aggregate(total=F.sum("value"))
    assert got(out.df, "key", "total") == [("americas", 101), ("asia", 124), ("europe", 109)]


def test_stream_joins(spark):
    left, right = frame(spark, [("a", "l1", 10), (None, "l2", 11), ("b", "l3", 50)]), frame(spark, [("a", "r1", 12), ("b", "r2", 90), (None, "r3", 1)])
    text = F.concat_ws("|", F.coalesce("value", F.lit("null")), F.coalesce("right_value", F.lit("null")))
    w = joins.JoinWindows.of(5)
    assert got(joins.stream_stream(left, right, w, text), "value", "ts") == [("l1|r1", 12)]
    assert [r[0] for r in got(joins.stream_stream(left, right, w, text, "left"), "value")] == ["l1|r1", "l2|null", "l3|null"]
    assert [r[0] for r in got(joins.stream_stream(left, right, w, text, "outer"), "value")] == ["l1|r1", "l2|null", "l3|null", "null|r2", "null|r3"]
    own = frame(spark, [("1", "A", 42), ("1", "B", 43)])
    assert got(joins.stream_stream(own, own, joins.JoinWindows.of("100 minutes"), F.concat("value", "right_value")), "value", "ts") == [("AA", 42), ("AB", 43), ("BA", 43), ("BB", 43)]


@pytest.mark.parametrize("before,after", [(0, 0), (3, 7), (7, -2), (-2, 7)])
def test_interval_join_is_brute_force(spark, before, after):
    rows = [(str(i % 3), f"v{i}", (i * 37) % 50) for i in range(60)]
    l, r = frame(spark, rows[:30]), frame(spark, rows[30:])  # noqa: E741
    want = sorted((f"{a[1]}{b[1]}", max(a[2], b[2])) for a in rows[:30] for b in rows[30:] if a[0] == b[0] and a[2] - before <= b[2] <= a[2] + after)
    assert got(joins.stream_stream(l, r, joins.JoinWindows(before, after), F.concat("value", "right_value")), "value", "ts") == want


def test_as_of_and_versions(spark):
    updates = frame(spark, [("a", "v1", 10), ("a", "v2", 20), ("a", None, 30), ("a", "v4", 40), ("a", "v4b", 40)])
    stream = frame(spark, [("a", "s", t) for t in (5, 10, 25, 30, 45)] + [(None, "s", 1)])
    out = joins.stream_as_of(stream, updates, F.coalesce("table_value", F.lit("-")), "left")
    assert got(out, "ts", "value") == sorted([(5, "-"), (10, "v1"), (25, "v2"), (30, "-"), (45, "v4b"), (1, "-")], key=repr)
    assert got(joins.stream_as_of(stream, updates, F.col("table_value")), "ts", "value") == [(10, "v1"), (25, "v2"), (45, "v4b")]
    v = tables.versions(updates)
    assert got(v, "valid_from", "valid_to", "value") == [(10, 20, "v1"), (20, 30, "v2"), (40, None, "v4b")]
    s = stores.Stores()
    s.add("v", v, stores.Position({"t": {0: 4}}))
    assert s.run(stores.Request("v", stores.VersionedKeyQuery("a", 25))).first()["value"] == "v2"
    with pytest.raises(stores.NotUpToBound):
        s.run(stores.Request("v", stores.VersionedKeyQuery("a"), bound=stores.Position({"t": {0: 5}})))


def test_tables(spark):
    t = frame(spark, [("a", "1", 5), ("b", "2", 6), ("a", "3", 1), ("b", None, 7), (None, "4", 8)])
    assert got(tables.latest(t), "key", "value") == [("a", "3")]
    assert got(tables.latest(t, tombstones=True), "key", "value") == [("a", "3"), ("b", None)]
    assert got(tables.compact(t, keep_tombstones_after=7), "key", "value") == [("a", "3"), ("b", None)]
    assert got(tables.compact(t, keep_tombstones_after=8), "key", "value") == [("a", "3")]


def test_late_records_and_suppression(spark):
    df = frame(spark, [("a", "1", 5), ("a", "2", 30), ("a", "3", 7), ("a", "4", 21)]).withColumn("partition", F.lit(0))
    kept = windows.drop_late(df, windows.TimeWindows(10, grace=5))
    assert [r[0] for r in got(kept, "value")] == ["1", "2", "4"]
    few = [windows.drop_late(df, windows.TimeWindows(10, grace=g)).count() for g in (0, 5, 20, 50)]
    assert few == sorted(few)
    held = windows.suppress_until_limit(frame(spark, [("a", "1", 0), ("a", "2", 5), ("a", "3", 10), ("a", "4", 11)]), 10)
    assert got(held, "held_from", "value") == [(0, "2"), (10, "4")]
    early = windows.suppress_records(frame(spark, [("a", "1", 0), ("b", "1", 1), ("a", "2", 2), ("c", "1", 3)]), 2)
    assert got(early, "key", "value") == [("a", "2")]
    with pytest.raises(ValueError):
        dsl.stream(df).group_by_key().windowed_by(windows.UnlimitedWindows()).emit_on_close()


def test_folds_and_signed_sums(spark):
    df = frame(spark, [("a", "x", 1), ("b", "q", 1), ("a", "y", 1), ("a", "z", 1)])
    assert got(aggregate.fold(df, F.lit(""), lambda a, v: F.concat(a, v)), "key", "value") == [("a", "xyz"), ("b", "q")]
    assert got(aggregate.reduce(df, lambda a, v: F.concat(v, a)), "key", "value") == [("a", "zyx"), ("b", "q")]
    rows = tables.signed(tables.changes(df), F.col("value"), F.lit(1))
    assert got(tables.aggregate_signed(rows, {"n": F.lit(1)}), "key") == [("q",), ("z",)]


def test_field_paths():
    assert fieldpath.parse("a.b") == ["a.b"]
    assert fieldpath.parse("a.b", "V2") == ["a", "b"]
    assert fieldpath.parse("`a.b`.c", "V2") == ["a.b", "c"]
    assert fieldpath.parse("`a\\`.b`", "V2") == ["a`.b"]
    with pytest.raises(ValueError):
        fieldpath.parse("`a.b", "V2")


def test_record_transforms(spark):
    df = spark.createDataFrame([("test", 0, 1, 789, None, 42, (42, "x"))], "topic string, partition int, offset long, ts long, headers array<struct<key: string, value: binary>>, key long, value struct<magic: long, note: string>")
    out = smt.insert_field(topic="topic_field", partition="p", timestamp="t", static=("instance", "my-instance-id"))(df).first()["value"]
    assert (out["magic"], out["topic_field"], out["p"], out["t"], out["instance"]) == (42, "test", 0, 789, "my-instance-id")
    none = df.withColumn("value", F.lit(None).cast(df.schema["value"].dataType))
    assert smt.insert_field(topic="x")(none).first()["value"] is None
    assert smt.hoist("magic", "key")(df).first()["key"]["magic"] == 42
    assert smt.extract_field("magic")(df).first()["value"] == 42
    nested = df.withColumn("key", F.struct(F.struct(F.lit(42).alias("foo")).alias("magic")))
    assert smt.extract_field("magic.foo", "key", "V2")(nested).first()["key"] == 42
    with pytest.raises(ValueError, match="Unknown field: magic.nonexistent"):
        smt.extract_field("magic.nonexistent", "key", "V2")(nested)
    route = lambda t: smt.regex_router(r"(.*)-(\d{8})", "$1")(df.withColumn("topic", F.lit(t))).first()["topic"]
    assert (route("index-20160117"), route("foo")) == ("index", "foo")
    assert smt.timestamp_router()(df.withColumn("ts", F.lit(1483425001864))).first()["topic"] == "test-20170103"
    assert smt.value_to_key(["magic"])(df).first()["key"].asDict() == {"magic": 42}
    with pytest.raises(ValueError):
        smt.value_to_key(["nope"])(df)
    assert smt.mask(["magic", "note"])(df).first()["value"].asDict() == {"magic": 0, "note": ""}
    assert smt.mask(["magic"], "7")(df).first()["value"]["magic"] == 7
    with pytest.raises(ValueError):
        smt.header_from(["a"], ["b", "c"])
    with pytest.raises(ValueError):
        smt.set_schema_metadata()


def test_codecs(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, -1, 32767, -32768, None)], "v long")
    for kind in ("short", "int", "long"):
        assert got(df.select("v", codecs.decode_number(codecs.encode_number(F.col("v"), kind), kind).cast("long").alias("w")).where("NOT v <=> w"), "v") == []
    assert [bytes(r[0]) for r in df.where("v = -1").select(codecs.encode_number(F.col("v"), "short")).collect()] == [b"\xff\xff"]
    lists = spark.createDataFrame([([1, None, -3],), ([],), (None,), ([None],)], "x array<int>")
    assert [r[0] for r in lists.select(codecs.decode_list(codecs.encode_list(F.col("x")))).collect()] == [[1, None, -3], [], None, [None]]
    kind = spark.createDataFrame([], "a struct<i: int, d: date, m: map<string, long>, l: array<double>>").schema["a"].dataType
    assert codecs.spark_type(codecs.envelope_schema(kind)).simpleString() == kind.simpleString()
    with pytest.raises(codecs.ProjectionError):
        codecs.project(F.lit(1), spark.range(1).schema["id"].dataType, spark.sql("select 1 as i").schema["i"].dataType)


def test_times_and_lines(spark, tmp_path):
    df = frame(spark, [("a", "x", -1), ("a", "y", 5)]).withColumn("partition", F.lit(0))
    assert timestamps.skip_invalid(df).count() == 1
    with pytest.raises(Exception, match="invalid timestamp"):
        timestamps.fail_on_invalid(df).collect()
    lines = spark.createDataFrame([("h:1,g:2\tk\tv\tw",)], "value string")
    r = log.parse_lines(lines).first()
    assert ([h["key"] for h in r["headers"]], r["key"], r["value"]) == (["h", "g"], "k", "v\tw")
    (tmp_path / "t.txt").write_bytes(b"a\nb\r\nc\n")
    assert [r[0] for r in files.read_lines(spark, str(tmp_path / "t.txt")).collect()] == ["a", "b", "c"]
    sink = files.exactly_once(str(tmp_path / "out"))
    sink(spark.range(3), 1)
    sink(spark.range(3), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_plans_push_filters_down(spark):
    from conftest import DATA
    from rivulet.queries import QUERIES

    text = QUERIES["reduce_max"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "partial_max" in text
    read = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "user_id" in read and "props" not in read
