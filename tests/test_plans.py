"""The fluent API, the graph API, streams and supervised queries."""

import pytest
from pyspark.sql import functions as F

from rivulet.functions import codecs, errors
from rivulet.operators import windows
from rivulet.plans import dsl, topology
from rivulet.sources import log
from rivulet.streaming import processors, run

SCHEMA = "key long, value string, ts long, offset long"


def stream_of(spark, tmp_path, batches):
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return run.read(spark, path, SCHEMA, 1)


def test_topology(spark):
    t = topology.Topology().add_source("in", lambda: spark.range(10).withColumnRenamed("id", "key"))
    t.add_processor("even", lambda df: df.where("key % 2 = 0"), "in").add_processor("sum", lambda a, b: a.union(b), "in", "even")
    t.add_sink("out", lambda df: df.count(), "sum")
    assert t.run() == {"out": [15]}
    assert "Source: in --> even, sum" in t.describe()
    for wrong in (lambda: t.add_source("in", None), lambda: t.add_processor("x", None, "nope"), lambda: t.add_processor("y", None), lambda: t.add_store("s", None, "nope")):
        with pytest.raises(topology.TopologyError):
            wrong()


def test_wrapper_decorates_processors(spark):
    seen = []
    t = topology.Topology(wrapper=lambda name, f: lambda *a, **k: (seen.append(name), f(*a, **k))[1])
    t.add_source("in", lambda: spark.range(3)).add_processor("p", lambda df: df, "in")
    assert t.frame("p").count() == 3 and seen == ["p"]


def test_stream_needs_a_window_to_join(spark):
    s = dsl.stream(spark.createDataFrame([(1, "a", 1, 1)], SCHEMA))
    with pytest.raises(ValueError):
        s.join(s, F.lit(1))
    with pytest.raises(ValueError):
        dsl.table(s.df).suppress_until_close()
    assert s.map(F.lit(2), F.lit("b")).key_changed and not s.map_values(F.lit("b")).key_changed


def test_append_sends_closed_windows_only(spark, tmp_path):
    s = stream_of(spark, tmp_path, [[(1, "a", 1000, 1), (1, "b", 2000, 2)], [(1, "c", 11_000, 3)], [(1, "c", 12_000, 6)], [(1, "d", 1500, 4), (1, "e", 40_000, 5)]])
    out = run.collect(run.windowed(s, windows.TimeWindows(10_000), {"n": F.count(F.lit(1))}), "append").collect()
    assert sorted((r.window_start, r.n) for r in out) == [(0, 2), (10_000, 2)]  # the late record is dropped, the last window stays open


def test_filters_do_not_cut_sessions_of_streams(spark, tmp_path):
    s = stream_of(spark, tmp_path, [[(1, "a", 1000, 1), (1, "b", 1400, 2)], [(1, "c", 1800, 3), (1, "z", -5000, 6), (2, "d", 9000, 4)], [(3, "e", 40_000, 5)]])
    held = run.windowed(s, windows.SessionWindows(500), {"n": F.count(F.lit(1))})
    out = run.collect(held.where("window_end >= 1200 AND window_start <= 1500"), "append").collect()
    assert [(r.key, r.window_start, r.window_end, r.n) for r in out] == [(1, 1000, 1800, 3)]


def test_held_updates_and_punctuation(spark, tmp_path):
    rows = [[(1, "a", 1000, 1), (1, "b", 1005, 2)], [(2, "x", 1100, 3)], [(2, "y", 1105, 4)], [(3, "z", 2000, 5)]]
    s = run.with_time(stream_of(spark, tmp_path, rows), 0)
    with run.rocksdb(spark):
        out = run.collect(processors.held_updates(s, 50)).collect()
    assert {(r.key, r.value) for r in out} >= {(1, "b"), (2, "y")}
    t = run.with_time(stream_of(spark, tmp_path / "p", rows), 0)
    with run.rocksdb(spark):
        ticks = run.collect(processors.punctuated_counts(t, 40)).collect()
    assert any(r.key == 1 and r["count"] == 2 for r in ticks)


def test_exactly_once_batches(spark, tmp_path):
    from rivulet.sources import files

    s = stream_of(spark, tmp_path, [[(1, "a", 0, 1)], [(2, "b", 1, 2)]])
    run.to_batches(s, files.exactly_once(str(tmp_path / "out")), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    tried = []

    def start():
        tried.append(1)
        if len(tried) < 3:
            raise RuntimeError("lost")
        return s.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()

    assert run.supervised(start, lambda e, n: "restart") == 2
    with pytest.raises(RuntimeError):
        run.supervised(lambda: (_ for _ in ()).throw(RuntimeError("x")), lambda e, n: "stop")


def test_delivery_handler(spark):
    def broken(df, batch):
        raise OSError("full")

    errors.delivering(broken, lambda e, i: "continue")(spark.range(1), 0)
    with pytest.raises(OSError):
        errors.delivering(broken, lambda e, i: "fail")(spark.range(1), 0)


def test_generators_and_floats(spark):
    kinds = ("sequential", "constant", "uniform", "gaussian", "timestamped", "null")
    assert {k: log.generate(spark, 20, k).count() for k in kinds} == dict.fromkeys(kinds, 20)
    a, b = (log.generate(spark, 20, "uniform", seed=3).collect() for _ in range(2))
    assert a == b and len({r.value for r in a}) == 20
    df = spark.createDataFrame([(x,) for x in (0.0, -1.5, 1e300, None, float("inf"))], "x double")
    assert [r[0] for r in df.select(codecs.decode_float(codecs.encode_float(F.col("x")))).collect()] == [0.0, -1.5, 1e300, None, float("inf")]
