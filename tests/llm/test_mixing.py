"""The mix against its definition, brute force and SQL."""

import re
from collections import defaultdict

import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from rivulet.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, taken int"


def check(rows, weights=mixing.WEIGHTS):
    """Every property of the contract, from the result rows alone and a plain water-filling."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, want = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total > 2 * sizes[s]]
        for s in full or open_.copy():
            want[s] = 2.0 * sizes[s] if full else left * w[s] / total
        open_ -= set(full) if full else open_
        left -= sum(2.0 * sizes[s] for s in full)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents(spark, oracle, sf):
    df = mixing.op1_mixing(spark, f"{DATA}/{sf}")
    assert rows_of(df) == oracle(sf, mixing.ORACLE)
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet")
    got = mixing.mix(docs).collect()
    check(got)
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert all(r["size"] == size[r["doc_id"]] for r in got)


def test_edges(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 4}", "x", 0) for i in range(200)]
    rows += [(None, "a b", None, "x", 0), (7, None, "s0", "x", 0), (8, "", "empty", "x", 0), (9, "one " * 50_000, "s1", "x", 0)] + [(5, "a b c", "s2", "x", 0)] * 3
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    check(out)
    assert len({(r["doc_id"], r["size"], r["taken"]) for r in out if r["doc_id"] == 5 and r["size"] == 3}) == 1
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_apply_repeats_rows_as_planned(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").withColumn("size", F.lit("clash"))
    times = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix(docs).where("size > 0").collect()}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in times.items() if v}


def test_nested_budgets(spark):
    rows = spark.range(2000).select(F.lit("=a").alias("source_key"), (F.col("id") % 9 + 1).alias("size"), mixing.row_hash(F.col("id")).alias("hash"))
    cuts = mixing.cutoffs(rows, spark.createDataFrame([("=a", float(b)) for b in (10, 100, 5000, 9000)], "source_key string, budget double")).orderBy("budget").collect()
    assert [c["cut"] for c in cuts] == sorted(c["cut"] for c in cuts)
    for c in cuts:
        assert abs(rows.where(F.col("hash") <= c["cut"]).agg(F.sum("size")).first()[0] - c["budget"]) <= 5
