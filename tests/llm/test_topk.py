"""Exact search against brute force."""

import math
import random

import pytest
from conftest import DATA, rows_of

from rivulet.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def brute(rows, k):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    q = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if ok(v)]
    out, seen = [], set()
    for qi, qv in q:
        if qi is None or qi % 50 or (qi, tuple(qv)) in seen:
            continue
        seen.add((qi, tuple(qv)))
        found = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in q if i is not None and i != qi and len(v) == len(qv))[:k]
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), k).collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_embeddings(spark, oracle, sf):
    assert rows_of(topk.op4_topk(spark, f"{DATA}/{sf}")) == oracle(sf, topk.ORACLE)


def test_ties_and_blocks(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], "x", "x") for i in range(400)] + [(1000 + i, [1.0, 1.0, 1.0], "x", "x") for i in range(300)]
    want = brute(rows, 5)
    assert run(spark, rows) == want
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(topk, "SCORES", 50)
    assert run(spark, rows) == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "x", "x"), (50, [1.0, nan], "x", "x"), (100, None, "x", "x"), (150, [], "x", "x"), (200, [1.0], "x", "x"), (None, [1.0, 1.0], "x", "x"), (1, [inf, 1.0], "x", "x"), (2, [None, 1.0], "x", "x"), (3, [-0.001, 0.5], "x", "x"), (3, [-0.001, 0.5], "x", "x"), (4, [1e6, -1e6], "x", "x")]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, rows, 2) == brute(rows, 2)
    assert run(spark, []) == []
