"""Fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from conftest import DATA

from rivulet.llm import simhash
from rivulet.llm.common import components


def naive(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    """{id: smallest id reachable} over all pairs."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_masks_cover_every_pair():
    r = random.Random(1)
    for family in range(simhash.FAMILIES):
        ms = [m % 2**64 for m in simhash.masks(family=family)]
        assert len(ms) == 15
        for _ in range(3000):
            diff = sum(1 << i for i in r.sample(range(64), r.randint(1, 3)))
            assert any(diff & m == 0 for m in ms)


@pytest.mark.parametrize("text", ["", None, " \t\n", "one", "ONE two", "a b c", "A b  c\td É x", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == naive(text)


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    fps = {r.doc_id: naive(r.text) for r in docs.collect()}
    want = brute(fps)
    got = {r.doc_id: r for r in simhash.op2_simhash(spark, f"{DATA}/sf0.001").collect()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == fps
    assert {k: r.component_id for k, r in got.items()} == want


@pytest.mark.parametrize("block", [2, 7, 2048])
def test_dense_groups_in_blocks(spark, block):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = {(b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 3)))) for b in base for _ in range(25)} | {r.getrandbits(64) for _ in range(50)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    edges = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), block=block)
    pairs = edges.collect()
    assert all(bin((a ^ b) % 2**64).count("1") <= 3 for a, b in pairs)
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    want = brute({f: f % 2**64 for f in signed})
    assert {f: got.get(f, f) for f in signed} == want


def test_a_crowded_bucket_is_split(spark):
    """5,000 fingerprints that agree under one mask: over the default block in its bucket."""
    r = random.Random(11)
    free = [i for i in range(64) if not simhash.masks()[0] >> i & 1]
    base = [sum(1 << i for i in free if r.random() < 0.5) for _ in range(4600)]
    fps = {*base, *(b ^ 1 << r.choice(free) for b in base[:400])}
    masked = {}
    for f in fps:
        for t, m in enumerate(simhash.masks()):
            masked.setdefault((t, f & m % 2**64), set()).add(f)
    assert max(map(len, masked.values())) > simhash.BLOCK
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    edges = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {x.node: x.root for x in components(edges, "a", "b").collect()}
    arr = np.array(signed, dtype=np.int64)
    root = {f: f for f in signed}
    a, b = simhash.linked(np.sort(arr))  # all in one piece
    for x, y in zip(a.tolist(), b.tolist(), strict=True):  # breadth-first: x has its root already
        root[y] = root[x]
    assert {f: got.get(f, f) for f in signed} == root


def made(df):
    """Rows made by the joins and generators of a query that has run, by node; with adaptive execution."""
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.nodeName()
        below = node.children()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else []
        todo += inner or [below.apply(i) for i in range(below.size())]
        if "Join" in name or name.startswith("Generate"):
            out.append(node.metrics().get("numOutputRows").get().value())
    return out


def test_rows_grow_with_the_fingerprints(spark):
    """Masks on parts: five times the fingerprints make five times the rows in every node, though short keys meet by chance."""
    r = np.random.default_rng(4)
    fps = np.unique(r.integers(-(2**63), 2**63, 30_000))
    fps[1::50] = fps[::50] ^ (np.int64(0b1111111) << r.integers(0, 57, 600))
    rows = []
    for n in (6_000, 30_000):
        edges = simhash.link_fingerprints(spark.createDataFrame([(int(f),) for f in fps[:n]], "fp long"), 7, parts=2)
        got = {frozenset(e) for e in edges.collect()}
        assert got == {frozenset((int(a), int(b))) for a, b in zip(fps[:n:50], fps[1:n:50], strict=True)}
        rows.append(sorted(made(edges)))
    assert rows[0] and all(b <= 5.5 * a for a, b in zip(*rows, strict=True))


@pytest.mark.parametrize("block", [3, 12, 64])
def test_masks_on_parts_in_blocks(spark, block):
    """Crowded buckets of short keys are split or dealt out as pairs of blocks, the others compared as they are."""
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(25)} | {r.getrandbits(64) for _ in range(100)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    root = {f: f for f in signed}
    a, b = simhash.linked(np.array(signed, dtype=np.int64), 7)  # all in one piece
    for x, y in zip(a.tolist(), b.tolist(), strict=True):  # breadth-first: x has its root already
        root[y] = root[x]
    for families in (1, 2):
        edges = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), 7, block, families, parts=2)
        assert all(bin((x ^ y) % 2**64).count("1") <= 7 for x, y in edges.collect())
        got = {x.node: x.root for x in components(edges, "a", "b").collect()}
        least = {}
        for f, c in root.items():
            least[c] = min(least.get(c, f), f)
        assert {f: got.get(f, f) for f in signed} == {f: least[c] for f, c in root.items()}


def test_a_dense_group_takes_rows_in_proportion(spark):
    """One group of near fingerprints, five times as large, makes five times the rows, and keeps those that hang on its rim."""
    r = random.Random(9)
    middle = r.getrandbits(64)
    rows = []
    for n in (400, 2000):
        fps = sorted({middle ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 4))) for _ in range(n)})
        rim = [f ^ sum(1 << i for i in r.sample([i for i in range(64) if not (f ^ middle) >> i & 1], 7)) for f in fps[:: n // 8]]
        far = [f ^ 0b1111111 << r.randrange(57) for f in rim]
        signed = [f - 2**64 if f >> 63 else f for f in {*fps, *rim, *far, *(r.getrandbits(64) for _ in range(20))}]
        edges = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), 7, 64, parts=2)
        assert all(bin((a ^ b) % 2**64).count("1") <= 7 for a, b in edges.collect())
        root = {f: f for f in signed}
        a, b = simhash.linked(np.array(signed, dtype=np.int64), 7)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            root[y] = root[x]
        got = {x.node: x.root for x in components(edges, "a", "b").collect()}
        assert len({(root[f], got.get(f, f)) for f in signed}) == len(set(root.values())) == len({got.get(f, f) for f in signed})
        rows.append(sum(made(edges)))
    assert 0 < rows[1] <= 6 * rows[0]


def test_buckets_are_searched_alike():
    """Sizes about SEARCHED: the same links as walking each bucket by itself."""
    r = np.random.default_rng(6)
    sizes = [1, 2, 1, 40, simhash.SEARCHED, simhash.SEARCHED + 1, 3]
    starts = np.r_[0, np.cumsum(sizes)]
    fps = r.integers(-(2**63), 2**63, starts[-1])
    for at in (1, 5, 60, 300, 301, 555):
        fps[at + 1] = fps[at] ^ 5
    edges = simhash._edges(fps, starts, 3)
    want = [simhash.linked(fps[a:b], 3) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert len(edges) == sum(len(x[0]) for x in want) >= 5
    assert {frozenset(e) for e in edges.itertuples(index=False)} == {frozenset(e) for x in want for e in zip(*x, strict=True)}


def test_components(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(r.randrange(5000, 5400), r.randrange(5000, 5400)) for _ in range(200)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: y for x, y in root.items() if x in got} and all(x in got or x == y for x, y in root.items())
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_edges(spark):
    schema = "doc_id long, text string, fp string, component_id string"
    rows = [(5, None, "x", "x"), (3, "", "x", "x"), (4, "a b c d", "x", "x"), (9, "A B C D", "x", "x"), (9, "A B C D", "x", "x"), (None, "a b c d", "x", "x"), (None, "zz yy xx", "x", "x"), (1, "w " * 300_000, "x", "x")]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    zero = "0" * 16
    assert got[(5, zero)] == got[(3, zero)] == 3
    assert {v for (d, _), v in got.items() if d in (4, 9)} == {4}
    assert sorted(v is None for (d, _), v in got.items() if d is None) == [False, True]
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_linked_is_a_forest():
    near = [0, 1, 3, 7, 1 << 40, (1 << 40) | 1, -(2**63)]
    fps = np.array([*near, 0x0F0F0F0F0F0F0F0F, -1, -8], dtype=np.int64)
    a, b = simhash.linked(fps)
    assert len(a) == len(near) - 1 + 1 and {*a, *b} == {*near, -1, -8}
