"""The pipeline's near-dedup against brute-force similarity of five-word shingles."""

import random
import re

import corpus_pipeline as pipeline
import numpy as np
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from rivulet.llm import neardup, simhash

SCHEMA = "doc_id long, text string"


def shingled(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(sets):
    """Smallest position reachable over pairs at 0.8 or more."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            shared = len(a & b)
            if 5 * shared >= 4 * (len(a) + len(b) - shared):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    roots = brute([shingled(r.text) for r in rows])
    want = [r.doc_id for i, r in enumerate(rows) if roots[i] == i]
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()) == want


def varied(r, copies):
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    for _ in range(copies):
        words = list(base)
        for at in r.sample(range(100), r.randint(1, 2)):
            words[at] = f"x{r.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("block", [(1 << 19, 4096), (1000, 4)])
def test_dense_groups_in_blocks(spark, block):
    r = random.Random(7)
    texts = [t for _ in range(4) for t in varied(r, 25)]
    got = {x.doc_id: x.root for x in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA), *block).collect()}
    roots = brute([shingled(t) for t in texts])
    assert 4 < len(set(roots)) < 60
    assert [[got[i] == got[j] for j in got] for i in got] == [[roots[i] == roots[j] for j in got] for i in got]


def test_linked_sets():
    r = np.random.default_rng(1)
    base = [r.choice(400, 60, replace=False) for _ in range(4)]
    sets = [np.unique(np.r_[b[: 60 - k], r.choice(400, k)]).astype(np.uint64) for b in base for k in range(12) for _ in range(3)]
    roots = brute([frozenset(s.tolist()) for s in sets])
    a, b = neardup.linked_sets(sets)
    assert len(a) == len(sets) - len(set(roots)) and all(roots[x] == roots[y] for x, y in zip(a, b, strict=True))


def test_null_and_repeated_ids(spark):
    alike = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, "Abc def"), (None, "ghi jkl"), (None, "mno pqr"), (None, "mno pqr"), (5, "stu vwx"), (5, "other words"), (7, "OTHER  words"), (None, alike), (9, alike), (8, alike + " more")]
    got = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((x.doc_id or 0, x.text) for x in got) == [(0, "Abc def"), (0, "ghi jkl"), (0, "mno pqr"), (5, "other words"), (5, "stu vwx"), (8, alike + " more")]


def test_simhash_proposes(spark):
    """Texts within the radius meet by their fingerprints, whatever their bands; with few shingles only equal ones do."""
    r = random.Random(5)
    base = [r.getrandbits(63) for _ in range(40)]
    fps = {2 * i + k: (b ^ k * sum(1 << at for at in r.sample(range(63), 1 + i % neardup.RADIUS)), 9) for i, b in enumerate(base) for k in (0, 1)}
    fps |= {100: (0b1, 3), 101: (0b11, 3), 102: (0b11, 3)}
    texts = spark.createDataFrame([(i, n, fp) for i, (fp, n) in fps.items()], "node long, n long, fp long")
    bands = spark.createDataFrame([(i, [i]) for i in fps], "node long, bands array<long>")
    got = {tuple(sorted(e)) for e in neardup.proposals(texts, bands).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(40)} | {(101, 102)}


def test_masks_on_parts_cover_every_pair():
    r = random.Random(1)
    for family in range(simhash.FAMILIES):
        ms = [m % 2**64 for m in simhash.masks(neardup.RADIUS, family=family, parts=neardup.PARTS)]
        assert len(ms) == 30 and all(ms)
        for _ in range(3000):
            diff = sum(1 << i for i in r.sample(range(64), r.randint(1, neardup.RADIUS)))
            assert any(diff & m == 0 for m in ms)


def test_sketch_holds_the_fingerprint(spark):
    text = " ".join(f"Word{i % 70}" for i in range(90))
    got = spark.createDataFrame([(text,)], "t string").select(neardup._sketched(F.col("t")).alias("s")).first().s
    hashes = [xxhash.xxh64_intdigest(s, neardup.SEED) for s in shingled(text)]
    assert got.n == len(hashes)
    assert got.fp % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
