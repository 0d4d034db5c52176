"""License scans against brute force."""

import random

from conftest import DATA, rows_of

from rivulet.llm import licenses

SCHEMA = "doc_id long, text string, labels string, template string"
BASE = ("n_words", "n_base", "first_word", "last_word", "base_labels")


def test_documents_agree_with_sql(spark, oracle):
    assert rows_of(licenses.op10_licenses(spark, f"{DATA}/sf0.01")) == oracle("sf0.01", licenses.ORACLE)


def test_documents(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    rows = licenses.op10_licenses(spark, f"{DATA}/sf0.01").collect()
    assert len(rows) == len(text)
    for r in rows:
        assert tuple(r[c] for c in BASE) == licenses.base_py(text[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert any("gpl-3.0" in r.labels for r in rows) and any("apache-2.0" in r.labels for r in rows)


def one(spark, *texts):
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(texts)], SCHEMA)
    return [r for r in licenses.scan(df).orderBy("doc_id").collect()]


def test_labels_of_the_method(spark):
    mit = licenses.TEXTS["mit-text"].split()
    altered = " ".join([*mit[:20], "and", "its", "parts", *mit[20:40], *mit[42:]])
    r = one(spark, " ".join(mit).upper(), altered, " ".join(mit[:25]), "GNU General Public License, version 3", "CC BY-NC 4.0 and cc-by", "the software")
    assert r[0].labels == "mit-text" and r[0].score == 1
    assert r[1].labels == "mit-text" and 0.8 <= r[1].score < 1
    assert r[2].labels == "" and 0 < r[2].score < 0.8
    assert (r[3].labels, r[3].base_labels, r[3].n_base) == ("gpl,gpl-3.0", "gpl", 1)
    assert (r[4].labels, r[4].n_base, r[4].first_word, r[4].last_word) == ("cc-by,cc-by-nc-4.0", 2, 0, 6)
    assert r[5].labels == "" and r[5].n_base == 0


def test_spans_are_verified_in_order_and_extent(spark):
    mit, bsd = licenses.TEXTS["mit-text"].split(), licenses.TEXTS["bsd-text"].split()
    pairs = [p for p in zip(mit[:-1], mit[1:], strict=True)]
    r = random.Random(3)
    mixed = r.sample(pairs, len(pairs))
    filler = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(n))
    texts = {
        "scrambled": " ".join(f"{a} {b}" for a, b in mixed),
        "reversed": " ".join(f"{a} {b}" for a, b in reversed(pairs)),
        "stretched": " ".join(f"{a} {b} {filler(6)}" for a, b in pairs),
        "with a footer": " ".join([*mit[:34], filler(25), *mit[34:]]),
        "late and twice": " ".join([filler(5000), *bsd, filler(300), *mit, filler(40), *bsd]),
        "in pieces far apart": " ".join([*mit[:34], filler(400), *mit[34:]]),
    }
    got = dict(zip(texts, one(spark, *texts.values()), strict=True))
    for name in ("scrambled", "reversed", "stretched", "in pieces far apart"):
        assert "mit-text" not in got[name].labels and got[name].score < 0.8, name
    assert got["with a footer"].labels == "mit-text" and got["with a footer"].score > 0.95
    assert got["late and twice"].labels == "bsd-text,mit-text" and got["late and twice"].score == 1


def test_longest_chain_against_brute_force():
    r = random.Random(8)
    for _ in range(300):
        hits = sorted({(r.randrange(40), r.randrange(8)) for _ in range(r.randrange(25))})
        reach, best = r.randrange(1, 30), {}
        for i, (at, place) in enumerate(hits):  # by first hit of the chain
            best[i, i] = 1
            for f in range(i):
                longest = max((n for (g, e), n in best.items() if g == f and hits[e][0] < at and hits[e][1] < place), default=0)
                if longest and at - hits[f][0] < reach:
                    best[f, i] = longest + 1
        diagonals = {}
        for at, place in hits:
            diagonals.setdefault(at - place, []).append(place)
        assert list(licenses.in_text_order(sorted(diagonals.items()))) == hits
        assert licenses.longest_chain(hits, reach) == max(best.values(), default=0)


def test_edges(spark):
    texts = [None, "", "mit", "MIT License", "mit license", "mit license " * 3, "cc by " * 40_000]
    for r, t in zip(one(spark, *texts), texts, strict=True):
        assert tuple(r[c] for c in BASE) == licenses.base_py(t)
    rows = [(None, "mit license", "x", "x"), (None, "apache license", "x", "x"), (1, "cc by", "x", "x"), (1, "cc by", "x", "x"), (1, "none", "x", "x")]
    got = sorted((r.doc_id is None, r.labels) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, ""), (False, "cc-by"), (False, "cc-by"), (True, "apache"), (True, "mit")]
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
