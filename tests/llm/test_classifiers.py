"""Language ID and quality: held-out accuracy, what may be learned from, edges."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from rivulet.llm import langid, quality, sampling

D = f"{DATA}/sf0.01"


def test_folds(spark):
    rows = spark.createDataFrame([(i,) for i in [None, *range(-5, 300)]], "doc_id long").select("doc_id", sampling.held_out(F.col("doc_id")).alias("h"), sampling.learnable(F.col("doc_id")).alias("l")).collect()
    for r in rows:
        out = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        assert (r.h, r.l) == (out, r.doc_id is not None and not out)


def test_sample_is_bounded_and_whole_if_small(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "rare").otherwise("often").alias("lang"))
    n = {r["lang"]: r["count"] for r in sampling.bounded_sample(rows, "lang", "doc_id", 200).groupBy("lang").count().collect()}
    assert n == {"rare": 30, "often": 100}
    many = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 1500).cast("string").alias("lang")).unionByName(spark.createDataFrame([(-1, None)], "doc_id long, lang string"))
    assert sampling.bounded_sample(many, "lang", "doc_id", 200).count() == 200
    assert sampling.bounded_sample(many.where("false"), "lang", "doc_id", 200).count() == 0


def grams(text):
    """{feature: how often} of a text's n-grams, written down apart from the operator."""
    line = " " + re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0].isalpha() else " ", (text or "").lower(), flags=re.DOTALL).strip() + " "
    line = " " + " ".join(line.split()) + " " if line.strip() else ""
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            h = 0
            for c in line[i : i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (ord(c) * 0x9E3779B1 & 0xFFFFFFFF)
            out[(h * 0x85EBCA6B + n & 0xFFFFFFFF) >> 16] += 1
    return out


@pytest.mark.parametrize("text", ["a", "Ab, c", "Été 24 à l'eau", "  x  y!  ", "12 !?", "", None, "ß ñ 漢字 Ω", "one two " * 300])
def test_ngrams(text):
    features, times = langid.counts(text)
    assert dict(zip(features.tolist(), times.tolist(), strict=True)) == grams(text)


def test_query_against_brute_force(spark):
    """Frequencies of all learnable documents and each prediction, by dictionaries."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model, rows = langid.fit(docs), docs.collect()
    learned = [grams(r.text) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None]
    df = Counter(f for g in learned for f in g)
    for f in [*df, 0, 77]:
        assert model.idf[f] == pytest.approx(math.log((1 + len(learned)) / (1 + df[f])) + 1, rel=1e-5)
    got = {r.doc_id: r for r in langid.op3_langid(spark, f"{DATA}/sf0.001").collect()}
    for r in rows:
        x = {f: (1 + math.log(n)) * model.idf[f] for f, n in grams(r.text).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        scores = [(float(model.weights[langid.FEATURES][k]) + sum(v / size * float(model.weights[f][k]) for f, v in x.items())) / model.heat for k in range(len(model.languages))]
        p = [math.exp(s - max(scores)) for s in scores]
        best = max(range(len(p)), key=lambda k: p[k])
        assert got[r.doc_id].lang_pred == (model.languages[best] if x else "und")
        assert got[r.doc_id].score == pytest.approx(p[best] / sum(p) if x else 0.0, abs=1e-4)


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = langid.op3_langid(spark, D).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_labels_of_held_out_rows_are_not_seen(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    other = docs.withColumn("lang", F.when(sampling.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted(langid.identify(x).collect()) for x in (docs, other))
    assert a == b


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score string, lang_pred string"
    rows = [(i, "el la de los que" if i % 2 else "the of and to in", "es" if i % 2 else "en", "x", "x") for i in range(60)]
    rows += [(None, "the of", None, "x", "x"), (100, None, "en", "x", "x"), (101, "", None, "x", "x"), (102, "12 !?", "en", "x", "x"), (103, "the " * 300_000, None, "x", "x"), (1, "el la", "es", "x", "x")]
    df = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert (got[103].lang_pred, got[None].lang_pred, got[None].held_out) == ("en", "en", False)
    assert langid.predict(df, langid.fit(df)).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert langid.identify(df.where("false")).count() == 0
    nothing = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and {r.score for r in nothing} == {0.0}


def test_quality_held_out(spark):
    got = quality.op7_quality(spark, D).join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    clean = [r for r in got if r.quality == 1]
    assert np.mean([r.predicted for r in clean]) > 0.95


def plain_score(net, text):
    """The network's probability by loops over chunks, places and filters, written down apart from the operator."""
    data = list((text or "").encode())
    data += [quality.PAD] * (2 * quality.HALF - len(data))
    best = [-math.inf] * quality.FILTERS
    for chunk in range(0, max(1, len(data) - quality.HALF), quality.HALF):
        for place in range(chunk, min(chunk + 2 * quality.HALF, len(data)), quality.STRIDE):
            under = [data[i] if i < len(data) else quality.PAD for i in range(place, place + quality.WIDTH)]
            answer = np.concatenate([net.p["embed"][b] for b in under]) @ net.p["filters"]
            best = [max(a, float(b)) for a, b in zip(best, answer, strict=True)]
    logit = sum(math.tanh(b + float(net.p["bias"][f])) * float(net.p["out"][f]) for f, b in enumerate(best)) + float(net.p["end"][0]) + net.prior
    return 1 / (1 + math.exp(-logit))


def test_scores_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    net = quality.fit(docs, spark.read.parquet(f"{DATA}/sf0.001/labels.parquet"))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = quality.op7_quality(spark, f"{DATA}/sf0.001").collect()
    assert len(got) == len(text) and any(r.predicted == 0 for r in got)
    for r in sorted(got)[:60]:
        assert r.score == pytest.approx(plain_score(net, text[r.doc_id]), abs=1e-4)
    for t in (None, "", "a", "x" * 511, "ab " * 171, "é" * 300, "word " * 250):
        assert net.score(t) == pytest.approx(plain_score(net, t), abs=1e-4)


def test_score_ties_predict_one(spark):
    net = quality.Network()
    net.p["out"][:] = 0
    assert [(r.score, r.predicted) for r in quality.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), net).collect()] == [(0.5, 1)]


def test_repeated_ids_teach_alike(spark):
    docs = spark.createDataFrame([(1, "b text"), (1, "a text"), (1, None), (2, "### ### ###"), (2, "%%% %%%")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    nets = [quality.fit(x, labels) for x in (docs, docs.orderBy(F.desc("text")))]
    assert all(np.array_equal(nets[0].p[k], nets[1].p[k]) for k in nets[0].p)


def test_network_sees_the_whole_text():
    net = quality.Network()
    net.p["embed"][250] *= 50  # a byte that some filters answer more than all others
    data = np.arange(5000) % 200
    base = net.forward(data)[3]
    for at in (0, 1000, 2563, 4990):
        other = data.copy()
        other[at : at + 8] = 250
        assert not np.array_equal(net.forward(other)[3], base)
    long = np.resize(data, quality.STEP * 2 + 700)
    assert len(net.forward(long)[3]) == -(-len(long) // quality.HALF) - 1


def test_gradient_is_the_slope():
    net = quality.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = np.random.default_rng(1).integers(0, 256, 900)
    g = {k: np.zeros_like(v) for k, v in net.p.items()}
    net.gradient(data, 1, g)
    seen = int(np.flatnonzero(np.abs(g["embed"]).sum(1))[0])
    for k, at in (("out", 3), ("bias", 2), ("filters", (5, 3)), ("embed", (seen, 1))):
        eps, old = 1e-5, net.p[k][at]
        loss = []
        for d in (eps, -eps):
            net.p[k][at] = old + d
            loss.append(np.log1p(np.exp(-net.forward(data)[0])))
        net.p[k][at] = old
        assert (loss[0] - loss[1]) / (2 * eps) == pytest.approx(g[k][at], abs=2e-3)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(None, "a", "x"), (1, None, "x"), (2, "", "x"), (3, "x" * 300_000, "x"), (3, "x", "x")] + [(10 + i, "good text " * 9 if i % 2 else "### !!! " * 9, "x") for i in range(90)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(10 + i, i % 2, 7) for i in range(60)] + [(None, 1, 7), (11, None, 7), (12, 0, 7), (999, 1, 7)], "doc_id long, quality int, held_out int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == (r.doc_id - 10) % 2 for r in got if (r.doc_id or 0) >= 10)
    assert quality.score(docs.where("false"), quality.fit(docs, labels.where("false"))).count() == 0
