"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of letters (with a space for all else) are hashed to a fixed number of features. Document frequencies count all
documents that may be learned from; weights are learned from a bounded sample by follow-the-regularised-leader with
elastic-net penalties; a temperature fitted on rows left out of that learning calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import bounded_batches
from rivulet.llm.sampling import bounded_sample, held_out, learnable

#: Features; longest n-gram; rows learned from at most, their longest text in characters (documented bounds); one row in this many calibrates.
FEATURES, ORDER, SAMPLE, LONGEST, CALIBRATE = 1 << 16, 3, 2400, 20_000, 5
#: Learning rate and its smoothing, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 3
UNKNOWN = "und"
#: Code points that one step hashes.
STEP = 1 << 20

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _tables:
        _tables.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _tables[0]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, how often) of a whole text, features ascending; nothing without a letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[code] if len(code) else np.zeros(0, bool)
    if not letter.any():
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    code = np.where(letter, code, 32)
    code = code[letter | np.r_[False, letter[:-1]]]  # one space for a run of others
    code = np.r_[np.uint32(32), code, np.full(int(code[-1] != 32), 32)].astype(np.uint32)  # and one at either end
    total = np.zeros(FEATURES, np.int64)
    for at in range(0, len(code), STEP):
        part = code[at : at + STEP + ORDER - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, ORDER + 1):
            m = min(STEP, len(part) - n + 1)
            if m <= 0:
                break
            h = (h[:m] * np.uint32(0x01000193)) ^ (part[n - 1 : n - 1 + m] * np.uint32(0x9E3779B1))
            total += np.bincount((h * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(16), minlength=FEATURES)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found].astype(np.float32)


def weighted(features: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(times)) * idf[features]
    return (x / max(1e-9, float(np.sqrt((x * x).sum())))).astype(np.float32)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int) -> np.ndarray:
    """Weights (features + bias, classes) by FTRL-proximal over sparse rows."""
    z, n = np.zeros((FEATURES + 1, classes), np.float32), np.zeros((FEATURES + 1, classes), np.float32)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) > L1, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2), 0)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            i, x = rows[r]
            i, x = np.r_[i, FEATURES], np.r_[x, np.float32(1)]
            w = weights(i)
            p = _softmax(x @ w)
            p[labels[r]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(FEATURES + 1)).astype(np.float32)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, by golden section over its logarithm; 1 without rows."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(1e-12, _softmax(scores / np.exp(t))[np.arange(len(labels)), labels])).mean())

    lo, hi, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    """What prediction needs; its size depends on the number of features and languages only."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.languages, self.idf, self.weights, self.heat = languages, idf, weights, heat

    def scores(self, features: np.ndarray, times: np.ndarray) -> np.ndarray:
        return weighted(features, times, self.idf) @ self.weights[features] + self.weights[FEATURES]

    def predict(self, text: str | None) -> tuple[str, float]:
        features, times = counts(text)
        if not len(features) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.scores(features, times).astype(np.float64) / self.heat)
        return self.languages[int(p.argmax())], float(min(1.0, p.max()))


def fit(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """A model from docs (doc_id, text, lang): null languages and held-out documents are not looked at.

    Document frequencies count every learnable row, repeated ones each time, and whole texts. Weights are learned from a
    sample of texts of at most `longest` characters. An empty table gives a model that knows no language.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(FEATURES, np.int64), 0
        for x in batches:
            for text in x["text"]:
                seen[counts(text)[0]] += 1
                n += 1
        found = np.flatnonzero(seen)
        yield pd.DataFrame({"feature": np.r_[found, -1], "n": np.r_[seen[found], n]})

    totals = rows.select("text").mapInPandas(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df, n = np.zeros(FEATURES, np.int64), 0
    for r in totals.toLocalIterator():
        if r["feature"] < 0:
            n = r["n"]
        else:
            df[r["feature"]] = r["n"]
    idf = np.log((1 + n) / (1 + df)) + 1
    few = bounded_sample(rows.where(F.length("text") <= longest), "lang", "doc_id", sample)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = [counts(t) for t in x["text"]]
            yield pd.DataFrame({"doc_id": x["doc_id"], "lang": x["lang"], "i": [g[0] for g in got], "n": [g[1] for g in got]})

    got = sorted(few.mapInPandas(featured, "doc_id long, lang string, i array<int>, n array<float>").collect(), key=lambda r: (r.doc_id, r.lang))
    got = [r for r in got if r.i]
    languages = sorted({r.lang for r in got})
    y = np.array([languages.index(r.lang) for r in got], dtype=np.int64)
    x = [(i := np.array(r.i, np.int64), weighted(i, np.array(r.n, np.float32), idf)) for r in got]
    held = np.arange(len(got)) % CALIBRATE == 0
    at = np.flatnonzero(~held)
    weights = learn([x[i] for i in at], y[at], max(1, len(languages)))
    scores = np.array([v @ weights[i] + weights[FEATURES] for i, v in (x[j] for j in np.flatnonzero(held))])
    return Model(languages, idf.astype(np.float32), weights, temperature(scores, y[held]))


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the prediction and its probability added under the given names; the text alone decides.

    Null texts and texts without a letter are `und` with score 0; so is everything if there was nothing to learn from.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"]).astype({"lang_pred": str, "score": float})

    # of added columns with clashing names, ours replace the table's
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*kept, told(F.col(text).cast("string")).alias("__told")).select(*kept, F.col("__told.lang_pred").alias(names[0]), F.col("__told.score").alias(names[1]))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang); an empty table gives an empty result.

    Null and letterless texts are `und`; of equally likely languages the first in code-point order is told. Repeated rows
    are told alike; very long texts are counted in steps of STEP code points. Further columns take no part.
    """
    out = predict(docs.select("doc_id", "text"), fit(docs, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
