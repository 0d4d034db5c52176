"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters slide over overlapping chunks that cover the whole document; each filter's largest
answer in a chunk is kept, and the largest of these over the chunks; the output layer combines them into one probability.
A text shorter than a chunk is filled up with a symbol of its own, which filters can learn to answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import bounded_batches
from rivulet.llm.sampling import bounded_sample, held_out, learnable

#: Bytes between chunk starts (chunks are twice as long), between filter places, and under a filter.
HALF, STRIDE, WIDTH = 256, 4, 12
EMBEDDING, FILTERS = 8, 64
#: Labelled rows learned from at most, their longest text in characters (documented bounds of the sample), passes, rows a step, learning rate.
SAMPLE, LONGEST, EPOCHS, BATCH, RATE = 1200, 20_000, 10, 16, 0.01
#: Bytes that one step of scoring embeds.
STEP = HALF * 256
PAD = 256


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (257, EMBEDDING)),
            "filters": r.normal(0, (WIDTH * EMBEDDING) ** -0.5, (WIDTH * EMBEDDING, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": r.normal(0, 0.05, FILTERS),
            "end": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.prior = 0.0  # log odds of the labels over those of the sample

    def _halves(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(halves, filters): largest raw answer in each half chunk and the place it stands at."""
        n = max(1, len(data))
        most, where = [], []
        for at in range(0, n, STEP):
            places = -(-min(STEP, n - at) // STRIDE)
            part = np.full(places * STRIDE + WIDTH, PAD, np.int64)
            own = data[at : at + len(part)]
            part[: len(own)] = own
            e = self.p["embed"][part]
            windows = np.lib.stride_tricks.sliding_window_view(e, (WIDTH, EMBEDDING))[:, 0][::STRIDE][:places].reshape(places, -1)
            s = windows @ self.p["filters"]
            per = HALF // STRIDE
            for i in range(0, places, per):
                best = s[i : i + per].argmax(0)
                most.append(s[i + best, np.arange(FILTERS)])
                where.append(at + (i + best) * STRIDE)
        return np.array(most), np.array(where)

    def forward(self, data: np.ndarray) -> tuple:
        most, where = self._halves(data)
        if len(most) > 1:  # a chunk is two halves
            second = most[1:] > most[:-1]
            chunks, places = np.where(second, most[1:], most[:-1]), np.where(second, where[1:], where[:-1])
        else:
            chunks, places = most, where
        top, f = chunks.argmax(0), np.arange(FILTERS)
        pooled = np.tanh(chunks[top, f] + self.p["bias"])
        logit = float(pooled @ self.p["out"] + self.p["end"][0])
        return logit, pooled, places[top, f], chunks

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.forward(_bytes(text))[0] + self.prior, -30, 30))))

    def gradient(self, data: np.ndarray, label: int, into: dict[str, np.ndarray]) -> float:
        logit, pooled, places, _ = self.forward(data)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        d = np.float32(p - label)
        into["out"] += d * pooled
        into["end"] += d
        g = d * self.p["out"] * (1 - pooled * pooled)
        into["bias"] += g
        under = np.r_[data, np.full(WIDTH + STRIDE, PAD, np.int64)][places[:, None] + np.arange(WIDTH)]  # filters, width
        into["filters"] += (g[:, None] * self.p["embed"][under].reshape(FILTERS, -1)).T
        back = (g[:, None] * self.p["filters"].T).reshape(-1, EMBEDDING)
        np.add.at(into["embed"], under.reshape(-1), back)
        return float(-np.log(max(1e-7, p if label else 1 - p)))


def _bytes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    return np.r_[data, np.full(max(0, 2 * HALF - len(data)), PAD)]


def learn(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Network:
    """Adam on the mean log loss of balanced steps."""
    net, r = Network(), np.random.default_rng(5)
    data, y = [_bytes(t) for t in texts], np.array(labels)
    m, v, t = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2)), None, 0
    m, v = tuple(m)
    for epoch in range(epochs):
        order, rate = r.permutation(len(data)), RATE * (1 - 0.9 * epoch / max(1, epochs))
        for at in range(0, len(order), BATCH):
            g = {k: np.zeros_like(x) for k, x in net.p.items()}
            step = order[at : at + BATCH]
            for i in step:
                net.gradient(data[i], int(y[i]), g)
            t += 1
            for k in g:
                d = g[k] / len(step)
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Network:
    """A network from the labelled, not held-out rows: docs (doc_id, text), labels (doc_id, quality).

    Rows without a quality of 0 or 1, and texts longer than `longest`, teach nothing; of repeated labels of a document
    the least counts, and of repeated texts of an id the first in code-point order. Empty tables give a network that has
    learned nothing. Only the named columns are read.
    """
    rows = labels.where(learnable(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = bounded_sample(rows, "quality", "doc_id", sample)  # at most `sample` rows: may be broadcast
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.length("text") <= longest).groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: r.doc_id)
    net = learn([r.text for r in got], [r.quality for r in got])
    # the sample holds both labels alike; all labelled rows say how frequent each is
    n = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    seen = [sum(r.quality == q for r in got) for q in (0, 1)]
    if min(*seen, *(n.get(q, 0) for q in (0, 1))) > 0:
        net.prior = float(np.log(n[1] / n[0]) - np.log(seen[1] / seen[0]))
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs: the whole text alone decides; null counts as empty.

    A score of exactly 0.5 predicts 1. Repeated rows have equal scores. A very long text is read in steps of STEP bytes.
    An empty table gives an empty result. Only doc_id and text are read, so clashing names don't matter.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    out = docs.select("doc_id", scored(F.col("text").cast("string")).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")))
