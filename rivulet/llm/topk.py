"""Exact top-k inner-product search by distributed histogram selection.

Every candidate is scored against every query of a block. Each pass counts scores in equal-width bins of each query's
current interval, sums the counts over all tasks, and narrows the interval to the bin that holds the k-th score; after
a few passes the interval is one score or holds few rows. A last pass keeps the rows at or above the k-th score and
breaks ties by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import durable
from rivulet.record import importable

K, SCALE, EVERY = 5, 256, 50
BINS = 256
#: Queries in a block, and scores held at once; both bound a task's memory whatever the tables' sizes.
BLOCK_QUERIES, BLOCK_BYTES, SCORES = 16_384, 16 << 20, 1 << 21
_NONE = np.iinfo(np.int64).min


def _valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    x = F.col("x").cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("x")).select("vec_id", x.alias("x")).where(F.col("x").isNotNull() & finite)


def _scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products (rows of c by rows of q), held to the range of a long."""
    most = c.shape[1] * max(1.0, float(np.abs(c).max(initial=0))) * max(1.0, float(np.abs(q).max(initial=0)))
    if most < 2**53:
        return (c @ q.T).astype(np.int64)
    if most < 2**62:
        return c.astype(np.int64) @ q.T.astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in c], dtype=object).reshape(c.shape) @ np.array([[int(v) for v in r] for r in q], dtype=object).reshape(q.shape).T
    return np.clip(exact, _NONE + 1, 2**63 - 1).astype(np.int64)


class _Block:
    """Queries of one block as the tasks get them: ids, quantised vectors by length, intervals."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.ids = ids
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        dims = np.array([len(v) for v in vectors])
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            self.by_dim[int(d)] = (at, np.stack([vectors[i] for i in at]).reshape(len(at), int(d)))

    def scored(self, batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query indices, candidate ids, scores) with rows for candidates; a query's own row has _NONE."""
        ids, x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1)
        null_id = np.asarray(batch.column(0).is_null())
        lengths = np.diff(x.offsets.to_numpy())
        starts, flat = x.offsets.to_numpy()[:-1], x.values.to_numpy(zero_copy_only=False)
        for d, (at, q) in self.by_dim.items():
            rows = np.flatnonzero((lengths == d) & ~null_id)
            step = max(1, SCORES // len(at))
            for i in range(0, len(rows), step):
                r = rows[i : i + step]
                c = np.floor(scale * flat[starts[r][:, None] + np.arange(d)].reshape(len(r), d))
                s = _scores(c, q)
                s[ids[r][:, None] == self.ids[at][None, :]] = _NONE
                yield at, ids[r], s


def _histogram(block: _Block, lo: np.ndarray, hi: np.ndarray, width: np.ndarray, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.ids)
        counts = np.zeros((n, BINS), np.int64)
        for batch in batches:
            for at, _, s in block.scored(batch, scale):
                ok = (s >= lo[at]) & (s <= hi[at])
                bins = (s - lo[at]) // width[at] + np.arange(len(at)) * BINS
                counts[at] += np.bincount(bins[ok], minlength=len(at) * BINS).reshape(len(at), BINS)
        # bins under a task's own k-th score can't hold the k-th of all
        above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], names=["q", "b", "n"])

    return run


def _best(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[rank < k], ids[rank < k], s[rank < k]


def _filtered(block: _Block, least: np.ndarray, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            for at, ids, s in block.scored(batch, scale):
                r, c = np.nonzero((s >= least[at]) & (s != _NONE))
                kept = _best(np.r_[kept[0], at[c]], np.r_[kept[1], ids[r]], np.r_[kept[2], s[r, c]], k)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer scores among the rows of vectors but its own id.

    Components become floor(scale * x). Null vectors, vectors with null or non-finite components and rows without id
    take no part; vectors of another length than the query's are no candidates of it. Fewer than k candidates: all
    of them. Repeated candidate rows count each; a repeated query is asked once. Only the named columns are read.
    Queries go to the tasks in blocks of at most BLOCK_QUERIES rows and about BLOCK_BYTES bytes.
    """
    spark = vectors.sparkSession
    importable(spark)
    rows, asked = _valid(vectors, key, vector), _valid(queries, key, vector).where("vec_id is not null").distinct()
    asked = durable(asked, "queries")
    size = asked.agg(F.count(F.lit(1)), F.sum(8 * F.size("x"))).first()
    blocks = max(1, -(-size[0] // BLOCK_QUERIES), -(-(size[1] or 0) // BLOCK_BYTES))
    most = rows.agg(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()[0] or 0.0
    found = [_block_top_k(rows, asked.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)) == b), most, k, scale) for b in range(blocks)]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block_top_k(rows: DataFrame, asked: DataFrame, most: float, k: int, scale: int) -> DataFrame:
    spark = rows.sparkSession
    got = asked.orderBy("vec_id").collect()
    if not got:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    vectors = [np.floor(scale * np.array(r.x, dtype=np.float64)) for r in got]
    shared = _Block(np.array([r.vec_id for r in got], dtype=np.int64), vectors)
    reach = np.array([min(float(2**61), float(np.abs(v).sum()) * (scale * most + 1)) for v in vectors])
    lo, hi = -np.ceil(reach).astype(np.int64) - 1, np.ceil(reach).astype(np.int64) + 1
    above = np.zeros(len(got), np.int64)  # rows over the interval
    while True:
        width = np.maximum(1, -(-(hi - lo + 1) // BINS))
        counts = rows.mapInArrow(_histogram(shared, lo, hi, width, k, scale), "q long, b long, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
        # for each query at most k bins and those a task could not rule out
        upto = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("b")))
        start = spark.createDataFrame([(i, int(a)) for i, a in enumerate(above)], "q long, above long")
        at = counts.withColumn("upto", upto).join(F.broadcast(start), "q").where(F.col("upto") + F.col("above") >= k)
        at = at.groupBy("q").agg(F.max(F.struct("b", "upto", "n")).alias("at")).select("q", "at.*").collect()
        crowd = np.zeros(len(got), np.int64)
        narrowed = np.zeros(len(got), bool)
        for r in at:
            lo[r.q], above[r.q], crowd[r.q], narrowed[r.q] = lo[r.q] + r.b * width[r.q], above[r.q] + r.upto - r.n, r.n, True
            hi[r.q] = min(hi[r.q], lo[r.q] + width[r.q] - 1)
        # queries with fewer than k candidates keep the whole interval
        if not (narrowed & (width > 1) & (crowd > 4 * k)).any():
            break
    least = np.where(narrowed, lo, _NONE)
    return durable(rows.mapInArrow(_filtered(shared, least, k, scale), "query_id long, vec_id long, score long"), "top")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
      FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
