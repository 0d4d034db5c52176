"""Mixing sources to target weights by hash-threshold histograms.

Every row gets a 60-bit hash. Words are summed by source and hash bucket; the bucket in which a source's budget runs
out is found from running sums, and only that bucket is split further, until it holds one document. The mix is then
a filter on the hash: nothing is sorted, and a smaller budget always takes a subset of what a larger one takes.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import WORD, durable

#: Relative weights of the sources in code-point order (null last), repeating; words to take in all; words to take of a source at most.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
HASH_BITS, LEVEL_BITS = 60, 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def allocate(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Targets in proportion to the weights, none above cap times its size; the excess is shared again by weight.

    The targets are min(cap * size, level * weight) for the one level at which they add up to share times all sizes.
    """
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    left, weight, level = share * sum(sizes), float(sum(weights)), 0.0
    for i in order:
        level = left / weight
        if level <= cap * sizes[i] / weights[i]:
            break
        left, weight = left - cap * sizes[i], weight - weights[i]
    return [min(cap * n, level * w) for n, w in zip(sizes, weights, strict=True)]


def cutoffs(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source_key, budget, cut): rows of the source with hash <= cut hold as nearly budget words as whole rows allow.

    rows: source_key, size, hash. budgets: source_key, budget, any number of them for a source; the cuts are nested.
    """
    spark = rows.sparkSession
    rows = rows.where("size > 0")
    open_ = durable(budgets.where("budget > 0").select("source_key", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before")), "bounds")
    done = None
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        if open_.isEmpty():
            break
        # one row a source and prefix, as many as there are budgets
        wanted = open_.select("source_key", "prefix").distinct()
        inside = rows.withColumn("prefix", F.shiftright("hash", shift + LEVEL_BITS)).join(F.broadcast(wanted) if _small(wanted) else wanted, ["source_key", "prefix"])
        buckets = inside.groupBy("source_key", "prefix", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        ordered = Window.partitionBy("source_key", "prefix").orderBy("bucket")
        summed = buckets.withColumn("upto", F.sum("words").over(ordered))
        at = F.struct("bucket", "upto", "words", "n")
        found = (
            open_.join(summed, ["source_key", "prefix"])
            .where(F.col("before") + F.col("upto") >= F.col("budget"))
            .groupBy("source_key", "budget", "before")
            .agg(F.min(at).alias("at"))
            .select("source_key", "budget", F.col("at.bucket").alias("prefix"), (F.col("before") + F.col("at.upto") - F.col("at.words")).alias("before"), F.col("at.words").alias("words"), F.col("at.n").alias("n"))
        )
        found = durable(found, "bounds")
        last = F.lit(shift == 0) | (F.col("n") == 1)
        nearer = F.col("before") + F.col("words") - F.col("budget") < F.col("budget") - F.col("before")
        low = F.shiftleft("prefix", shift)
        cut = F.when(nearer, low + F.lit((1 << shift) - 1)).otherwise(low - 1)
        ended = found.where(last).select("source_key", "budget", cut.alias("cut"))
        done = ended if done is None else done.unionByName(ended)
        open_ = found.where(~last).select("source_key", "budget", "prefix", "before")
    return done if done is not None else spark.createDataFrame([], "source_key string, budget double, cut long")


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table of short rows may be broadcast: counted, not guessed."""
    return df.limit(rows + 1).count() <= rows


def source_key(source: Column) -> Column:
    """The source as a join key: null has its own."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def plan_mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source_key, source_size, target, times, cut: one row for each source of rows (source, source_key, size, hash).

    A row is taken times times, and once more if its hash is at most its source's cut. One row a source goes to the driver.
    """
    spark = rows.sparkSession
    totals = sorted(rows.groupBy("source").agg(F.sum("size").alias("n")).collect(), key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in totals]
    targets = allocate(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], share, cap) if sizes else []
    plan = []
    for r, t in zip(totals, targets, strict=True):
        times = floor(t / r.n) if r.n else 0
        plan.append(("" if r.source is None else f"={r.source}", r.n, t, times, t - times * r.n))
    plan = spark.createDataFrame(plan, "source_key string, source_size long, target double, times long, budget double")
    cut = cutoffs(rows.select("source_key", "size", "hash"), plan.select("source_key", "budget"))
    return durable(plan.join(cut.select("source_key", "cut"), "source_key", "left").select("source_key", "source_size", "target", "times", F.coalesce("cut", F.lit(-1)).alias("cut")), "plan")


def _measured(docs: DataFrame, key: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row_hash(F.col(key)).alias("hash"))
    return durable(rows.withColumn("source_key", source_key(F.col("source"))), "sizes")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(plan) if _small(plan) else plan, "source_key")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, key: str = "doc_id") -> DataFrame:
    """key, size, source_size, target, taken, source for each row of docs (key, text, source).

    Null text has size 0, and so has an empty one; both are taken 0 words. A null source is a source of its own, the
    last. Repeated rows have equal hashes and are taken alike. An empty table gives an empty result. Further columns of
    docs, whatever their names, take no part.
    """
    rows = _measured(docs, key)
    once_more = (F.col("hash") <= F.col("cut")).cast("long")
    taken = (F.col("size") * (F.col("times") + once_more)).alias("taken")
    return _with_plan(rows, plan_mix(rows, weights, share, cap)).select("doc_id", "size", "source_size", "target", taken, "source")


def apply_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, key: str = "doc_id") -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns; no row is shuffled."""
    plan = plan_mix(_measured(docs, key), weights, share, cap)
    plan = plan.select("source_key", F.col("times").alias("__times"), F.col("cut").alias("__cut")).withColumnRenamed("source_key", "__source_key")
    marked = docs.withColumn("__source_key", source_key(F.col("source").cast("string")))
    joined = marked.join(F.broadcast(plan) if _small(plan) else plan, "__source_key")
    times = (F.col("__times") + (row_hash(F.col(key)) <= F.col("__cut")).cast("long")).cast("int")
    copies = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))
    return joined.withColumn("__copy", copies).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("source")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * n AS cap FROM s),
o AS (SELECT *, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS lvl
      FROM w WINDOW before AS (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(lvl, (cap / w, rn)) AS lvl FROM o WHERE lvl <= cap / w),
t AS (SELECT source, n, least(cap, l.lvl * w) AS target FROM w, l),
p AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE floor(target / n) END AS times FROM t),
c AS (SELECT d.doc_id, d.size, p.n, p.target, p.times, p.target - p.times * p.n AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, n AS source_size, target,
       CAST(size * (times + CASE WHEN budget > 0 AND (upto <= budget OR (upto - own < budget AND upto - budget < budget - (upto - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
