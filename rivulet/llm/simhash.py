"""SimHash near-dedup with covering locality-sensitive hashing.

64-bit fingerprints are majority votes over word-shingle hashes. Fingerprints within the radius are found through
2^(radius+1) - 1 structured bit masks: each bit position has a non-zero vector of radius+1 bits, and mask v holds the
positions whose vector has an odd inner product with v. Any `radius` positions span at most `radius` of the radius+1
dimensions, so some v is orthogonal to all positions in which a pair differs, and the pair agrees under that mask:
no pair within the radius is missed.

A crowded bucket is split by a second family of such masks, and what is crowded still by a third: a pair within the radius
agrees under some mask of each family, so it meets again in a part of the bucket.

A wider radius takes masks on parts of the fingerprint: of `parts` parts of a pair within the radius, one differs in at most
radius // parts bits, so masks for that many on each part miss no pair either, and are far fewer. Their keys are short (about
17 bits for two parts), so that in a large table nearly all fingerprints share buckets by chance. Looking for those that do
would make rows that grow faster than the table; instead each goes to the comparison once a mask, a row count in proportion,
and meets at most the fingerprints of a bucket that isn't yet crowded. Out of a crowded one a dense group is taken first,
whose members would meet under most masks of the next families as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import ascii_lower_py, bounded_batches, components, durable

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Buckets with more fingerprints than this are split by the next family of masks, in the last one dealt out as pairs of blocks of about this size.
BLOCK, FAMILIES = 2048, 3
#: Buckets up to this size are searched for links all at once; only fingerprints with a link are then walked.
SEARCHED = 256

_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def voted(pieces: Iterable[np.ndarray]) -> int:
    """Signed 64-bit fingerprint of the hashes in all pieces: a bit is 1 if set in over half of them."""
    n, votes = 0, np.zeros(64, np.int64)
    for h in pieces:
        n += len(h)
        votes += np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half of the shingles' XXH64; no word gives 0."""
    line = _SPACE.sub(" ", ascii_lower_py(text or "")).strip(" ").encode("utf-8", "surrogatepass")
    if not line:
        return 0
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(line)]
    if len(starts) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh64_intdigest
    return voted(np.array([hashed(line[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], dtype="<u8") for at in range(0, len(starts), 1 << 16))


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype=np.int64)

    return fp(text.cast("string"))


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def masks(radius: int = RADIUS, bits: int = 64, family: int = 0, parts: int = 1) -> list[int]:
    """The covering masks as signed longs. Families deal the vectors, and the parts, to the bits in other orders."""
    dims = radius // parts + 1
    order = [int(i) for i in np.random.default_rng(family).permutation(bits)] if family else range(bits)
    vectors = [1 + i % ((1 << dims) - 1) for i in order]
    out = []
    for part in range(parts):
        for v in range(1, 1 << dims):
            m = sum(1 << i for i in range(bits) if order[i] * parts // bits == part and bin(vectors[i] & v).count("1") % 2)
            out.append(m - (1 << 64) if m >> 63 else m)
    return out


def linked(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: each edge is a pair within the radius.

    Breadth-first: a reached fingerprint is compared with those not yet reached, so that dense groups cost little more
    than one comparison each.
    """
    left, froms, tos = fps, [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= radius  # of a signed number it would count the absolute value's bits
            if near.any():
                found = left[near]
                left = left[~near]
                froms.append(np.full(len(found), x))
                tos.append(found)
                todo.extend(found)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *froms]), np.concatenate([none, *tos])


def _cells(keys: DataFrame, full: DataFrame, block: int) -> DataFrame:
    """fp, t, k, i, j: the fingerprints of each bucket of full, those of one over `block` dealt out as pairs of blocks."""
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    return (
        keys.join(full, ["t", "k"])
        .select("fp", "t", "k", parts.alias("s"))
        .select("fp", "t", "k", own.alias("b"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("o"))
        .select("fp", "t", "k", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    )


def _balls(keys: DataFrame, crowded: DataFrame, radius: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Takes a dense group out of each crowded bucket in rows in proportion: (edges, cells, keys of the rest).

    The fingerprint nearest to the majority of a bucket's bits is its centre, which those within the radius link to. Only
    what lies within twice the radius can link to those; it is compared with them in cells. A bucket with more than `block`
    fingerprints there stays whole.
    """
    within = durable(keys.join(crowded.select("t", "k"), ["t", "k"]).select("fp", "t", "k"), "crowded")
    ones = [F.sum(F.shiftright("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    votes = within.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), *ones)
    middle = F.lit(0).cast("long")
    for i in range(64):
        middle = middle.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    middles = durable(votes.select("t", "k", middle.alias("m")), "middles")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("m")))
    centres = within.join(middles, ["t", "k"]).groupBy("t", "k").agg(F.min(F.struct(apart.alias("d"), "fp")).alias("c")).select("t", "k", F.col("c.fp").alias("m"))
    told = durable(within.join(durable(centres, "centres"), ["t", "k"]).select("fp", "t", "k", "m", apart.alias("d")), "distances")
    outer = (F.col("d") > radius) & (F.col("d") <= 2 * radius)
    sizes = told.groupBy("t", "k").agg(F.count(F.when(F.col("d") <= radius, 1)).alias("in"), F.count(F.when(outer, 1)).alias("out"), F.min(F.when(outer, F.col("d"))).alias("least"))
    whole = durable(sizes.where(F.col("out") > block).select("t", "k"), "whole")
    split = told.join(whole, ["t", "k"], "left_anti")
    edge = durable(sizes.where(F.col("out").between(1, block)).select("t", "k", "least", F.ceil(F.col("in") / F.lit(block)).cast("int").alias("s")), "edges-of-balls")
    cell = ["fp", "t", "k", "i", F.lit(-1).alias("j")]
    beside = told.join(edge, ["t", "k"])
    inner = beside.where((F.col("d") <= radius) & (F.col("d") >= F.col("least") - radius)).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")).select(*cell)
    outside = beside.where(outer).select("fp", "t", "k", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("i")).select(*cell)
    stars = split.where(F.col("d").between(1, radius)).select(F.col("m").alias("a"), F.col("fp").alias("b"))
    rest = split.where(F.col("d") > radius).select("fp", "t", "k").unionByName(told.join(whole, ["t", "k"]).select("fp", "t", "k"))
    return stars, inner.unionByName(outside), durable(rest, "rest")


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, families: int = FAMILIES, parts: int = 1) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fps.fp that connect exactly what the links within the radius connect.

    Buckets up to `block` are compared in one piece. A larger one is split by the masks of the next family, each of its
    fingerprints going into as many parts as a family has masks; after the last family, by pairs of blocks, so that no
    task gathers more than two blocks of a bucket at once.
    """
    keys, cells = fps.select("fp", F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("k")), None
    stars = None
    for family in range(families):
        own = masks(radius, family=family, parts=parts)
        masked = F.posexplode(F.array(*(F.col("k").bitwiseOR(F.col("fp").bitwiseAND(F.lit(m))) for m in own))).alias("p", "__k")
        keys = keys.select("fp", "t", "k", masked).select("fp", (F.col("t") * len(own) + F.col("p")).alias("t"), F.col("__k").alias("k"))
        short = parts > 1 and family == 0
        full = durable(keys.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (block if short else 1)), "buckets")
        crowded = full.where(F.col("n") > block)
        none = crowded.isEmpty()
        last = family == families - 1 or none
        if short:
            cells = keys if none else keys.join(crowded, ["t", "k"], "left_anti")
            cells = cells.select("fp", "t", "k", F.lit(0).alias("i"), F.lit(0).alias("j"))
            if none:
                break
            stars, met, keys = _balls(keys, crowded, radius, block)
            cells = cells.unionByName(met)
            full = durable(keys.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
            crowded = full.where(F.col("n") > block)
            last = family == families - 1 or crowded.isEmpty()
        part = _cells(keys, full if last else full.where(F.col("n") <= block), block)
        cells = part if cells is None else cells.unionByName(part)
        if last:
            break
        keys = durable(keys.join(crowded.select("t", "k"), ["t", "k"]).select("fp", "t", "k"), "crowded")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for x in batches:
            if not len(x):
                continue
            x = x if kept is None else pd.concat([kept, x], ignore_index=True)
            cell, fp = x[["t", "k", "i", "j"]].to_numpy(np.int64), x["fp"].to_numpy(np.int64)
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)])
            yield _edges(fp[: starts[-1]], starts, radius)
            kept = x.iloc[starts[-1] :]
        if kept is not None:
            yield _edges(kept["fp"].to_numpy(np.int64), np.array([0, len(kept)]), radius)

    edges = cells.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "fp").mapInPandas(walk, "a long, b long")
    return edges if stars is None else edges.unionByName(stars)


def _edges(fps: np.ndarray, starts: np.ndarray, radius: int) -> pd.DataFrame:
    """Spanning forests of the links in each bucket; a bucket's place is from one of `starts` to the next."""
    sizes = np.diff(starts)
    met = np.repeat(sizes > SEARCHED, sizes)
    after = np.repeat(starts[1:], sizes) - np.arange(len(fps)) - 1
    rows = np.flatnonzero((after > 0) & ~met)
    step = 0
    while len(rows):
        step += 1
        rows = rows[after[rows] >= step]
        near = rows[np.bitwise_count((fps[rows] ^ fps[rows + step]).view(np.uint64)) <= radius]
        met[near] = met[near + step] = True
    bucket = np.repeat(np.arange(len(sizes)), sizes)[met]
    ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1 if len(bucket) else bucket
    found = [linked(g, radius) for g in np.split(fps[met], ends)]
    none = np.zeros(0, np.int64)
    return pd.DataFrame({"a": np.concatenate([none, *(x[0] for x in found)]), "b": np.concatenate([none, *(x[1] for x in found)])})


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, block: int = BLOCK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    component_id is the smallest doc_id reachable over links. Null, empty and blank texts have fingerprint zero and
    link like any other; repeated rows and equal texts share a component. A null doc_id never is a component's name
    unless all of its members have none. Very long texts are hashed in pieces. An empty table gives an empty result.
    Only the two named columns are read, so clashing names don't matter.
    """
    bounded_batches(docs.sparkSession)
    rows = durable(docs.select(F.col(key).alias("doc_id"), fingerprint_column(F.col(text), shingle).alias("fp")), "fingerprints")
    fps = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    labels = components(link_fingerprints(fps.select("fp"), radius, block), "a", "b")
    joined = fps.select("fp", "least").join(labels.withColumnRenamed("node", "fp"), "fp")
    of_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    shared = joined.join(of_root, "root").select("fp", "component_id")
    # fingerprints of one row without links are their own component
    several = fps.where("n > 1").join(shared, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    names = durable(shared.unionByName(several).withColumn("known", F.lit(True)), "components")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(names, "fp", "left").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), component.alias("component_id"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
