"""Near-duplicates by the Jaccard similarity of five-word shingles, for the pipeline's stage.

SimHash proposes first: texts whose fingerprints (votes over their distinct shingles) differ in at most RADIUS bits, found
by covering masks on PARTS parts of the fingerprint, which miss none. A pair at 0.8 differs in about 10 bits, more than
masks can cover, so bands of min-hashes propose the rest: a pair at similarity s shares no band with probability
(1 - s^ROWS)^BANDS, about one in eight million at 0.8. The texts of each component of candidates are then compared by
their exact shingle sets, which alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import ascii_lower_py, bounded_batches, components, durable
from rivulet.llm.simhash import _SPACE, link_fingerprints, voted

#: Words of a shingle; least similarity of a link as a fraction; bands and min-hashes of a band.
SHINGLE, LEAST, BANDS, ROWS, SEED = 5, (4, 5), 40, 5, 42
#: Bits in which fingerprints that propose a pair may differ; parts that the masks cover by themselves.
RADIUS, PARTS = 7, 2
#: A set with fewer shingles is similar to an equal one only, so its coarse fingerprint proposes equal fingerprints only.
LEAST_VOTES = 4
#: Components of candidates with more shingles or texts than this are dealt out as pairs of blocks of about this size.
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 19, 4096

_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def normalised(text: str | None) -> bytes:
    return _SPACE.sub(" ", ascii_lower_py(text or "")).strip(" ").encode("utf-8", "surrogatepass")


def shingles(line: bytes) -> np.ndarray:
    """Distinct XXH64 of a normalised text's shingles, sorted; a text with fewer words is one shingle."""
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(line)]
    if len(starts) > SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A signed hash for each band of min-hashes."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * _TIMES + _PLUS).min(0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), SEED) for b in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def _sketched(text: Column) -> Column:
    @F.pandas_udf("node long, n long, fp long, bands array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            line = normalised(t)
            sh = shingles(line)
            out.append((int(np.uint64(xxhash.xxh64_intdigest(line, SEED)).view(np.int64)), len(sh), voted(sh[at : at + (1 << 16)] for at in range(0, len(sh), 1 << 16)), bands(sh)))
        return pd.DataFrame(out, columns=["node", "n", "fp", "bands"])

    return sketch(text.cast("string"))


def linked_sets(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of sets with similarity LEAST or more, exactly.

    Breadth-first. Sets are sorted by how rare their members are; two sets that similar share one of the rarest members
    of each (one more than may be missing), so only those are looked up, and what is found is counted in full.
    """
    num, den = LEAST
    sizes = np.array([len(s) for s in sets])
    _, member, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((rank[member], owner))
    member, starts = rank[member][order], np.r_[0, np.cumsum(sizes)]
    prefix = sizes - -(-num * sizes // den) + 1
    rare = np.arange(len(member)) - starts[owner] < prefix[owner]
    of, by = owner[rare], member[rare]
    at = np.argsort(by, kind="stable")
    of, by = of[at], by[at]
    left, marked = np.ones(len(sets), bool), np.zeros(len(often), bool)
    remaining = indexed = len(sets)
    froms, tos = [], []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], todo = False, [first]
        remaining -= 1
        while todo and remaining:
            if 2 * remaining < indexed:
                keep = left[of]
                of, by, indexed = of[keep], by[keep], remaining
            x = todo.pop()
            mine = member[starts[x] : starts[x + 1]]
            look = mine[: prefix[x]]
            lo, hi = np.searchsorted(by, look, "left"), np.searchsorted(by, look, "right")
            some = [of[a:b] for a, b in zip(lo, hi, strict=True) if b > a]
            if not some:
                continue
            near = np.unique(np.concatenate(some))
            near = near[left[near]]
            near = near[(den * np.minimum(sizes[near], sizes[x]) >= num * np.maximum(sizes[near], sizes[x]))]
            if not len(near):
                continue
            marked[mine] = True
            ns = sizes[near]
            ends = np.cumsum(ns)
            places = np.arange(ends[-1]) + np.repeat(starts[near] - (ends - ns), ns)
            shared = np.add.reduceat(marked[member[places]].astype(np.int64), ends - ns)
            marked[mine] = False
            found = near[(num + den) * shared >= num * (ns + sizes[x])]
            left[found] = False
            remaining -= len(found)
            froms.extend([x] * len(found))
            tos.extend(found.tolist())
            todo.extend(found.tolist())
    return froms, tos


def _compared(cells: DataFrame) -> DataFrame:
    """Edges (a, b) between the nodes of each cell (root, i, j) whose texts are similar."""

    def edges(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        node = group["node"].to_numpy(np.int64)
        a, b = linked_sets([shingles(normalised(t)) for t in group["text"]]) if len(node) > 1 else ([], [])
        return pd.DataFrame({"a": node[a] if a else node[:0], "b": node[b] if b else node[:0]})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for x in batches:
            if not len(x):
                continue
            x = x if kept is None else pd.concat([kept, x], ignore_index=True)
            cell = x[["root", "i", "j"]].to_numpy(np.int64)
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield edges(x.iloc[a:b])
            kept = x.iloc[starts[-1] :]
        if kept is not None:
            yield edges(kept)

    return cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInPandas(walk, "a long, b long")


def identified(docs: DataFrame) -> DataFrame:
    """docs with __r1 and __r2, 128 bits that tell rows apart by all of their columns."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    whole = [*cols, *(c.isNull() for c in cols)]
    return docs.withColumns({"__r1": F.xxhash64(*whole), "__r2": F.xxhash64(F.lit(SEED), *reversed(whole))})


def proposals(texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes that may be similar. texts: node, n and fp; sketches: node and bands."""
    fps = durable(texts.groupBy("fp").agg(F.min("node").alias("first"), F.max("n").alias("n")), "fingerprints")
    near = durable(link_fingerprints(fps.where(F.col("n") >= LEAST_VOTES).select("fp"), RADIUS, parts=PARTS), "near-fingerprints")
    first = fps.select("fp", "first")
    close = near.join(first.toDF("a", "u"), "a").join(first.toDF("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    equal = texts.select("node", "fp").join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    keys = sketches.select("node", F.posexplode("bands").alias("t", "k"))
    full = keys.groupBy("t", "k").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").drop("most")
    banded = keys.join(full, ["t", "k"]).where("node > b").select(F.col("node").alias("a"), "b")
    return close.unionByName(equal).unionByName(banded)


def near_duplicates(docs: DataFrame, block_shingles: int = BLOCK_SHINGLES, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """doc_id, __r1, __r2, node (of the text) and root (of its component) for each row of docs.

    Texts that are equal but for ASCII case and white space are one node; null and blank texts are equal. Components are
    those of all pairs of texts with similarity LEAST or more, whatever their doc_id.
    """
    bounded_batches(docs.sparkSession)
    told = identified(docs)
    rows = durable(told.select("doc_id", "__r1", "__r2", _sketched(F.col("text")).alias("s")).select("doc_id", "__r1", "__r2", "s.*"), "sketches")
    texts = durable(rows.groupBy("node").agg(F.min(F.struct("__r1", "__r2")).alias("r"), F.first("n").alias("n"), F.first("fp").alias("fp")), "texts")
    once = rows.join(texts.select("node", "r.*"), ["node", "__r1", "__r2"], "left_semi").select("node", "bands")
    candidates = durable(components(proposals(texts.select("node", "n", "fp"), once), "a", "b"), "candidates")
    sized = durable(texts.join(candidates, "node").select("node", "root", "r.*", "n"), "sized")
    blocks = sized.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / block_shingles), F.ceil(F.count(F.lit(1)) / block_texts)).cast("int").alias("s"))
    own = F.pmod(F.xxhash64("node"), F.col("s")).cast("int")
    cells = (
        told.select("__r1", "__r2", F.col("text").cast("string").alias("text"))
        .join(sized.select("node", "root", "__r1", "__r2").hint("merge"), ["__r1", "__r2"])
        .join(blocks, "root")
        .select("node", "text", "root", own.alias("b"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("o"))
        .select("node", "text", "root", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    )
    labels = durable(components(_compared(cells), "a", "b"), "components").withColumnRenamed("root", "__root")
    return rows.drop("n", "fp", "bands").join(labels, "node", "left").select("doc_id", "__r1", "__r2", "node", F.coalesce("__root", "node").alias("root"))
