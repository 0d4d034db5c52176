"""License scans by diagonal voting.

All rolling word pairs of a text are joined by hash to the positions of the pairs in license templates. A hit votes for
the diagonal (place in the text minus place in the template), and votes are summed by diagonal. Neighbouring diagonals of
one template are merged as far as insertions and deletions may shift them, and what they hold is verified: the longest
chain of hits that goes forward in text and template alike, within a stretch of text that the template's length bounds.
Hits are compared word by word, so equal hashes alone don't count.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import ascii_lower, bounded_batches

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, of a text in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a long template's pairs that verify a span; longest stretch of text of a span, as a multiple of the template's pairs.
SIMILAR, REACH = 0.8, 1.5

#: Phrases that label a text wherever their words stand in a row.
PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}
#: Grants that name a version; all of their words must stand in a row.
GRANTS = {
    "apache-2.0": "apache license version 2 0",
    "gpl-2.0": "gnu general public license version 2",
    "gpl-3.0": "gnu general public license version 3",
    "cc-by-4.0": "cc by 4 0",
    "cc-by-nc-4.0": "cc by nc 4 0",
    "cc-by-nd-4.0": "cc by nd 4 0",
    "cc-by-sa-4.0": "cc by sa 4 0",
}
#: Wordings that may be altered in places.
TEXTS = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "apache-text": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
}


def template_pairs() -> list[tuple[str, bool, int, int, str, str]]:
    """template, exact, pairs (in the template), place, a, b: one for each word pair; their number is fixed by the tables above."""
    rows = []
    for kind, table in (("phrase", PHRASES), ("grant", GRANTS), ("text", TEXTS)):
        for label, text in table.items():
            words = text.split()
            rows += [(f"{kind}:{label}", kind != "text", len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words[:-1], words[1:], strict=True))]
    return rows


def templates(spark: SparkSession) -> DataFrame:
    """The template pairs with their hashes, h."""
    return spark.createDataFrame(template_pairs(), "template string, exact boolean, pairs int, place int, a string, b string").withColumn("h", F.xxhash64("a", "b"))


def words(text: Column) -> Column:
    """Lower-cased words. Splitting takes time in proportion to the text; matching all words copies the text for each."""
    parts = F.split(ascii_lower(text), BETWEEN)
    first, last = (F.get(parts, F.lit(0)) == "").cast("int"), ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")
    return F.slice(parts, first + 1, F.size(parts) - first - last)


def longest_chain(hits: Iterator[tuple[int, int]], reach: int) -> int:
    """The most (at, place) pairs, given in order of at, that rise in both within `reach` places of text.

    Only a window with more different places than the longest chain so far is looked into.
    """
    best, held, places = 0, deque(), Counter()

    def look(best: int) -> int:
        if len(places) <= best:
            return best
        tails: list[int] = []
        for _, place in sorted(held, key=lambda h: (h[0], -h[1])):  # of one place in the text a chain takes one
            i = bisect_left(tails, place)
            tails[i : i + 1] = [place]
        return max(best, len(tails))

    def drop() -> None:
        _, place = held.popleft()
        places[place] -= 1
        if not places[place]:
            del places[place]

    for at, place in hits:
        if held and held[0][0] + reach <= at:
            best = look(best)
            while held and held[0][0] + reach <= at:
                drop()
        held.append((at, place))
        places[place] += 1
    return look(best)


def in_text_order(diagonals: Iterator[tuple[int, list[int]]]) -> Iterator[tuple[int, int]]:
    """(at, place) by at, of (diagonal, places) by diagonal: what is held is not more than a template's length of diagonals."""
    held: list[tuple[int, int]] = []
    for diagonal, places in diagonals:
        while held and held[0][0] < diagonal:
            yield heapq.heappop(held)
        for place in places:
            heapq.heappush(held, (diagonal + place, place))
    while held:
        yield heapq.heappop(held)


class _Found:
    """What the votes of one text come to, template by template."""

    def __init__(self) -> None:
        self.base, self.labels, self.score = [], set(), 0.0

    def add(self, template: str, pairs: int, exact: bool, diagonals: Iterator[tuple[int, list[int]]]) -> None:
        kind, label = template.split(":")
        if exact:
            for diagonal, places in diagonals:
                self.score = max(self.score, len(places) / pairs)
                if len(places) == pairs:
                    self.labels.add(label)
                    if kind == "phrase":
                        self.base.append((diagonal, label))
        else:
            share = longest_chain(in_text_order(diagonals), int(REACH * pairs)) / pairs
            self.score = max(self.score, share)
            if share >= SIMILAR:
                self.labels.add(label)

    def row(self) -> tuple:
        at = [d for d, _ in self.base]
        return len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in self.base})), ",".join(sorted(self.labels)), self.score


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each row of docs.

    n_base counts all places of the phrases; labels holds the phrases' labels and those of verified grants and texts. A
    grant must stand whole on one diagonal. Of a wording, SIMILAR of its pairs must stand in order within a stretch of
    REACH times its pairs. score is the largest share of a template's pairs found so (1 for whole templates). Null and
    empty texts have no words, no labels and score 0; a text of one word has no pairs. Repeated rows get equal results,
    an empty table none. Only the two named columns are read, so clashing names don't matter. Long texts are cut into
    pairs row by row, and their hits are verified in windows of the text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text_ = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # rows are known by id and text, so that repeated and null ids don't mix
    split = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(key), text_).alias("row_key"), words(text_).alias("w"))
    # one pass: after a text's words comes a pair of nulls, whose place is their number
    pair = F.arrays_zip(F.concat("w", F.array(F.lit(None).cast("string"))).alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    at = split.select("doc_id", "row_key", F.posexplode(pair).alias("at", "p"))
    at = at.select("doc_id", "row_key", "at", F.xxhash64("p.a", "p.b").alias("h"), F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    end = spark.createDataFrame([("", False, 0, 0, None, None)], "template string, exact boolean, pairs int, place int, ta string, tb string").withColumn("h", F.xxhash64("ta", "tb"))
    known = templates(spark).withColumnsRenamed({"a": "ta", "b": "tb"}).unionByName(end)  # as many rows as the tables above have pairs
    hits = at.join(F.broadcast(known), "h").where(F.col("a").eqNullSafe(F.col("ta")) & F.col("b").eqNullSafe(F.col("tb")))
    votes = hits.select("doc_id", "row_key", "template", "exact", "pairs", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    diagonals = votes.groupBy("doc_id", "row_key", "template", "exact", "pairs", "diagonal").agg(F.collect_set("place").alias("places"), F.count(F.when(F.col("template") == "", 1)).alias("copies"))
    kind = docs.schema[key].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by text, template ("" first) and diagonal; rows of equal texts and ids are told by the copies of the first."""
        rows = ((x.column(0).type, *r) for x in batches for r in zip(*(c.to_pylist() for c in x.columns), strict=True))
        ids, done, found = [], [], None
        r = next(rows, None)
        while r is not None:
            id_type, doc_id, row_key, template, exact, pairs, diagonal, _, copies = r
            if template == "":
                n_words, times, found = diagonal, copies, _Found()
                r = next(rows, None)
            else:
                own, r = (row_key, template), r

                def same() -> Iterator[tuple[int, list[int]]]:
                    nonlocal r
                    while r is not None and (r[2], r[3]) == own:  # noqa: B023
                        yield r[6], r[7]
                        r = next(rows, None)

                found.add(template, pairs, exact, same())
            if r is None or r[3] == "":
                got = (n_words, *found.row())
                for _ in range(times):
                    ids.append(doc_id)
                    done.append(got)
                    if len(ids) >= 2000:
                        yield made(ids, done, id_type)
                        ids, done = [], []
        if ids:
            yield made(ids, done, id_type)

    def made(ids: list, done: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*done, strict=True), fields, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *columns], names=["doc_id", *(n for n, _ in fields)])

    return diagonals.repartition("doc_id", "row_key").sortWithinPartitions("row_key", "doc_id", "template", "diagonal").mapInArrow(verified, out)


def base_py(text: str | None) -> tuple:
    """Brute force for one text: n_words, n_base, first_word, last_word, base_labels."""
    w = re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    at = sorted((i, label) for label, phrase in PHRASES.items() for i in range(len(w)) if w[i : i + len(p := phrase.split())] == p)
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({label for _, label in at}))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The rule as SQL, written down apart from the code above: chains grow hit by hit from each first one.
ORACLE = rf"""
WITH RECURSIVE t(template, exact, pairs, place, a, b) AS (VALUES {", ".join(f"('{t}', {str(e).lower()}, {n}, {i}, '{a}', '{b}')" for t, e, n, i, a, b in template_pairs())}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(len(w) - 1)) AS i, w FROM w WHERE len(w) > 1),
hit AS (SELECT doc_id, template, exact, pairs, i AS pos, place FROM (SELECT doc_id, i, w[i + 1] AS a, w[i + 2] AS b FROM p) JOIN t USING (a, b)),
chain AS (SELECT doc_id, template, pairs, pos AS since, pos, place, 1 AS n FROM hit WHERE NOT exact
  UNION SELECT c.doc_id, c.template, c.pairs, c.since, h.pos, h.place, c.n + 1 FROM chain c JOIN hit h ON h.doc_id = c.doc_id AND h.template = c.template AND h.pos > c.pos AND h.place > c.place AND h.pos - c.since < floor({REACH} * c.pairs)),
s AS (SELECT doc_id, template, pos - place AS diagonal, count(DISTINCT place) / pairs AS share FROM hit WHERE exact GROUP BY doc_id, template, pairs, pos - place
  UNION ALL SELECT doc_id, template, NULL, max(n) / pairs FROM chain GROUP BY doc_id, template, pairs),
v AS (SELECT *, split_part(template, ':', 1) AS kind, split_part(template, ':', 2) AS label, CASE WHEN split_part(template, ':', 1) = 'text' THEN share >= {SIMILAR} ELSE share = 1 END AS verified FROM s),
f AS (SELECT doc_id, count(*) FILTER (WHERE verified AND kind = 'phrase') AS n_base, min(diagonal) FILTER (WHERE verified AND kind = 'phrase') AS first_word, max(diagonal) FILTER (WHERE verified AND kind = 'phrase') AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE verified AND kind = 'phrase') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE verified) AS labels, max(share) AS score FROM v GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM w LEFT JOIN f USING (doc_id)
"""
