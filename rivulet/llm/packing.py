"""Best-fit packing by a linear grouping scheme.

Pieces have integer lengths, so the packing is planned on the counts of each length, whatever the number of documents:
large lengths are rounded up within groups of equal cardinality, a linear program over configurations of these few
sizes (column generation with a knapsack) says how many sequences hold which sizes, actual lengths take the places of
the rounded ones, and small pieces go where they fit best. Documents then find their sequence from their rank within
their length.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import bounded_batches, durable

CAPACITY, END_ID = 1024, 2
VOCABULARY = "byte_bpe_50k.json"
#: Pieces under this length are small; sizes of the linear program; simplex steps at most (the packing stays valid if it stops early).
SMALL, GROUPS, STEPS = 256, 96, 600
#: Rows of one length that one task ranks.
RANK_ROWS = 50_000
#: Bytes, about, that a worker's remembered ids of word pieces may take; characters of the longest that it remembers.
REMEMBERED_BYTES, REMEMBERED_CHARS = 96 << 20, 64
#: Characters, about, of a text that are encoded at a time; characters of a window of an unbroken piece, and tokens that two windows share.
PART_CHARS, WINDOW, SHARED = 1 << 16, 1 << 14, 128

_tokenizers: dict[str, _Ids] = {}


def _class(kind: str) -> str:
    """The plain characters of a Unicode category as the inside of a character class."""
    points = [c for c in _PLAIN if unicodedata.category(chr(c)).startswith(kind)]
    runs = [[points[0], points[0]]]
    for c in points[1:]:
        if c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{re.escape(chr(x))}-{re.escape(chr(y))}" for x, y in runs)


#: Characters (white space, ASCII, Latin letters and signs) on which Python's and the tokenizer's patterns agree.
_PLAIN = [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)]
#: Byte-level vocabularies show each byte as a printable character: itself, or the next from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}


class _Ids(dict):
    """Pre-tokenised piece -> its ids as little-endian 32-bit bytes.

    The tokenizer splits a text by its pattern and encodes each piece by itself, so pieces can be remembered. Texts of
    plain characters are split here; others, and all texts if the vocabulary isn't a byte-level one, by the tokenizer.
    Of remembered pieces there are a younger and an older half; the older goes when the younger has its share of bytes.
    Long texts are cut where no piece can span, and long pieces are encoded in windows, so memory doesn't follow the
    length of a text.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        letter, number = _class("L"), _class("N")
        space = r"\t\n\r "
        self.split = re.compile(f" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        self.byte_level = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.plain = re.compile(f"[{''.join(re.escape(chr(c)) for c in _PLAIN)}]*").fullmatch if self.byte_level else lambda text: None
        spare = iter(range(256, 512))
        self.shown = {b: b if b in _PRINTABLE else next(spare) for b in range(256)}
        self.space = chr(self.shown[32])
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.older: dict[str, bytes] = {}
        self.taken = 0

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            if part.isascii() and part.isprintable():
                shown = part.replace(" ", self.space)
            else:
                shown = part.encode().decode("latin-1").translate(self.shown)
            ids = self.piece(shown)
        if len(part) <= REMEMBERED_CHARS:
            self.taken += 170 + len(part) + len(ids)  # of both objects and the table's entry
            if self.taken > REMEMBERED_BYTES // 2:
                self.older, self.taken = dict(self), 0
                self.clear()
            self[part] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.older, self.taken = {}, 0

    def piece(self, shown: str) -> bytes:
        """The ids of one pre-tokenised piece.

        Tokens that are valid side by side in pairs are the one encoding of their text, so the windows of a long piece
        are joined at a token that both have at the same place. A window starts where the one before has a token.
        """
        if len(shown) <= WINDOW:
            return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(shown)])
        out, (ids, starts), end = [], self.window(shown, 0), WINDOW
        while end < len(shown):
            back = max(1, len(ids) - SHARED)
            next_ids, next_starts = self.window(shown, starts[back])
            places = {x: i for i, x in enumerate(zip(next_starts[:SHARED], next_ids[:SHARED], strict=True))}
            joint = next((j for j in range(back, len(ids)) if (starts[j], ids[j]) in places), None)
            if joint is None:
                return np.array([t.id for t in self.model.tokenize(shown)], dtype="<u4").tobytes()
            out.append(np.array(ids[:joint], dtype="<u4").tobytes())
            end, i = starts[back] + WINDOW, places[starts[joint], ids[joint]]
            ids, starts = next_ids[i:], next_starts[i:]
        return b"".join([*out, np.array(ids, dtype="<u4").tobytes()])

    def window(self, shown: str, start: int) -> tuple[list[int], list[int]]:
        tokens = self.model.tokenize(shown[start : start + WINDOW])
        starts = start + np.cumsum([0, *(len(t.value) for t in tokens)])
        return [t.id for t in tokens], starts[:-1].tolist()

    def parts(self, text: str) -> Iterator[str]:
        """text, cut before single spaces between letters."""
        at = 0
        while len(text) - at > PART_CHARS and self.byte_level and (cut := _CUT(text, at + PART_CHARS)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def whole(self, text: str) -> bytes:
        if self.byte_level and len(text) > PART_CHARS:
            return b"".join(self.piece(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.__getitem__, self.split(t))) if self.plain(t) else self.whole(t) for t in self.parts(text))


_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])").search


def token_bytes(text: str | None, vocabulary: str = VOCABULARY) -> bytes:
    """The ids of a text, without an end id, as little-endian 32-bit bytes; null is empty."""
    if vocabulary not in _tokenizers:
        _tokenizers[vocabulary] = _Ids(vocabulary)
    return _tokenizers[vocabulary].encode(text or "")


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents longer than capacity are cut so that only the first piece may be shorter."""
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from map(cut, batches)
        finally:  # idle workers, of which an executor may keep several, hold no pieces
            for t in _tokenizers.values():
                t.forget()

    def cut(x: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, text in zip(x.column(0).to_pylist(), x.column(1), strict=True):
            ids = token_bytes(text.as_py(), vocabulary) + end
            n = len(ids) // 4
            first = (n - 1) % capacity + 1
            starts = [0, *range(first, n, capacity)]
            out += [(doc_id, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True))]
        columns = zip(*out, strict=True) if out else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes of the highest worth within the capacity."""
    use = np.flatnonzero(worth > 1e-12)
    sizes_, worth_ = sizes[use], worth[use]
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    if len(use):
        for c in range(int(sizes_.min()), capacity + 1):
            v = np.where(sizes_ <= c, best[np.maximum(c - sizes_, 0)] + worth_, -1.0)
            i = int(v.argmax())
            best[c], last[c] = (v[i], i) if v[i] > best[c - 1] else (best[c - 1], -2)
    out, c = np.zeros(len(sizes)), capacity
    while c > 0 and last[c] != -1:
        if last[c] == -2:
            c -= 1
        else:
            out[use[last[c]]] += 1
            c -= int(sizes_[last[c]])
    return float(best[capacity]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, counts by size): whole-number parts of the configuration program's solution; the rest of the demand is left."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(STEPS):
        dual = np.linalg.solve(basis.T, np.ones(k))
        worth, column = _knapsack(sizes, dual, capacity)
        if worth <= 1 + 1e-7:
            break
        x, d = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.floor(np.linalg.solve(basis, demand) + 1e-9).astype(np.int64)
    return [(int(n), basis[:, i].astype(np.int64)) for i, n in enumerate(x) if n > 0]


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """(times, lengths): so many sequences hold these lengths, in order; together they hold exactly the counts.

    The number of entries depends on the number of lengths and groups, not on the number of pieces.
    """
    out: list[tuple[int, list[int]]] = [(n, [length]) for length, n in counts.items() if length == capacity and n]
    queues: list[list[list[int]]] = []  # by group: [length, left], longest first
    large = sorted(((length, n) for length, n in counts.items() if small <= length < capacity and n), reverse=True)
    total, seen = sum(n for _, n in large), 0
    for length, n in large:
        while n:
            g = seen * groups // total
            upto = -(-(g + 1) * total // groups)  # pieces before the next group
            take = min(n, upto - seen)
            while len(queues) <= g:
                queues.append([])
            if queues[g] or g == 0 or not queues[g - 1] or queues[g - 1][0][0] != length:
                queues[g].append([length, take])
            else:  # a length as long as the group's before: one size less
                queues[g - 1][-1][1] += take
            n, seen = n - take, seen + take
    queues = [q for q in queues if q]
    filled: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]  # by room left

    def add(times: int, held: list[int]) -> None:
        filled[capacity - sum(held)].append((times, held))

    if queues:
        sizes = np.array([q[0][0] for q in queues])
        demand = np.array([sum(n for _, n in q) for q in queues], dtype=float)
        for times, column in configurations(sizes, demand, capacity):
            wanted = [(g, int(a)) for g, a in enumerate(column) if a]
            while times:
                runs = [q[0][1] // a for g, a in wanted if (q := queues[g])]
                if not runs:
                    break
                step = min(times, max(1, min(runs)))
                held = []
                for g, a in wanted:
                    q = queues[g]
                    for _ in range(a):
                        if q:
                            held.append(q[0][0])
                            q[0][1] -= step
                            if not q[0][1]:
                                q.pop(0)
                            elif q[0][1] < 0:
                                raise AssertionError("a run was overdrawn")
                add(step, held)
                times -= step
    rest = Counter({length: n for length, n in counts.items() if 0 < length < small})
    for q in queues:
        for length, n in q:
            rest[length] += n
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            room = next((r for r in range(length, capacity) if filled[r]), capacity)
            times, held = filled[room].pop() if filled[room] else (left, [])
            each = room // length
            if (full := min(times, left // each)) == 0:
                full, each = 1, left
            if times > full and held:
                filled[room].append((times - full, held))
            add(full, [*held, *[length] * each])
            left -= full * each
    return out + [x for room in filled for x in room]


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    Null and empty texts are one piece that holds the end id alone. Repeated rows are packed each. An empty table gives
    an empty result. Texts are tokenised whole. The driver gets one count for each length up to the capacity; the plan
    has some thousand entries at any size. Only doc_id and text are read, so clashing names don't matter.
    """
    rows = durable(pieces(docs, capacity, vocabulary, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    runs: dict[int, list[tuple[int, int, int]]] = {length: [] for length in counts}  # of each length: first rank, sequence less rank, offset
    at, sequence = Counter(), 0
    for times, held in plan(counts, capacity):
        place = 0
        for length in held:
            runs[length].append((at[length], sequence - at[length], place))
            at[length] += times
            place += length
        sequence += times
    assert at == Counter(counts), "the plan holds other lengths than the pieces have"
    # one row for each length, at most `capacity` of them
    places = rows.sparkSession.createDataFrame([(length, x) for length, x in runs.items()], "length long, runs array<struct<first: long, sequence: long, offset: long>>")

    salts = max(16, -(-max(counts.values(), default=1) // RANK_ROWS))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("rank", rank).join(before, ["length", "salt"])
    placed = ranked.select("*", (F.col("before") + F.col("rank") - 1).alias("at")).join(F.broadcast(places), "length")
    # a length's runs are in order of their first rank: halving finds the last that starts at or before the row
    low = F.lit(0)
    for step in (1 << i for i in reversed(range(max(map(len, runs.values()), default=1).bit_length()))):
        low = F.when(F.get("runs", low + step)["first"] <= F.col("at"), low + step).otherwise(low)
        placed = placed.withColumn("low", low)
        low = F.col("low")
    run = F.get("runs", low)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (run["sequence"] + F.col("at")).alias("sequence_id"), run["offset"].alias("offset"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
