"""Media columns: MPEG transport streams.

A payload becomes a column of 188-byte transport packets: program tables (PAT and PMT, with CRC), and elementary
packets with presentation times, the first of each group a random-access point with a clock reference. The times and
random-access points stand in a column beside the media, so that a reader finds its place without parsing. Reading
parses the tables, checks continuity counters, reassembles the elementary packets, and holds their times against that
column.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import bounded_batches, durable

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
#: Stream type and id of private data in elementary packets; the descriptor that holds the unpadded length.
STREAM_TYPE, STREAM_ID, LENGTH_TAG = 0x06, 0xBD, 0x80
#: Payload bytes of an elementary packet, ticks (of 90 kHz) between two, elementary packets from one random-access point to the next.
CHUNK, TICKS, GROUP = 16_384, 3600, 8
BLOCK = 64

_CRC = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ (0x04C11DB7 if _c & 0x80000000 else 0)) & 0xFFFFFFFF
    _CRC.append(_c)


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | counter) + b"\0" + section).ljust(PACKET, b"\xff")


def padded(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(BLOCK - len(data) % BLOCK if not data or len(data) % BLOCK else 0)


def mux(payload: bytes, length: int) -> tuple[bytes, list[tuple[int, int, bool]]]:
    """The transport stream of a payload, and (pts, packet, random access) of each of its elementary packets.

    length is kept in a descriptor of its program map.
    """
    pat = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    info = struct.pack(">BBQ", LENGTH_TAG, 8, length)
    pmt = _section(0x02, PROGRAM, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000 | len(info)) + info + struct.pack(">BHH", STREAM_TYPE, 0xE000 | DATA_PID, 0xF000))
    out, times, counter, tables, packets = [], [], 0, 0, 0
    for k, at in enumerate(range(0, len(payload), CHUNK)):
        data, pts = payload[at : at + CHUNK], k * TICKS % (1 << 33)
        stamp = bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 0xFF, 0x01 | (pts << 1 & 0xFE)])
        pes = b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, len(data) + 8, 0x80, 0x80, 5) + stamp + data
        field = b""
        if k % GROUP == 0:
            out += [_table_packet(PAT_PID, tables & 15, pat), _table_packet(PMT_PID, tables & 15, pmt)]
            tables, packets = tables + 1, packets + 2
            field = b"\x07\x50" + struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        times.append((pts, packets, bool(field)))
        first = True
        i = 0
        whole = (len(pes) - (184 - len(field))) // 184 if len(pes) > 184 - len(field) else 0
        while i < len(pes):
            room = 184 - len(field)
            left = len(pes) - i
            if left < room:  # the last packet: stuffing in the adaptation field
                stuff = room - left
                if field:
                    field = bytes([field[0] + stuff]) + field[1:] + b"\xff" * stuff
                else:
                    field = b"\0" if stuff == 1 else bytes([stuff - 1, 0]) + b"\xff" * (stuff - 2)
                room = left
            out.append(struct.pack(">BHB", SYNC, (0x4000 if first else 0) | DATA_PID, (0x30 if field else 0x10) | counter) + field + pes[i : i + room])
            counter, i, first, field, packets = counter + 1 & 15, i + room, False, b"", packets + 1
            if whole > 0 and i < len(pes):  # packets without a field in one step
                full = np.empty((whole, PACKET), np.uint8)
                full[:, 0], full[:, 1], full[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
                full[:, 3] = 0x10 | ((counter + np.arange(whole)) & 15)
                full[:, 4:] = np.frombuffer(pes, np.uint8, whole * 184, i).reshape(whole, 184)
                out.append(full.tobytes())
                counter, i, packets, whole = counter + whole & 15, i + whole * 184, packets + whole, 0
    return b"".join(out), times


class Demuxed:
    """payload, length (unpadded), times (pts, packet, random access) of each elementary packet, and counts."""

    def __init__(self, media: bytes):
        if not media or len(media) % PACKET:
            raise ValueError("not whole transport packets")
        p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
        if (p[:, 0] != SYNC).any():
            raise ValueError("a packet lost its sync byte")
        pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
        self.packets = len(p)
        pat = self._table(p, pid, PAT_PID, 0x00)
        programs = dict(struct.unpack(">HH", pat[i : i + 4]) for i in range(0, len(pat), 4))
        pmt_pid = programs[PROGRAM] & 0x1FFF
        pmt = self._table(p, pid, pmt_pid, 0x02)
        info = struct.unpack(">H", pmt[2:4])[0] & 0x0FFF
        tag, size = pmt[4], pmt[5]
        if tag != LENGTH_TAG or size != 8:
            raise ValueError("the program map has no length")
        self.length = struct.unpack(">Q", pmt[6:14])[0]
        kind, es = struct.unpack(">BH", pmt[4 + info : 7 + info])
        es &= 0x1FFF
        self.tables = int(((pid == PAT_PID) | (pid == pmt_pid)).sum())
        self.breaks = sum(self._breaks(p[pid == x]) for x in (PAT_PID, pmt_pid, es))
        at = np.flatnonzero(pid == es)
        own = p[at]
        has = (own[:, 3] & 0x20) > 0
        skip = np.where(has, own[:, 4].astype(np.int64) + 1, 0)
        random = has & (skip > 1) & ((own[:, 5] & 0x40) > 0)
        starts = np.flatnonzero(own[:, 1] & 0x40)
        body = own[:, 4:]
        keep = np.arange(184)[None, :] >= skip[:, None]
        parts, self.times = [], []
        for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
            pes = (body[a:b][keep[a:b]] if has[a:b].any() else body[a:b]).tobytes()
            if pes[:3] != b"\0\0\1" or pes[3] != STREAM_ID:
                raise ValueError("no elementary packet where one starts")
            size, _, flags, head = struct.unpack(">HBBB", pes[4:9])
            t = pes[9:14]
            pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1 if flags & 0x80 else -1
            if len(pes) != 6 + size:
                raise ValueError("an elementary packet isn't whole")
            parts.append(pes[9 + head :])
            self.times.append((pts, int(at[a]), bool(random[a])))
        self.payload = b"".join(parts)

    @staticmethod
    def _table(p: np.ndarray, pid: np.ndarray, wanted: int, table: int) -> bytes:
        data = p[int(np.argmax(pid == wanted))].tobytes()
        if not (pid == wanted).any() or data[5] != table:
            raise ValueError("a program table is missing")
        size = (struct.unpack(">H", data[6:8])[0] & 0x0FFF) + 3
        section = data[5 : 5 + size]
        if crc32_mpeg(section):
            raise ValueError("a program table's CRC is wrong")
        return section[8:-4]

    @staticmethod
    def _breaks(p: np.ndarray) -> int:
        c = (p[:, 3] & 15).astype(np.int64)
        return int((np.diff(c) % 16 != 1).sum())

    def feature(self) -> str:
        points = [t for t in self.times if t[2]]
        index = zlib.crc32(np.array([(a, b) for a, b, _ in points], dtype="<i8").tobytes())
        return f"packets={self.packets};tables={self.tables};pes={len(self.times)};breaks={self.breaks};random_access={len(points)};first_pts={self.times[0][0]};last_pts={self.times[-1][0]};index_crc={index:08x}"


TIMES = "array<struct<pts: long, packet: long, random_access: boolean>>"


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, media, times: each whole text (null: empty) as a transport stream, with its times and random-access points.

    times has (pts, packet, random_access) of each elementary packet. Equal texts, and so repeated rows, give equal
    media. A very long text is muxed whole, its row as large as itself. An empty table gives an empty result. Only the
    two named columns are read, so clashing names don't matter.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(f"media binary, times {TIMES}")
    def media(texts: pd.Series) -> pd.DataFrame:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        made = [mux(padded(x), len(x)) for x in raw]
        return pd.DataFrame({"media": [m for m, _ in made], "times": [_structs(t) for _, t in made]})

    return docs.select("doc_id", media(F.col(text).cast("string")).alias("m")).select("doc_id", "m.*")


def _structs(times: list[tuple[int, int, bool]]) -> list[dict]:
    return [{"pts": a, "packet": b, "random_access": c} for a, b, c in times]


def features(stored: DataFrame) -> DataFrame:
    """What the stored bytes of (doc_id, media, times) say; a damaged stream is an error, a gap in its counters a count.

    times, as read from the packets, must equal the stored column; a mismatch is an error. Repeated rows give equal
    rows, an empty table none. A very long stream is read whole. Further columns, whatever their names, take no part.
    """
    bounded_batches(stored.sparkSession)
    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times {TIMES}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for doc_id, media, times in zip(x["doc_id"], x["media"], x["times"], strict=True):
                d = Demuxed(media := bytes(media))
                if [(t["pts"], t["packet"], t["random_access"]) for t in times] != d.times:
                    raise ValueError("the stored times are not the stream's")
                out.append((doc_id, d.length, len(d.payload), hashlib.sha256(d.payload).hexdigest(), zlib.crc32(d.payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), d.feature(), _structs(d.times)))
            got = pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times"])
            got["doc_id"] = got["doc_id"].astype("Int64")
            yield got

    return stored.select(F.col("doc_id").cast("long"), "media", "times").mapInPandas(run, schema)


def op8_transport(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return features(durable(store(docs), "media"))
