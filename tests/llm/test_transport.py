"""Transport streams: exact round trip, damage, edges."""

import hashlib
import struct
import zlib

import pytest
from conftest import DATA

from rivulet.llm import transport as ts


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 100, 127, 128, 158, 159, 160, 176, 177, 184, 300, 1000, 16_383, 16_384, 16_385, 16_384 * 9 + 7, 400_000])
def test_round_trip(n):
    data = bytes((i * 31 + n) % 251 for i in range(n))
    payload = ts.padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= max(64, n) and len(payload) < n + 64 + (n == 0)
    media, times = ts.mux(payload, n)
    assert len(media) % 188 == 0 and all(media[i] == 0x47 for i in range(0, len(media), 188))
    d = ts.Demuxed(media)
    assert (d.payload, d.length, d.breaks, d.times) == (payload, n, 0, times)
    assert len(d.times) == -(-len(payload) // ts.CHUNK)
    assert [t[0] for t in d.times] == [i * ts.TICKS for i in range(len(d.times))]
    assert [t[2] for t in d.times] == [i % ts.GROUP == 0 for i in range(len(d.times))]


def test_all_sizes_of_last_packets():
    for n in range(64, 64 * 60, 64):
        assert ts.Demuxed(ts.mux(b"x" * n, n)[0]).payload == b"x" * n


def test_damage():
    media, _ = ts.mux(ts.padded(b"y" * 5000), 5000)
    gap = bytearray(media)
    gap[188 * 5 + 3] ^= 4
    assert ts.Demuxed(bytes(gap)).breaks == 2
    for at, what in ((0, "sync"), (15, "CRC")):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ValueError, match=what):
            ts.Demuxed(bytes(broken))
    with pytest.raises(ValueError, match="isn't whole"):
        ts.Demuxed(media[:-188])
    assert ts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_frames(spark):
    schema = "doc_id long, text string, media string"
    texts = [None, "", "a", "é" * 64, "long " * 100_000, "a"]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)]
    got = ts.features(ts.store(spark.createDataFrame(rows, schema))).collect()
    assert len(got) == len(rows)
    for r in got:
        data = (texts[r.doc_id or 0] or "").encode()
        payload = ts.padded(data)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(ts.mux(payload, len(data))[0]).hexdigest()
    assert len({r.media_sha256 for r in got}) == 4  # equal texts, equal media
    assert ts.features(ts.store(spark.createDataFrame([], schema))).count() == 0


def read_packet_by_packet(media):
    """payload, feature and times by a plain reader of one packet at a time, written down apart from the operator."""
    packets, tables, breaks, last, es = 0, 0, 0, {}, {}
    times, pes, payload = [], None, b""

    def ended(x):
        assert x[:4] == b"\0\0\1\xbd" and struct.unpack(">H", x[4:6])[0] == len(x) - 6
        return x[9 + x[8] :]

    for n in range(0, len(media), 188):
        p = media[n : n + 188]
        assert p[0] == 0x47
        pid, counter, start = (p[1] & 0x1F) << 8 | p[2], p[3] & 15, p[1] >> 6 & 1
        breaks += pid in last and (last[pid] + 1) % 16 != counter
        last[pid] = counter
        body, random = p[4:], False
        if p[3] & 0x20:
            random = p[4] > 0 and bool(p[5] & 0x40)
            body = p[5 + p[4] :]
        if pid == 0:
            tables += 1
            es["pmt"] = struct.unpack(">H", body[1 + 8 + 2 : 1 + 8 + 4])[0] & 0x1FFF
        elif pid == es["pmt"]:
            tables += 1
            info = struct.unpack(">H", body[1 + 10 : 1 + 12])[0] & 0xFFF
            es["data"] = struct.unpack(">H", body[1 + 12 + info + 1 : 1 + 12 + info + 3])[0] & 0x1FFF
        else:
            assert pid == es["data"]
            if start:
                payload += ended(pes) if pes is not None else b""
                pes = b""
                t = body[9:14]
                times.append(((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1, packets, random))
            pes += body
        packets += 1
    payload += ended(pes)
    points = [(a, b) for a, b, c in times if c]
    index = zlib.crc32(b"".join(struct.pack("<qq", *x) for x in points))
    return payload, f"packets={packets};tables={tables};pes={len(times)};breaks={breaks};random_access={len(points)};first_pts={times[0][0]};last_pts={times[-1][0]};index_crc={index:08x}", times


def test_query_against_a_plain_reader(spark):
    d = f"{DATA}/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    media = {r.doc_id: r for r in ts.store(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    rows = ts.op8_transport(spark, d).collect()
    assert len(rows) == len(docs) and max(len(r.times) for r in rows) > 1
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        stored = bytes(media[r.doc_id].media)
        payload, feature, times = read_packet_by_packet(stored)
        assert payload == ts.padded(data) and (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(payload), len(stored))
        assert (r.payload_sha256, r.tail_crc32, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(stored).hexdigest())
        assert r.feature == feature and [tuple(t) for t in r.times] == times == [tuple(t) for t in media[r.doc_id].times]


def test_stored_times_must_be_the_streams(spark):
    stored = ts.store(spark.createDataFrame([(1, "abc " * 20_000)], "doc_id long, text string"))
    media, times = stored.select("media", "times").first()
    for t in times:  # a reader starts at a random-access point's packet
        p = bytes(media)[188 * t.packet : 188 * (t.packet + 1)]
        assert p[1] & 0x40 and (not t.random_access or p[3] & 0x20)
    with pytest.raises(Exception, match="times are not the stream's"):
        ts.features(stored.selectExpr("doc_id", "media", "slice(times, 2, 100) AS times")).collect()
