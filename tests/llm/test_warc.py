"""The archive: SQL, exact round trip, edges."""

import base64
import hashlib

import pytest
from conftest import DATA, rows_of

from rivulet.llm import warc

SCHEMA = "page_id long, url string, html string, sha256 string"


def expected(rows, least=0):
    groups = {}
    for p, _, h, *_ in rows:
        groups.setdefault(h or "", []).append(p)
    out = []
    for p, _, h, *_ in rows:
        body = (h or "").encode()
        own = [x for x in groups[h or ""] if x is not None]
        owner = max(own) if own else None
        again = len(body) >= least and p != owner
        out.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", owner if again else None))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()), key=repr)


def test_pages(spark, oracle):
    assert rows_of(warc.op6_warc(spark, f"{DATA}/sf0.001")) == oracle("sf0.001", warc.ORACLE)


ROWS = [(i, f"http://a/{i % 5}\r\nx", f"page {i % 4}", "x") for i in range(40)] + [(50, None, None, "x"), (51, "", "", "x"), (60, "u", "é" * 100_000, "x"), (61, "u", "alone", "x"), (61, "u", "alone", "x"), (None, "u", "page 1", "x"), (None, "u", "only null", "x")]


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("least", [0, 5, 7])
def test_edges_and_round_trip(spark, monkeypatch, few, least):
    if not few:
        monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    headers, payloads = warc.archive(spark.createDataFrame(ROWS, SCHEMA), least)
    assert payloads.count() == len({r[2] or "" for r in ROWS})  # each payload once
    assert result(warc.read_back(headers, payloads)) == expected(ROWS, least)
    records = [bytes(r["record"]) for r in warc.restore(headers, payloads).collect()]
    assert len(records) == len(ROWS)
    for r in records:
        head, _, rest = r.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        block = rest[: int(fields[b"Content-Length"])]
        assert rest[len(block) :] == b"\r\n\r\n" and r.startswith(b"WARC/1.1\r\n")
        body = block.partition(b"\r\n\r\n")[2]
        if fields[b"WARC-Type"] == b"response":
            assert b"sha1:" + base64.b32encode(hashlib.sha1(body).digest()) == fields[b"WARC-Payload-Digest"]
        else:
            assert body == b"" and b"WARC-Refers-To" in fields


def test_empty_and_damaged(spark):
    headers, payloads = warc.archive(spark.createDataFrame([], SCHEMA))
    assert warc.read_back(headers, payloads).count() == 0
    headers, payloads = warc.archive(spark.createDataFrame(ROWS[:3], SCHEMA))
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="another digest"):
        warc.read_back(headers, payloads.withColumn("payload", F.lit(b"changed"))).collect()


def test_wrong_lengths(spark):
    from pyspark.sql import functions as F

    headers, payloads = warc.archive(spark.createDataFrame(ROWS[:6], SCHEMA))
    for kind in ("NOT revisit", "revisit"):
        for name in ("Content-Length: ", "charset=utf-8\\r\\nContent-Length: "):
            longer = F.regexp_replace(F.col("header").cast("string"), f"({name})([0-9]+)", "$19$2").cast("binary")
            damaged = headers.where(kind).withColumn("header", longer)
            with pytest.raises(Exception, match="another Content-Length"):
                warc.read_back(damaged, payloads).collect()
    with pytest.raises(Exception, match="no stored payload|another digest"):
        warc.read_back(headers, payloads.where("false")).collect()
