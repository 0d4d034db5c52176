"""Content-addressed WARC archive.

Payload bytes are stored once for each SHA-256 digest; each record's exact header bytes are kept in a separate table
with the digest of its payload. Original records are rebuilt by joining the two.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import bounded_batches, durable

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Date written into records whose table has none; smallest payload for which a revisit is written; rows that may be broadcast.
DATE, LEAST_BYTES, BROADCAST_ROWS = "2024-01-01T00:00:00Z", 0, 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """RFC 4648 base32 of 20 bytes given as 40 hex digits: each five hex digits are four letters."""
    fives = [F.conv(F.substring(digest, 5 * j + 1, 5), 16, 10).cast("int") for j in range(8)]
    return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(fives[i // 4], 15 - 5 * (i % 4)).bitwiseAND(31) + 1, F.lit(1)) for i in range(32)))


def _records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, bytes, sha256, sha1 (base32) of each row."""
    body = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    return rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha256": F.sha2("payload", 256), "sha1": base32_of_hex(F.sha1("payload"))})


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        out = []
        for page, url, n, sha1, owner, revisit in zip(x["page_id"], x["url"], x["bytes"], x["sha1"], x["owner"], x["revisit"], strict=True):
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
            target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
            lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if pd.isna(page) else int(page)}>", f"WARC-Date: {DATE}"]
            lines += [f"WARC-Target-URI: {target}"] * bool(target)
            lines += [f"WARC-Refers-To: <urn:page:{int(owner)}>", f"WARC-Profile: {PROFILE}"] if revisit else []
            lines += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n)}", "", ""]
            out.append("\r\n".join(lines).encode() + http)
        yield pd.DataFrame({"page_id": x["page_id"].astype("Int64"), "sha256": x["sha256"], "revisit": x["revisit"], "header": out})


def archive(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of the archive of pages (page_id, url, html), both written as tables.

    headers: page_id, sha256, revisit, header (bytes up to the payload). payloads: sha256, payload, one row a digest.
    Among equal payloads of at least least_bytes bytes the largest page_id is the response and the others revisit it;
    a repeated page_id with the same payload is a response each time. Null html is an empty payload; a null or empty
    url gives no target line; a null page_id is the smallest. Equal SHA-256 with other length or SHA-1 is an error.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    records = _records(pages)
    index = durable(records.drop("payload"), "warc-index")
    same = (F.min("bytes") == F.max("bytes")) & (F.min("sha1") == F.max("sha1"))
    groups = index.groupBy("sha256").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n"), F.when(~same, F.raise_error(F.lit("two payloads have one digest"))).otherwise(F.lit(True)).alias("same"))
    several = durable(groups.where("n > 1 AND same").select("sha256", "owner"), "warc-groups")
    joined = index.join(several.withColumn("grouped", F.lit(True)), "sha256", "left")
    revisit = F.coalesce(F.col("grouped"), F.lit(False)) & (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    head = joined.withColumn("revisit", revisit).select("page_id", "url", "bytes", "sha1", "sha256", "owner", "revisit")
    headers = durable(head.mapInPandas(_headers, "page_id long, sha256 string, revisit boolean, header binary"), "warc-headers")
    # payloads of one record pass without a shuffle if the other groups are few; of these the owner's is kept, once
    stored = records.select("page_id", "sha256", "payload")
    if several.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marked = stored.join(F.broadcast(several.withColumn("grouped", F.lit(True))), "sha256", "left")
    else:
        kept = joined.where(F.col("grouped").isNull() | F.col("page_id").eqNullSafe(F.col("owner")))
        kept = kept.select(F.col("page_id").alias("kept_id"), F.col("sha256").alias("kept_sha"), "owner", "grouped").distinct()
        marked = stored.join(kept, F.col("page_id").eqNullSafe(F.col("kept_id")) & (F.col("sha256") == F.col("kept_sha")))
    single = marked.where("grouped IS NULL").select("sha256", "payload")
    once = marked.where(F.col("grouped") & F.col("page_id").eqNullSafe(F.col("owner"))).select("sha256", "payload").dropDuplicates(["sha256"])
    return headers, durable(single.unionByName(once), "warc-payloads")


def restore(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id, sha256, record: the original WARC records, byte for byte, ended by two line ends; null without a payload."""
    body = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(payloads, "sha256", "left").select("page_id", "sha256", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    lines = head.decode().split("\r\n")
    return lines[0], dict(line.split(": ", 1) for line in lines[1:])


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        out = []
        for page, sha256, record in zip(x["page_id"], x["sha256"], x["record"], strict=True):
            if record is None:
                raise ValueError("a record has no stored payload")
            head, _, rest = bytes(record).partition(b"\r\n\r\n")
            version, fields = _fields(head)
            if version != "WARC/1.1":
                raise ValueError("not a WARC record")
            block, end = rest[:-4], rest[-4:]
            http, _, body = block.partition(b"\r\n\r\n")
            n, digest, response = int(_fields(http)[1]["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
            if response and (base64.b32encode(hashlib.sha1(body).digest()).decode() != digest or hashlib.sha256(body).hexdigest() != sha256):
                raise ValueError("a stored payload has another digest than its record")
            if len(block) != int(fields["Content-Length"]) or end != b"\r\n\r\n" or len(body) != (n if response else 0):
                raise ValueError("a record has another Content-Length than its bytes")
            refers = fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
            out.append((page, sha256, n, digest, fields["WARC-Type"], int(refers) if refers else None))
        got = pd.DataFrame(out, columns=["page_id", "sha256", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        yield got.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def read_back(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as the archive's bytes say.

    Every record is rebuilt and parsed. Digests are computed anew from the stored bytes and must equal those in the
    headers, and so must lengths; a mismatch is an error. A revisit holds no payload: the one it stands for is compared.
    Repeated rows are read each. Empty tables give an empty result. Very long payloads are read whole, and columns beside
    those of an archive take no part.
    """
    schema = "page_id long, sha256 string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    responses = restore(headers.where("NOT revisit"), payloads).mapInPandas(_parsed, schema)
    revisits = restore(headers.where("revisit"), payloads.where("false")).mapInPandas(_parsed, schema)
    found = payloads.select("sha256", F.octet_length("payload").cast("long").alias("stored_bytes"), base32_of_hex(F.sha1("payload")).alias("stored"), F.sha2("payload", 256).alias("again"))
    right = (F.col("stored") == F.col("payload_digest")) & (F.col("again") == F.col("sha256"))
    digest = F.when(right, F.col("stored")).otherwise(F.raise_error(F.lit("a stored payload has another digest than its record")))
    absent = F.raise_error(F.lit("a record has no stored payload"))
    size = F.when(F.col("stored_bytes").isNull(), absent).when(F.col("stored_bytes") == F.col("payload_bytes"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a record has another Content-Length than its bytes")))
    revisits = revisits.join(found, "sha256", "left").select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
    return responses.select(*revisits.columns).unionByName(revisits)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(*archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM d
"""
