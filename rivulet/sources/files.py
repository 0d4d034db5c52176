"""Files and sinks: text lines, JSON directories, Parquet topics, idempotent batch commits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

CODECS = ("none", "gzip", "snappy", "lz4", "zstd")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: one row a line; line ends may be \\n, \\r or \\r\\n."""
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("append").text(path)


def to_topics(df: DataFrame, path: str, topic: str = "topic", codec: str = "zstd") -> None:
    """A sink with a folder for each topic; the topic may be computed for each record."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec: {codec}")
    df.write.mode("append").partitionBy(topic).option("compression", codec).parquet(path)


def read_topics(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """Topics as written by to_topics; one topic reads only its folder."""
    df = spark.read.parquet(path)
    return df if topic is None else df.where(F.col("topic") == topic)


def exactly_once(path: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes each batch into a folder of its own: a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def lines_of(data: bytes, position: int, last: bool = False) -> tuple[list[tuple[int, str]], int]:
    """([(position after the line, line)], position): whole lines of a file's bytes from a position on.

    Lines end by \\n, \\r or \\r\\n. A last line without an end is held back, and so is one that ends by \\r if more may
    come, since a \\n may follow; with `last` nothing is held back.
    """
    out, at = [], 0
    while at < len(data):
        ends = [i for i in (data.find(b"\n", at), data.find(b"\r", at)) if i >= 0]
        if not ends or data[min(ends)] == 13 and min(ends) + 1 == len(data) and not last:
            break
        end = min(ends)
        after = end + (2 if data[end : end + 2] == b"\r\n" else 1)
        out.append((position + after, data[at:end].decode("utf-8", "replace")))
        at = after
    if last and at < len(data):
        out.append((position + len(data), data[at:].decode("utf-8", "replace")))
        at = len(data)
    return out, position + at


class _Tail(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("bytes", 1 << 20))

    def initialOffset(self) -> dict:
        return {"position": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        with open(self.path, "rb") as f:
            f.seek(start["position"])
            data = f.read(self.most)
            while len(data) % self.most == 0 and data and not {10, 13} & {*data} and (more := f.read(self.most)):
                data += more  # one line longer than a read
        found, position = lines_of(data, start["position"])
        return iter([(self.path, p, line) for p, line in found]), {"position": position}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(start["position"])
            data = f.read(end["position"] - start["position"])
        return iter([(self.path, p, line) for p, line in lines_of(data, start["position"], True)[0]])


class TailSource(DataSource):
    """A file's lines as they are appended: path, position (the offset to go on from), value. The file is the driver's."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, position long, value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Tail(self.options)


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _SequenceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.rows, self.parts = int(options.get("rows", "100")), int(options.get("partitions", "4"))
        self.topic = options.get("topic", "verifiable")

    def partitions(self) -> list[_Range]:
        step = -(-self.rows // self.parts)
        return [_Range(a, min(self.rows, a + step)) for a in range(0, self.rows, step)]

    def read(self, partition: _Range):
        for i in range(partition.start, partition.end):
            yield self.topic, i, i * 1000, str(i)


class SequenceSource(DataSource):
    """A verifiable source: consecutive sequence numbers, `rows` of them over `partitions` readers."""

    @classmethod
    def name(cls) -> str:
        return "sequence"

    def schema(self) -> str:
        return "topic string, offset long, ts long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _SequenceReader(self.options)
