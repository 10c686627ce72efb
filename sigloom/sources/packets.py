"""Packet captures as a data source, and older stream files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

PACKETS = "file string, pkt_no long, src string, dst string, sport int, dport int, ts timestamp, proto string, status string, payload binary"

#: Sequence numbers of packets of different files of one capture lie this far apart.
FILE_STEP = 1 << 40


def decode(data: bytes, name: str = "", first: int = 0) -> Iterator[tuple]:
    """Packets of a capture: Ethernet, IPv4, TCP and UDP; anything else is passed over, and a cut last packet ends it."""
    from datetime import UTC, datetime

    if len(data) < 24:
        return
    magic = data[:4]
    order = "<" if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    if magic not in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\xa1\xb2\x3c\x4d"):
        raise ValueError(f"{name}: not a packet capture")
    unit = 1e9 if magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1e6
    if struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF != 1:
        raise ValueError(f"{name}: not Ethernet")
    at, number = 24, first
    while at + 16 <= len(data):
        sec, frac, size, _ = struct.unpack_from(order + "IIII", data, at)
        frame = data[at + 16 : at + 16 + size]
        at += 16 + size
        if len(frame) < size:
            return
        number += 1
        kind, ip = (struct.unpack_from(">H", frame, 12)[0], 14) if len(frame) >= 14 else (0, 0)
        if kind == 0x8100 and len(frame) >= 18:
            kind, ip = struct.unpack_from(">H", frame, 16)[0], 18
        if kind != 0x0800 or len(frame) < ip + 20:
            continue
        head, total, proto = (frame[ip] & 15) * 4, struct.unpack_from(">H", frame, ip + 2)[0], frame[ip + 9]
        body, end = ip + head, min(len(frame), ip + total) if total else len(frame)
        if proto == 6 and len(frame) >= body + 20:
            flags, skip, name_ = frame[body + 13], (frame[body + 12] >> 4) * 4, "tcp"
            status = "rst" if flags & 4 else "fin" if flags & 1 else "open"
        elif proto == 17 and len(frame) >= body + 8:
            skip, name_, status = 8, "udp", "udp"
        else:
            continue
        sport, dport = struct.unpack_from(">HH", frame, body)
        src, dst = (".".join(map(str, frame[i : i + 4])) for i in (ip + 12, ip + 16))
        yield name, number - 1, src, dst, sport, dport, datetime.fromtimestamp(sec + frac / unit, UTC), name_, status, frame[body + skip : end]


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Packets of all captures at a path, through Spark's own file reader, so any store that Spark reads will do."""

    arrow = to_arrow_schema(_parse_datatype_string(PACKETS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, number, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rows = list(decode(data, name, number * FILE_STEP))
                for lo in range(0, len(rows), 10_000):
                    part = rows[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(arrow)], schema=arrow)

    files = spark.read.format("binaryFile").load(path)
    names = sorted(r.path for r in files.select("path").collect())
    number = spark.createDataFrame(list(enumerate(names)), "number long, path string")
    return files.join(F.broadcast(number), "path").select("path", "number", "content").mapInArrow(run, PACKETS)


class _Part(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Part]:
        return [_Part(p, i) for i, p in enumerate(sorted(self.options["path"].split(",")))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from decode(f.read(), partition.path, partition.number * FILE_STEP)


class PcapSource(DataSource):
    """``spark.read.format("pcap").load("a.pcap,b.pcap")`` for captures on a file system that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)


def read_stream_file(spark: SparkSession, folder: str, width: int = 8) -> DataFrame:
    """``(stream_id, data)`` of a folder with ``data`` (streams one behind the other) and ``offsets`` (their starts)."""
    form = {4: "I", 8: "Q"}[width]
    offsets = spark.read.format("binaryFile").load(f"{folder}/offsets").select("content").first().content
    starts = [x[0] for x in struct.iter_unpack("<" + form, offsets)]
    if starts and starts[0]:
        raise ValueError("the first stream starts at 0")
    data = spark.read.format("binaryFile").load(f"{folder}/data").select(F.col("content").alias("whole"))
    size = data.select(F.octet_length("whole").alias("n")).first()
    rows = [(i, a, b - a) for i, (a, b) in enumerate(zip(starts, [*starts[1:], size.n if size else 0], strict=True))]
    cuts = spark.createDataFrame(rows, "stream_id long, at long, size long")
    return cuts.crossJoin(F.broadcast(data)).select("stream_id", F.expr("substring(whole, cast(at + 1 as int), cast(size as int))").alias("data"))


def read_samples(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """Samples of files: each file one, or each line one: ``(sample, data)``."""
    if by_line:
        return spark.read.text(path).select(F.monotonically_increasing_id().alias("sample"), F.encode("value", "UTF-8").alias("data"))
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("sample"), F.col("content").alias("data"))
