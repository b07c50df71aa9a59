"""Packet logs and live datagrams."""

from __future__ import annotations

import socket
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from scanlake.functions.geometry import c

SCHEMA = "stamp_ns bigint, sender string, data binary"


def read_log(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """Packets of a Parquet log (topic, stamp_ns, data, ...), of some topics; the
    filter reaches the files."""
    log = spark.read.parquet(path)
    return log.filter(c("topic").isin(topics)) if topics else log


def replay(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A log as a stream, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def accept(packets: DataFrame, sender: str | None, mtu: int) -> DataFrame:
    """Packets of one sender, with a flag on those longer than the buffer."""
    own = packets.filter(c("sender") == sender) if sender else packets
    return own.withColumn("truncated", F.length("data") > mtu)


def window_of(rows: DataFrame, skip: int, most: int, *order: str) -> DataFrame:
    """Leave out the first rows and emit so many at most."""
    return rows.orderBy(*order).offset(skip).limit(most)


def latest_frames(stream: DataFrame, keep: int = 5) -> DataFrame:
    """The last frames of each topic in a batch: what a best-effort subscriber that
    keeps a few would see."""
    newest = stream.groupBy("topic").agg(F.max("frame_id").alias("_top"))
    return stream.join(newest, "topic").filter(c("frame_id") > c("_top") - keep).drop("_top")


class _Receiver(SimpleDataSourceStreamReader):
    """Reads what has arrived since the last trigger. One socket, so one reader; the
    rows of a batch are kept until it is committed."""

    def __init__(self, options: dict):
        self.options, self.socket, self.held = options, None, {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, int(self.options.get("receiveBuffer", 1 << 22)))
            self.socket.bind((self.options.get("host", "127.0.0.1"), int(self.options["port"])))
            self.socket.setblocking(False)
        rows, most = [], int(self.options.get("maxPackets", 10_000))
        while len(rows) < most:
            try:
                data, (sender, _) = self.socket.recvfrom(int(self.options.get("mtu", 1500)) + 1)
            except BlockingIOError:
                break
            if self.options.get("sender", sender) == sender:
                rows.append((time.time_ns(), sender, data))
        self.held[start["n"]] = rows
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self.held.get(start["n"], [])[: end["n"] - start["n"]])

    def commit(self, end: dict) -> None:
        self.held = {k: v for k, v in self.held.items() if k + len(v) > end["n"]}


class UdpPackets(DataSource):
    """spark.readStream.format("udp_packets").option("port", ...): datagrams with
    their time of receipt and sender. Options: host, port, sender, mtu,
    receiveBuffer, maxPackets (a batch)."""

    @classmethod
    def name(cls) -> str:
        return "udp_packets"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Receiver(dict(self.options))
