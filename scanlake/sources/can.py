"""CAN-FD frames: their layout as column expressions, a live source and a sink.

A frame is the 72 bytes that a raw socket gives: a 32-bit id with flags, a length, and 64
bytes of data. Everything but the socket itself works on columns, so a log of frames of
any size is opened without Python.

    spark.dataSource.register(CanFrames)
    frames = spark.readStream.format("can_fd").option("interface", "can0").load()
    fragments = to_packets(frames)
"""

from __future__ import annotations

import socket
import struct
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.types import StructType

from scanlake.functions.binary import byte_at, hex_be, hex_le, uint_le
from scanlake.functions.geometry import c

# Layout of a frame, flags in its id, and the lengths that its data can have.
FRAME_BYTES, DATA_AT, DATA_BYTES = 72, 8, 64
EXTENDED, ERROR = 0x80000000, 0x20000000
STANDARD_IDS, EXTENDED_IDS = 0x7FF, 0x1FFFFFFF
LENGTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64)
#: Options of raw sockets and the message that holds a kernel's stamp.
_SOL_CAN_RAW, _CAN_RAW_FD_FRAMES, _SO_TIMESTAMPNS = 101, 5, 35


def to_packets(frames: DataFrame) -> DataFrame:
    """stamp_ns, can_id and data of frames: four bytes of id, most significant first, then
    the frame's own bytes. Error frames, null and short ones, and those that claim more than
    64 bytes are left out. `frames`: stamp_ns, frame and any other columns, which stay."""
    f = frames.filter(F.length("frame") >= FRAME_BYTES).withColumn("_id", uint_le("frame", F.lit(0), 4)).withColumn("_n", byte_at("frame", F.lit(4)))
    f = f.filter((c("_id").bitwiseAND(F.lit(ERROR)) == 0) & (c("_n") <= DATA_BYTES))
    mask = F.when(c("_id").bitwiseAND(F.lit(EXTENDED)) != 0, F.lit(EXTENDED_IDS)).otherwise(F.lit(STANDARD_IDS)).cast("long")
    f = f.withColumn("can_id", c("_id").bitwiseAND(mask))
    data = F.concat(F.unhex(hex_be("can_id", 4)), F.substr("frame", F.lit(DATA_AT + 1), c("_n").cast("int")))
    return f.withColumn("data", data).drop("_id", "_n", "frame")


def to_frames(packets: DataFrame) -> DataFrame:
    """The inverse of to_packets(): standard ids stay standard, larger ones are extended.
    Data whose length no frame has is padded with zeros up to the next; what is longer
    than 64 bytes is an error."""
    size = F.length("data") - 4
    fits: Column = F.when(size < 0, F.raise_error(F.lit("data without an id")).cast("int"))
    for n in LENGTHS:
        fits = fits.when(size <= n, n)
    fits = fits.otherwise(F.raise_error(F.lit("more than 64 bytes in a frame")).cast("int"))
    can_id = F.conv(F.hex(F.substr("data", F.lit(1), F.lit(4))), 16, 10).cast("long")
    flagged = F.when(can_id > STANDARD_IDS, can_id.bitwiseOR(F.lit(EXTENDED).cast("long"))).otherwise(can_id)
    text = F.concat(hex_le(flagged, 4), hex_le(fits, 1), F.lit("000000"), F.rpad(F.hex(F.substr("data", F.lit(5), size)), 2 * DATA_BYTES, "0"))
    return packets.withColumn("frame", F.unhex(text)).drop("data")


def _open(options: dict, to_send: bool) -> socket.socket:
    """A raw socket of an interface, or a datagram socket at a path (a gateway)."""
    if "interface" in options:
        s = socket.socket(socket.AF_CAN, socket.SOCK_RAW, socket.CAN_RAW)
        s.setsockopt(_SOL_CAN_RAW, _CAN_RAW_FD_FRAMES, 1)
        s.bind((options["interface"],))
        return s
    s = socket.socket(socket.AF_UNIX, socket.SOCK_DGRAM)
    s.connect(options["socket"]) if to_send else s.bind(options["socket"])
    return s


class _FrameReader(SimpleDataSourceStreamReader):
    """What has arrived since the last trigger. A bus is one socket, so one reader; a
    batch's rows are kept until it is committed."""

    def __init__(self, options: dict):
        self.options, self.socket, self.held = options, None, {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        if self.socket is None:
            self.socket = _open(self.options, to_send=False)
            self.socket.setblocking(False)
            if self.options.get("busTime", "false") == "true":
                self.socket.setsockopt(socket.SOL_SOCKET, _SO_TIMESTAMPNS, 1)
        rows, most = [], int(self.options.get("maxFrames", 10_000))
        while len(rows) < most:
            try:
                frame, about, _, _ = self.socket.recvmsg(FRAME_BYTES, 64)
            except BlockingIOError:
                break
            stamp = next((struct.unpack("qq", x[:16]) for level, kind, x in about if (level, kind) == (socket.SOL_SOCKET, _SO_TIMESTAMPNS)), None)
            rows.append((stamp[0] * 1_000_000_000 + stamp[1] if stamp else time.time_ns(), frame))
        self.held[start["n"]] = rows
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self.held.get(start["n"], [])[: end["n"] - start["n"]])

    def commit(self, end: dict) -> None:
        self.held = {k: v for k, v in self.held.items() if k + len(v) > end["n"]}


class _FrameSender(DataSourceWriter, DataSourceStreamWriter):
    """Each task sends its frames in their order; a task that is run again sends again, as
    a bus can't take back."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        s = None
        for row in iterator:
            s = s or _open(self.options, to_send=True)
            s.settimeout(float(self.options.get("timeout", 1.0)))
            s.send(bytes(row["frame"]))
        if s:
            s.close()
        return WriterCommitMessage()

    def commit(self, messages, batchId=None) -> None:
        pass

    def abort(self, messages, batchId=None) -> None:
        pass


class CanFrames(DataSource):
    """Options: interface (can0) or socket (path of a gateway); to read, busTime (the kernel's
    stamps in place of the time of receipt) and maxFrames (a batch); to send, timeout."""

    @classmethod
    def name(cls) -> str:
        return "can_fd"

    def schema(self) -> str:
        return "stamp_ns bigint, frame binary"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _FrameReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FrameSender(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _FrameSender(dict(self.options))
