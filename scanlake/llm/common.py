"""What the training-data operators share: table access and vectorised word hashing.

Text is handled as UTF-8 bytes in numpy. A word is a maximal run of bytes other
than 0x20 and 0x09-0x0D; this equals the same class on code points, because no
multi-byte sequence of UTF-8 holds those bytes.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from scanlake.storage import drop_table, materialize, shared_dir  # noqa: F401

#: Bytes of text that a vectorised step holds at once.
CHUNK = 1 << 20
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "6m") -> None:
    """Bound the Arrow batches that Python workers get, by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def trim() -> None:
    """Give freed memory back to the system: workers stay for later tasks, and the
    functions of earlier ones, which hold their modules' names, are cycles."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(found := ctypes.CDLL(libc), "malloc_trim"):
        found.malloc_trim(0)


def trimmed(f):
    """A function for mapInArrow() that trims when it is through."""

    def run(batches):
        yield from f(batches)
        trim()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection on 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random value for each byte.
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """_P (or its inverse modulo 2**64) to the powers 0..n-1. A process keeps one
    table of each, whatever its tasks."""
    kept = sys.modules.setdefault("_scanlake_powers", types.ModuleType("_scanlake_powers")).__dict__
    have = kept.get(("powers", inverse))
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK + 4096)
        have = np.full(size, _P_INV if inverse else _P, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * CHUNK + 4096:
            kept["powers", inverse] = have
    return have[:n]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first
    word (n+1 values). `between`: which bytes part words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~between[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1]
    before[edges[edges < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Spans of more bytes are hashed one by one.
LONG = 64


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: eight bytes at a time are mixed in, so what
    a byte adds depends on all before it, and no two spans are equal by construction."""
    size = ends - starts
    out = mix64((size + 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = np.flatnonzero((size > 0) & (size <= LONG))
    for k in range(0, LONG, 8):
        unused = np.maximum(k + 8 - size[left], 0).astype(np.uint64) * np.uint64(8)
        out[left] = mix64(out[left] ^ (eight[starts[left] + k] << unused))
        left = left[size[left] > k + 8]
    if len(far := np.flatnonzero(size > LONG)):
        import xxhash

        raw = memoryview(np.ascontiguousarray(data))
        h = [xxhash.xxh3_64_intdigest(raw[a:z]) for a, z in zip(starts[far].tolist(), ends[far].tolist())]
        out[far] = mix64(out[far] ^ np.array(h, dtype=np.uint64))
    return out


def word_hashes(column, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column of texts, and each text's first word."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(LOWER[data] if lower else data, starts, ends), first


def ngram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that lie in one text, with each text's first."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        h = (h + words[at + k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mix64(h), begin


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def pack_integers(x: np.ndarray) -> bytes:
    """Compressed integers: bytes of equal significance stand together."""
    import zstandard

    if not len(x):
        return b""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes())


def unpack_integers(blob: bytes, kind) -> np.ndarray:
    import zstandard

    if not blob:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)
