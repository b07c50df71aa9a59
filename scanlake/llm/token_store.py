"""Token ids in files of directly addressable codes (DAC).

Ids are split into chunks of `bits` bits. Level 0 holds the lowest chunk of every
id, level k the chunks of those ids that go on beyond level k-1; a continuation
bitmap at each level says which do, and a rank directory (ones before each block
of 512 bits) turns a position into the position at the next level. So any id is
read with at most one rank per level, and nothing is decoded for it.

A shard is one binary value: magic, version, counts, then for each level the
chunks (one byte or two each), the bitmap and the directory, then the documents'
ids and end offsets. Shards are rows of a Parquet table in the shared folder,
`shard` ascending with doc_id; Parquet is only the container, so the files live
wherever Spark can write.

Documents are read back as the library would read any span: the span's first and
last position go down the levels by rank, and only chunks between them are touched.

Ids are the library's own for the whole text, special tokens in it included
(`literal` encodes their strings as any text; chat formatting needs that).

Defined cases: a null text is empty and holds the end id only. Null doc_ids come
first. Rows that repeat a doc_id follow one another by a hash of their text, then by
text, so the order never changes, and a doc_id that a third of the rows share is
split among tasks. Long texts are encoded whole; one of more than SHARD_IDS ids is a
shard of its own. Other columns, whatever their names, are not read. An empty table
makes no shard.
"""

from __future__ import annotations

import os
import struct
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanlake.llm.common import read, shared_dir, small_batches, span_hashes, text_bytes, trimmed

MAGIC = b"DAC1"
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Ids of a shard, unless a document alone has more.
SHARD_IDS = 1 << 19
#: Pieces of text whose ids a worker remembers.
MEMO = 600_000
BLOCK = 512
#: Bytes of text of a range of documents.
PART_BYTES = 32 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Classes of bytes of UTF-8 text: space, other white space, letter, digit, other,
#: and those of characters for which the library decides.
SPACE_, WHITE, LETTER, DIGIT, OTHER, ODD = range(6)
CLASS = np.full(256, OTHER, dtype=np.uint8)
CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[9:14], CLASS[32] = WHITE, SPACE_
CLASS[[*range(9), *range(14, 32), 127, 0xC0, 0xC1, 0xC2, *range(0xCA, 256)]] = ODD


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin in texts end to end, and which texts are odd.

    The pieces of this public vocabulary's pattern: a contraction ('s 't 're 've 'm
    'll 'd); letters, digits or other characters, each with one space before if there
    is one; white space, of which the last character before anything else is a piece
    of its own or goes with what follows. Odd texts hold characters outside
    U+0009-U+024F, controls, or U+0080-U+00BF."""
    n = len(data)
    kind = CLASS[data]
    following = np.append(data[1:], 0)
    # Multiplication and division signs are no letters; U+0250 and on is for the library.
    sign = (data == 0xC3) & ((following == 0x97) | (following == 0xB7))
    kind[sign] = OTHER
    kind[1:][sign[:-1]] = OTHER
    odd = (kind == ODD) | ((data == 0xC9) & (following >= 0x90))
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    white = kind <= WHITE
    group = np.where(white, 0, kind)
    turn = np.ones(n, dtype=bool)
    turn[1:] = group[1:] != group[:-1]
    turn |= edge[:-1]
    start = turn.copy()
    # The last white space before something else begins a piece; a space takes what follows along.
    last = white & np.append(~white[1:], True) & ~edge[1:]
    start |= last
    after_space = np.zeros(n, dtype=bool)
    after_space[1:] = (last & (kind == SPACE_))[:-1]
    start &= ~after_space
    # Contractions: a lone apostrophe that begins a piece, then certain letters.
    apostrophe = np.flatnonzero((data == 39) & start)
    if len(apostrophe):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        one, two = padded[apostrophe + 1], padded[apostrophe + 2]
        room = offsets[np.searchsorted(offsets, apostrophe, "right")] - apostrophe
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (room > 1)
        long = ((two == 101) & ((one == 114) | (one == 118)) | (one == 108) & (two == 108)) & (room > 2)
        size = np.where(short, 2, np.where(long, 3, 0))
        for p, k in zip(apostrophe[size > 0].tolist(), size[size > 0].tolist()):
            start[p + 1] = False
            if p + k < n and not edge[p + k]:
                start[p + k] = start[p + k] or bool(kind[p + k] == LETTER)
    return np.flatnonzero(start), np.add.reduceat(np.append(odd, False), np.minimum(offsets[:-1], n)).astype(bool) & (np.diff(offsets) > 0) if len(offsets) > 1 else np.zeros(0, bool)


class Encoder:
    """Whole texts to ids with the tokenizers library. A byte-level BPE works on
    the pieces that its splitting pattern makes, each alone; pieces recur, so each is
    encoded once and known again by a 64-bit hash. Texts for which the splitting
    below might differ from the library's, or that hold a special token's string, go
    to the library whole."""

    def __init__(self, path: str, remember: int = MEMO, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if literal:
            self.library.encode_special_tokens = True
        self.special = [] if literal else [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.most = remember
        self.forget()

    @classmethod
    def here(cls, path: str, remember: int = MEMO, literal: bool = False) -> Encoder:
        """The encoder of this process and these options: a worker that runs several
        tasks goes on with what it remembers."""
        kept = sys.modules.setdefault("_scanlake_encoders", types.ModuleType("_scanlake_encoders")).__dict__
        key = path, remember, literal
        if key not in kept:
            kept[key] = cls(*key)
        return kept[key]

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.begin, self.size, self.pool, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        """Remember pieces. Those of a space and letters split again where they
        were joined, so many go as one text."""
        plain = [i for i, x in enumerate(texts) if x[0] == " " and x[1:].isalpha()]
        rest = sorted(set(range(len(texts))) - set(plain))
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            e = self.library.encode("".join([texts[i] for i in some]), add_special_tokens=False)
            self._keep([hashes[i] for i in some], np.array(e.ids, dtype=np.uint32), np.searchsorted(np.array(e.word_ids), np.arange(len(some) + 1)))
        for at in range(0, len(rest), 2000):
            some = rest[at : at + 2000]
            ids = self.whole([texts[i] for i in some])
            self._keep([hashes[i] for i in some], np.concatenate(ids), np.cumsum([0, *map(len, ids)]))

    def _keep(self, hashes: list[int], ids: np.ndarray, cut: np.ndarray) -> None:
        k, n = len(self.slot), len(hashes)
        if k + n > len(self.begin):
            more = np.zeros(max(n, len(self.begin)), np.int64)
            self.begin, self.size = np.concatenate([self.begin, more]), np.concatenate([self.size, more])
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), np.uint32)])
        self.begin[k : k + n], self.size[k : k + n] = self.used + cut[:-1], np.diff(cut)
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.slot.update(zip(hashes, range(k, k + n)))

    def column(self, column) -> list[np.ndarray]:
        """The ids of each text of an Arrow column; null is empty."""
        data, offsets = text_bytes(column)
        start, odd = split_pieces(data, offsets)
        out = self._pieces(data, offsets, start)
        raw = data.tobytes() if odd.any() or self.special else b""
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        if odd.any():
            rows = np.flatnonzero(odd).tolist()
            for i, ids in zip(rows, self.whole([raw[offsets[i] : offsets[i + 1]].decode() for i in rows])):
                out[i] = ids
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return self.column(pa.array(texts, pa.large_string()))

    def _pieces(self, data, offsets, start) -> list[np.ndarray]:
        if not len(start):
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        end = np.append(start[1:], len(data))
        distinct, which = np.unique(span_hashes(data, start, end), return_inverse=True)
        if len(self.slot) + len(distinct) > self.most:
            self.forget()
        hashes = distinct.tolist()
        slots = np.fromiter(map(lambda h, get=self.slot.get: get(h, -1), hashes), dtype=np.int64, count=len(hashes))
        new = np.flatnonzero(slots < 0)
        if len(new):
            one = np.zeros(len(distinct), np.int64)
            one[which] = np.arange(len(which))
            raw = data.tobytes()
            # Odd texts are split without regard to characters; what isn't text isn't learnt.
            texts = [raw[a:z].decode(errors="replace") for a, z in zip(start[one[new]].tolist(), end[one[new]].tolist())]
            self._learn([hashes[i] for i in new.tolist()], texts)
            slots[new] = [self.slot[hashes[i]] for i in new.tolist()]
        size = self.size[slots][which]
        upto = np.cumsum(size)
        ids = self.pool[np.repeat(self.begin[slots][which] - upto + size, size) + np.arange(upto[-1])]
        cut = np.append(0, upto)[np.searchsorted(start, offsets)].tolist()
        return [ids[a:z] for a, z in zip(cut, cut[1:])]


def _ranks(bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bitmap's bytes, and the ones before each block."""
    padded = np.zeros(-(-max(len(bits), 1) // BLOCK) * BLOCK, dtype=bool)
    padded[: len(bits)] = bits
    ones = padded.reshape(-1, BLOCK).sum(1)
    return np.packbits(padded, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u4")


def pack(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, bits: int = 8) -> bytes:
    """One shard."""
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        more = rest >> np.uint32(bits)
        goes_on = more > 0
        levels.append(((rest & np.uint32((1 << bits) - 1)).astype("<u1" if bits <= 8 else "<u2"), goes_on))
        if not goes_on.any():
            break
        rest = more[goes_on]
    out = [struct.pack("<4sBBIQ", MAGIC, bits, len(levels), len(doc_ids), len(ids))]
    for k, (chunks, goes_on) in enumerate(levels):
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes()]
        if k + 1 < len(levels):
            bitmap, directory = _ranks(goes_on)
            out += [bitmap, directory.tobytes()]
    known = np.array([x is not None for x in doc_ids], dtype="<u1")
    return b"".join([*out, known.tobytes(), np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), np.asarray(ends, dtype="<u8").tobytes()])


class Shard:
    """A shard opened for reading: shard[i] is an id without decoding others,
    span(a, z) the ids from a to z - 1, documents() the ids of each document."""

    def __init__(self, blob: bytes):
        magic, self.bits, n_levels, n_docs, self.n = struct.unpack_from("<4sBBIQ", blob)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at, width, self.levels = struct.calcsize("<4sBBIQ"), 1 if self.bits <= 8 else 2, []
        for k in range(n_levels):
            (m,) = struct.unpack_from("<Q", blob, at)
            chunks = np.frombuffer(blob, f"<u{width}", m, at + 8)
            at += 8 + m * width
            bitmap = directory = None
            if k + 1 < n_levels:
                blocks = -(-max(m, 1) // BLOCK)
                bitmap = np.frombuffer(blob, np.uint8, blocks * BLOCK // 8, at)
                directory = np.frombuffer(blob, "<u4", blocks, at + len(bitmap))
                at += len(bitmap) + 4 * blocks
            self.levels.append((chunks, bitmap, directory))
        known = np.frombuffer(blob, "<u1", n_docs, at)
        ids = np.frombuffer(blob, "<i8", n_docs, at + n_docs)
        self.doc_ids = [int(x) if ok else None for x, ok in zip(ids, known)]
        self.ends = np.frombuffer(blob, "<u8", n_docs, at + 9 * n_docs)

    def __len__(self) -> int:
        return self.n

    def _rank(self, k: int, i: int) -> int:
        """How many of the first i chunks of level k go on at the next."""
        chunks, bitmap, directory = self.levels[k]
        block = min(i // BLOCK, len(directory) - 1)
        inside = np.unpackbits(bitmap[block * BLOCK // 8 : -(-i // 8)], bitorder="little", count=i - block * BLOCK)
        return int(directory[block]) + int(np.count_nonzero(inside))

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (k * self.bits)
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(k, i)
        return value

    def span(self, a: int, z: int, k: int = 0) -> np.ndarray:
        """The ids a to z - 1: ranks lead its two ends from level to level."""
        chunks, bitmap, _ = self.levels[k]
        out = chunks[a:z].astype(np.uint32)
        if bitmap is not None and z > a:
            first = a >> 3 << 3
            on = np.flatnonzero(np.unpackbits(bitmap[a >> 3 : -(-z // 8)], bitorder="little", count=z - first)[a - first :])
            if len(on):
                low = self._rank(k, a)
                out[on] |= self.span(low, low + len(on), k + 1) << np.uint32(self.bits)
        return out

    def documents(self):
        begin = 0
        for doc, end in zip(self.doc_ids, self.ends.tolist()):
            yield doc, self.span(begin, end)
            begin = end


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, bits: int = 8, shard_ids: int = SHARD_IDS, remember: int = MEMO, batch: str = "4m") -> None:
    """Write the shards: documents by range of doc_id, ascending, so files follow
    one another by `part`, and shards in a file by `shard`. Texts are dealt out
    first and encoded where they are packed, so each is encoded once. `remember` and
    `batch` bound what a worker holds; neither changes a result."""
    spark = docs.sparkSession
    small_batches(spark, 500, batch)
    vocabulary, tail = tokenizer or tokenizer_path(), np.array([end_id], dtype=np.uint32)

    def shards(batches):
        encoder = Encoder.here(vocabulary, remember)
        docs, held, count, part, k = [], [], 0, -1, 0

        def out():
            ids = np.concatenate(held)
            ends = np.cumsum([len(x) + 1 for x in held[::2]])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([pack(ids, docs, ends, bits)], pa.binary())], ["part", "shard", "n_ids", "blob"])

        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else part
            own = b.column(0).to_pylist()
            for doc, ids in zip(own, encoder.column(b.column(1))):
                docs.append(doc)
                held += [ids, tail]
                count += len(ids) + 1
                if count >= shard_ids:
                    yield out()
                    docs, held, count, k = [], [], 0, k + 1
        if docs:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES), 1)
    order = ["doc_id", F.xxhash64("text"), "text"]
    ranged = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    ranged.withColumn("part", F.spark_partition_id()).mapInArrow(trimmed(shards), "part int, shard int, n_ids long, blob binary").write.option("compression", "uncompressed").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the
    files. A shard's first id is the sum of those before it: two small windows
    over one row per part, and per shard of a part."""
    small_batches(spark, 4)
    table = spark.read.schema("part int, shard int, n_ids long, blob binary").parquet(path)
    sizes = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = table.select("part", "shard", "n_ids").withColumn("inside", F.sum("n_ids").over(inside) - F.col("n_ids"))
    at = at.join(base, "part").select("part", "shard", (F.col("base") + F.col("inside")).alias("base"))

    def opened(batches):
        for b in batches:
            for part, k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                shard = Shard(blob.as_buffer().to_pybytes())
                found = [(d, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, x in shard.documents()]
                n = np.array([x[1] for x in found], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(found), pa.int32()), pa.array([k] * len(found), pa.int32()), pa.array([x[0] for x in found], pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array([x[2] for x in found], pa.int64())],
                    ["part", "shard", "doc_id", "own", "n_tokens", "ids_crc32"],
                )

    docs = table.select("part", "shard", "blob").mapInArrow(trimmed(opened), "part int, shard int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return docs.join(at, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def store(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, bits: int = 8, remember: int = MEMO, batch: str = "4m") -> DataFrame:
    """Encode, write to `path` (a new shared folder if none) and read back."""
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    write_store(docs, path, tokenizer, end_id, bits, remember=remember, batch=batch)
    return read_store(spark, path)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(read(spark, sf_dir, "documents"))
