"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

Count tables are partitioned by hash and joined to the documents' exploded n-grams
in columns, not row by row. Documents are packed into blocks of about BLOCK_BYTES.
A block asks, per order and hash bucket, for its distinct n-grams: their sorted
hashes and own counts. A bucket merges what all blocks ask (each n-gram comes at
most once a block, so no n-gram is hot), adds up the corpus counts and answers each
block in the order of its question. A block then has the counts of every n-gram it
holds, and sums the scores of each of its documents.

Score of a word: for the longest n-gram ending in it (at most `order` words, inside
its document) that the tables hold, count / count of its context, times `alpha` for
each order given up; for a single word its count / all words. Tables hold every
n-gram; `min_count` above 1 leaves out rarer ones of two words or more.
Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lowered.

N-grams are known by hashes of SPARE_BITS more bits than it takes to number them;
two that share one add their counts.

Defined cases: null or wordless text: 0 words, log_score 0, mean null. Rows that
repeat count and are scored each, as do rows without doc_id. A text longer than a
block is a block of its own. An empty table gives no rows. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm.common import materialize, ngram_hashes, pack_integers, read, small_batches, trim, trimmed, unpack_integers, word_hashes
from scanlake.llm.repeats import release

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 1
BLOCK_BYTES = 5 << 20
#: An n-gram's hash has so many bits more than the logarithm of their number: about
#: one in 2^SPARE_BITS n-grams shares its hash with another, at any size.
SPARE_BITS = 24
#: Bytes of text for each hash bucket.
BUCKET_BYTES = 4 << 20


def _pack_sorted(h: np.ndarray, drop: int) -> bytes:
    """Sorted hashes whose lowest `drop` bits are zero, as steps."""
    return pack_integers(np.diff(h, prepend=np.uint64(0)) >> np.uint64(drop))


def _unpack_sorted(blob: bytes, drop: int) -> np.ndarray:
    return np.cumsum(unpack_integers(blob, np.uint64), dtype=np.uint64) << np.uint64(drop)


def _grams(words: np.ndarray, first: np.ndarray, n: int, drop: int) -> np.ndarray:
    return ngram_hashes(words, first, n)[0] >> np.uint64(drop) << np.uint64(drop)


def blocks(docs: DataFrame) -> DataFrame:
    """block, ids, texts (compressed): documents packed together."""
    small_batches(docs.sparkSession, 500, "4m")

    def pack(batches):
        import zstandard

        part, k, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def out():
            raw = b"".join(x.encode() for x in texts)
            lengths = np.array([len(x.encode()) for x in texts], dtype="<i8").tobytes()
            blob = zstandard.ZstdCompressor(level=3).compress(lengths + raw)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([blob], pa.binary()), pa.array([len(raw)], pa.int64())], ["block", "ids", "texts", "n_bytes"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield out()
                    k, ids, texts, size = k + 1, [], [], 0
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(pack), "block long, ids array<long>, texts binary, n_bytes long")


def open_block(blob: bytes, n: int) -> pa.Array:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, dtype="<i8", count=n))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[8 * n :]))


QUESTION = "bucket long, n int, block long, hashes binary, counts binary"


def question(block: int, n: int, h: np.ndarray, bits: int, drop: int) -> pa.RecordBatch:
    """What a block asks about its sorted hashes: a row for each bucket."""
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    h, count = h[at], np.diff(np.append(at, len(h))).astype(np.uint32)
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(h))
    m = len(cut) - 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cut[:-1]]), pa.array(np.full(m, n, np.int32)), pa.array(np.full(m, block, np.int64)),
            pa.array([_pack_sorted(h[a:z], drop) for a, z in zip(cut, cut[1:])], pa.binary()), pa.array([pack_integers(count[a:z]) for a, z in zip(cut, cut[1:])], pa.binary()),
        ],
        ["bucket", "n", "block", "hashes", "counts"],
    )


def questions(packed: DataFrame, order: int, bits: int, drop: int) -> DataFrame:
    """bucket, n, block, hashes, counts: what the blocks ask of the buckets."""
    small_batches(packed.sparkSession, 1)

    def ask(batches):
        for b in batches:
            for block, ids, blob in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                words, first = word_hashes(open_block(blob.as_buffer().to_pybytes(), len(ids)))
                for n in range(1, order + 1):
                    yield question(block, n, np.sort(_grams(words, first, n, drop)), bits, drop)

    return packed.select("block", "ids", "texts").mapInArrow(trimmed(ask), QUESTION)


def answers(asked: DataFrame, drop: int) -> DataFrame:
    """block, n, bucket, counts: the corpus counts, in the order of the question."""

    def count(table):
        hashes = [_unpack_sorted(x, drop) for x in table.column("hashes").to_pylist()]
        own = np.concatenate([unpack_integers(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        _, where = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(where, own).astype(np.uint64)[where]
        cut = np.cumsum([0, *map(len, hashes)])
        return pa.table({"block": table.column("block"), "n": table.column("n"), "bucket": table.column("bucket"), "total": pa.array([pack_integers(total[a:z]) for a, z in zip(cut, cut[1:])], pa.binary())})

    return asked.groupBy("bucket", "n").applyInArrow(count, "block long, n int, bucket long, total binary")


def block_scores(words: np.ndarray, first: np.ndarray, totals: dict[int, np.ndarray], all_words: int, order: int, alpha: float, min_count: int, drop: int) -> np.ndarray:
    """The sum of log scores of each text."""
    size = np.diff(first)
    place = np.arange(len(words)) - np.repeat(first[:-1], size)  # in its text
    counts = {}
    for n in range(1, order + 1):
        h = _grams(words, first, n, drop)
        c = np.zeros(len(words), dtype=np.int64)  # by the n-gram's last word
        c[place >= n - 1] = totals[n][np.unique(h, return_inverse=True)[1]].astype(np.int64) if len(h) else 0
        counts[n] = c
    score = np.log(np.maximum(counts[1], 1)) - np.log(max(all_words, 1))
    reach = np.minimum(place + 1, order)
    score += (reach - 1) * np.log(alpha)
    for n in range(2, order + 1):
        held = counts[n] >= min_count
        context = np.concatenate([[1], counts[n - 1][:-1]])
        score = np.where(held, np.log(np.maximum(counts[n], 1)) - np.log(np.maximum(context, 1)) + (reach - n) * np.log(alpha), score)
    return np.array([score[a:z].sum() for a, z in zip(first[:-1].tolist(), first[1:].tolist())])


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of every document."""
    spark = docs.sparkSession
    packed = materialize(blocks(docs))
    size = packed.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1.0, size / BUCKET_BYTES)))))
    # No text has more words than bytes.
    drop = max(0, 64 - SPARE_BITS - max(16, int(size).bit_length()))
    answered = materialize(answers(questions(packed, order, bits, drop), drop))
    release(spark)

    def words_in(batches):
        for b in batches:
            n = sum(len(word_hashes(open_block(blob.as_buffer().to_pybytes(), len(ids)))[0]) for ids, blob in zip(b.column(0), b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    all_words = packed.select("ids", "texts").mapInArrow(trimmed(words_in), "n long").agg(F.sum("n")).first()[0] or 0

    def add_up(left, right):
        ids, blob = left.column("ids")[0].as_py(), left.column("texts")[0].as_py()
        words, first = word_hashes(open_block(blob, len(ids)))
        rows = sorted(zip(right.column("n").to_pylist(), right.column("bucket").to_pylist(), right.column("total").to_pylist()), key=lambda x: x[:2])
        totals = {n: np.concatenate([np.zeros(0, np.uint64), *(unpack_integers(x, np.uint64) for m, _, x in rows if m == n)]) for n in range(1, order + 1)}
        sums, n_words = block_scores(words, first, totals, all_words, order, alpha, min_count, drop), np.diff(first)
        trim()
        mean = [s / n if n else None for s, n in zip(sums.tolist(), n_words.tolist())]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words.astype(np.int64)), "log_score": pa.array(sums), "mean_log_score": pa.array(mean, pa.float64())})

    met = packed.select("block", "ids", "texts").groupBy("block").cogroup(answered.groupBy("block"))
    return met.applyInArrow(add_up, "doc_id long, n_words long, log_score double, mean_log_score double")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs)
), n1 AS (SELECT a, count(*) AS n FROM places GROUP BY a
), n2 AS (SELECT b, a, count(*) AS n FROM places WHERE i > 1 GROUP BY b, a
), n3 AS (SELECT c, b, a, count(*) AS n FROM places WHERE i > 2 GROUP BY c, b, a
), total AS (SELECT count(*) AS n FROM places
), scored AS (
  SELECT at_.doc_id, CASE
    WHEN n3.n >= 1 THEN ln(n3.n) - ln(c2.n)
    WHEN n2.n >= 1 THEN ln(n2.n) - ln(c1.n) + (least(i, 3) - 2) * ln(0.4)
    ELSE ln(n1.n) - ln(total.n) + (least(i, 3) - 1) * ln(0.4) END AS s
  FROM places at_ CROSS JOIN total JOIN n1 ON n1.a = at_.a
  LEFT JOIN n2 ON n2.b = at_.b AND n2.a = at_.a LEFT JOIN n1 c1 ON c1.a = at_.b
  LEFT JOIN n3 ON n3.c = at_.c AND n3.b = at_.b AND n3.a = at_.a LEFT JOIN n2 c2 ON c2.b = at_.c AND c2.a = at_.b
)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 3) AS log_score, round(s / nullif(len(w), 0), 6) AS mean_log_score
FROM docs LEFT JOIN (SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id) USING (doc_id)
"""
