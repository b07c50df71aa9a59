"""Quality scores: ridge regression on random Fourier features of document
statistics, followed by isotonic calibration.

Every text gives the same few statistics (length, byte classes, entropy, words,
lines). Standardised, they pass through `features` random cosines, whose inner
products approximate a Gaussian kernel. Each partition sums its normal equations
(matrix and right side, of fixed size); the driver adds and solves them. Training
scores fall into BINS bins, counted by Spark, and pooling adjacent violators over
the bins turns a score into a probability.

The fit uses about `fit_rows` labelled doc_ids, those whose hash lies below a
threshold; the scores cover all documents and use their text only.

Defined cases: null text counts as empty, and empty texts are scored as any other, as
are texts of any length, whole. Null labels are no labels; a doc_id labelled twice
counts twice, and rows that share a labelled doc_id all count. With no labels every
score is 0.5. Rows that repeat get equal scores. An empty table gives no rows. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm.common import LOWER, materialize, read, small_batches, span_hashes, text_bytes, trimmed, word_spans
from scanlake.llm.langid import held_out

FIT_ROWS = 200_000
FEATURES = 256
BINS = 2048
PARTS = 16

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "newline": (10, 13), "high": range(128, 256),
    "stop": b".!?", "shout": b"!", "pause": b",;:", "bar": b"|", "symbol": b"#$%&*+-/<=>@[\\]^_`{}~", "quote": b"\"'()",
}
NAMES = (
    "chars", "words", "word_mean", "word_std", "distinct", "top", "lines", "line_mean", "line_distinct", "entropy", "short", "long", *_CLASSES,
)


def _per_text(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def _distinct(first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per text, and the count of the most frequent."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, o[at], run)
    return np.bincount(o[at], minlength=n).astype(float), top


def statistics(column) -> np.ndarray:
    """A row of NAMES for each text."""
    data, offsets = text_bytes(column)
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    counts = np.zeros((n, 256))
    for i in range(n):
        counts[i] = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
    share = counts / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    starts, ends, first = word_spans(data, offsets)
    length = (ends - starts).astype(float)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    mean = _per_text(first, length) / some
    spread = np.sqrt(np.maximum(_per_text(first, length**2) / some - mean**2, 0))
    distinct, top = _distinct(first, span_hashes(LOWER[data], starts, ends))
    # Lines: runs of bytes other than a line feed.
    cut = data == 10
    edge = ~cut
    begin = edge.copy()
    if len(data):
        begin[1:] &= cut[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        begin[inner] = edge[inner]
        close = edge.copy()
        close[:-1] &= cut[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        close[last] = edge[last]
        ls, le = np.flatnonzero(begin), np.flatnonzero(close) + 1
    else:
        ls = le = np.zeros(0, np.int64)
    lfirst = np.searchsorted(ls, offsets)
    lines = np.diff(lfirst).astype(float)
    ldistinct, _ = _distinct(lfirst, span_hashes(data, ls, le))
    columns = [
        np.log1p(size), np.log1p(words), mean, np.log1p(spread), distinct / some, top / some, np.log1p(lines), np.log1p(size / np.maximum(lines, 1)), ldistinct / np.maximum(lines, 1), entropy,
        _per_text(first, length <= 3) / some, _per_text(first, length > 20) / some,
    ]
    columns += [np.sqrt(share[:, list(c)].sum(1)) for c in _CLASSES.values()]
    return np.stack(columns, axis=1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of each text as an array."""
    small_batches(docs.sparkSession, 1000)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = statistics(b.column(1))
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(trimmed(run), f"doc_id {kind}, x array<double>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, f, size: int) -> np.ndarray:
    """The sum over all rows of vectors of `size`: one vector per partition, at
    most PARTS of them."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            total += f(_matrix(b.column(0)), *(b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    parts = rows.select("x", "y", "w").coalesce(PARTS).mapInArrow(trimmed(run), "v binary").collect()
    return np.sum([np.frombuffer(p.v) for p in parts] or [np.zeros(size)], axis=0)


def pool_adjacent(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Isotonic regression: the nearest ascending values in weighted squares."""
    stack: list[list[float]] = []
    for v, n in zip(y, w):
        stack.append([v, n, 1])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            v1, n1, c1 = stack.pop()
            v0, n0, c0 = stack.pop()
            stack.append([(v0 * n0 + v1 * n1) / (n0 + n1), n0 + n1, c0 + c1])
    return np.concatenate([np.full(int(c), v) for v, _, c in stack]) if stack else np.zeros(0)


class Model:
    """Standardisation, random features, ridge weights and the calibration."""

    def __init__(self, mean, scale, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, size=features)
        self.beta = np.zeros(features + 1)
        self.at, self.value = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2.0 / self.w.shape[1]) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated probability; within a step of the calibration a small
        share follows the raw score, so its order is kept."""
        raw = self.raw(x)
        fine = np.clip(raw, 0.0, 1.0)
        return np.clip(0.99 * np.interp(raw, self.at, self.value) + 0.01 * np.where(np.interp(raw, self.at, self.value) >= 0.5, 0.5 + fine / 2, fine / 2), 0.0, 1.0)


def fit(labelled: DataFrame, features: int = FEATURES, width: float = 4.0, ridge: float = 1e-4, seed: int = 7) -> Model | None:
    """`labelled`: x, y (how often labelled 1), w (how often labelled). None, if it
    has no rows."""
    m = len(NAMES)
    moments = _summed(labelled, lambda x, y, w: np.concatenate([[w.sum()], w @ x, w @ x**2]), 2 * m + 1)
    n = moments[0]
    if not n:
        return None
    mean = moments[1 : m + 1] / n
    scale = np.sqrt(np.maximum(moments[m + 1 :] / n - mean**2, 1e-12))
    model = Model(mean, np.where(scale < 1e-5, 1.0, scale), features, width, seed)
    d = features + 1

    def equations(x, y, w):
        z = model.features(x)
        return np.concatenate([((z.T * w) @ z).ravel(), z.T @ y])

    sums = _summed(labelled, equations, d * d + d)
    a = sums[: d * d].reshape(d, d) + ridge * n * np.eye(d)
    model.beta = np.linalg.solve(a, sums[d * d :])
    span = _summed_bins(labelled, model)
    raw, count, ones = span
    model.at, model.value = raw, pool_adjacent(ones / count, count)
    if len(model.at) == 1:
        model.at, model.value = np.array([raw[0], raw[0] + 1e-9]), np.repeat(model.value, 2)
    return model


def _summed_bins(labelled: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def count(x, y, w):
        k = np.clip((model.raw(x) + 1.0) / 3.0 * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(k, w, minlength=BINS), np.bincount(k, y, minlength=BINS)])

    sums = _summed(labelled, count, 2 * BINS)
    used = np.flatnonzero(sums[:BINS])
    return (used + 0.5) / BINS * 3.0 - 1.0, sums[:BINS][used], sums[BINS:][used]


def score(statistics_: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **options) -> DataFrame:
    """doc_id, score, predicted of every row of document_statistics(). `labels`:
    doc_id, y."""
    y = labels.filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sum("y").cast("double").alias("y"), F.count("*").alias("w"))
    n = y.count()
    if n > fit_rows:
        y = y.filter(F.xxhash64("doc_id") <= int((fit_rows / n - 0.5) * 2.0**64))
    labelled = materialize(statistics_.join(y, "doc_id").select("x", "y", "w").repartition(PARTS))
    model = fit(labelled, **options)
    kind = statistics_.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            s = model.score(_matrix(b.column(1))) if model and len(b.column(1)) else np.full(len(b.column(1)), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return statistics_.mapInArrow(trimmed(run), f"doc_id {kind}, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(document_statistics(read(spark, sf_dir, "documents")))
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).filter(~F.coalesce(held_out(3, 1), F.lit(False)))
    out = score(stats, labels)
    return out.select("doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "score", "predicted")
