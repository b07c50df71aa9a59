"""Whitening of embeddings by a one-sided Jacobi SVD of their triangular factor.

Entries become integers, x = floor(64 * entry) + OFFSET, so the sums S and the
deviations n * x - S are exact. Each task reduces its centred rows block by block to
a triangle R (QR of the last triangle on top of the next block); triangles of FAN
tasks at a time are stacked and reduced again until one is left, of d x d numbers
whatever the rows. Plane rotations make R's columns orthogonal, those of a round on
disjoint pairs of columns; the rotations multiplied together hold the components,
the columns' lengths are the standard deviations times sqrt(n). No product of the
data with itself is formed, so small deviations keep their accuracy.

The whitened rows' covariance is taken in a pass of its own, centred by their own
mean: means and centred products of tasks are merged in the same tree.

Defined cases: a vector that is null, empty, of another length than most (ties: the
shorter) or that holds null or non-finite entries takes no part. Entries beyond
2^52 / 64 count as that. Rows that repeat count and are returned each, as are rows
without id. Components whose variance is nothing but rounding (below d * 2^-52 of
the largest deviation) are left out, so fewer may come, and none for a single
vector or equal ones. Equal eigenvalues: any basis of their space, the same for all
rows. A deviation beyond a long is null. Without vectors, no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm.common import drop_table, materialize, read, small_batches, trimmed

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Partial results that one task merges.
FAN = 16
LIMIT = 1 << 52


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, v (doubles) of the vectors that take part, and their length."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0].d if sizes else 0
    return rows.filter(F.size("v") == d), d


def integers(column, d: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.clip(np.floor(SCALE * v), -LIMIT, LIMIT).astype(np.int64) + OFFSET


def deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - s, exactly: as long integers where these hold it, else Python's."""
    mean = np.array([t / n for t in s])
    if n * (np.abs(x - mean).max(initial=0.0) + 1) < 2.0**62:
        # Differences of products that wrap around are right if they fit.
        wrapped = np.array([t % (1 << 64) for t in s], dtype=np.uint64)
        return (np.uint64(n % (1 << 64)) * x.view(np.uint64) - wrapped).view(np.int64)
    return n * x.astype(object) - np.array(s, dtype=object)


def square_sums(y: np.ndarray) -> list[int | None]:
    """Of each row, exactly; None beyond a long."""
    wide = np.flatnonzero((y.astype(np.float64) ** 2).sum(1) >= 2.0**62)
    small = y.copy()
    small[wide] = 0
    out: list = (small.astype(np.int64) ** 2).sum(1).tolist()
    for i in wide.tolist():
        total = sum(int(t) ** 2 for t in y[i])
        out[i] = total if total < 1 << 63 else None
    return out


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each entry, exact: halves of the integers are
    added apart, so that no task's sum overflows."""

    def add(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = integers(b.column(1), d)
            n, high, low = n + len(x), high + (x >> 26).sum(0), low + (x & ((1 << 26) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    total = sorted(rows.mapInArrow(trimmed(add), "i int, n long, high long, low long").groupBy("i").agg(*exact).collect())  # d rows
    return (int(total[0].n) if total else 0), [(int(r.high) << 26) + int(r.low) for r in total]


def _dump(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _load(blob: bytes) -> list[np.ndarray]:
    held = np.load(io.BytesIO(blob))
    return [held[k] for k in held.files]


def merged(rows: DataFrame, blocks, merge) -> list[np.ndarray]:
    """One result of all tasks: `blocks` turns a batch into arrays, `merge` two sets of
    arrays into one, first in each task, then FAN tasks' at a time until one is left."""

    def in_task(batches):
        kept = None
        for b in batches:
            if b.num_rows:
                kept = blocks(b) if kept is None else merge(kept, blocks(b))
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_dump(*kept)], pa.binary())], ["node", "state"])

    def together(table):
        table = table.sort_by("node")
        kept = None
        for blob in table.column("state").to_pylist():
            kept = _load(blob) if kept is None else merge(kept, _load(blob))
        return pa.table({"node": pa.array([table.column("node")[0].as_py() // FAN], pa.int64()), "state": pa.array([_dump(*kept)], pa.binary())})

    written = materialize(rows.mapInArrow(trimmed(in_task), "node long, state binary"))
    level, top = written, written.agg(F.max("node")).first()[0]
    while top:
        level, top = level.groupBy(F.expr(f"node div {FAN}")).applyInArrow(together, "node long, state binary"), top // FAN
    out = _load(level.first().state)
    drop_table(written)
    return out


def _pairs(d: int):
    """Rounds of disjoint pairs of columns that meet each pair once: one column stays,
    the others move on in a circle."""
    m = d + d % 2
    ring = np.arange(m)
    for _ in range(m - 1):
        p, q = ring[: m // 2], ring[: m // 2 - 1 : -1]
        held = (p < d) & (q < d)
        yield p[held], q[held]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the orthogonalised columns of `r`, falling, and the rotations: the
    right singular vectors, a column each."""
    d = r.shape[1]
    order = np.argsort(-(r**2).sum(0), kind="stable")
    a, v = r[:, order].astype(np.float64), np.eye(d)[:, order]
    enough = 2.0**-52 * max(8.0, np.sqrt(d))
    for _ in range(sweeps):
        turned = False
        for p, q in _pairs(d):
            left, right = a[:, p], a[:, q]
            alpha, beta, gamma = (left**2).sum(0), (right**2).sum(0), (left * right).sum(0)
            open_ = np.abs(gamma) > enough * np.sqrt(alpha * beta)
            if not open_.any():
                continue
            turned = True
            p, q, alpha, beta, gamma = (x[open_] for x in (p, q, alpha, beta, gamma))
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            for m in (a, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * (x - t * y), c * (t * x + y)
        if not turned:
            break
    size = np.sqrt((a**2).sum(0))
    order = np.argsort(-size, kind="stable")
    return size[order], v[:, order]


@dataclass
class Model:
    """n and S of the fit list, components (a column each), standard deviations, and the
    share of the whole variance that each explains."""

    n: int
    s: list[int]
    components: np.ndarray
    deviation: np.ndarray
    explained: np.ndarray

    def whiten(self, y: np.ndarray) -> np.ndarray:
        """Of deviations n * x - S."""
        return (y.astype(np.float64) / self.n) @ self.components / self.deviation


def _triangle(above: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.concatenate([above, below]), mode="r")


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Model:
    n, s = sums(rows, d)
    if not n:
        return Model(0, s, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    (r,) = merged(
        rows,
        lambda b: [np.linalg.qr(deviations(integers(b.column(1), d), n, s).astype(np.float64) / n, mode="r")],
        lambda x, y: [_triangle(x[0], y[0])],
    )
    size, v = jacobi(r)
    k = min(components, int((size > d * 2.0**-52 * size[0]).sum()))
    return Model(n, s, v[:, :k], size[:k] / np.sqrt(n), size[:k] ** 2 / max((size**2).sum(), 2.0**-1022))


def _moments(w: np.ndarray) -> list[np.ndarray]:
    mean = w.mean(0)
    return [np.array(float(len(w))), mean, (w - mean).T @ (w - mean)]


def _join_moments(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    n, shift = x[0] + y[0], y[1] - x[1]
    return [n, x[1] + shift * (y[0] / n), x[2] + y[2] + np.outer(shift, shift) * (x[0] * y[0] / n)]


def identity_error(rows: DataFrame, d: int, model: Model) -> float:
    """Largest entry of the whitened rows' covariance less the identity."""
    if not model.deviation.size:
        return 0.0
    n, _, m2 = merged(rows, lambda b: _moments(model.whiten(deviations(integers(b.column(1), d), model.n, model.s))), _join_moments)
    return float(np.abs(m2 / n - np.eye(len(m2))).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Model, float]:
    """vec_id, deviation, whitened (an array, a number a component) of each vector that
    takes part; the model; and the identity error."""
    small_batches(vectors.sparkSession)
    rows, d = usable(vectors)
    model = fit(rows, d, components)
    error = identity_error(rows, d, model)

    def run(batches):
        for b in batches:
            y = deviations(integers(b.column(1), d), model.n, model.s)
            w = model.whiten(y)
            k = w.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(square_sums(y), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(run), f"vec_id {kind}, deviation long, whitened array<double>"), model, error


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, model, error = whiten(read(spark, sf_dir, "embeddings"))
    long = out.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    explained = F.get(F.lit(model.explained.tolist()), F.col("i")) if model.explained.size else F.lit(None).cast("double")
    return long.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"),
    )
