"""op12: against an eigendecomposition and Python's integers, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.llm import whitening as W

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows, kind=VECTORS):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], kind)


def write(spark, df, path):
    df.write.parquet(f"{path}/embeddings.parquet")
    return {(r.vec_id, r.component): r for r in W.op12_whitening(spark, str(path)).collect()}


def check(found, rows, d, k=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    centred = ((n * x - s) / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    assert len(found) == n * min(k, d)
    for j in range(min(k, d)):
        got = np.array([found[i, j + 1].whitened for i, _ in rows])
        want = centred @ v[:, j] / np.sqrt(e[j])
        assert np.abs(got * np.sign(got @ want) - want).max() < 1e-6
    for i, (vec, _) in enumerate(rows):
        r = found[vec, 1]
        assert r.deviation == sum(int(t) ** 2 for t in n * x[i] - s) and r.n == n
        assert r.identity_error < 1e-9 and r.explained == pytest.approx(e[0] / (centred**2).sum() * n, rel=1e-9)


def test_equals_an_eigendecomposition_over_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FAN", 3)
    rng = np.random.default_rng(0)
    data = rng.normal(size=(400, 40)) * np.geomspace(8, 0.2, 40)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(data @ np.linalg.qr(rng.normal(size=(40, 40)))[0])]
    check(write(spark, vectors(spark, rows).repartition(11), tmp_path), rows, 40)


def test_fewer_dimensions_than_components_and_clashing_names(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(60, 3)) * [3, 1, 0.5])]
    df = vectors(spark, rows)
    for name in ("n", "i", "whitened", "component", "deviation", "v", "node", "state"):
        df = df.withColumn(name, F.lit("clash"))
    check(write(spark, df, tmp_path), rows, 3)


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    fine = [(i, [float(np.float32(c)) for c in rng.normal(size=2)]) for i in range(20)]
    odd = [(100, None), (101, [1.0, None]), (102, [float("nan"), 1.0]), (103, [float("inf"), 0.0]), (104, [1.0]), (105, [])]
    found = write(spark, vectors(spark, fine + [fine[0], (None, fine[1][1])] + odd), tmp_path)
    assert {i for i, _ in found} == {*range(20), None} and all(r.n == 22 for r in found.values())


def test_no_variance_and_no_rows(spark, tmp_path):
    assert write(spark, vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), tmp_path / "equal") == {}
    assert write(spark, vectors(spark, [(1, [1.0, 2.0])]), tmp_path / "one") == {}
    assert write(spark, vectors(spark, [(1, None)]), tmp_path / "null") == {}
    assert write(spark, vectors(spark, []), tmp_path / "empty") == {}
    # Three vectors on a line: one component.
    line = write(spark, vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(3)]), tmp_path / "line")
    assert {k for _, k in line} == {1} and line[0, 1].explained == pytest.approx(1, abs=1e-12)


def test_large_entries_stay_exact(spark, tmp_path):
    rows = [(i, [float(i) * 2**20, float(i % 3)]) for i in range(50)]
    found = write(spark, vectors(spark, rows, VECTORS.replace("float", "double")), tmp_path)
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    for i, v in enumerate(x):
        want = sum((50 * c - t) ** 2 for c, t in zip(v, s))
        assert found[i, 1].deviation == (want if want < 1 << 63 else None)
    far = write(spark, vectors(spark, [(1, [1e300]), (2, [-1e300]), (3, [0.0])], VECTORS.replace("float", "double")), tmp_path / "far")
    assert far[1, 1].deviation is None and far[1, 1].whitened == pytest.approx(-far[2, 1].whitened)


def test_rotations_keep_small_deviations():
    rng = np.random.default_rng(3)
    size = np.geomspace(1e8, 1e-3, 30)
    u, _ = np.linalg.qr(rng.normal(size=(60, 30)))
    got, v = W.jacobi(np.linalg.qr(u * size, mode="r"))
    assert np.abs(got / size - 1).max() < 1e-10 and np.abs(v.T @ v - np.eye(30)).max() < 1e-12
    got, v = W.jacobi(np.zeros((1, 3)))
    assert not got.any() and (np.abs(v.T @ v - np.eye(3)) < 1e-15).all()
