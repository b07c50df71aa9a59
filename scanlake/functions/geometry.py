"""Angles, rigid transforms and small matrices as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TAU = 2 * math.pi


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


@F.pandas_udf(DoubleType())
def exact_atan2(y: pd.Series, x: pd.Series) -> pd.Series:
    """atan2 as the C library rounds it. Java's is off by a last place at times, which
    tells where angles are compared with a bound that they meet exactly."""
    return pd.Series(list(map(math.atan2, y, x)), dtype="float64")


def wrap(angle, period: float = TAU) -> Column:
    """To [0, period)."""
    a = c(angle)
    return a - F.floor(a / F.lit(period)) * F.lit(period)


def in_arc(angle, start, end) -> Column:
    """Whether an angle lies in the circular interval from start to end, ends included."""
    a, s, e = c(angle), c(start), c(end)
    return ((s <= a) & (a <= e)) | ((e < s) & ((a <= e) | (s <= a)))


def arc_extent(start, end, period: float = 360.0) -> Column:
    """Length of a circular interval; an interval that ends where it starts is a full turn."""
    d = wrap(c(end) - c(start), period)
    return F.when(d == 0, F.lit(period)).otherwise(d)


def finite(*columns) -> Column:
    out = F.lit(True)
    for x in columns:
        out = out & c(x).isNotNull() & ~F.isnan(c(x)) & (F.abs(c(x)) < float("inf"))
    return out


def rigid(x, y, z, m: str = "") -> tuple[Column, Column, Column]:
    """R p + t with the columns m11..m33, tx, ty, tz (prefixed by `m`)."""
    x, y, z = c(x), c(y), c(z)
    k = lambda n: F.col(m + n)
    return tuple(k(f"m{i}1") * x + k(f"m{i}2") * y + k(f"m{i}3") * z + k(t) for i, t in ((1, "tx"), (2, "ty"), (3, "tz")))


def quaternion_matrix(qx: float, qy: float, qz: float, qw: float) -> list[list[float]]:
    """Rotation of a unit quaternion."""
    n = math.sqrt(qx * qx + qy * qy + qz * qz + qw * qw)
    x, y, z, w = qx / n, qy / n, qz / n, qw / n
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def symmetric_eigenvalues(a, b, d, e, f, g) -> tuple[Column, Column, Column]:
    """Eigenvalues, largest first, of [[a, e, f], [e, b, g], [f, g, d]] in closed form."""
    a, b, d, e, f, g = map(c, (a, b, d, e, f, g))
    q = (a + b + d) / 3
    p1 = e * e + f * f + g * g
    p2 = (a - q) * (a - q) + (b - q) * (b - q) + (d - q) * (d - q) + 2 * p1
    p = F.sqrt(p2 / 6)
    det = (a - q) * ((b - q) * (d - q) - g * g) - e * (e * (d - q) - g * f) + f * (e * g - (b - q) * f)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))
    phi = F.acos(r) / 3
    high, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + TAU / 3)
    flat = p2 <= 0
    return F.when(flat, q).otherwise(high), F.when(flat, q).otherwise(3 * q - high - low), F.when(flat, q).otherwise(low)


def out4(x) -> Column:
    """A float for output: four decimals, halves up, no negative zero."""
    return F.round(c(x) + F.lit(1e-9), 4) + F.lit(0.0)
