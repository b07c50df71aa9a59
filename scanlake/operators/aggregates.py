"""Grouped aggregates over points; all are combined in each task before a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions.geometry import TAU, c, finite, symmetric_eigenvalues


def ring_capacity(points: DataFrame) -> DataFrame:
    """Per frame the number of rings (largest + 1) and the most points of one."""
    rings = points.groupBy("frame_id", "channel").count()
    return rings.groupBy("frame_id").agg((F.max("channel") + 1).alias("n_rings"), F.max("count").alias("max_points"))


def relabel(labels: DataFrame, min_size: int, max_size: int) -> DataFrame:
    """frame_id, label to a dense cluster_id, by ascending label, of the labels
    that have min_size to max_size points."""
    sizes = labels.groupBy("frame_id", "label").agg(F.count("*").alias("n_points")).filter(F.col("n_points").between(min_size, max_size))
    order = Window.partitionBy("frame_id").orderBy("label")
    return sizes.withColumn("cluster_id", (F.dense_rank().over(order) - 1).cast("int"))


def centroids(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"), F.count("*").alias("n_points"))


def aabb(points: DataFrame, *keys: str) -> DataFrame:
    """Axis-aligned boxes: centre and size."""
    ends = points.groupBy(*keys).agg(*(f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("n_points"))
    for a in "xyz":
        ends = ends.withColumns({f"c{a}": (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2, f"s{a}": F.col(f"max_{a}") - F.col(f"min_{a}")})
    return ends.drop(*(f"{n}_{a}" for a in "xyz" for n in ("min", "max")))


def voxel(size: float) -> list:
    return [F.floor(c(a) / size).alias(f"v{a}") for a in "xyz"]


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """The centroid of each leaf of a grid, per frame."""
    return points.select("frame_id", "x", "y", "z", *voxel(size)).groupBy("frame_id", "vx", "vy", "vz").agg(*(F.avg(a).alias(a) for a in "xyz"), F.count("*").alias("n_points"))


def range_image(points: DataFrame, width: int = 360, height: int = 32, min_range: float = 0.1) -> DataFrame:
    """The nearest point of each pixel; ties go to the smaller index."""
    r = F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z"))
    seen = points.filter(finite("x", "y", "z")).withColumn("range", r).filter(F.col("range") >= min_range)
    # atan2(-0.0, x) has another sign than atan2(0.0, x).
    azimuth = F.atan2(c("y") + F.lit(0.0), c("x"))
    col = F.pmod(F.floor((azimuth + math.pi) / TAU * width), F.lit(width)).cast("int")
    row = F.floor((F.asin(c("z") / F.col("range")) + math.pi / 2) / math.pi * height).cast("int")
    seen = seen.withColumns({"col": col, "row": F.least(row, F.lit(height - 1))})
    best = F.min_by(F.struct("point_idx", "range"), F.struct("range", "point_idx"))
    return seen.groupBy("frame_id", "row", "col").agg(best.alias("b")).select("frame_id", "row", "col", F.col("b.point_idx").alias("point_idx"), F.col("b.range").alias("range"))


def fitted_line(cells: DataFrame, *keys: str, radius: str = "r", height: str = "h", limit: float = math.tan(math.radians(20.0))) -> DataFrame:
    """Least-squares line through ground cells: slope (clamped) and intercept. One
    cell gives the line through the origin."""
    s = cells.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(radius).alias("sr"), F.sum(height).alias("sh"), F.sum(c(radius) * c(radius)).alias("srr"), F.sum(c(radius) * c(height)).alias("srh"),
    )
    det = F.col("n") * F.col("srr") - F.col("sr") * F.col("sr")
    raw = F.when(F.col("n") == 1, F.col("sh") / F.col("sr")).when(F.abs(det) < 1e-12, F.lit(0.0)).otherwise((F.col("n") * F.col("srh") - F.col("sr") * F.col("sh")) / det)
    slope = F.greatest(F.lit(-limit), F.least(F.lit(limit), raw))
    out = s.withColumn("slope", slope)
    return out.withColumn("intercept", F.when(F.col("n") == 1, F.lit(0.0)).otherwise((F.col("sh") - F.col("slope") * F.col("sr")) / F.col("n"))).select(*keys, "n", "slope", "intercept")


def cluster_quality(points: DataFrame, *keys: str, min_density: float = 0.01, max_elongation: float = 5.0) -> DataFrame:
    """0 for clusters of under 3 points or nearly no volume; else 1, times the
    density over its least where it is lower, times the elongation's limit over it
    where it is higher. Elongation: root of the ratio of the largest eigenvalue of
    the covariance to the middle one."""
    pairs = (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))
    g = points.groupBy(*keys).agg(
        F.count("*").alias("n_points"), *(F.covar_samp(a, b).alias(f"k{a}{b}") for a, b in pairs), *((F.max(a) - F.min(a)).alias(f"s{a}") for a in "xyz"),
    )
    e1, e2, _ = symmetric_eigenvalues("kxx", "kyy", "kzz", "kxy", "kxz", "kyz")
    g = g.withColumns({"volume": F.col("sx") * F.col("sy") * F.col("sz"), "e1": e1, "e2": e2})
    density = F.col("n_points") / F.col("volume")
    stretch = F.when(F.col("e2") > 1e-12, F.sqrt(F.col("e1") / F.col("e2"))).otherwise(F.lit(float(1 << 20)))
    q = F.least(F.lit(1.0), density / min_density) * F.when(stretch > max_elongation, max_elongation / stretch).otherwise(F.lit(1.0))
    return g.withColumn("quality", F.when((F.col("n_points") < 3) | (F.col("volume") < 1e-6), F.lit(0.0)).otherwise(q)).select(*keys, "n_points", "volume", "quality")


def normals(points: DataFrame, radius: float = 0.03) -> DataFrame:
    """frame_id, point_idx, n_neighbours, nx, ny, nz, curvature: the direction in which a
    point's neighbourhood (itself included) extends least, turned to the sensor at the
    origin, and that extent's share of all. Null where fewer than three points or only one
    line of them lie within the radius. Each point's sums are partial, no group is held."""
    from scanlake.operators.joins import neighbours

    near = neighbours(points, radius)
    both = near.select("frame_id", c("a").alias("point_idx"), c("b").alias("_o")).unionByName(near.select("frame_id", c("b").alias("point_idx"), c("a").alias("_o")))
    other = points.select("frame_id", c("point_idx").alias("_o"), "x", "y", "z")
    own = points.select("frame_id", "point_idx", "x", "y", "z")
    around = both.join(other, ["frame_id", "_o"]).select("frame_id", "point_idx", "x", "y", "z").unionByName(own)
    pairs = (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))
    m = around.groupBy("frame_id", "point_idx").agg(F.count("*").alias("n_neighbours"), *(F.covar_pop(a, b).alias(f"k{a}{b}") for a, b in pairs))
    e1, e2, e3 = symmetric_eigenvalues("kxx", "kyy", "kzz", "kxy", "kxz", "kyz")
    m = m.withColumns({"e1": e1, "e2": e2, "e3": e3})
    # Two rows of (covariance - e3) span the plane across the normal: of the three
    # cross products the longest is the most exact.
    rows = [[c("kxx") - c("e3"), c("kxy"), c("kxz")], [c("kxy"), c("kyy") - c("e3"), c("kyz")], [c("kxz"), c("kyz"), c("kzz") - c("e3")]]

    def cross(p, q):
        v = [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
        return F.struct((v[0] * v[0] + v[1] * v[1] + v[2] * v[2]).alias("s"), v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))

    m = m.withColumn("v", F.greatest(cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])))
    m = m.join(own, ["frame_id", "point_idx"])
    known = (c("n_neighbours") >= 3) & (c("e2") > 1e-6 * c("e1")) & (c("v.s") > 0)
    toward = F.when(c("v.x") * c("x") + c("v.y") * c("y") + c("v.z") * c("z") > 0, -1.0).otherwise(1.0) / F.sqrt("v.s")
    share = F.greatest(F.lit(0.0), c("e3")) / (c("e1") + c("e2") + c("e3"))
    return m.select("frame_id", "point_idx", "n_neighbours", *(F.when(known, c(f"v.{a}") * toward).alias(f"n{a}") for a in "xyz"), F.when(known, share).alias("curvature"))


def edge_coverage(points: DataFrame, start: float, end: float, margin: float) -> DataFrame:
    """Per frame whether all, any and how many channels have points near both ends
    of the field of view."""
    near = points.groupBy("frame_id", "channel").agg(F.bool_or(c("azimuth").between(start, start + margin)).alias("at_start"), F.bool_or(c("azimuth").between(end - margin, end)).alias("at_end"))
    both = F.col("at_start") & F.col("at_end")
    return near.groupBy("frame_id").agg(F.bool_and(both).alias("all_channels"), F.bool_or(both).alias("any_channel"), F.count_if(both).alias("n_channels"))
