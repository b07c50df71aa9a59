"""Projections and predicates over point tables: no shuffle, all in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions.geometry import c, finite, rigid
from scanlake.schemas import require_columns


def transform(points: DataFrame, tf: DataFrame, source: str, target: str) -> DataFrame:
    """Rotate and translate every point; other columns stay. One transform is one
    row, so joining it moves no points."""
    require_columns(points, "x", "y", "z")
    row = tf.filter((F.col("source") == source) & (F.col("target") == target)).limit(1).drop("source", "target")
    names = row.columns
    x, y, z = rigid("x", "y", "z")
    return points.join(F.broadcast(row)).withColumns({"_x": x, "_y": y, "_z": z}).drop("x", "y", "z", *names).withColumnsRenamed({"_x": "x", "_y": "y", "_z": "z"})


def rotate(vectors: DataFrame, tf: DataFrame, source: str, target: str) -> DataFrame:
    """A transform without its translation, as for angular velocities."""
    zero = tf.withColumns({k: F.lit(0.0) for k in ("tx", "ty", "tz")})
    return transform(vectors, zero, source, target)


def inside_box(box: dict) -> Column:
    """Strictly inside: faces belong to the outside."""
    out = F.lit(True)
    for a in "xyz":
        out = out & (c(a) > box[f"min_{a}"]) & (c(a) < box[f"max_{a}"])
    return out


def crop(points: DataFrame, boxes: list[dict]) -> DataFrame:
    """Keep points outside all boxes; with no boxes, all of them."""
    keep = F.lit(True)
    for b in boxes:
        keep = keep & ~inside_box(b)
    return points.filter(keep)


def crop_by_table(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """The same for a table of boxes (a configuration, so small)."""
    near = F.lit(True)
    for a in "xyz":
        near = near & (points[a] > boxes[f"min_{a}"]) & (points[a] < boxes[f"max_{a}"])
    return points.join(F.broadcast(boxes), near, "left_anti")


def roi(points: DataFrame, box: dict) -> DataFrame:
    """Keep points inside a box, faces included."""
    keep = F.lit(True)
    for a in "xyz":
        keep = keep & c(a).between(box[f"min_{a}"], box[f"max_{a}"])
    return points.filter(keep)


def compact(points: DataFrame, *masks: Column) -> DataFrame:
    """Points that pass all masks, with a dense index per frame."""
    keep = F.lit(True)
    for m in masks:
        keep = keep & m
    order = Window.partitionBy("frame_id").orderBy("point_idx")
    return points.filter(keep).withColumn("out_idx", (F.row_number().over(order) - 1).cast("long"))


def cap(points: DataFrame, max_points: int) -> DataFrame:
    """The first `max_points` of each frame."""
    order = Window.partitionBy("frame_id").orderBy("point_idx")
    return points.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_points).drop("_n")


def drop_non_finite(points: DataFrame) -> DataFrame:
    return points.filter(finite("x", "y", "z"))


def pinhole(points: DataFrame, camera: dict) -> DataFrame:
    """Pixels (u, v) of points before the camera that fall on the image; fractions
    are cut off."""
    u = camera["fx"] * c("x") / c("z") + camera["cx"]
    v = camera["fy"] * c("y") / c("z") + camera["cy"]
    seen = points.filter(finite("x", "y", "z") & (c("z") > 0))
    # Tested before they are cut: (-1, 0) would become 0, and no int holds what the least depths give.
    seen = seen.filter((u >= 0) & (v >= 0) & (u < camera["width"]) & (v < camera["height"]))
    return seen.withColumns({"u": u.cast("int"), "v": v.cast("int")})


def with_cluster_id(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Append cluster_id, -1 where a point has none."""
    own = labels.select("frame_id", "point_idx", F.col("cluster_id").cast("int"))
    return points.join(own, ["frame_id", "point_idx"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


def clustered_only(points: DataFrame) -> DataFrame:
    return points.filter(F.col("cluster_id") >= 0)


def select_clusters(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Points whose (frame, cluster) is listed."""
    return points.join(wanted.select("frame_id", "cluster_id").distinct(), ["frame_id", "cluster_id"], "left_semi")


def box_marker(boxes: DataFrame) -> DataFrame:
    """Centre and size of axis-aligned boxes."""
    out = {}
    for a in "xyz":
        out[f"c{a}"] = (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2
        out[f"s{a}"] = F.col(f"max_{a}") - F.col(f"min_{a}")
    return boxes.withColumns(out)


def plane_split(points: DataFrame, normal: tuple[float, float, float], d: float, height: float) -> DataFrame:
    """Signed distance along the unit normal of n.p + d = 0, and whether a point is
    farther from the plane than `height`."""
    n = sum(k * k for k in normal) ** 0.5
    dist = (normal[0] * c("x") + normal[1] * c("y") + normal[2] * c("z") + d) / n
    return points.withColumn("dist", dist).withColumn("is_obstacle", F.abs(F.col("dist")) > height)


#: Layouts of point tables other than the full one; azimuth in centidegrees and absolute time where a layout has them.
LAYOUTS = {
    "xyzir": lambda: [c("x"), c("y"), c("z"), c("intensity").cast("float").alias("intensity"), c("channel").alias("ring")],
    "xyzircaedt": lambda: [c(k) for k in ("x", "y", "z", "intensity", "return_type", "channel", "azimuth", "elevation", "distance", "t_ns")],
    "xyzirc": lambda: [c(k) for k in ("x", "y", "z", "intensity", "return_type", "channel")],
    "xyziradt": lambda: [
        c("x"), c("y"), c("z"), c("intensity").cast("float").alias("intensity"), c("channel").alias("ring"), (F.degrees("azimuth") * 100).alias("azimuth"), c("distance"),
        c("return_type"), ((c("stamp_ns") + c("t_ns")) / 1e9).alias("time_stamp"),
    ],
    "xyzicatr": lambda: [c("x"), c("y"), c("z"), c("intensity"), c("channel"), c("azimuth"), c("t_ns").alias("time_stamp"), c("return_type")],
}


def layout(points: DataFrame, name: str, *keys: str) -> DataFrame:
    return points.select(*keys, *LAYOUTS[name]())
