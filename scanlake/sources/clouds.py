"""Point clouds as PCD files, and a synthetic cloud."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.functions.geometry import c


def _header(names: list[str], n: int) -> bytes:
    k = len(names)
    return (
        f"# .PCD v0.7 - Point Cloud Data file format\nVERSION 0.7\nFIELDS {' '.join(names)}\nSIZE {' '.join('4' * k)}\nTYPE {' '.join('F' * k)}\nCOUNT {' '.join('1' * k)}\n"
        f"WIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
    ).encode()


def to_pcd(points: DataFrame, *fields: str) -> DataFrame:
    """frame_id, pcd: a binary PCD of each frame's points, by index, with x, y, z or
    the fields given. A frame is one scan and fits a task."""
    names = list(fields or ("x", "y", "z"))
    kind = points.schema["frame_id"].dataType.simpleString()

    def run(table):
        table = table.sort_by("point_idx")
        data = np.stack([table.column(n).to_numpy().astype("<f4") for n in names], axis=1)
        return pa.table({"frame_id": table.column("frame_id").slice(0, 1), "pcd": pa.array([_header(names, len(data)) + data.tobytes()], pa.binary())})

    return points.select("frame_id", "point_idx", *names).groupBy("frame_id").applyInArrow(run, f"frame_id {kind}, pcd binary")


def from_pcd(files: DataFrame) -> DataFrame:
    """frame_id, point_idx, x, y, z of binary PCD values."""
    kind = files.schema["frame_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, blob in enumerate(b.column(1).to_pylist()):
                head, _, body = blob.partition(b"DATA binary\n")
                fields = dict(line.split(b" ", 1) for line in head.splitlines() if b" " in line)
                names, n = fields[b"FIELDS"].decode().split(), int(fields[b"POINTS"])
                data = np.frombuffer(body, "<f4", n * len(names)).reshape(n, len(names)).astype(float)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * n, pa.int64())), pa.array(np.arange(n)), *(pa.array(data[:, names.index(a)]) for a in "xyz")], ["frame_id", "point_idx", "x", "y", "z"])

    return files.select("frame_id", "pcd").mapInArrow(run, f"frame_id {kind}, point_idx long, x double, y double, z double")


def synthetic(spark: SparkSession, frame_id: int = 0) -> DataFrame:
    """A cylinder of 20 rings of 100 points (radius 1, height 2) and a sphere of 1000
    points (radius 0.5, centre (2, 0, 1))."""
    turn = 2 * math.pi
    cylinder = spark.range(2000).select(c("id").alias("point_idx"), F.expr("id div 100").alias("r"), (c("id") % 100 * (turn / 100)).alias("a"))
    cylinder = cylinder.select("point_idx", F.cos("a").alias("x"), F.sin("a").alias("y"), (c("r") * 0.1).alias("z"))
    # Even places on the sphere: turns by the golden angle down its height.
    sphere = spark.range(1000).select((c("id") + 2000).alias("point_idx"), (1 - (c("id") + 0.5) / 500.0).alias("h"), (c("id") * (math.pi * (3 - math.sqrt(5)))).alias("a"))
    flat = F.sqrt(1 - c("h") * c("h")) * 0.5
    sphere = sphere.select("point_idx", (2 + flat * F.cos("a")).alias("x"), (flat * F.sin("a")).alias("y"), (1 + c("h") * 0.5).alias("z"))
    return cylinder.unionByName(sphere).withColumn("frame_id", F.lit(frame_id))
