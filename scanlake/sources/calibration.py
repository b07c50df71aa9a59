"""Calibration files as dimension tables. A file is a sensor's and small, so it is
read through Spark (from any store) and parsed on the driver."""

from __future__ import annotations

import re


import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanlake.functions.geometry import c


def read_channel_csv(spark: SparkSession, path: str) -> DataFrame:
    """channel (from 0), elev_deg, azim_off_deg of lines 'laser id, elevation,
    azimuth' with ids from 1; bad lines are skipped."""
    rows = spark.read.schema("laser int, elev_deg double, azim_off_deg double").option("mode", "DROPMALFORMED").csv(path)
    rows = rows.filter("laser is not null and elev_deg is not null and azim_off_deg is not null")
    return rows.select((c("laser") - 1).alias("channel"), "elev_deg", "azim_off_deg")


def write_channel_csv(calibration: DataFrame, path: str) -> None:
    out = calibration.select((c("channel") + 1).alias("Laser id"), c("elev_deg").alias("Elevation"), c("azim_off_deg").alias("Azimuth"))
    out.orderBy("Laser id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def parse_mirror_correction(blob: bytes) -> dict:
    """Frames, channels and adjustment grids of a binary correction file: it begins at
    the bytes EE FF; minor version 5 has four-byte values, 180 steps a channel and a
    resolution, 3 has two-byte values and grids of 36000."""
    at = blob.find(b"\xee\xff")
    if at < 0:
        raise ValueError("no correction data")
    minor, channels, mirrors = blob[at + 3], blob[at + 4], blob[at + 5]
    scale, at = blob[at + 15], at + 16
    if minor not in (3, 5):
        raise ValueError(f"unknown version {minor}")
    width, grid = (4, channels * 180) if minor == 5 else (2, 36_000)
    scale = scale if minor == 5 else 1

    def take(kind: str, n: int) -> list[int]:
        nonlocal at
        values = np.frombuffer(blob, kind, n, at).astype(np.int64) * scale
        at += values.size * np.dtype(kind).itemsize
        return values.tolist()

    unsigned, signed = (("<u4", "<i4") if width == 4 else ("<u2", "<u2"))
    return {"start": take(unsigned, mirrors), "stop": take(unsigned, mirrors), "azimuth": take(signed, channels), "elevation": take(signed, channels), "azimuth_adjust": take("<i1", grid), "elevation_adjust": take("<i1", grid), "steps": grid // max(channels, 1)}


def read_mirror_correction(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables frames, channels and grid of decode.correct_angles_by_mirror();
    angles in degrees of 1/25600."""
    k = parse_mirror_correction(_bytes(spark, path))
    frames = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(k["start"], k["stop"]))], "field int, start long, stop long")
    channels = spark.createDataFrame([(i, a / 25_600.0, e / 25_600.0) for i, (a, e) in enumerate(zip(k["azimuth"], k["elevation"]))], "channel int, azimuth double, elevation double")
    grid = spark.createDataFrame([(i // k["steps"], i % k["steps"], a, e) for i, (a, e) in enumerate(zip(k["azimuth_adjust"], k["elevation_adjust"]))], "channel int, step int, adjust int, elevation_adjust int")
    return frames, channels, grid


_PAIR = re.compile(r"([a-z_]+)\s*:\s*([-+]?[0-9.][-+0-9.eE]*)")
LASER = "laser_id int, rot_correction double, vert_correction double, dist_correction double, dist_correction_x double, dist_correction_y double, vert_offset_correction double, horiz_offset_correction double, focal_distance double, focal_slope double, max_intensity double, min_intensity double"


def parse_lasers(text: str) -> tuple[list[dict], dict]:
    """Lasers (each in braces) and the numbers beside them."""
    lasers = [{k: float(v) for k, v in _PAIR.findall(block)} for block in re.findall(r"\{([^}]*)\}", text)]
    rest = {k: float(v) for k, v in _PAIR.findall(re.sub(r"\{[^}]*\}", "", text))}
    return lasers, rest


def lasers_text(lasers: list[dict], rest: dict) -> str:
    body = "".join("- {" + ", ".join(f"{k}: {v:g}" if k == "laser_id" else f"{k}: {v!r}" for k, v in sorted(x.items())) + "}\n" for x in lasers)
    return "lasers:\n" + body + "".join(f"{k}: {v:g}\n" for k, v in rest.items())


def read_lasers(spark: SparkSession, path: str) -> DataFrame:
    """One row per laser with its corrections, bounds of intensity where missing
    0 and 255, and its ring."""
    lasers, _ = parse_lasers(_bytes(spark, path).decode())
    names = [x.split()[0] for x in LASER.split(", ")]
    filled = [{**dict.fromkeys(names, 0.0), "max_intensity": 255.0, **x} for x in lasers]
    rows = [tuple(int(x[n]) if n == "laser_id" else float(x[n]) for n in names) for x in filled]
    return with_rings(spark.createDataFrame(rows, LASER))


def with_rings(lasers: DataFrame) -> DataFrame:
    """ring: the rank of a laser's vertical angle; equal angles share one."""
    return lasers.withColumn("ring", F.dense_rank().over(Window.orderBy("vert_correction")) - 1)


