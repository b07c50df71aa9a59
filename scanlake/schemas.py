"""Column types of the tables the operators work on, as DDL text, and a guard that
fails fast.

Nanosecond stamps are BIGINT (TIMESTAMP has microseconds); coordinates are DOUBLE;
a missing value is NULL inside the engine, sentinels exist at sources and sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


POINT = "frame_id INT, point_idx BIGINT, x DOUBLE, y DOUBLE, z DOUBLE, intensity SMALLINT, return_type TINYINT, channel INT, azimuth DOUBLE, elevation DOUBLE, distance DOUBLE, t_ns BIGINT"
PACKET = "packet_id BIGINT, stamp_ns BIGINT, data BINARY"
UNIT = "packet_id BIGINT, block INT, channel INT, raw_az INT, raw_dist INT, refl INT, return_mode INT"
TWIST = "t_ns BIGINT, vx DOUBLE, wz DOUBLE"
TRANSFORM = "source STRING, target STRING, m11 DOUBLE, m12 DOUBLE, m13 DOUBLE, m21 DOUBLE, m22 DOUBLE, m23 DOUBLE, m31 DOUBLE, m32 DOUBLE, m33 DOUBLE, tx DOUBLE, ty DOUBLE, tz DOUBLE"
BOX = "box_id INT, min_x DOUBLE, max_x DOUBLE, min_y DOUBLE, max_y DOUBLE, min_z DOUBLE, max_z DOUBLE"
DETECTION = "det_idx BIGINT, cx DOUBLE, cy DOUBLE, w DOUBLE, h DOUBLE, class_id STRING, score DOUBLE"
CALIBRATION = "channel INT, elev_deg DOUBLE, azim_off_deg DOUBLE"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The table itself, or an error that names what it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df
