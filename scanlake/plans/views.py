"""Sensor-like tables derived from the provided ones, for Spark and as SQL.

The provided tables hold no sensor data; both sides derive the same rows by the
same arithmetic. Frames are bounded: more data means more frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CALIB = [(ch, -16.0 + ch, (ch % 4) * 0.5 - 0.75) for ch in range(32)]
TF = [
    ("lidar", "base", 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.5, -0.25, 2.0),
    ("imu", "base", 1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 1.0, 0.0, 0.5, 0.0, 1.0),
]
BOXES = [(0, -1.0, 1.0, -1.0, 1.0, -1.0, 1.0), (1, 2.0, 6.0, -3.0, 3.0, -5.0, 5.0), (2, -8.0, -4.0, 1.0, 9.0, -2.0, 2.0)]
#: A plane and a camera.
CAMERA = {"fx": 320.0, "fy": 300.0, "cx": 320.0, "cy": 240.0, "width": 640, "height": 480}

TF_SCHEMA = "source string, target string, m11 double, m12 double, m13 double, m21 double, m22 double, m23 double, m31 double, m32 double, m33 double, tx double, ty double, tz double"
BOX_SCHEMA = "box_id int, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def pts_emb(self, frame: str = "cast(vec_id div 64 as int)") -> DataFrame:
        e = self.table("embeddings").select("vec_id", "embedding", F.expr(frame).alias("frame_id"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
        at = lambda i: F.element_at("embedding", F.col("k") * 3 + i).cast("double") * 40
        return e.select(
            "frame_id", (F.col("vec_id") * 21 + F.col("k")).alias("point_idx"), (F.col("vec_id") % 32).cast("int").alias("channel"),
            at(1).alias("x"), at(2).alias("y"), at(3).alias("z"),
        )

    def pts_li(self) -> DataFrame:
        li = self.table("lineitem")
        # Ranked first: only the table's own columns are shuffled, and frames stay together after it.
        rows = li.withColumn("frame_id", F.expr("cast(l_orderkey div 256 as int)"))
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("frame_id").orderBy(*li.columns)) - 1)
        return rows.select(
            "frame_id", F.col("_n").cast("long").alias("point_idx"), (F.col("l_suppkey") % 32).cast("int").alias("channel"),
            ((F.col("l_partkey") * 7 % 401) / 10.0 - 20).alias("x"), ((F.floor("l_extendedprice") % 303) / 10.0 - 15).alias("y"), (F.col("l_discount") * 10 + F.col("l_tax") * 5 - 0.5).alias("z"),
            (F.col("l_partkey") % 256).cast("int").alias("intensity"),
        )

    def units_li(self) -> DataFrame:
        li = self.table("lineitem")
        # Ranked first: only the table's own columns are shuffled, and packets stay together after it.
        rows = li.withColumn("_n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*li.columns)) - 1)
        return rows.select(
            F.col("l_orderkey").alias("packet_id"), F.col("_n").cast("int").alias("block"), (F.col("l_suppkey") % 32).cast("int").alias("channel"),
            (F.col("l_orderkey") * 37 % 36000).cast("int").alias("raw_az"), (F.col("l_quantity") * 400).cast("int").alias("raw_dist"), (F.col("l_partkey") % 256).cast("int").alias("refl"),
            F.element_at(F.array(*map(F.lit, (0x33, 0x37, 0x38, 0x39, 0x3B, 0x3C))), (F.col("l_orderkey") % 6 + 1).cast("int")).alias("return_mode"),
        )

    def blocks_li(self) -> DataFrame:
        """All lines as blocks of packets of four; the last packet of 16 orders may be short."""
        li = self.table("lineitem")
        rows = li.withColumn("_n", F.row_number().over(Window.partitionBy(F.expr("l_orderkey div 16")).orderBy(*li.columns)) - 1)
        packet = F.expr("l_orderkey div 16 * 32 + _n div 4")
        return rows.select(
            packet.alias("packet_id"), (F.col("_n") % 4).cast("int").alias("block"), (F.col("l_orderkey") * 37 % 36000).cast("int").alias("raw_az"),
            (F.col("l_quantity") * 400).cast("int").alias("raw_dist"), (F.col("l_partkey") % 256).cast("int").alias("refl"),
            F.element_at(F.array(*map(F.lit, (0x33, 0x37, 0x38, 0x39, 0x3B, 0x3C))), (packet % 6 + 1).cast("int")).alias("return_mode"),
        )

    def _events(self) -> DataFrame:
        e = self.table("events")
        return e.withColumn("t_ns", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) * 1000"))

    def twist_ev(self, *more: str) -> DataFrame:
        return self._events().filter("event_type in ('click', 'view')").select(*more, "t_ns", (F.col("value") / 100).alias("vx"), ((F.col("event_id") % 21 - 10) / 100.0).alias("wz"))

    def imu_ev(self) -> DataFrame:
        return self._events().filter("event_type = 'purchase'").select("t_ns", ((F.col("event_id") % 21 - 10) / 100.0).alias("wz"))

    def stream_ev(self) -> DataFrame:
        return self._events().select(F.col("user_id").alias("sensor"), "event_id", "t_ns", "value", "props", "event_type")

    def dets(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("det_idx"), (k * 37 % 640).cast("double").alias("cx"), (k * 53 % 480).cast("double").alias("cy"), (40 + k % 80).cast("double").alias("w"), (30 + k % 60).cast("double").alias("h"),
            F.concat(F.lit("class_"), F.col("s_nationkey") % 5).alias("class_id"), (k % 100 / 100.0).alias("score"), (k % 10).cast("int").alias("frame_id"),
        )

    def calib(self) -> DataFrame:
        return self.spark.createDataFrame(CALIB, "channel int, elev_deg double, azim_off_deg double")

    def tf(self) -> DataFrame:
        return self.spark.createDataFrame(TF, TF_SCHEMA)

    def boxes(self) -> DataFrame:
        return self.spark.createDataFrame(BOXES, BOX_SCHEMA)


def _values(rows, names: str) -> str:
    cell = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


_ALL_LI = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_EV = "epoch_us(ts) * 1000"
SQL = {
    "pts_emb": """SELECT CAST(vec_id // 64 AS INT) AS frame_id, vec_id * 21 + k AS point_idx, CAST(vec_id % 32 AS INT) AS channel,
  CAST(embedding[3 * k + 1] AS DOUBLE) * 40 AS x, CAST(embedding[3 * k + 2] AS DOUBLE) * 40 AS y, CAST(embedding[3 * k + 3] AS DOUBLE) * 40 AS z
  FROM embeddings, (SELECT unnest(range(21)) AS k)""",
    "pts_li": f"""SELECT CAST(l_orderkey // 256 AS INT) AS frame_id, row_number() OVER (PARTITION BY l_orderkey // 256 ORDER BY {_ALL_LI}) - 1 AS point_idx,
  CAST(l_suppkey % 32 AS INT) AS channel, (l_partkey * 7 % 401) / 10.0::DOUBLE - 20 AS x, (CAST(floor(l_extendedprice) AS BIGINT) % 303) / 10.0::DOUBLE - 15 AS y,
  l_discount * 10 + l_tax * 5 - 0.5::DOUBLE AS z, CAST(l_partkey % 256 AS INT) AS intensity FROM lineitem""",
    "units_li": f"""SELECT l_orderkey AS packet_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ALL_LI}) - 1 AS INT) AS block,
  CAST(l_suppkey % 32 AS INT) AS channel, CAST(l_orderkey * 37 % 36000 AS INT) AS raw_az, CAST(trunc(l_quantity * 400) AS INT) AS raw_dist,
  CAST(l_partkey % 256 AS INT) AS refl, [51, 55, 56, 57, 59, 60][CAST(l_orderkey % 6 + 1 AS INT)] AS return_mode FROM lineitem""",
    "blocks_li": f"""SELECT *, [51, 55, 56, 57, 59, 60][CAST(packet_id % 6 + 1 AS INT)] AS return_mode FROM (
  SELECT l_orderkey // 16 * 32 + n // 4 AS packet_id, CAST(n % 4 AS INT) AS block, CAST(l_orderkey * 37 % 36000 AS INT) AS raw_az, CAST(trunc(l_quantity * 400) AS INT) AS raw_dist,
    CAST(l_partkey % 256 AS INT) AS refl
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey // 16 ORDER BY {_ALL_LI}) - 1 AS n FROM lineitem))""",
    "twist_ev": f"SELECT {_EV} AS t_ns, value / 100 AS vx, (event_id % 21 - 10) / 100.0::DOUBLE AS wz FROM events WHERE event_type IN ('click', 'view')",
    "imu_ev": f"SELECT {_EV} AS t_ns, (event_id % 21 - 10) / 100.0::DOUBLE AS wz FROM events WHERE event_type = 'purchase'",
    "stream_ev": f"SELECT user_id AS sensor, event_id, {_EV} AS t_ns, value, props, event_type FROM events",
    "dets": """SELECT s_suppkey AS det_idx, CAST(s_suppkey * 37 % 640 AS DOUBLE) AS cx, CAST(s_suppkey * 53 % 480 AS DOUBLE) AS cy, CAST(40 + s_suppkey % 80 AS DOUBLE) AS w,
  CAST(30 + s_suppkey % 60 AS DOUBLE) AS h, 'class_' || (s_nationkey % 5) AS class_id, (s_suppkey % 100) / 100.0::DOUBLE AS score, CAST(s_suppkey % 10 AS INT) AS frame_id FROM supplier""",
    "calib": _values(CALIB, "channel, elev_deg, azim_off_deg"),
    "tf": _values(TF, "source, target, m11, m12, m13, m21, m22, m23, m31, m32, m33, tx, ty, tz"),
    "boxes": _values(BOXES, "box_id, min_x, max_x, min_y, max_y, min_z, max_z"),
}
