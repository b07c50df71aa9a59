"""Queries that follow rings and sensors in order, and joins in time and space."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions.geometry import c, exact_atan2, out4
from scanlake.operators import joins as J
from scanlake.operators import ordered as W
from scanlake.plans.clouds import PIXELS, CAMERA
from scanlake.operators import clouds as P
from scanlake.plans.registry import query

HOUR = 3_600_000_000_000
TIES = ("event_id",)
#: Points of the rings test: distance and azimuth of pts_li.
_RING = "SELECT *, sqrt(x * x + y * y + z * z) AS distance, atan2(y, x) AS azimuth FROM pts_li"


def _ring(v):
    return v.pts_li().withColumns({"distance": F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z")), "azimuth": exact_atan2("y", "x")})


@query("w01_organize", "SELECT frame_id, channel, point_idx, CAST(row_number() OVER (PARTITION BY frame_id, channel ORDER BY point_idx) - 1 AS INT) AS ring_pos FROM pts_li")
def w01(v):
    return W.organize(v.pts_li()).select("frame_id", "channel", "point_idx", "ring_pos")


def _outlier_sql(source: str, n: int, ratio: float, length: float, step: float) -> str:
    return f"""WITH r0 AS ({source}), r1 AS (SELECT *, row_number() OVER w - 1 AS pos, lag(distance) OVER w AS d0, azimuth - lag(azimuth) OVER w AS da FROM r0 WINDOW w AS (PARTITION BY frame_id, channel ORDER BY point_idx)),
r2 AS (SELECT *, CASE WHEN d0 IS NULL OR greatest(d0, distance) >= least(d0, distance) * {ratio} OR degrees(CASE WHEN da < 0 THEN da + 2 * pi() ELSE da END) >= {step} THEN 1 ELSE 0 END AS brk FROM r1),
r3 AS (SELECT *, sum(brk) OVER (PARTITION BY frame_id, channel ORDER BY pos) AS island FROM r2),
r4 AS (SELECT *, greatest(min(pos) OVER i, pos - {n}) AS lo, least(max(pos) OVER i, pos + {n} - 1) AS hi FROM r3 WINDOW i AS (PARTITION BY frame_id, channel, island))
SELECT p.frame_id, p.point_idx, CAST(p.hi - p.lo + 1 AS INT) AS walk,
  (p.hi - p.lo + 1 > {n} OR (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) >= {length} * {length}) AS keep
FROM r4 p JOIN r4 a ON a.frame_id = p.frame_id AND a.channel = p.channel AND a.pos = p.lo JOIN r4 b ON b.frame_id = p.frame_id AND b.channel = p.channel AND b.pos = p.hi"""


@query("w02_ring_outliers", _outlier_sql(_RING, 5, 1.3, 6.0, 90.0))
def w02(v):
    return W.ring_outliers(_ring(v), 5, 1.3, 6.0, 90.0).select("frame_id", "point_idx", "walk", "keep")


_DAY = "CAST(floor(t_ns / 86400000000000.0) AS BIGINT)"
_POSES = f"""SELECT *, sum(vx * dt * cos(theta)) OVER w AS px, sum(vx * dt * sin(theta)) OVER w AS py FROM (
 SELECT *, sum(wz * dt) OVER (PARTITION BY day ORDER BY t_ns) AS theta FROM (
 SELECT *, coalesce((t_ns - lag(t_ns) OVER (PARTITION BY day ORDER BY t_ns)) / 1e9, 0.0) / 1000 AS dt FROM (SELECT *, {_DAY} AS day FROM twist_ev))) WINDOW w AS (PARTITION BY day ORDER BY t_ns)"""


def _twists(v):
    # Stamps are minutes apart in the test tables: a thousandth of their time. Of equal
    # stamps the event of smaller id, which is read first, comes first.
    return v.twist_ev("event_id").withColumn("day", F.floor(c("t_ns") / 86_400_000_000_000)).withColumns({"vx": c("vx") / 1000, "wz": c("wz") / 1000})


@query("w03_integrate_2d", f"SELECT t_ns, R4(theta) AS theta, R4(px) AS px, R4(py) AS py FROM ({_POSES})")
def w03(v):
    return W.integrate_2d(_twists(v), "day", ties=TIES).select("t_ns", *(out4(k).alias(k) for k in ("theta", "px", "py")))


@query("w05_undistort_2d", f"""WITH poses AS (SELECT *, coalesce(lag(t_ns) OVER o, t_ns) AS prev_ns, coalesce(lag(theta) OVER o, 0) AS prev_theta, coalesce(lag(px) OVER o, 0) AS prev_px, coalesce(lag(py) OVER o, 0) AS prev_py
  FROM ({_POSES}) WINDOW o AS (PARTITION BY day ORDER BY t_ns)),
pts AS (SELECT event_id, t_ns, value AS x, event_id % 17 - 8.0::DOUBLE AS y FROM stream_ev),
met AS (SELECT p.*, coalesce(q.t_ns, (SELECT max(t_ns) FROM poses)) AS at FROM pts p ASOF LEFT JOIN poses q ON p.t_ns <= q.t_ns),
moved AS (SELECT m.event_id, m.x, m.y, greatest(0.0, (m.t_ns - prev_ns) / 1e9) AS dt, q.* EXCLUDE (dt) FROM met m JOIN poses q ON q.t_ns = m.at),
turned AS (SELECT *, prev_theta + wz / 1000 * dt AS th FROM moved)
SELECT event_id, R4(x * cos(th) - y * sin(th) + prev_px + vx / 1000 * dt * cos(th)) AS ux, R4(x * sin(th) + y * cos(th) + prev_py + vx / 1000 * dt * sin(th)) AS uy FROM turned""")
def w05(v):
    poses = J.with_previous(W.integrate_2d(_twists(v), "day", ties=TIES), "day", ties=TIES).drop("day", *TIES)
    pts = v.stream_ev().select("event_id", "t_ns", c("value").alias("x"), (c("event_id") % 17 - 8.0).alias("y"))
    return J.undistort_2d(pts, poses, HOUR).select("event_id", out4("ux").alias("ux"), out4("uy").alias("uy"))


@query("w07_trim_queue", """SELECT t_ns FROM twist_ev, (SELECT max(t_ns) AS newest, max(CASE WHEN t_ns < 1704153600000000000 THEN t_ns END) AS before FROM twist_ev)
WHERE t_ns >= newest - 864000000000000 AND (t_ns >= 1704153600000000000 OR t_ns = before)""")
def w07(v):
    return W.trim_queue(v.twist_ev(), 1_704_153_600_000_000_000, 864_000_000_000_000).select("t_ns")


@query("w11_range_image_stats", """SELECT frame_id, count(*) AS n_pixels, R4(100.0 * sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*)) AS single_percent FROM (
 SELECT frame_id, floor(x) AS a, floor(y) AS b, count(*) AS n FROM pts_li GROUP BY ALL) GROUP BY frame_id""")
def w11(v):
    g = v.pts_li().groupBy("frame_id", F.floor("x").alias("a"), F.floor("y").alias("b")).agg(F.count("*").alias("n"))
    return g.groupBy("frame_id").agg(F.count("*").alias("n_pixels"), out4(100.0 * F.count_if(F.col("n") == 1) / F.count("*")).alias("single_percent"))


@query("a14_rates", """WITH g AS (SELECT *, (t_ns - lag(t_ns) OVER (PARTITION BY sensor ORDER BY t_ns, event_id)) / 1e9 AS gap FROM stream_ev)
SELECT event_id, n_gaps, R4(rate * 1e6) AS rate_uhz, (n_gaps = 5 AND rate BETWEEN 0.00001 AND 0.001) AS valid FROM (
 SELECT event_id, count(CASE WHEN gap > 0 THEN 1 / gap END) OVER w AS n_gaps, avg(CASE WHEN gap > 0 THEN 1 / gap END) OVER w AS rate FROM g
 WINDOW w AS (PARTITION BY sensor ORDER BY t_ns, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""")
def a14(v):
    r = W.rates(v.stream_ev(), 5, 0.00001, 0.001)
    return r.select("event_id", "n_gaps", out4(F.col("rate_hz") * 1e6).alias("rate_uhz"), "valid")


CYCLE = 20_000_000_000_000


@query("r06_drop_estimation", f"""WITH g AS (SELECT *, t_ns - lag(t_ns) OVER (PARTITION BY sensor ORDER BY t_ns, event_id) AS gap FROM stream_ev)
SELECT sensor, count(*) AS n_messages, CAST(count_if(value < 10) AS BIGINT) AS n_empty, CAST(count_if(gap > 1.75 * {CYCLE}) AS BIGINT) AS n_drops,
 CAST(sum(CASE WHEN gap > 1.75 * {CYCLE} THEN CAST(round(gap / {CYCLE}.0) AS BIGINT) - 1 ELSE 0 END) AS BIGINT) AS n_missed FROM g GROUP BY sensor""")
def r06(v):
    s = v.stream_ev().withColumn("n_objects", F.when(c("value") < 10, 0).otherwise(1))
    return W.drops(s, CYCLE).select("sensor", "n_messages", "n_empty", "n_drops", "n_missed")


@query("r07_drop_rates", f"""SELECT sensor, R4(CASE WHEN due > 0 THEN greatest(0.0, 1 - n / due) ELSE 0.0 END) AS drop_rate, R4(e / n) AS empty_rate FROM (
 SELECT sensor, CAST(count(*) AS DOUBLE) AS n, CAST(count_if(value < 10) AS DOUBLE) AS e, round((max(t_ns) - min(t_ns)) / {CYCLE}.0) + 1 AS due FROM stream_ev GROUP BY sensor)""")
def r07(v):
    s = v.stream_ev().withColumn("n_objects", F.when(c("value") < 10, 0).otherwise(1))
    return W.drop_rates(W.drops(s, CYCLE), CYCLE).select("sensor", out4("drop_rate").alias("drop_rate"), out4("empty_rate").alias("empty_rate"))


@query("t10_watchdog", f"""SELECT event_id, coalesce(lead(t_ns) OVER (PARTITION BY sensor ORDER BY t_ns, event_id) - t_ns > {CYCLE}, false) AS is_late FROM stream_ev""")
def t10(v):
    return W.late(v.stream_ev(), CYCLE).select("event_id", "is_late")


@query("t18_counter_drops", """WITH k AS (SELECT sensor, event_id, t_ns, event_id * 2654435761 % 4294967296 AS counter FROM stream_ev)
SELECT event_id, coalesce(((d % 4294967296) + 4294967296) % 4294967296, 0) AS dropped FROM (SELECT event_id, counter - lag(counter) OVER (PARTITION BY sensor ORDER BY t_ns, event_id) AS d FROM k)""")
def t18(v):
    s = v.stream_ev().withColumn("counter", c("event_id") * 2654435761 % 4294967296)
    return W.counter_drops(s).select("event_id", "dropped")


@query("j01_asof_forward", """SELECT p.event_id, coalesce(q.t_ns, (SELECT max(t_ns) FROM twist_ev)) AS twist_ns FROM (SELECT * FROM stream_ev) p ASOF LEFT JOIN (SELECT t_ns FROM twist_ev) q ON p.t_ns <= q.t_ns""")
def j01(v):
    return J.asof_forward(v.stream_ev(), v.twist_ev(), bucket_ns=HOUR).select("event_id", c("r_t_ns").alias("twist_ns"))


_MERGED = """SELECT coalesce(a.t_ns, b.t_ns) AS t_ns, a.vx, b.wz FROM (SELECT t_ns, max(vx) AS vx FROM twist_ev GROUP BY t_ns) a FULL JOIN (SELECT t_ns, max(wz) AS wz FROM imu_ev GROUP BY t_ns) b ON a.t_ns = b.t_ns"""


@query("j02_merge_streams", f"""SELECT t_ns, R4(coalesce(last_value(vx IGNORE NULLS) OVER w, 0)) AS vx, R4(coalesce(last_value(wz IGNORE NULLS) OVER w, 0)) AS wz FROM ({_MERGED}) WINDOW w AS (ORDER BY t_ns)""")
def j02(v):
    return J.merge_streams(v.twist_ev(), v.imu_ev()).select("t_ns", out4("vx").alias("vx"), out4("wz").alias("wz"))


@query("j02_merge_streams_3d", f"""SELECT t_ns, R4(coalesce(CASE WHEN t_ns <= (SELECT max(t_ns) FROM twist_ev) THEN last_value(vx IGNORE NULLS) OVER w END, 0)) AS vx,
 R4(coalesce(CASE WHEN t_ns <= (SELECT max(t_ns) FROM imu_ev) THEN last_value(wz IGNORE NULLS) OVER w END, 0)) AS wz FROM ({_MERGED}) WINDOW w AS (ORDER BY t_ns)""")
def j02_3d(v):
    return J.merge_streams(v.twist_ev(), v.imu_ev(), three_d=True).select("t_ns", out4("vx").alias("vx"), out4("wz").alias("wz"))


# Readings of each user as of a vehicle of its own.
_VEHICLES = """tw AS (SELECT sensor, t_ns, max(value / 100) AS vx FROM stream_ev WHERE event_type IN ('click', 'view') GROUP BY sensor, t_ns),
im AS (SELECT sensor, t_ns, max((event_id % 21 - 10) / 100.0::DOUBLE) AS wz FROM stream_ev WHERE event_type = 'purchase' GROUP BY sensor, t_ns)"""


def _vehicles(v):
    e = v.stream_ev()
    twists = e.filter("event_type in ('click', 'view')").select("sensor", "t_ns", (c("value") / 100).alias("vx"))
    return twists, e.filter("event_type = 'purchase'").select("sensor", "t_ns", ((c("event_id") % 21 - 10) / 100.0).alias("wz"))


@query("j02_merge_streams_by_vehicle", f"""WITH {_VEHICLES}, m AS (SELECT coalesce(a.sensor, b.sensor) AS sensor, coalesce(a.t_ns, b.t_ns) AS t_ns, vx, wz FROM tw a FULL JOIN im b ON a.sensor = b.sensor AND a.t_ns = b.t_ns),
ends AS (SELECT sensor, (SELECT max(t_ns) FROM tw WHERE tw.sensor = s.sensor) AS ta, (SELECT max(t_ns) FROM im WHERE im.sensor = s.sensor) AS tb FROM (SELECT DISTINCT sensor FROM m) s),
f AS (SELECT sensor, t_ns, last_value(vx IGNORE NULLS) OVER w AS vx, last_value(wz IGNORE NULLS) OVER w AS wz FROM m WINDOW w AS (PARTITION BY sensor ORDER BY t_ns))
SELECT sensor, t_ns, R4(coalesce(CASE WHEN t_ns <= ta THEN vx END, 0)) AS vx, R4(coalesce(CASE WHEN t_ns <= tb THEN wz END, 0)) AS wz FROM f JOIN ends USING (sensor)""")
def j02_by_vehicle(v):
    """Each vehicle's own streams merged: no task holds an hour of all vehicles."""
    return J.merge_streams(*_vehicles(v), three_d=True, by=("sensor",)).select("sensor", "t_ns", out4("vx").alias("vx"), out4("wz").alias("wz"))


@query("j01_asof_by_vehicle", f"""WITH {_VEHICLES}, ends AS (SELECT sensor, max(t_ns) AS last_ns FROM tw GROUP BY sensor)
SELECT p.event_id, coalesce(q.t_ns, last_ns) AS twist_ns FROM (SELECT * FROM stream_ev) p ASOF LEFT JOIN (SELECT sensor, t_ns FROM tw) q ON p.sensor = q.sensor AND p.t_ns <= q.t_ns LEFT JOIN ends ON ends.sensor = p.sensor""")
def j01_by_vehicle(v):
    """The first twist of the same vehicle not before an event, else its last."""
    return J.asof_forward(v.stream_ev(), _vehicles(v)[0], bucket_ns=HOUR, by=("sensor",)).select("event_id", c("r_t_ns").alias("twist_ns"))


@query("j03_concat_sensors", """WITH s AS (SELECT frame_id, channel % 3 AS sensor, point_idx, 1000 * frame_id + 10 * (channel % 3) AS stamp, x, y, z FROM pts_emb)
SELECT frame_id, point_idx, CAST(min(stamp) OVER (PARTITION BY frame_id) AS BIGINT) AS stamp, R4(CASE WHEN sensor = 0 THEN m11 * x + m12 * y + m13 * z + tx ELSE x END) AS x,
 R4(CASE WHEN sensor = 0 THEN m21 * x + m22 * y + m23 * z + ty ELSE y END) AS y FROM s, (SELECT * FROM tf WHERE source = 'lidar')""")
def j03(v):
    """Clouds of one frame from several sensors, in the base frame, at the oldest
    stamp; a sensor without a transform stays as it is."""
    from scanlake.operators.sync import concatenate

    p = v.pts_emb()
    sensor = F.when(c("channel") % 3 == 0, "lidar").otherwise(F.concat(F.lit("other"), c("channel") % 3))
    p = p.withColumns({"sensor": sensor, "stamp": (1000 * c("frame_id") + 10 * (c("channel") % 3)).cast("long")})
    return concatenate(p, v.tf(), "base").select("frame_id", "point_idx", "stamp", out4("x").alias("x"), out4("y").alias("y"))


@query("j04_transform_lookup", "SELECT s, coalesce(tx, 0.0) AS tx, tx IS NOT NULL OR s = 'base' AS known FROM (VALUES ('lidar'), ('imu'), ('camera'), ('base')) q(s) LEFT JOIN tf ON tf.source = s AND tf.target = 'base'")
def j04(v):
    from scanlake.operators.sync import lookup_transform

    wanted = v.spark.createDataFrame([("lidar",), ("imu",), ("camera",), ("base",)], "source string")
    return lookup_transform(wanted, v.tf(), "base").select(c("source").alias("s"), "tx", "known")


@query("j05_approximate_sync", """WITH a AS (SELECT event_id, t_ns FROM stream_ev WHERE event_type = 'click'), b AS (SELECT event_id, t_ns FROM stream_ev WHERE event_type = 'error')
SELECT a.event_id, b.event_id AS other, abs(b.t_ns - a.t_ns) AS dt FROM a JOIN b ON abs(b.t_ns - a.t_ns) <= 600000000000 QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.t_ns - a.t_ns), b.event_id) = 1""")
def j05(v):
    from scanlake.operators.sync import approximate_sync

    s = v.stream_ev().select("event_id", "t_ns", "event_type")
    left, right = s.filter("event_type = 'click'").drop("event_type"), s.filter("event_type = 'error'").drop("event_type")
    return approximate_sync(left, right, 600_000_000_000)


@query("j06_exact_sync", "SELECT a.event_id, b.event_id AS other FROM stream_ev a JOIN stream_ev b ON a.t_ns = b.t_ns WHERE a.event_type = 'click' AND b.value > 10")
def j06(v):
    s = v.stream_ev()
    other = s.filter(c("value") > 10).select("t_ns", c("event_id").alias("other"))
    return s.filter("event_type = 'click'").select("t_ns", "event_id").join(other, "t_ns").select("event_id", "other")


@query("j07_neighbours", """WITH pts AS (SELECT label AS frame_id, vec_id * 21 + k AS point_idx, CAST(embedding[3 * k + 1] AS DOUBLE) * 40 AS x, CAST(embedding[3 * k + 2] AS DOUBLE) * 40 AS y, CAST(embedding[3 * k + 3] AS DOUBLE) * 40 AS z
  FROM embeddings, (SELECT unnest(range(21)) AS k))
SELECT a.frame_id, a.point_idx AS a, b.point_idx AS b, R4(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS dist FROM pts a JOIN pts b ON a.frame_id = b.frame_id AND a.point_idx < b.point_idx WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.49""")
def j07(v):
    """All pairs of vectors of a label, not only those within 64 of each other."""
    return J.neighbours(v.pts_emb("label"), 0.7).withColumn("dist", out4("dist"))


@query("j09_points_in_detections", f"""SELECT point_idx, det_idx FROM ({PIXELS}) p JOIN dets d ON p.frame_id = d.frame_id AND u BETWEEN floor(cx - w / 2) AND ceil(cx + w / 2) AND v BETWEEN floor(cy - h / 2) AND ceil(cy + h / 2)""")
def j09(v):
    return J.points_in_detections(P.pinhole(v.pts_emb(), CAMERA), v.dets()).select("point_idx", "det_idx")


@query("j10_points_in_mask", f"SELECT point_idx FROM ({PIXELS}) WHERE (u * 80 // 640 + v * 60 // 480) % 3 = 0")
def j10(v):
    n = v.spark.range(80 * 60).select((F.col("id") % 80).cast("int").alias("x"), F.expr("cast(id div 80 as int)").alias("y"))
    mask = n.withColumn("grey", F.when((c("x") + c("y")) % 3 == 0, 255).otherwise(0))
    return J.points_in_mask(P.pinhole(v.pts_emb(), CAMERA), mask, (640, 480), (80, 60)).select("point_idx")


@query("j11_calibration_join", "SELECT packet_id, block, channel, R4(raw_az / 100.0 + azim_off_deg) AS azimuth, elev_deg FROM units_li JOIN calib USING (channel)")
def j11(v):
    u = v.units_li().join(F.broadcast(v.calib()), "channel")
    return u.select("packet_id", "block", "channel", out4(c("raw_az") / 100.0 + c("azim_off_deg")).alias("azimuth"), "elev_deg")


@query("j13_footprint_crossing", """SELECT frame_id, point_idx, R4(CASE WHEN nr <= fr AND t BETWEEN 0 AND 1 THEN t * sqrt(x * x + y * y) END) AS crossing FROM (SELECT *, CASE WHEN nr >= 0 THEN nr ELSE fr END AS t FROM (
 SELECT *, greatest(least(-1 / x, 3 / x), least(-1.2 / y, 1.2 / y)) AS nr, least(greatest(-1 / x, 3 / x), greatest(-1.2 / y, 1.2 / y)) AS fr FROM pts_emb WHERE x <> 0 AND y <> 0))""")
def j13(v):
    p = J.slab_entry(v.pts_emb().filter("x <> 0 and y <> 0"), -1.0, 3.0, -1.2, 1.2)
    return p.select("frame_id", "point_idx", out4("crossing").alias("crossing"))
