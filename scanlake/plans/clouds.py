"""Queries over point tables: projections, predicates, aggregates, set operations."""

from __future__ import annotations



from pyspark.sql import functions as F

from scanlake.functions.geometry import c, in_arc, out4, wrap
from scanlake.operators import aggregates as A
from scanlake.operators import clouds as P
from scanlake.plans.registry import query
from scanlake.plans.views import BOXES, CAMERA

NAMES = ("box_id", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z")
BOX_DICTS = [dict(zip(NAMES, b)) for b in BOXES]
ROI = {"min_x": -6.0, "max_x": 8.0, "min_y": -5.0, "max_y": 5.0, "min_z": -4.0, "max_z": 6.0}
XYZ = ("x", "y", "z")
_IN = lambda b: f"(x > {b['min_x']} AND x < {b['max_x']} AND y > {b['min_y']} AND y < {b['max_y']} AND z > {b['min_z']} AND z < {b['max_z']})"
_ROI = " AND ".join(f"{a} BETWEEN {ROI[f'min_{a}']} AND {ROI[f'max_{a}']}" for a in XYZ)
_OUTSIDE = " AND ".join(f"NOT {_IN(b)}" for b in BOX_DICTS)
_TRANSFORM = """SELECT frame_id, point_idx, channel, m11 * x + m12 * y + m13 * z + tx AS x, m21 * x + m22 * y + m23 * z + ty AS y, m31 * x + m32 * y + m33 * z + tz AS z
  FROM pts_emb, (SELECT * FROM tf WHERE source = 'lidar' AND target = 'base')"""
_XYZ4 = "R4(x) AS x, R4(y) AS y, R4(z) AS z"


def rounded(df, *keep, floats=XYZ):
    return df.select(*keep, *(out4(a).alias(a) for a in floats))


@query("flagship_preprocess", f"""WITH moved AS ({_TRANSFORM}),
kept AS (SELECT *, floor(x / 0.5) AS vx, floor(y / 0.5) AS vy, floor(z / 0.5) AS vz FROM moved WHERE {_OUTSIDE} AND {_ROI}),
leaves AS (SELECT frame_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM kept GROUP BY frame_id, vx, vy, vz)
SELECT frame_id, CAST(count(*) AS BIGINT) AS n_leaves, R4(avg(x)) AS cx, R4(avg(y)) AS cy, R4(avg(z)) AS cz,
  R4(max(x) - min(x)) AS sx, R4(max(y) - min(y)) AS sy, R4(max(z) - min(z)) AS sz FROM leaves GROUP BY frame_id""")
def flagship(v):
    """Transform, crop, region of interest, voxel grid, box and centroid per frame."""
    p = P.roi(P.crop(P.transform(v.pts_emb(), v.tf(), "lidar", "base"), BOX_DICTS), ROI)
    leaves = A.voxel_downsample(p, 0.5)
    g = leaves.groupBy("frame_id").agg(F.count("*").alias("n_leaves"), *(F.avg(a).alias(f"c{a}") for a in XYZ), *((F.max(a) - F.min(a)).alias(f"s{a}") for a in XYZ))
    return rounded(g, "frame_id", "n_leaves", floats=("cx", "cy", "cz", "sx", "sy", "sz"))


@query("p01_transform", f"SELECT frame_id, point_idx, {_XYZ4} FROM ({_TRANSFORM})")
def p01(v):
    return rounded(P.transform(v.pts_emb(), v.tf(), "lidar", "base"), "frame_id", "point_idx")


@query("p02_crop_box", f"SELECT frame_id, point_idx FROM pts_emb WHERE {_OUTSIDE}")
def p02(v):
    return P.crop(v.pts_emb(), BOX_DICTS).select("frame_id", "point_idx")


@query("p02_crop_box_table", "SELECT frame_id, point_idx FROM pts_emb p WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE x > min_x AND x < max_x AND y > min_y AND y < max_y AND z > min_z AND z < max_z)")
def p02_table(v):
    return P.crop_by_table(v.pts_emb(), v.boxes()).select("frame_id", "point_idx")


@query("p03_no_boxes", "SELECT frame_id, count(*) AS n FROM pts_emb GROUP BY frame_id")
def p03(v):
    return P.crop(v.pts_emb(), []).groupBy("frame_id").agg(F.count("*").alias("n"))


@query("p04_roi", f"SELECT frame_id, point_idx FROM pts_emb WHERE {_ROI}")
def p04(v):
    return P.roi(v.pts_emb(), ROI).select("frame_id", "point_idx")


@query("p05_compact", f"SELECT frame_id, point_idx, row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) - 1 AS out_idx FROM pts_emb WHERE {_ROI} AND {_OUTSIDE}")
def p05(v):
    inside = F.lit(True)
    for a in XYZ:
        inside = inside & c(a).between(ROI[f"min_{a}"], ROI[f"max_{a}"])
    outside = F.lit(True)
    for b in BOX_DICTS:
        outside = outside & ~P.inside_box(b)
    return P.compact(v.pts_emb(), inside, outside).select("frame_id", "point_idx", "out_idx")


@query("p06_point_cap", "SELECT frame_id, point_idx FROM pts_emb QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) <= 50")
def p06(v):
    return P.cap(v.pts_emb(), 50).select("frame_id", "point_idx")


@query("p07_finite", """SELECT frame_id, count(*) AS n FROM (SELECT frame_id, CASE WHEN point_idx % 7 = 0 THEN 'nan'::DOUBLE WHEN point_idx % 11 = 0 THEN 'inf'::DOUBLE WHEN point_idx % 13 = 0 THEN NULL ELSE x END AS x, y, z FROM pts_emb)
WHERE isfinite(x) AND isfinite(y) AND isfinite(z) GROUP BY frame_id""")
def p07(v):
    broken = F.when(F.col("point_idx") % 7 == 0, float("nan")).when(F.col("point_idx") % 11 == 0, float("inf")).when(F.col("point_idx") % 13 == 0, F.lit(None)).otherwise(F.col("x"))
    return P.drop_non_finite(v.pts_emb().withColumn("x", broken)).groupBy("frame_id").agg(F.count("*").alias("n"))


_U, _V = f"{CAMERA['fx']} * x / z + {CAMERA['cx']}", f"{CAMERA['fy']} * y / z + {CAMERA['cy']}"
PIXELS = f"""SELECT frame_id, point_idx, CAST(trunc({_U}) AS INT) AS u, CAST(trunc({_V}) AS INT) AS v FROM pts_emb
  WHERE z > 0 AND {_U} >= 0 AND {_V} >= 0 AND trunc({_U}) < {CAMERA['width']} AND trunc({_V}) < {CAMERA['height']}"""


@query("p08_pinhole", PIXELS)
def p08(v):
    return P.pinhole(v.pts_emb(), CAMERA).select("frame_id", "point_idx", "u", "v")


_LABELS = "SELECT frame_id, point_idx, CAST(point_idx % 9 AS INT) AS cluster_id FROM pts_emb WHERE point_idx % 4 <> 0"


def labels(v):
    return v.pts_emb().filter("point_idx % 4 <> 0").select("frame_id", "point_idx", (F.col("point_idx") % 9).cast("int").alias("cluster_id"))


@query("p09_append_cluster_id", f"SELECT p.frame_id, p.point_idx, coalesce(l.cluster_id, -1) AS cluster_id FROM pts_emb p LEFT JOIN ({_LABELS}) l USING (frame_id, point_idx)")
def p09(v):
    return P.with_cluster_id(v.pts_emb(), labels(v)).select("frame_id", "point_idx", "cluster_id")


@query("p10_clustered_only", _LABELS)
def p10(v):
    return P.clustered_only(P.with_cluster_id(v.pts_emb(), labels(v))).select("frame_id", "point_idx", "cluster_id")


@query("p11_select_clusters", f"SELECT frame_id, point_idx, cluster_id FROM ({_LABELS}) WHERE cluster_id = frame_id % 9")
def p11(v):
    wanted = v.pts_emb().select("frame_id", (F.col("frame_id") % 9).cast("int").alias("cluster_id")).distinct()
    return P.select_clusters(labels(v), wanted).select("frame_id", "point_idx", "cluster_id")


@query("p12_box_markers", "SELECT box_id, (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy, (min_z + max_z) / 2 AS cz, max_x - min_x AS sx, max_y - min_y AS sy, max_z - min_z AS sz FROM boxes")
def p12(v):
    return P.box_marker(v.boxes()).select("box_id", "cx", "cy", "cz", "sx", "sy", "sz")


@query("p13_angles", """SELECT packet_id, block, a - floor(a / 360) * 360 AS wrapped, ((270 <= w AND w <= 90) OR (90 < 270 AND (w <= 90 OR 270 <= w))) AS in_fov
FROM (SELECT *, a - floor(a / 360) * 360 AS w FROM (SELECT packet_id, block, raw_az / 100.0::DOUBLE + 200 AS a FROM units_li))""")
def p13(v):
    w = wrap(F.col("raw_az") / 100.0 + 200, 360.0)
    return v.units_li().select("packet_id", "block", w.alias("wrapped"), in_arc(w, 270.0, 90.0).alias("in_fov"))


@query("p14_imu_rotation", """SELECT t_ns, R4(m11 * x + m12 * y + m13 * z) AS x, R4(m21 * x + m22 * y + m23 * z) AS y, R4(m31 * x + m32 * y + m33 * z) AS z
FROM (SELECT t_ns, 0.1::DOUBLE AS x, wz / 2 AS y, wz AS z FROM imu_ev), (SELECT * FROM tf WHERE source = 'imu')""")
def p14(v):
    w = v.imu_ev().select("t_ns", F.lit(0.1).alias("x"), (F.col("wz") / 2).alias("y"), F.col("wz").alias("z"))
    return rounded(P.rotate(w, v.tf(), "imu", "base"), "t_ns")


@query("p15_plane_split", "SELECT frame_id, point_idx, R4(d) AS dist, abs(d) > 0.2 AS is_obstacle FROM (SELECT *, (0.1 * x - 0.2 * y + z + 0.5) / sqrt(0.1 * 0.1 + 0.2 * 0.2 + 1.0) AS d FROM pts_emb)")
def p15(v):
    p = P.plane_split(v.pts_emb(), (0.1, -0.2, 1.0), 0.5, 0.2)
    return p.select("frame_id", "point_idx", out4("dist").alias("dist"), "is_obstacle")


@query("d36_layout", "SELECT frame_id, point_idx, R4(x) AS x, R4(y) AS y, R4(z) AS z, intensity, channel AS ring, R4(degrees(atan2(y, x)) * 100) AS azimuth, R4(sqrt(x * x + y * y)) AS distance, 1 AS return_type, 1700000000.5::DOUBLE + point_idx AS time_stamp FROM pts_li")
def d36(v):
    p = v.pts_li().withColumns({"azimuth": F.atan2("y", "x"), "distance": F.sqrt(c("x") * c("x") + c("y") * c("y")), "return_type": F.lit(1), "stamp_ns": F.lit(1_700_000_000_500_000_000), "t_ns": c("point_idx") * 1_000_000_000})
    out = P.layout(p, "xyziradt", "frame_id", "point_idx")
    return out.select("frame_id", "point_idx", *(out4(a).alias(a) for a in ("x", "y", "z", "azimuth", "distance")), F.col("intensity").cast("int").alias("intensity"), "ring", "return_type", "time_stamp")


@query("a01_ring_capacity", "SELECT frame_id, max(channel) + 1 AS n_rings, max(n) AS max_points FROM (SELECT frame_id, channel, count(*) AS n FROM pts_li GROUP BY ALL) GROUP BY frame_id")
def a01(v):
    return A.ring_capacity(v.pts_li())


@query("a02_relabel", """SELECT frame_id, label, n_points, CAST(dense_rank() OVER (PARTITION BY frame_id ORDER BY label) - 1 AS INT) AS cluster_id
FROM (SELECT frame_id, point_idx % 37 AS label, count(*) AS n_points FROM pts_li GROUP BY ALL HAVING count(*) BETWEEN 24 AND 500)""")
def a02(v):
    return A.relabel(v.pts_li().select("frame_id", (F.col("point_idx") % 37).alias("label")), 24, 500)


@query("a03_centroids", f"SELECT frame_id, cluster_id, R4(avg(x)) AS cx, R4(avg(y)) AS cy, R4(avg(z)) AS cz, count(*) AS n_points FROM pts_emb JOIN ({_LABELS}) USING (frame_id, point_idx) GROUP BY ALL")
def a03(v):
    p = v.pts_emb().join(labels(v), ["frame_id", "point_idx"])
    return rounded(A.centroids(p, "frame_id", "cluster_id"), "frame_id", "cluster_id", "n_points", floats=("cx", "cy", "cz"))


@query("a04_aabb", "SELECT frame_id, channel, R4((min(x) + max(x)) / 2) AS cx, R4((min(y) + max(y)) / 2) AS cy, R4((min(z) + max(z)) / 2) AS cz, R4(max(x) - min(x)) AS sx, R4(max(y) - min(y)) AS sy, R4(max(z) - min(z)) AS sz, count(*) AS n_points FROM pts_emb GROUP BY ALL")
def a04(v):
    return rounded(A.aabb(v.pts_emb(), "frame_id", "channel"), "frame_id", "channel", "n_points", floats=("cx", "cy", "cz", "sx", "sy", "sz"))


@query("a07_voxel_downsample", "SELECT frame_id, vx, vy, vz, R4(avg(x)) AS x, R4(avg(y)) AS y, R4(avg(z)) AS z, count(*) AS n_points FROM (SELECT *, CAST(floor(x / 0.8) AS BIGINT) AS vx, CAST(floor(y / 0.8) AS BIGINT) AS vy, CAST(floor(z / 0.8) AS BIGINT) AS vz FROM pts_emb) GROUP BY ALL")
def a07(v):
    return rounded(A.voxel_downsample(v.pts_emb(), 0.8), "frame_id", "vx", "vy", "vz", "n_points")


RANGE_SQL = """SELECT frame_id, point_idx, range, CAST(floor((atan2(y + 0.0, x) + pi()) / (2 * pi()) * 360) AS BIGINT) % 360 AS col,
  least(CAST(floor((asin(z / range) + pi() / 2) / pi() * 32) AS BIGINT), 31) AS row FROM (SELECT *, sqrt(x * x + y * y + z * z) AS range FROM pts_emb) WHERE range >= 0.1"""


@query("a08_range_image", f"SELECT frame_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, point_idx, R4(range) AS range FROM ({RANGE_SQL}) QUALIFY row_number() OVER (PARTITION BY frame_id, row, col ORDER BY range, point_idx) = 1")
def a08(v):
    return A.range_image(v.pts_emb()).withColumn("range", out4("range"))


@query("a11_fitted_line", """SELECT frame_id, channel, n, R4(slope) AS slope, R4(CASE WHEN n = 1 THEN 0.0 ELSE (sh - slope * sr) / n END) AS intercept FROM (SELECT *,
 greatest(-tan(radians(20.0)), least(tan(radians(20.0)), CASE WHEN n = 1 THEN sh / sr WHEN abs(n * srr - sr * sr) < 1e-12 THEN 0.0 ELSE (n * srh - sr * sh) / (n * srr - sr * sr) END)) AS slope
 FROM (SELECT frame_id, channel, count(*) AS n, sum(r) AS sr, sum(z) AS sh, sum(r * r) AS srr, sum(r * z) AS srh FROM (SELECT *, sqrt(x * x + y * y) AS r FROM pts_emb) GROUP BY ALL))""")
def a11(v):
    p = v.pts_emb().withColumn("r", F.sqrt(c("x") * c("x") + c("y") * c("y")))
    line = A.fitted_line(p, "frame_id", "channel", height="z")
    return line.select("frame_id", "channel", "n", out4("slope").alias("slope"), out4("intercept").alias("intercept"))


QUALITY_SQL = """SELECT {key}, n AS n_points, R4(volume) AS volume, R4(CASE WHEN n < 3 OR volume < 1e-6 THEN 0.0 ELSE least(1.0, n / volume / {density}) * CASE WHEN e > 5 THEN 5 / e ELSE 1.0 END END) AS quality FROM (
 SELECT *, CASE WHEN e2 > 1e-12 THEN sqrt(e1 / e2) ELSE 1048576.0 END AS e FROM (
 SELECT *, CASE WHEN p2 <= 0 THEN q ELSE q + 2 * p * cos(phi) END AS e1, CASE WHEN p2 <= 0 THEN q ELSE 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3)) END AS e2 FROM (
 SELECT *, acos(greatest(-1.0, least(1.0, CASE WHEN p2 <= 0 THEN 0 ELSE ((a - q) * ((b - q) * (d - q) - g * g) - e_ * (e_ * (d - q) - g * f) + f * (e_ * g - (b - q) * f)) / (2 * p * p * p) END))) / 3 AS phi FROM (
 SELECT *, sqrt(p2 / 6) AS p FROM (
 SELECT *, (a - q) * (a - q) + (b - q) * (b - q) + (d - q) * (d - q) + 2 * (e_ * e_ + f * f + g * g) AS p2 FROM (
 SELECT *, (a + b + d) / 3 AS q FROM (
 SELECT {key}, count(*) AS n, covar_samp(x, x) AS a, covar_samp(y, y) AS b, covar_samp(z, z) AS d, covar_samp(x, y) AS e_, covar_samp(x, z) AS f, covar_samp(y, z) AS g,
  (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) AS volume FROM {source} GROUP BY {key})))))))"""


@query("a12_cluster_quality", QUALITY_SQL.format(key="frame_id, channel", source="pts_emb", density="0.01"))
def a12(v):
    return A.cluster_quality(v.pts_emb(), "frame_id", "channel").select("frame_id", "channel", "n_points", out4("volume").alias("volume"), out4("quality").alias("quality"))


_EIGEN = """SELECT *, q + 2 * p * cos(phi) AS e1, q + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM (
 SELECT *, acos(greatest(-1.0, least(1.0, ((a - q) * ((b - q) * (d - q) - g * g) - e_ * (e_ * (d - q) - g * f) + f * (e_ * g - (b - q) * f)) / (2 * p * p * p)))) / 3 AS phi FROM (
 SELECT *, sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (d - q) * (d - q) + 2 * (e_ * e_ + f * f + g * g)) / 6) AS p FROM (
 SELECT *, (a + b + d) / 3 AS q FROM m)))"""


@query("a13_curvature", f"""WITH o AS (SELECT p.frame_id, p.point_idx, count(*) AS n, covar_pop(q.x, q.x) AS a, covar_pop(q.y, q.y) AS b, covar_pop(q.z, q.z) AS d, covar_pop(q.x, q.y) AS e_, covar_pop(q.x, q.z) AS f, covar_pop(q.y, q.z) AS g
 FROM pts_emb p JOIN pts_emb q ON p.frame_id = q.frame_id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) <= 4 GROUP BY p.frame_id, p.point_idx), m AS (SELECT * FROM o WHERE n >= 4),
r AS (SELECT *, 3 * q - e1 - e3 AS e2 FROM ({_EIGEN})) SELECT frame_id, point_idx, n AS n_neighbours, round(CASE WHEN e2 > 1e-6 * e1 THEN greatest(0.0, e3) / (e1 + e2 + e3) END + 1e-7, 3) AS curvature FROM r""")
def a13(v):
    """Curvature where four points or more lie within 2 m."""
    n = A.normals(v.pts_emb(), 2.0).filter("n_neighbours >= 4")
    return n.select("frame_id", "point_idx", "n_neighbours", F.round(F.col("curvature") + 1e-7, 3).alias("curvature"))


@query("a15_column_stats", """WITH s AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.999) AS q FROM events GROUP BY event_type)
SELECT s.event_type, R4(s.mean) AS mean, R4(s.std) AS std, R4(s.q) AS q999, R4(100 * s.mean / b.mean) AS percent_of_baseline FROM s, (SELECT mean FROM s WHERE event_type = 'click') b""")
def a15(v):
    s = v.table("events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.percentile("value", 0.999).alias("q"))
    b = s.filter("event_type = 'click'").select(F.col("mean").alias("base"))
    return s.join(F.broadcast(b)).select("event_type", out4("mean").alias("mean"), out4("std").alias("std"), out4("q").alias("q999"), out4(100 * F.col("mean") / F.col("base")).alias("percent_of_baseline"))


@query("a16_edge_coverage", """SELECT frame_id, bool_and(a AND z) AS all_channels, bool_or(a AND z) AS any_channel, CAST(count_if(a AND z) AS BIGINT) AS n_channels FROM (
 SELECT frame_id, channel, bool_or(az BETWEEN 30 AND 60) AS a, bool_or(az BETWEEN 300 AND 330) AS z FROM (SELECT *, degrees(atan2(y, x)) + 180 AS az FROM pts_li) GROUP BY ALL) GROUP BY frame_id""")
def a16(v):
    return A.edge_coverage(v.pts_li().withColumn("azimuth", F.degrees(F.atan2("y", "x")) + 180), 30.0, 330.0, 30.0)


@query("a18_azimuth_padding", "SELECT -max(azim_off_deg) AS low, -min(azim_off_deg) AS high FROM calib")
def a18(v):
    return v.calib().agg((-F.max("azim_off_deg")).alias("low"), (-F.min("azim_off_deg")).alias("high"))


@query("o04_centroid_order", f"""WITH k AS (SELECT frame_id, cluster_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts_emb JOIN ({_LABELS}) USING (frame_id, point_idx) GROUP BY ALL)
SELECT frame_id, cluster_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY cx, cy, cz, cluster_id) AS INT) AS position FROM k""")
def o04(v):
    from pyspark.sql import Window

    k = A.centroids(v.pts_emb().join(labels(v), ["frame_id", "point_idx"]), "frame_id", "cluster_id")
    return k.select("frame_id", "cluster_id", F.row_number().over(Window.partitionBy("frame_id").orderBy("cx", "cy", "cz", "cluster_id")).alias("position"))


@query("o08_concat_clouds", "SELECT sensor, count(*) AS n FROM (SELECT 'a' AS sensor, frame_id FROM pts_emb UNION ALL SELECT 'b', frame_id FROM pts_li) GROUP BY sensor")
def o08(v):
    tag = lambda p, s: p.select(F.lit(s).alias("sensor"), F.col("frame_id").cast("int").alias("frame_id"))
    return tag(v.pts_emb(), "a").unionByName(tag(v.pts_li(), "b")).groupBy("sensor").agg(F.count("*").alias("n"))


@query("o09_set_difference", "SELECT frame_id, point_idx FROM pts_emb EXCEPT SELECT frame_id, point_idx FROM pts_emb WHERE z > 0")
def o09(v):
    p = v.pts_emb()
    return p.select("frame_id", "point_idx").join(p.filter("z > 0").select("frame_id", "point_idx"), ["frame_id", "point_idx"], "left_anti")


@query("j12_semi_anti", "SELECT frame_id, CAST(count_if(point_idx % 4 <> 0) AS BIGINT) AS n_kept, CAST(count_if(point_idx % 4 = 0) AS BIGINT) AS n_removed FROM pts_emb GROUP BY frame_id")
def j12(v):
    p, removed = v.pts_emb(), v.pts_emb().filter("point_idx % 4 = 0").select("frame_id", "point_idx")
    kept = p.join(removed, ["frame_id", "point_idx"], "left_anti").groupBy("frame_id").agg(F.count("*").alias("n_kept"))
    gone = p.join(removed, ["frame_id", "point_idx"], "left_semi").groupBy("frame_id").agg(F.count("*").alias("n_removed"))
    return kept.join(gone, "frame_id", "full").na.fill(0)


@query("s07_skip_limit", "SELECT event_id, t_ns FROM stream_ev ORDER BY t_ns, event_id LIMIT 20 OFFSET 5")
def s07(v):
    return v.stream_ev().orderBy("t_ns", "event_id").offset(5).limit(20).select("event_id", "t_ns")


@query("fn_norms", "SELECT frame_id, point_idx, R4(sqrt(x * x + y * y)) AS hyp, R4(x * y + y * z + z * x) AS dot, R4(y * x - z * z) AS cross_x, R4(x / sqrt(x * x + y * y + z * z)) AS unit_x FROM pts_emb WHERE x <> 0")
def fn_norms(v):
    x, y, z = c("x"), c("y"), c("z")
    return v.pts_emb().filter("x <> 0").select("frame_id", "point_idx", out4(F.hypot("x", "y")).alias("hyp"), out4(x * y + y * z + z * x).alias("dot"), out4(y * x - z * z).alias("cross_x"), out4(x / F.sqrt(x * x + y * y + z * z)).alias("unit_x"))


@query("fn_rounding", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(v) AS BIGINT) AS f, CAST(ceil(v) AS BIGINT) AS c, CAST(trunc(v) AS BIGINT) AS t, CAST(CASE WHEN v < 0 THEN floor(v) ELSE ceil(v) END AS BIGINT) AS away, greatest(0.0::DOUBLE, least(255.0::DOUBLE, v)) AS clamped FROM (SELECT *, l_tax * 100 - l_quantity + 0.25::DOUBLE AS v FROM lineitem)")
def fn_rounding(v):
    x = F.col("l_tax") * 100 - F.col("l_quantity") + 0.25
    away = F.when(x < 0, F.floor(x)).otherwise(F.ceil(x))
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.floor(x).alias("f"), F.ceil(x).alias("c"), x.cast("long").alias("t"), away.alias("away"), F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)).alias("clamped"))


@query("fn_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS n_keys FROM stream_ev")
def fn_json(v):
    return v.stream_ev().select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("fn_strings", """SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS padded, regexp_extract(p_brand, '([0-9]+)', 1) AS number, split_part(p_type, ' ', 1) AS first_word, lower(to_hex(CAST(p_partkey AS BIGINT))) AS hexed, array_to_string(string_split(p_name, ' '), '_') AS joined FROM part""")
def fn_strings(v):
    return v.table("part").select(
        "p_partkey", F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("padded"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("number"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("first_word"),
        F.lower(F.hex("p_partkey")).alias("hexed"), F.concat_ws("_", F.split("p_name", " ")).alias("joined"),
    )


@query("fn_image_size", "SELECT p_partkey, CAST(ceil(least(greatest(w, h), 1280) / 32.0) * 32 AS BIGINT) AS size FROM (SELECT p_partkey, p_size * 40 AS w, CAST(floor(p_retailprice) AS BIGINT) AS h FROM part)")
def fn_image_size(v):
    from scanlake.operators.imaging import snapped_size

    return v.table("part").select("p_partkey", snapped_size(F.col("p_size") * 40, F.expr("cast(floor(p_retailprice) as bigint)")).alias("size"))



