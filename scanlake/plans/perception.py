"""Queries for ground segmentation, clustering and matching."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from scanlake.functions.geometry import c, out4
from scanlake.operators import aggregates as A
from scanlake.operators import clouds as P
from scanlake.operators import clustering as C
from scanlake.operators import ground as G
from scanlake.operators import joins as J
from scanlake.operators.grid_ground import GridParams, grid_filter
from scanlake.plans.clouds import PIXELS, CAMERA, QUALITY_SQL, RANGE_SQL, ROI
from scanlake.plans.registry import query

_ROI = " AND ".join(f"{a} BETWEEN {ROI[f'min_{a}']} AND {ROI[f'max_{a}']}" for a in "xyz")
_RAYS = """SELECT *, CAST(floor((CASE WHEN {t} < 0 THEN {t} + 2 * pi() ELSE {t} END) / radians({d})) AS INT) AS ray, sqrt(x * x + y * y) AS radius FROM {source}"""


def _reach(edges: str, k: str = "") -> str:
    """Components of edges (f, a, b) over points, by reachability."""
    return f"""e{k} AS ({edges}), both{k}_ AS (SELECT f, a, b FROM e{k} UNION SELECT f, b, a FROM e{k}),
reach{k} AS (SELECT frame_id AS f, point_idx AS a, point_idx AS r FROM {{nodes}} UNION SELECT b.f, b.b, reach{k}.r FROM both{k}_ b JOIN reach{k} ON reach{k}.f = b.f AND reach{k}.a = b.a),
labelled{k} AS (SELECT f AS frame_id, a AS point_idx, min(r) AS label FROM reach{k} GROUP BY f, a)"""


@query("w08_radial_division", f"SELECT frame_id, point_idx, ray, R4(radius) AS radius, CAST(row_number() OVER (PARTITION BY frame_id, ray ORDER BY radius, point_idx) AS INT) AS place FROM ({_RAYS.format(t='atan2(y, x)', d='0.5', source='pts_emb')})")
def w08(v):
    from pyspark.sql import Window

    p = G.with_rays(v.pts_emb(), 0.5)
    place = F.row_number().over(Window.partitionBy("frame_id", "ray").orderBy("radius", "point_idx"))
    return p.select("frame_id", "point_idx", "ray", out4("radius").alias("radius"), place.alias("place"))


_T = {k: math.tan(math.radians(d)) for k, d in (("g", 10.0), ("l", 7.0), ("i", 3.0))}


def _g01_step(near: str, height: str, ground: str, slope: float) -> str:
    gap = f"(p.radius - {near})"
    return f"""CASE WHEN {gap} < 0.15 THEN {ground} WHEN abs(p.z - {height}) <= greatest({slope} * {gap}, 0.03) THEN ({ground} OR abs(p.z) <= {_T['g']} * p.radius)
 ELSE ({gap} > 0.15 AND abs(p.z) <= {_T['g']} * p.radius) END"""


@query("g01_ray_ground", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY frame_id, ray ORDER BY radius, point_idx) AS n FROM ({_RAYS.format(t='atan2(y, x)', d='5.0', source='(SELECT frame_id, point_idx, x, y, z / 4 AS z FROM pts_emb)')})),
f AS (SELECT frame_id, ray, n, point_idx, radius, z, {_g01_step('0.0', '0.0', 'false', _T['i'])} AS g FROM p WHERE n = 1
 UNION ALL SELECT p.frame_id, p.ray, p.n, p.point_idx, p.radius, p.z, {_g01_step('f.radius', 'f.z', 'f.g', _T['l'])} FROM f JOIN p ON p.frame_id = f.frame_id AND p.ray = f.ray AND p.n = f.n + 1)
SELECT frame_id, point_idx, CASE WHEN g THEN 'ground' ELSE 'obstacle' END AS label FROM f""", recursive=True)
def g01(v):
    return G.ray_filter(v.pts_emb().withColumn("z", c("z") / 4), divider=5.0)


_FOOT = (-3.0, 5.0, -2.0, 2.0)


@query("g01_ray_ground_footprint", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY frame_id, ray ORDER BY radius, point_idx) AS n,
  least(CASE WHEN x > 0 THEN {_FOOT[1]} / x WHEN x < 0 THEN {_FOOT[0]} / x END, CASE WHEN y > 0 THEN {_FOOT[3]} / y WHEN y < 0 THEN {_FOOT[2]} / y END) AS t
  FROM ({_RAYS.format(t='atan2(y, x)', d='5.0', source='(SELECT frame_id, point_idx, x, y, z / 4 AS z FROM pts_emb)')})),
f AS (SELECT frame_id, ray, n, point_idx, CASE WHEN t <= 1 THEN radius ELSE 0 END AS near, CASE WHEN t <= 1 THEN z ELSE 0 END AS height, t <= 1 AND {_g01_step('(p.t * p.radius)', '0.0', 'false', _T['i'])} AS g FROM p WHERE n = 1
 UNION ALL SELECT p.frame_id, p.ray, p.n, p.point_idx, p.radius, p.z, {_g01_step('f.near', 'f.height', 'f.g', _T['l'])} FROM f JOIN p ON p.frame_id = f.frame_id AND p.ray = f.ray AND p.n = f.n + 1)
SELECT frame_id, point_idx, CASE WHEN g THEN 'ground' ELSE 'obstacle' END AS label FROM f""", recursive=True)
def g01_footprint(v):
    return G.ray_filter(v.pts_emb().withColumn("z", c("z") / 4), divider=5.0, footprint=_FOOT)


_SCAN = {"tg": math.tan(math.radians(10.0)), "local": math.radians(13.0), "angle": math.radians(2.0), "tol": 0.40, "split": 0.50, "base": 2.79}


@query("g02_scan_ground", """WITH q AS (SELECT *, CASE WHEN atan2(x, y) < 0 THEN atan2(x, y) + 2 * pi() ELSE atan2(x, y) END AS th, sqrt(x * x + y * y) AS r FROM (SELECT frame_id, point_idx, x, y, z / 4 AS z FROM pts_li)),
p AS (SELECT *, row_number() OVER (PARTITION BY frame_id, ray ORDER BY r, point_idx) AS n FROM (SELECT *, CAST(floor(th / radians(2.0)) AS INT) AS ray FROM q)),
f AS (SELECT frame_id, ray, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS point_idx, CASE WHEN x > {base} THEN {base} ELSE 0.0 END::DOUBLE AS px, 0.0::DOUBLE AS py, 0.0::DOUBLE AS pz,
  CASE WHEN x > {base} THEN {base} ELSE 0.0 END::DOUBLE AS gr, 0.0::DOUBLE AS gz, 0.0::DOUBLE AS slope,
  0.0::DOUBLE AS sgr, 0.0::DOUBLE AS sgz, 0.0::DOUBLE AS sgn, 0.0::DOUBLE AS soz, 0.0::DOUBLE AS son, 'init' AS last FROM p WHERE n = 1
 UNION ALL SELECT frame_id, ray, n, point_idx, x, y, z, CASE WHEN g = 'ground' THEN r ELSE gr END, CASE WHEN g = 'ground' THEN z ELSE gz END, CASE WHEN g = 'ground' THEN atan2((bz + z) / (bn + 1), (br + r) / (bn + 1)) ELSE slope END,
  br + CASE WHEN g = 'ground' THEN r ELSE 0 END, bz + CASE WHEN g = 'ground' THEN z ELSE 0 END, bn + CASE WHEN g = 'ground' THEN 1 ELSE 0 END,
  oz + CASE WHEN g = 'obstacle' THEN z ELSE 0 END, o_n + CASE WHEN g = 'obstacle' THEN 1 ELSE 0 END, g FROM (
  SELECT *, CASE WHEN fresh THEN 0 ELSE sgr END AS br, CASE WHEN fresh THEN 0 ELSE sgz END AS bz, CASE WHEN fresh THEN 0 ELSE sgn END AS bn, CASE WHEN fresh THEN 0 ELSE soz END AS oz, CASE WHEN fresh THEN 0 ELSE son END AS o_n FROM (
  SELECT *, CASE WHEN way = 1 THEN 'obstacle' WHEN way = 3 THEN CASE WHEN last IN ('ground', 'obstacle') THEN last ELSE 'follow' END ELSE sloped END AS g, way IN (2, 4) AND sloped = 'ground' AS fresh FROM (
  SELECT *, CASE WHEN z > {tg} * r THEN 1 WHEN last = 'obstacle' AND abs(z - CASE WHEN son > 0 THEN soz / son ELSE 0 END) >= {split} THEN 2 WHEN close AND abs(z - gz) < {split} THEN 3 ELSE 4 END AS way,
   CASE WHEN atan2(z - CASE WHEN NOT close THEN gz WHEN sgn > 0 THEN sgz / sgn ELSE 0 END, r - CASE WHEN NOT close THEN gr WHEN sgn > 0 THEN sgr / sgn ELSE 0 END) - slope > {local} THEN 'obstacle' ELSE 'ground' END AS sloped FROM (
  SELECT p.frame_id, p.ray, p.n, p.point_idx, p.x, p.y, p.r, p.z, f.gr, f.gz, f.slope, f.sgr, f.sgz, f.sgn, f.soz, f.son, f.last,
   sqrt((p.x - f.px) * (p.x - f.px) + (p.y - f.py) * (p.y - f.py) + (p.z - f.pz) * (p.z - f.pz)) < p.r * {angle} + {tol} AS close
  FROM f JOIN p ON p.frame_id = f.frame_id AND p.ray = f.ray AND p.n = f.n + 1)))))
SELECT frame_id, point_idx, last AS label FROM f WHERE n > 0""".format(**_SCAN), recursive=True)
def g02(v):
    return G.scan_filter(v.pts_li().withColumn("z", c("z") / 4), divider=2.0)


@query("g04_grid_ground")
def g04(v):
    return grid_filter(v.pts_li().withColumn("z", c("z") / 4), GridParams(step=0.5, azimuth_deg=3.0))


_CORNER = "((h * 3 + {k}) * 2654435761 + frame_id * 40503 + 1) >> 8"


@query("g14_ransac_ground", f"""WITH src AS (SELECT frame_id, point_idx, x, y, z / 10 AS z FROM pts_li), l0 AS (SELECT frame_id, floor(x / 0.1) AS vx, floor(y / 0.1) AS vy, floor(z / 0.1) AS vz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM src GROUP BY ALL),
l AS (SELECT frame_id, x, y, z, row_number() OVER (PARTITION BY frame_id ORDER BY vx, vy, vz) - 1 AS i FROM l0), n AS (SELECT frame_id, count(*) AS n FROM l GROUP BY frame_id),
t AS (SELECT frame_id, h, (({_CORNER.format(k=1)}) % n + n) % n AS i1, (({_CORNER.format(k=2)}) % n + n) % n AS i2, (({_CORNER.format(k=3)}) % n + n) % n AS i3 FROM n, (SELECT unnest(range(200)) AS h) WHERE n >= 3),
d AS (SELECT t.frame_id, t.h, p.x AS x1, p.y AS y1, p.z AS z1, q.x - p.x AS ax, q.y - p.y AS ay, q.z - p.z AS az, r.x - p.x AS bx, r.y - p.y AS by_, r.z - p.z AS bz FROM t JOIN l p ON p.frame_id = t.frame_id AND p.i = i1 JOIN l q ON q.frame_id = t.frame_id AND q.i = i2 JOIN l r ON r.frame_id = t.frame_id AND r.i = i3 WHERE i1 <> i2 AND i2 <> i3 AND i1 <> i3),
c0 AS (SELECT *, ay * bz - az * by_ AS a, az * bx - ax * bz AS b, ax * by_ - ay * bx AS k FROM d), c1 AS (SELECT *, sqrt(a * a + b * b + k * k) AS s FROM c0), c2 AS (SELECT frame_id, h, a / s AS a, b / s AS b, k / s AS k, x1, y1, z1 FROM c1 WHERE s > 1e-9),
c3 AS (SELECT frame_id, h, a, b, k, -(a * x1 + b * y1 + k * z1) AS d FROM c2), votes AS (SELECT c3.frame_id, h, a, b, k, d, count(*) FILTER (abs(a * x + b * y + k * z + d) <= 0.15) AS votes FROM c3 JOIN l ON l.frame_id = c3.frame_id GROUP BY ALL),
best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY votes DESC, h) = 1),
m AS (SELECT best.frame_id, a, b, k, d, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM best JOIN l ON l.frame_id = best.frame_id WHERE abs(a * x + b * y + k * z + d) <= 0.15 GROUP BY ALL),
w AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS fx, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS fy, xx * yy - xy * xy > 1e-9 AND abs(k) > 0.1 AS fits FROM m), u AS (SELECT *, sqrt(fx * fx + fy * fy + 1) AS q FROM w),
plane AS (SELECT frame_id, CASE WHEN fits THEN -fx / q ELSE a END AS a, CASE WHEN fits THEN -fy / q ELSE b END AS b, CASE WHEN fits THEN 1 / q ELSE k END AS k, CASE WHEN fits THEN (fx * mx + fy * my - mz) / q ELSE d END AS d FROM u)
SELECT src.frame_id, point_idx, coalesce(abs(a * x + b * y + k * z + d) > 0.2, true) AS is_obstacle FROM src LEFT JOIN (SELECT * FROM plane WHERE abs(k) >= cos(radians(15.0))) p ON p.frame_id = src.frame_id""")
def g14(v):
    return G.ransac(v.pts_li().withColumn("z", c("z") / 10), threshold=0.15, height=0.2)


@query("g15_split", """SELECT frame_id, count(*) AS n_points, CAST(count_if(abs(z) > 1) AS BIGINT) AS n_obstacle FROM pts_emb GROUP BY frame_id""")
def g15(v):
    p = v.pts_emb()
    labels = p.select("frame_id", "point_idx", F.when(F.abs("z") > 1, "obstacle").otherwise("ground").alias("label"))
    ground, obstacle = G.split(p, labels)
    both = ground.select("frame_id", F.lit(0).alias("o")).unionByName(obstacle.select("frame_id", F.lit(1).alias("o")))
    return both.groupBy("frame_id").agg(F.count("*").alias("n_points"), F.sum("o").cast("long").alias("n_obstacle"))


_NEAR = "SELECT a.frame_id AS f, a.point_idx AS a, b.point_idx AS b FROM {s} a JOIN {s} b ON a.frame_id = b.frame_id AND a.point_idx < b.point_idx WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {t2}"
_DENSE = "kept AS (SELECT frame_id, label, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY label) - 1 AS INT) AS cluster_id FROM labelled GROUP BY frame_id, label HAVING count(*) BETWEEN {lo} AND {hi})"


@query("c01_voxel_key", "SELECT frame_id, point_idx, CAST(floor(x / 0.2) AS BIGINT) AS vx, CAST(floor(y / 0.2) AS BIGINT) AS vy, CAST(floor(z / 0.2) AS BIGINT) AS vz FROM pts_emb")
def c01(v):
    return v.pts_emb().select("frame_id", "point_idx", *A.voxel(0.2))


@query("c03_euclidean_clusters", "WITH " + _reach(_NEAR.format(s="pts_emb", t2=0.49)).format(nodes="pts_emb") + ", " + _DENSE.format(lo=2, hi=500) + " SELECT frame_id, point_idx, label, coalesce(cluster_id, -1) AS cluster_id FROM labelled LEFT JOIN kept USING (frame_id, label)", recursive=True)
def c03(v):
    return C.euclidean(v.pts_emb(), 0.7, 2, 500)


@query("c05_cluster_node", "WITH near_ AS (SELECT * FROM pts_emb WHERE " + _ROI + " QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) <= 300), " + _reach(_NEAR.format(s="near_", t2=1.0)).format(nodes="near_") + ", " + _DENSE.format(lo=2, hi=500) + """
 SELECT frame_id, cluster_id, count(*) AS n_points, R4((min(x) + max(x)) / 2) AS cx, R4((min(y) + max(y)) / 2) AS cy, R4((min(z) + max(z)) / 2) AS cz, R4(max(x) - min(x)) AS sx, R4(max(y) - min(y)) AS sy, R4(max(z) - min(z)) AS sz
 FROM near_ JOIN labelled USING (frame_id, point_idx) JOIN kept USING (frame_id, label) GROUP BY ALL""", recursive=True)
def c05(v):
    _, _, boxes = C.cluster_node(v.pts_emb(), ROI, 300, 1.0, 2, 500)
    return boxes.select("frame_id", "cluster_id", "n_points", *(out4(f"{s}{a}").alias(f"{s}{a}") for s in "cs" for a in "xyz"))


@query("c06_decimation", "SELECT frame_id, count(*) AS n FROM pts_li WHERE frame_id % 3 = 0 GROUP BY frame_id")
def c06(v):
    return C.every_kth_frame(v.pts_li(), 3).groupBy("frame_id").agg(F.count("*").alias("n"))


def _image(level: str, d: float, angle: float) -> str:
    return f"""SELECT a.frame_id AS f, a.point_idx AS a, b.point_idx AS b FROM {level} a JOIN {level} b ON a.frame_id = b.frame_id AND a.point_idx < b.point_idx AND abs(a.row - b.row) <= 1
  AND (((a.col - b.col) % 360 + 360) % 360) IN (0, 1, 359)
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < greatest(CASE WHEN a.range > 5 THEN {d} * least(a.range / 5, 4.0) ELSE {d} END, CASE WHEN b.range > 5 THEN {d} * least(b.range / 5, 4.0) ELSE {d} END)
  AND acos(greatest(-1.0, least(1.0, (a.x * b.x + a.y * b.y + a.z * b.z) / (a.range * b.range)))) < {angle}"""


_PIX = f"pix AS (SELECT q.frame_id, point_idx, range, row, col, x, y, z FROM ({RANGE_SQL}) q JOIN pts_emb USING (frame_id, point_idx) QUALIFY row_number() OVER (PARTITION BY q.frame_id, row, col ORDER BY range, point_idx) = 1)"


@query("c08_range_image_clusters", f"WITH {_PIX}, " + _reach(_image("pix", 1.5, 0.3)).format(nodes="pix") + ", " + _DENSE.format(lo=2, hi=5000) + " SELECT frame_id, point_idx, label, coalesce(cluster_id, -1) AS cluster_id FROM labelled LEFT JOIN kept USING (frame_id, label)", recursive=True)
def c08(v):
    return C.range_image_clusters(v.pts_emb(), 1.5, 0.3)


_REST = "rest AS (SELECT * FROM pts_emb ANTI JOIN taken USING (frame_id, point_idx))"
_PIX2 = _PIX.replace("pix AS", "pix2 AS").replace("FROM pts_emb)", "FROM rest)").replace("JOIN pts_emb USING", "JOIN rest USING")


@query("c09_multi_level", f"WITH {_PIX}, " + _reach(_image("pix", 1.0, 0.2)).format(nodes="pix") + ", taken AS (SELECT frame_id, point_idx, label FROM labelled WHERE (frame_id, label) IN (SELECT (frame_id, label) FROM labelled GROUP BY frame_id, label HAVING count(*) BETWEEN 2 AND 5000)), "
       + _REST + ", " + _PIX2 + ", " + _reach(_image("pix2", 2.5, 0.4), "2").format(nodes="pix2") + """ SELECT frame_id, point_idx, 0 AS level, label FROM taken UNION ALL
 SELECT frame_id, point_idx, 1, label FROM labelled2 WHERE (frame_id, label) IN (SELECT (frame_id, label) FROM labelled2 GROUP BY frame_id, label HAVING count(*) BETWEEN 2 AND 5000)""", recursive=True)  # fmt: skip
def c09(v):
    return C.multi_level(v.pts_emb(), 2, 1.0, 0.2, 1.5, 0.2)


@query("c11_quality_filter", f"SELECT frame_id, channel AS cluster_id, n_points FROM ({QUALITY_SQL.format(key='frame_id, channel', source='pts_emb', density='0.01')}) WHERE quality > 0")
def c11(v):
    p = v.pts_emb().withColumnRenamed("channel", "cluster_id")
    return C.good_clusters(p).groupBy("frame_id", "cluster_id").agg(F.count("*").alias("n_points"))


@query("c12_greedy_merge")
def c12(v):
    p = v.pts_emb().withColumn("cluster_id", (c("point_idx") % 40).cast("int"))
    return C.merge_greedily(p, 2.0)


@query("c13_published_ids", "WITH l AS (SELECT frame_id, point_idx, point_idx % 11 AS label, CASE WHEN point_idx % 11 < 8 THEN 1 ELSE -1 END AS cluster_id FROM pts_emb) SELECT frame_id, point_idx, CAST(CASE WHEN cluster_id >= 0 THEN label + 1 ELSE 0 END AS INT) AS published_id FROM l")
def c13(v):
    l = v.pts_emb().select("frame_id", "point_idx", (c("point_idx") % 11).alias("label"), F.when(c("point_idx") % 11 < 8, 1).otherwise(-1).alias("cluster_id"))
    return C.published_ids(l)


_VOTES = f"""v0 AS (SELECT frame_id, point_idx, CAST(point_idx % 12 AS INT) AS cluster_id, u, v FROM ({PIXELS})),
votes AS (SELECT v0.frame_id, det_idx, cluster_id, count(*) AS votes FROM v0 JOIN dets ON v0.frame_id = dets.frame_id AND u BETWEEN floor(cx - w / 2) AND ceil(cx + w / 2) AND v BETWEEN floor(cy - h / 2) AND ceil(cy + h / 2) GROUP BY ALL),
totals AS (SELECT frame_id, cluster_id, count(*) AS total FROM v0 GROUP BY ALL)"""


def _votes(v):
    px = P.pinhole(v.pts_emb(), CAMERA).withColumn("cluster_id", (c("point_idx") % 12).cast("int"))
    votes = C.vote(J.points_in_detections(px.select("frame_id", "point_idx", "cluster_id", "u", "v"), v.dets()))
    return votes, px.groupBy("frame_id", "cluster_id").agg(F.count("*").alias("total"))


@query("a05_votes", f"WITH {_VOTES} SELECT * FROM votes")
def a05(v):
    return _votes(v)[0]


@query("a06_cluster_totals", f"WITH {_VOTES} SELECT * FROM totals")
def a06(v):
    return _votes(v)[1]


@query("c16_match", f"WITH {_VOTES} SELECT frame_id, det_idx, cluster_id, votes, CAST(row_number() OVER (PARTITION BY frame_id, det_idx ORDER BY votes DESC, cluster_id) AS INT) AS rank FROM votes JOIN totals USING (frame_id, cluster_id) WHERE votes >= 2 AND votes::DOUBLE / total >= 0.1 QUALIFY rank <= 3")
def c16(v):
    return C.match(*_votes(v), min_points=2, min_ratio=0.1, exclusive=False, max_clusters=3)


@query("c16_match_exclusive", f"""WITH {_VOTES}, k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY det_idx, votes DESC, cluster_id) AS n FROM votes JOIN totals USING (frame_id, cluster_id) WHERE votes >= 2 AND votes::DOUBLE / total >= 0.1)
 SELECT frame_id, det_idx, cluster_id, votes, CAST(row_number() OVER (PARTITION BY frame_id, det_idx ORDER BY n) AS INT) AS rank FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY frame_id, cluster_id ORDER BY n) = 1)""")
def c16x(v):
    """Unless a detection is full, a cluster goes to the first that wants it."""
    return C.match(*_votes(v), min_points=2, min_ratio=0.1, exclusive=True)


@query("o06_top_k", f"WITH {_VOTES} SELECT frame_id, det_idx, cluster_id, votes, CAST(row_number() OVER (PARTITION BY frame_id, det_idx ORDER BY votes DESC, cluster_id) AS INT) AS rank FROM votes JOIN totals USING (frame_id, cluster_id) QUALIFY rank <= 1")
def o06(v):
    return C.match(*_votes(v), min_points=0, min_ratio=0.0, exclusive=False, max_clusters=1)


@query("c17_detections", """SELECT image_id, det_idx, score, coalesce(name, 'class_' || class) AS class_id FROM (
 SELECT s_suppkey AS det_idx, CAST(s_nationkey AS INT) AS class, (s_suppkey % 100) / 100.0::DOUBLE AS score, s_suppkey % 7 AS image_id FROM supplier) LEFT JOIN (SELECT n_nationkey AS class, n_name AS name FROM nation WHERE n_nationkey < 10) USING (class)
 WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_idx) <= 8""")
def c17(v):
    d = v.table("supplier").select(c("s_suppkey").alias("det_idx"), c("s_nationkey").cast("int").alias("class"), (c("s_suppkey") % 100 / 100.0).alias("score"), (c("s_suppkey") % 7).alias("image_id"))
    names = v.table("nation").filter("n_nationkey < 10").select(c("n_nationkey").cast("int").alias("class"), c("n_name").alias("name"))
    return C.detections(d, names, 0.2, 8).select("image_id", "det_idx", "score", "class_id")


@query("c18_masks", "SELECT p_partkey, i, CAST(CASE WHEN (p_partkey + i) % 3 = 0 THEN 255 ELSE 0 END AS INT) AS grey FROM part, (SELECT unnest(range(8)) AS i)")
def c18(v):
    m = v.table("part").select("p_partkey", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((c("p_partkey") + i) % 3 == 0, 1).otherwise(0)).alias("mask"))
    return C.masks_to_images(m).select("p_partkey", F.posexplode("grey").alias("i", "grey")).withColumn("i", c("i").cast("long"))
