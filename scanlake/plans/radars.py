"""Queries for radar lists and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions.binary import crc16, hex_be
from scanlake.functions.geometry import c, out4
from scanlake.operators import radar as R
from scanlake.plans.registry import query

_DET = """det AS (SELECT l_orderkey AS list_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INT) AS idx,
 (l_partkey % 628) / 100.0::DOUBLE - 3.14 AS azimuth, (l_suppkey % 50) / 100.0::DOUBLE - 0.25 AS elevation, l_quantity * 7 AS range, CAST(l_partkey % 101 AS DOUBLE) AS positive_predictive_value, CAST(l_suppkey % 3 * (l_partkey % 256) AS INT) AS invalid_flags FROM lineitem)"""


def _lists(v):
    li = v.table("lineitem")
    entry = F.struct(
        *li.columns, ((c("l_partkey") % 628) / 100.0 - 3.14).alias("azimuth"), ((c("l_suppkey") % 50) / 100.0 - 0.25).alias("elevation"), (c("l_quantity") * 7).alias("range"),
        (c("l_partkey") % 101).cast("double").alias("positive_predictive_value"), (c("l_suppkey") % 3 * (c("l_partkey") % 256)).cast("int").alias("invalid_flags"),
    )
    return li.groupBy(c("l_orderkey").alias("list_id")).agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.count("*").cast("int").alias("n"))


def _det(v):
    return R.detections(_lists(v))


@query("r01_dispatch", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'status' WHEN o_orderkey % 3 = 1 THEN 'detection' ELSE 'object' END AS kind FROM orders WHERE o_orderkey % 50 < 40")
def r01(v):
    sizes = F.when(c("o_orderkey") % 3 == 0, 84).when(c("o_orderkey") % 3 == 1, 35_336).otherwise(9_401)
    method = F.when(c("o_orderkey") % 3 == 0, 380).when(c("o_orderkey") % 3 == 1, 336).otherwise(329)
    p = v.table("orders").select("o_orderkey", F.lit(0).alias("service_id"), method.alias("method_id"), F.unhex(F.repeat(F.lit("00"), F.when(c("o_orderkey") % 50 < 40, sizes).otherwise(sizes - 1))).alias("data"))
    out = None
    for k in R.ARS_MESSAGES:
        one = R.dispatch(p, k).select("o_orderkey", F.lit(k).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


@query("r02_detections", f"WITH {_DET} SELECT list_id, idx, invalid_flags & 1 <> 0 AS invalid_distance, invalid_flags & 4 <> 0 AS invalid_azimuth, invalid_flags & 128 <> 0 AS invalid_range_rate_std FROM det")
def r02(v):
    return _det(v).select("list_id", "idx", "invalid_distance", "invalid_azimuth", "invalid_range_rate_std")


@query("r03_objects_not_corner", "SELECT o_orderkey FROM orders WHERE NOT (abs(degrees((o_orderkey % 400) / 100.0::DOUBLE - 2)) > 5 AND abs(degrees((o_orderkey % 400) / 100.0::DOUBLE - 2)) < 90)")
def r03(v):
    return v.table("orders").filter(~R.is_corner((c("o_orderkey") % 400) / 100.0 - 2)).select("o_orderkey")


@query("r04_violations", f"WITH {_DET} SELECT 'range' AS field, count(*) AS n_rows, CAST(count_if(range NOT BETWEEN 0 AND 301) AS BIGINT) AS n_bad FROM det UNION ALL SELECT 'azimuth', count(*), CAST(count_if(azimuth NOT BETWEEN -pi() AND pi()) AS BIGINT) FROM det")
def r04(v):
    return R.violations(_det(v), ["range", "azimuth"])


_FLAGS = {0: "VOLTAGE", 1: "TEMPERATURE", 2: "BLOCKAGE"}


@query("r05_status_strings", """SELECT o_orderkey, k || ':' || CASE k WHEN 1 THEN 'SYNC_OK' WHEN 2 THEN 'NEVER_SYNC' WHEN 3 THEN 'SYNC_LOST' ELSE 'INVALID' END AS sync, CASE WHEN m = 0 THEN 'OK' ELSE
 array_to_string(list_filter([CASE WHEN m & 1 <> 0 THEN 'VOLTAGE' END, CASE WHEN m & 2 <> 0 THEN 'TEMPERATURE' END, CASE WHEN m & 4 <> 0 THEN 'BLOCKAGE' END], lambda x: x IS NOT NULL), ', ') END AS flags FROM (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderkey % 8 AS m FROM orders)""")
def r05(v):
    k = c("o_orderkey")
    return v.table("orders").select("o_orderkey", R.coded(k % 5, {1: "SYNC_OK", 2: "NEVER_SYNC", 3: "SYNC_LOST"}).alias("sync"), R.flag_names((k % 8).cast("int"), _FLAGS).alias("flags"))


@query("r08_detection_points", f"WITH {_DET} SELECT list_id, idx, R4(cos(elevation) * cos(azimuth) * range) AS x, R4(cos(elevation) * sin(azimuth) * range) AS y, R4(sin(elevation) * range) AS z, positive_predictive_value / 100 AS probability FROM det")
def r08(v):
    return R.detections_to_points(_det(v)).select("list_id", "idx", *(out4(a).alias(a) for a in "xyz"), "probability")


@query("r10_radar_scan", f"WITH {_DET} SELECT list_id, idx, R4(range) AS range FROM det WHERE invalid_flags = 0")
def r10(v):
    return R.valid_scan(_det(v)).select("list_id", "idx", out4("range").alias("range"))


_OBJ = """obj AS (SELECT o_orderkey AS object_id, (o_orderkey * 7 % 1000) / 10.0::DOUBLE AS x, (o_orderkey * 11 % 1000) / 10.0::DOUBLE AS y, (o_orderkey % 628) / 100.0::DOUBLE AS orientation, 4.5::DOUBLE AS length, 1.8::DOUBLE AS width, o_orderkey % 12 AS reference,
 o_orderkey % 4 AS status, 0.1::DOUBLE * (o_orderkey % 5) AS std_x, 0.2::DOUBLE AS std_y, {ps} FROM orders)""".format(ps=", ".join(f"CAST(o_orderkey * {i + 3} % 17 AS DOUBLE) AS p_{n}" for i, n in enumerate(R.CLASSES)))


def _objects(v):
    k = c("o_orderkey")
    return v.table("orders").select(
        k.alias("object_id"), (k * 7 % 1000 / 10.0).alias("x"), (k * 11 % 1000 / 10.0).alias("y"), (k % 628 / 100.0).alias("orientation"), F.lit(4.5).alias("length"), F.lit(1.8).alias("width"),
        (k % 12).alias("reference"), (k % 4).alias("status"), (k % 5 * 0.1).alias("std_x"), F.lit(0.2).alias("std_y"), *((k * (i + 3) % 17).cast("double").alias(f"p_{n}") for i, n in enumerate(R.CLASSES)),
    )


_BEST = "CASE " + " ".join(f"WHEN p_{n} = best THEN '{n}'" for n in R.CLASSES) + " END"
_FX, _FY = ("CASE reference " + " ".join(f"WHEN {k} THEN {x}" for k, *xy in R.REFERENCE for x in [xy[i]]) + " ELSE 0.0 END" for i in (0, 1))


@query("r09_object_points", f"WITH {_OBJ} SELECT object_id, R4(x) AS x, R4(y) AS y FROM obj")
def r09(v):
    return _objects(v).select("object_id", out4("x").alias("x"), out4("y").alias("y"))


@query("r11_tracks", f"""WITH {_OBJ}, b AS (SELECT *, greatest({', '.join('p_' + n for n in R.CLASSES)}) AS best, -({_FX}) * length AS ox, -({_FY}) * width AS oy FROM obj)
SELECT object_id, R4(x + ox * cos(orientation) - oy * sin(orientation)) AS cx, R4(y + ox * sin(orientation) + oy * cos(orientation)) AS cy, {_BEST} AS label, R4(std_x * std_x) AS var_x, lpad(lower(to_hex(object_id)), 32, '0') AS uuid FROM b""")
def r11(v):
    return R.tracks(_objects(v)).select("object_id", out4("cx").alias("cx"), out4("cy").alias("cy"), "label", out4("var_x").alias("var_x"), "uuid")


@query("r12_normalized_objects", f"WITH {_OBJ} SELECT object_id, CASE status WHEN 0 THEN 'measured' WHEN 1 THEN 'new' WHEN 2 THEN 'predicted' ELSE 'invalid' END AS status_name, {len(R.CLASSES)} AS n_classes FROM obj")
def r12(v):
    return R.normalized_objects(_objects(v)).select("object_id", "status_name", F.size("classes").alias("n_classes"))


@query("r13_field_info", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {lo!r}::DOUBLE, {hi!r}::DOUBLE, {'NULL' if x is None else x}::DOUBLE)" for f, lo, hi, x in R.FIELDS) + ") v(field, min_value, max_value, resolution)")
def r13(v):
    return R.field_info(v.spark)


_NEAR = "n AS (SELECT packet_id, block, channel, raw_dist % 4096 AS r, raw_az % 511 AS a, raw_dist * 3 % 2047 AS v, refl % 127 AS s, refl % 32 AS f, channel % 16 AS q FROM units_li WHERE block < 10)"


def _near(v):
    u = v.units_li().filter("block < 10")
    h = R.fragment_hex(c("raw_dist") % 4096, c("raw_az") % 511, c("raw_dist") * 3 % 2047, c("refl") % 127, c("refl") % 32, c("channel") % 16)
    g = u.groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct("block", h.alias("h")))).alias("b"), F.count("*").alias("n_detections"))
    text = F.rpad(F.array_join(F.transform("b", lambda x: x["h"]), ""), 120, "0")
    return R.near_detections(g.select("packet_id", "n_detections", F.lit(0).alias("message"), F.unhex(text).alias("data")))


@query("r15_near_detections", f"WITH {_NEAR} SELECT packet_id, CAST(block AS INT) AS idx, R4(r * 0.024420024) AS range, R4(a * 0.006159986 - 1.570796327) AS azimuth, R4(v * 0.014662757 - 15) AS range_rate, R4(s * 0.476190476 - 40) AS rcs, R4(q * 1.7 + 11) AS snr, CAST(100 * (f // 16) AS BIGINT) AS pdh00, CAST(100 * (f // 4 % 2) AS BIGINT) AS pdh02 FROM n")
def r15(v):
    return _near(v).select("packet_id", "idx", *(out4(k).alias(k) for k in ("range", "azimuth", "range_rate", "rcs", "snr")), "pdh00", "pdh02")


@query("r19_radar_scan", f"WITH {_NEAR} SELECT packet_id, CAST(block AS INT) AS idx FROM n WHERE f // 16 = 0 AND f // 4 % 2 = 0")
def r19(v):
    return R.radar_scan(_near(v)).select("packet_id", "idx")


@query("r17_group_assembly", "SELECT l_orderkey AS sensor, CAST(1 AS BIGINT) AS group_no, count(*) AS n_elements, count(*) = 4 AND l_orderkey % 3 <> 0 AS whole FROM lineitem GROUP BY l_orderkey")
def r17(v):
    u = v.units_li().select(c("packet_id").alias("sensor"), (c("block") + 1).alias("seq"), F.lit("element").alias("kind"), F.unhex(hex_be("raw_dist", 4)).alias("data"))
    heads = u.select("sensor").distinct().select("sensor", F.lit(0).alias("seq"), F.lit("header").alias("kind"), F.unhex(F.lit("AB01")).alias("data"))
    text = F.unhex(F.concat(F.lit("AB01"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex("data").alias("h")))), lambda x: x["h"]), "")))
    crcs = u.groupBy("sensor").agg(text.alias("t")).select("sensor", F.lit(1000).alias("seq"), F.lit("crc").alias("kind"), F.unhex(hex_be(crc16("t") + F.when(c("sensor") % 3 == 0, 1).otherwise(0), 2)).alias("data"))
    return R.assemble(heads.unionByName(u).unionByName(crcs), 4)


@query("r21_vanished_ids", """WITH f AS (SELECT DISTINCT l_orderkey // 100 AS frame_no, l_suppkey AS object_id FROM lineitem) SELECT a.frame_no + 1 AS frame_no, a.object_id FROM f a WHERE EXISTS (SELECT 1 FROM f x WHERE x.frame_no = a.frame_no + 1)
 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.frame_no = a.frame_no + 1 AND b.object_id = a.object_id)""")
def r21(v):
    return R.vanished(v.table("lineitem").select(F.expr("l_orderkey div 100").alias("frame_no"), c("l_suppkey").alias("object_id")))


@query("t17_diagnostics", """SELECT source, CAST(max(CASE WHEN off THEN level ELSE 0 END) AS INT) AS level, coalesce(string_agg(DISTINCT CASE WHEN off THEN metric END, ', ' ORDER BY CASE WHEN off THEN metric END), '') AS message FROM (
 SELECT user_id AS source, event_type AS metric, level, value NOT BETWEEN low AND high AS off FROM events JOIN (VALUES ('click', 0.5, 90.0, 1), ('error', 2.0, 60.0, 2), ('view', 0.0, 95.0, 1)) r(metric, low, high, level) ON event_type = metric) GROUP BY source""")
def t17(v):
    rules = v.spark.createDataFrame([("click", 0.5, 90.0, 1), ("error", 2.0, 60.0, 2), ("view", 0.0, 95.0, 1)], "metric string, low double, high double, level int")
    return R.diagnostics(v.table("events").select(c("user_id").alias("source"), c("event_type").alias("metric"), "value"), rules)
