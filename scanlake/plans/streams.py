"""Queries for scan cutting, streaming twins, sources and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions.binary import hex_le
from scanlake.functions.geometry import c, out4
from scanlake.operators import imaging as I
from scanlake.operators.motion import integrate_3d, undistort_3d
from scanlake.operators.sync import collect_groups
from scanlake.plans.registry import query
from scanlake.sources import clouds as S
from scanlake.sources.calibration import with_rings
from scanlake.sources.can import to_packets
from scanlake.sources.packets import accept, latest_frames, window_of
from scanlake.streaming import scans as T

_BLOCKS = "b AS (SELECT sensor, event_id AS seq, CAST(event_id * 977 % 36000 AS DOUBLE) / 100 AS azimuth, t_ns FROM stream_ev)"
_PASS = "CASE WHEN l IS NULL THEN 0 WHEN l <= azimuth THEN CASE WHEN l < 90 AND 90 <= azimuth THEN 1 ELSE 0 END WHEN l < 90 OR 90 <= azimuth THEN 1 ELSE 0 END"
_CUT = f"""{_BLOCKS}, l AS (SELECT *, lag(azimuth) OVER (PARTITION BY sensor ORDER BY seq) AS l FROM b), k AS (SELECT *, {_PASS} AS cut FROM l),
s AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY sensor ORDER BY seq) - cut AS BIGINT) AS scan_id FROM k)"""


def _blocks(v):
    return v.stream_ev().select("sensor", c("event_id").alias("seq"), ((c("event_id") * 977 % 36000).cast("double") / 100).alias("azimuth"), "t_ns")


@query("t01_scan_cut", f"WITH {_CUT} SELECT seq, scan_id FROM s")
def t01(v):
    return T.cut_at_angle(_blocks(v), 90.0).select("seq", "scan_id")


@query("t01_scan_cut_stream", f"WITH {_CUT} SELECT seq, scan_id FROM s")
def t01_stream(v):
    """The same rule as a stream with state, over the table as a file source."""
    schema = v.table("events").schema
    stream = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    blocks = stream.select(c("user_id").alias("sensor"), c("event_id").alias("seq"), ((c("event_id") * 977 % 36000).cast("double") / 100).alias("azimuth"))
    return T.run_once(T.cut_stream(blocks, 90.0)).select("seq", "scan_id")


@query("t02_overlap", f"""WITH {_CUT}, p AS (SELECT *, azimuth + 3 - floor((azimuth + 3) / 360) * 360 AS pa FROM s)
SELECT seq, scan_id + CASE WHEN (azimuth - 85) - floor((azimuth - 85) / 360) * 360 <= 5 AND (pa - 90) - floor((pa - 90) / 360) * 360 <= 20 THEN 1 ELSE 0 END AS scan_id FROM p""")
def t02(v):
    from scanlake.functions.geometry import wrap

    p = T.cut_at_angle(_blocks(v), 90.0).withColumn("point_azimuth", wrap(c("azimuth") + 3, 360.0))
    return T.into_next_scan(p, 85.0, 90.0).select("seq", "scan_id")


@query("t04_scan_cut_wrap", f"""WITH {_BLOCKS}, w AS (SELECT *, (azimuth - 90) - floor((azimuth - 90) / 360) * 360 AS q FROM b), l AS (SELECT *, lag(q) OVER (PARTITION BY sensor ORDER BY seq) AS l FROM w)
SELECT seq, CAST(sum(CASE WHEN q < l THEN 1 ELSE 0 END) OVER (PARTITION BY sensor ORDER BY seq) AS BIGINT) AS scan_id FROM l""")
def t04(v):
    return T.cut_on_wrap(_blocks(v), 90.0, 360.0).select("seq", "scan_id")


@query("t05_packet_cut", f"""WITH {_BLOCKS}, w AS (SELECT *, (azimuth + 12 - 180) - floor((azimuth + 12 - 180) / 360) * 360 AS q FROM b), l AS (SELECT *, lag(q) OVER (PARTITION BY sensor ORDER BY seq) AS l FROM w)
SELECT seq, CAST(sum(CASE WHEN q < l THEN 1 ELSE 0 END) OVER (PARTITION BY sensor ORDER BY seq) AS BIGINT) AS scan_id FROM l""")
def t05(v):
    return T.cut_packets(_blocks(v).withColumn("last", c("azimuth") + 12), 180.0, 360.0).select("seq", "scan_id")


@query("t06_overflow", f"""WITH {_CUT}, p AS (SELECT *, seq % 5 = 0 AS tail FROM s), st AS (SELECT sensor, scan_id - 1 AS scan_id, min(t_ns) AS start FROM p WHERE NOT tail GROUP BY ALL)
SELECT seq, scan_id + CASE WHEN tail THEN 1 ELSE 0 END AS scan_id FROM p LEFT JOIN st USING (sensor, scan_id) WHERE NOT (tail AND (start IS NULL OR start - t_ns > 40000000000000))""")
def t06(v):
    p = T.cut_at_angle(_blocks(v), 90.0).withColumn("tail", c("seq") % 5 == 0)
    return T.overflow(p, 90.0, 40_000_000_000_000).select("seq", "scan_id")


@query("t07_scan_stamps", f"WITH {_CUT} SELECT sensor, scan_id, min(t_ns) AS stamp_ns, count(*) AS n_points FROM s GROUP BY ALL")
def t07(v):
    return T.scan_stamps(T.cut_at_angle(_blocks(v), 90.0))


@query("t14_collect_groups", """WITH m AS (SELECT sensor % 10 AS key, event_id % 3 AS sensor, t_ns, event_id FROM stream_ev), g AS (SELECT *, CASE WHEN coalesce(t_ns - lag(t_ns) OVER w > 60000000000, true) THEN 1 ELSE 0 END AS n FROM m WINDOW w AS (PARTITION BY key ORDER BY t_ns, event_id)),
k AS (SELECT *, CAST(sum(n) OVER (PARTITION BY key ORDER BY t_ns, event_id) AS BIGINT) AS group_no FROM g) SELECT key, group_no, event_id FROM k QUALIFY row_number() OVER (PARTITION BY key, group_no, sensor ORDER BY t_ns, event_id) = 1""")
def t14(v):
    m = v.stream_ev().select((c("sensor") % 10).alias("key"), (c("event_id") % 3).alias("sensor"), "t_ns", "event_id")
    return collect_groups(m, 60_000_000_000).select("key", "group_no", "event_id")


@query("t15_after_calibration", """SELECT p.event_id, q.event_id AS info_id FROM (SELECT * FROM stream_ev WHERE event_type <> 'signup') p ASOF JOIN (SELECT sensor, t_ns, event_id FROM stream_ev WHERE event_type = 'signup') q ON p.sensor = q.sensor AND p.t_ns >= q.t_ns""")
def t15(v):
    s = v.stream_ev()
    infos = s.filter("event_type = 'signup'").select("sensor", "t_ns", "event_id")
    return T.after_calibration(s.filter("event_type <> 'signup'"), infos).select("event_id", c("r_event_id").alias("info_id"))


@query("s02_can_frames", """SELECT CAST(o_orderkey AS BIGINT) AS packet_id, id AS can_id, lower(printf('%08x', id)) || lower(array_to_string([printf('%02x', (k * 3 + i) % 256) FOR i IN range(n)], '')) AS data
 FROM (SELECT o_orderkey, k, CASE WHEN k % 3 = 0 THEN k * 7919 % 536870912 ELSE k % 2048 END AS id, [0, 8, 12, 20, 48, 64][k % 6 + 1] AS n FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS k FROM orders)) WHERE k % 10 <> 9""")
def s02(v):
    """Frames to packets: standard and extended ids, lengths, error frames left out."""
    k = c("o_orderkey").cast("long")
    can_id = F.when(k % 3 == 0, (k * 7919 % 536870912).bitwiseOR(F.lit(0x80000000).cast("long"))).otherwise(k % 2048)
    flagged = F.when(k % 10 == 9, can_id.bitwiseOR(F.lit(0x20000000).cast("long"))).otherwise(can_id)
    n = F.element_at(F.array(*map(F.lit, (0, 8, 12, 20, 48, 64))), (k % 6 + 1).cast("int"))
    data = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex((k * 3 + i) % 256), 2, "0")), "")
    frame = F.unhex(F.concat(hex_le(flagged, 4), hex_le(n, 1), F.lit("000000"), data))
    frames = v.table("orders").select(k.alias("packet_id"), F.lit(0).cast("long").alias("stamp_ns"), frame.alias("frame"))
    return to_packets(frames).select("packet_id", "can_id", F.lower(F.hex("data")).alias("data"))


@query("s03_sender_filter", "SELECT event_id, length(props) > 8 AS truncated FROM stream_ev WHERE sensor = 7")
def s03(v):
    p = v.stream_ev().select("event_id", c("sensor").cast("string").alias("sender"), c("props").cast("binary").alias("data"))
    return accept(p, "7", 8).select("event_id", "truncated")


@query("s04_topic_filter", "SELECT event_type AS topic, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def s04(v):
    return v.table("events").filter(c("event_type").isin("click", "view")).groupBy(c("event_type").alias("topic")).agg(F.count("*").alias("n"))


@query("s05_pcd_round_trip", "SELECT frame_id, count(*) AS n, R4(sum(CAST(x AS FLOAT)::DOUBLE)) AS sx FROM pts_emb GROUP BY frame_id")
def s05(v):
    """Points written as PCD and read again."""
    back = S.from_pcd(S.to_pcd(v.pts_emb()))
    return back.groupBy("frame_id").agg(F.count("*").alias("n"), out4(F.sum("x")).alias("sx"))


@query("s05_pcd_files", "SELECT frame_id, count(*) AS n, R4(sum(CAST(x AS FLOAT)::DOUBLE)) AS sx FROM pts_emb GROUP BY frame_id")
def s05_files(v):
    """A PCD file a frame, written by the tasks, moved into place when all are done, and read again."""
    from scanlake.sources import files
    from scanlake.storage import shared_dir

    path = shared_dir(v.spark)
    files.write_pcd(v.pts_emb(), path)
    return S.from_pcd(files.read(v.spark, path)).groupBy("frame_id").agg(F.count("*").alias("n"), out4(F.sum("x")).alias("sx"))


@query("s07_skip_and_limit", "SELECT event_id FROM stream_ev ORDER BY t_ns DESC, event_id LIMIT 7 OFFSET 3")
def s07(v):
    return window_of(v.stream_ev().withColumn("neg", -c("t_ns")), 3, 7, "neg", "event_id").select("event_id")


@query("s10_keep_last", "SELECT topic, frame_id FROM (SELECT event_type AS topic, event_id AS frame_id FROM events) WHERE frame_id > (SELECT max(event_id) FROM events e WHERE e.event_type = topic) - 50")
def s10(v):
    return latest_frames(v.table("events").select(c("event_type").alias("topic"), c("event_id").alias("frame_id")), 50)


@query("s13_channel_file", "SELECT CAST(p_partkey AS INT) AS channel, (p_partkey * 37 % 5000 - 2500) / 100.0::DOUBLE AS elev_deg, (p_partkey * 11 % 360 - 180) / 8.0::DOUBLE AS azim_off_deg FROM part")
def s13(v):
    """A calibration written as a file of channels and read again."""
    from scanlake.sources.calibration import read_channel_csv, write_channel_csv
    from scanlake.storage import shared_dir

    k, path = c("p_partkey"), shared_dir(v.spark)
    own = v.table("part").select(k.cast("int").alias("channel"), ((k * 37 % 5000 - 2500) / 100.0).alias("elev_deg"), ((k * 11 % 360 - 180) / 8.0).alias("azim_off_deg"))
    write_channel_csv(own, path)
    return read_channel_csv(v.spark, path)


@query("s16_rings", "SELECT n_nationkey AS laser_id, CAST(dense_rank() OVER (ORDER BY n_regionkey) - 1 AS INT) AS ring FROM nation")
def s16(v):
    return with_rings(v.table("nation").withColumn("vert_correction", c("n_regionkey").cast("double"))).select(c("n_nationkey").alias("laser_id"), "ring")


@query("s17_merge_pairs", "SELECT 'p' || p_partkey AS stem, 'merged_' || lpad(CAST(row_number() OVER (ORDER BY 'p' || p_partkey) - 1 AS VARCHAR), 6, '0') AS name FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 0")
def s17(v):
    p = v.table("part")
    name = lambda ext, col: F.concat(F.lit("p"), c("p_partkey"), F.lit(ext)).alias(col)
    return I.merge_pairs(p.filter("p_partkey % 3 <> 0").select(name(".png", "image")), p.filter("p_partkey % 4 <> 0").select(name(".json", "label")), "merged_").select("stem", "name")


@query("s18_label_polygons", "SELECT s_suppkey AS line, CAST(s_suppkey % 3 AS INT) AS class, 4 AS n_corners, 0.25::DOUBLE * (s_suppkey % 4) AS x0 FROM supplier WHERE s_suppkey % 5 <> 0")
def s18(v):
    k = c("s_suppkey")
    text = F.when(k % 5 == 0, F.concat_ws(" ", k % 3, F.lit("0.1 0.2 0.3"))).otherwise(F.concat_ws(" ", (k % 3).cast("string"), (0.25 * (k % 4)).cast("string"), F.lit("0.5 0.1 0.5 0.1 0.9 0.7 0.9")))
    rows = I.parse_labels(v.table("supplier").select(F.lit("f").alias("file"), k.alias("line"), text.alias("value")))
    return rows.select("line", "class", F.size("poly").alias("n_corners"), c("poly")[0]["x"].alias("x0"))


@query("s19_split", "WITH b AS (SELECT p_partkey, CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS b FROM part) SELECT p_partkey, b < 20 OR (NOT EXISTS (SELECT 1 FROM b WHERE b < 20) AND (b, p_partkey) = (SELECT min((b, p_partkey)) FROM b)) AS is_validation FROM b")
def s19(v):
    return I.split_train_validation(v.table("part").select("p_partkey"), "p_partkey", 20)


@query("s20_synthetic_cloud", "SELECT 3000 AS n, 20.0::DOUBLE * 100 * 0.95 + 1000 AS sz")
def s20(v):
    return S.synthetic(v.spark).agg(F.count("*").cast("int").alias("n"), F.round(F.sum("z"), 6).alias("sz"))


@query("s22_exact_sync", "SELECT a.t_ns, R4(a.vx) AS vx, b.event_id FROM twist_ev a JOIN stream_ev b ON a.t_ns = b.t_ns")
def s22(v):
    return v.twist_ev().select("t_ns", out4("vx").alias("vx")).join(v.stream_ev().select("t_ns", "event_id"), "t_ns")


@query("c20_model_metadata", "SELECT p_partkey, CAST(5 + p_partkey % 7 AS VARCHAR) AS version, ['nano', 'small', 'medium'][CAST(p_partkey % 3 + 1 AS INT)] AS size, CASE WHEN p_partkey % 2 = 0 THEN 'segment' ELSE 'detect' END AS task FROM part")
def c20(v):
    k = c("p_partkey")
    file = F.concat(F.lit("models/netv"), 5 + k % 7, F.element_at(F.array(F.lit("n"), F.lit("s"), F.lit("m")), (k % 3 + 1).cast("int")), F.when(k % 2 == 0, "-seg.pt").otherwise(".pt"))
    return I.model_metadata(v.table("part").select("p_partkey", file.alias("file"))).select("p_partkey", "version", "size", "task")


@query("fn_pixel_formats", "SELECT *, NOT is_color AND NOT is_bayer AS is_mono FROM (VALUES " + ", ".join(f"('{n}', {k}, {b}, {d}, {a}, {y})" for n, k, b, d, a, y in I.FORMATS) + ") v(encoding, is_color, bytes_per_pixel, bit_depth, has_alpha, is_bayer)")
def fn_pixel_formats(v):
    return I.format_table(v.spark)


@query("fn_yuyv_to_rgb", """WITH q AS (SELECT p_partkey, p_partkey % 256 AS y0, p_partkey * 7 % 256 - 128 AS u, p_partkey * 3 % 256 AS y1, p_partkey * 13 % 256 - 128 AS v FROM part), h AS (SELECT p_partkey AS image_id, 0 AS pixel, y0 AS y, u, v FROM q UNION ALL SELECT p_partkey, 1, y1, u, v FROM q)
SELECT image_id, pixel, greatest(0, least(255, y + ((v * 37221) >> 15))) AS r, greatest(0, least(255, y - ((u * 12975 + v * 18949) >> 15))) AS g, greatest(0, least(255, y + ((u * 66883) >> 15))) AS b FROM h""")
def fn_yuyv(v):
    return I.packed_yuv_to_rgb(_four_bytes(v))


def _four_bytes(v):
    from scanlake.functions.binary import hex_le

    k = c("p_partkey")
    return v.table("part").select(k.alias("image_id"), F.unhex(F.concat(*(hex_le(x % 256, 1) for x in (k, k * 7, k * 3, k * 13)))).alias("data"))


@query("fn_uyvy_to_rgb", """WITH q AS (SELECT p_partkey, p_partkey * 7 % 256 AS y0, p_partkey % 256 - 128 AS u, p_partkey * 13 % 256 AS y1, p_partkey * 3 % 256 - 128 AS v FROM part), h AS (SELECT p_partkey AS image_id, 0 AS pixel, y0 AS y, u, v FROM q UNION ALL SELECT p_partkey, 1, y1, u, v FROM q)
SELECT image_id, pixel, greatest(0, least(255, y + ((v * 37221) >> 15))) AS r, greatest(0, least(255, y - ((u * 12975 + v * 18949) >> 15))) AS g, greatest(0, least(255, y + ((u * 66883) >> 15))) AS b FROM h""")
def fn_uyvy(v):
    return I.packed_yuv_to_rgb(_four_bytes(v), "uyvy")


@query("fn_mono8", "SELECT p_partkey AS image_id, CAST(i AS INT) AS pixel, CAST([p_partkey, p_partkey * 7, p_partkey * 3, p_partkey * 13][i + 1] % 256 AS BIGINT) AS grey FROM part, (SELECT unnest(range(4)) AS i)")
def fn_mono8(v):
    return I.mono8(_four_bytes(v))


_PLANAR = "SELECT p_partkey AS image_id, CAST(i AS INT) AS pixel, (p_partkey * 7 + i * 31) % 256 AS y, (p_partkey * 13 + (i % 4 // 2) * 5) % 256 - 128 AS v, (p_partkey * 3 + (i % 4 // 2) * 11) % 256 - 128 AS u FROM part, (SELECT unnest(range(8)) AS i)"


@query("fn_planar_yuv_to_rgb", f"""SELECT image_id, pixel, greatest(0, least(255, (l + v * 1673527) >> 20)) AS r, greatest(0, least(255, (l - v * 852492 - u * 409993) >> 20)) AS g, greatest(0, least(255, (l + u * 2116026) >> 20)) AS b
FROM (SELECT *, greatest(0, y - 16) * 1220542 + 524288 AS l FROM ({_PLANAR}))""")
def fn_planar(v):
    from scanlake.functions.binary import hex_le

    k = c("p_partkey")
    planes = [(k * 7 + i * 31) % 256 for i in range(8)] + [(k * 13 + i * 5) % 256 for i in range(2)] + [(k * 3 + i * 11) % 256 for i in range(2)]
    images = v.table("part").select(k.alias("image_id"), F.lit(4).alias("width"), F.lit(2).alias("height"), F.unhex(F.concat(*(hex_le(x, 1) for x in planes))).alias("data"))
    return I.planar_yuv_to_rgb(images)


@query("s12_pixmaps", "SELECT p_partkey AS image_id, '50360A3120310A3235350A' || printf('%02X%02X%02X', p_partkey % 256, p_partkey * 7 % 256, p_partkey * 3 % 256) AS data FROM part")
def s12(v):
    k = c("p_partkey")
    pixels = v.table("part").select(k.alias("image_id"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(0).alias("pixel"), (k % 256).alias("r"), (k * 7 % 256).alias("g"), (k * 3 % 256).alias("b"))
    return I.to_pixmap(pixels).select("image_id", F.hex("data").alias("data"))


@query("fn_y10_to_mono8", "SELECT p_partkey AS image_id, 0 AS pixel, (p_partkey * 5 % 1024) // 4 AS grey FROM part")
def fn_y10(v):
    from scanlake.functions.binary import hex_le

    return I.y10_to_mono8(v.table("part").select(c("p_partkey").alias("image_id"), F.unhex(hex_le(c("p_partkey") * 5 % 1024, 2)).alias("data")))


@query("fn_four_cc", "SELECT 'YUYV' AS code")
def fn_four_cc(v):
    return v.spark.range(1).select(I.four_cc(F.lit(0x56595559)).alias("code"))


def _twists(v):
    t = v.twist_ev("event_id").withColumn("day", F.floor(c("t_ns") / 86_400_000_000_000))
    z = lambda k: (F.col("wz") * k / 1000).alias
    return t.select("day", "t_ns", "event_id", (c("vx") / 1000).alias("vx"), F.lit(0.0001).alias("vy"), F.lit(0.0).alias("vz"), z(0.5)("wx"), z(-0.25)("wy"), z(1.0)("wz"))


#: Stamps of the test tables are minutes apart.
HALF_DAY = 43_200_000_000_000
_I = (1, 2, 3)
_K = {(1, 2): "-fz", (1, 3): "fy", (2, 1): "fz", (2, 3): "-fx", (3, 1): "-fy", (3, 2): "fx"}
_AX = "xyz"


def _exp(one: str, two: str, i: int, j: int) -> str:
    """An entry of I + one * K + two * K^2 for the rotation vector (fx, fy, fz)."""
    square = f"f{_AX[i - 1]} * f{_AX[j - 1]}" + (" - a2" if i == j else "")
    return f"({1 if i == j else 0} + {one} * ({_K.get((i, j), '0')}) + {two} * ({square}))"


_SERIES = """CASE WHEN sqrt(a2) < 1e-6 THEN 1 - a2 / 6 ELSE sin(sqrt(a2)) / sqrt(a2) END AS s, CASE WHEN sqrt(a2) < 1e-6 THEN 0.5 - a2 / 24 ELSE (1 - cos(sqrt(a2))) / a2 END AS b,
 CASE WHEN sqrt(a2) < 1e-6 THEN 1.0 / 6 - a2 / 120 ELSE (sqrt(a2) - sin(sqrt(a2))) / (a2 * sqrt(a2)) END AS g"""
_TW = """tw AS (SELECT *, row_number() OVER o AS n, coalesce(lag(t_ns) OVER o, t_ns) AS prev_ns FROM (SELECT t_ns, CAST(floor(t_ns / 86400000000000.0) AS BIGINT) AS day, vx / 1000 AS vx, 0.0001::DOUBLE AS vy, 0.0::DOUBLE AS vz,
 wz * 0.5 / 1000 AS wx, wz * -0.25 / 1000 AS wy, wz / 1000 AS wz FROM twist_ev) WINDOW o AS (PARTITION BY day ORDER BY t_ns)),
q0 AS (SELECT *, wx * (t_ns - prev_ns) / 1e9 AS fx, wy * (t_ns - prev_ns) / 1e9 AS fy, wz * (t_ns - prev_ns) / 1e9 AS fz, vx * (t_ns - prev_ns) / 1e9 AS rx, vy * (t_ns - prev_ns) / 1e9 AS ry, vz * (t_ns - prev_ns) / 1e9 AS rz FROM tw),
q1 AS (SELECT *, """ + _SERIES + """ FROM (SELECT *, fx * fx + fy * fy + fz * fz AS a2 FROM q0)),
q2 AS (SELECT *, """ + ", ".join(f"{_exp('s', 'b', i, j)} AS d{i}{j}" for i in _I for j in _I) + ", " + ", ".join(" + ".join(f"{_exp('b', 'g', i, j)} * r{_AX[j - 1]}" for j in _I) + f" AS e{i}" for i in _I) + """ FROM q1),
f AS (SELECT day, n, """ + ", ".join(f"d{i}{j} AS r{i}{j}" for i in _I for j in _I) + ", " + ", ".join(f"e{i} AS p{i}" for i in _I) + """ FROM q2 WHERE n = 1
 UNION ALL SELECT q2.day, q2.n, """ + ", ".join(" + ".join(f"f.r{i}{k} * d{k}{j}" for k in _I) for i in _I for j in _I) + ", " + ", ".join(f"f.p{i} + " + " + ".join(f"f.r{i}{k} * e{k}" for k in _I) for i in _I) + """ FROM f JOIN q2 ON q2.day = f.day AND q2.n = f.n + 1),
pose AS (SELECT tw.*, """ + ", ".join(f"f.r{i}{j}" for i in _I for j in _I) + """, f.p1, f.p2, f.p3 FROM tw JOIN f USING (day, n))"""


@query("w04_integrate_3d", f"WITH {_TW} SELECT day, t_ns, R4(p1) AS px, R4(p2) AS py, R4(p3) AS pz, R4(r11) AS r11, R4(r33) AS r33 FROM pose", recursive=True)
def w04(v):
    return integrate_3d(_twists(v), "day", HALF_DAY, ("event_id",)).select("day", "t_ns", *(out4(k).alias(k) for k in ("px", "py", "pz", "r11", "r33")))


@query("w06_undistort_3d", f"""WITH {_TW}, pts AS (SELECT event_id, t_ns, value AS x, event_id % 17 - 8.0::DOUBLE AS y, event_id % 5 - 2.0::DOUBLE AS z FROM stream_ev),
met AS (SELECT p.*, coalesce(q.t_ns, (SELECT max(t_ns) FROM tw)) AS twist_ns FROM pts p ASOF LEFT JOIN tw q ON p.t_ns <= q.t_ns),
m0 AS (SELECT m.event_id, m.x, m.y, m.z, greatest(0.0, (m.t_ns - q.prev_ns) / 1e9) AS dt, q.day, q.n, q.vx, q.vy, q.vz, q.wx, q.wy, q.wz FROM met m JOIN tw q ON q.t_ns = m.twist_ns),
m1 AS (SELECT *, {_SERIES} FROM (SELECT *, fx * fx + fy * fy + fz * fz AS a2 FROM (SELECT *, wx * dt AS fx, wy * dt AS fy, wz * dt AS fz FROM m0))),
m2 AS (SELECT *, {', '.join(' + '.join(f"{_exp('s', 'b', i, j)} * {_AX[j - 1]} + {_exp('b', 'g', i, j)} * v{_AX[j - 1]} * dt" for j in _I) + f' AS l{i}' for i in _I)} FROM m1),
m3 AS (SELECT m2.event_id, l1, l2, l3, {', '.join(f'coalesce(o.r{i}{j}, {1 if i == j else 0}) AS r{i}{j}' for i in _I for j in _I)}, {', '.join(f'coalesce(o.p{i}, 0) AS p{i}' for i in _I)} FROM m2 LEFT JOIN pose o ON o.day = m2.day AND o.n = m2.n - 1)
SELECT event_id, {', '.join(f"R4(r{i}1 * l1 + r{i}2 * l2 + r{i}3 * l3 + p{i}) AS u{_AX[i - 1]}" for i in _I)} FROM m3""", recursive=True)
def w06(v):
    pts = v.stream_ev().select("event_id", "t_ns", c("value").alias("x"), (c("event_id") % 17 - 8.0).alias("y"), (c("event_id") % 5 - 2.0).alias("z"))
    return undistort_3d(pts, integrate_3d(_twists(v), "day", HALF_DAY, ("event_id",)).drop("day")).select("event_id", *(out4(k).alias(k) for k in ("ux", "uy", "uz")))
