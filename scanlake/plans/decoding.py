"""Queries for packet decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions.binary import crc8_h2f, crc16, hex_be, hex_le, yuv_rgb
from scanlake.functions.geometry import c, in_arc, out4
from scanlake.operators import decode as D
from scanlake.operators.firing import BLOCKS, E3X_FAR, E3X_NEAR, E4X_TABLES, FIRING_NS, HELIOS_NS
from scanlake.plans.registry import query

_N = "CASE WHEN return_mode IN (51, 52, 55, 56) THEN 1 WHEN return_mode = 61 THEN 3 ELSE 2 END"
_WRAP = "({a} - floor({a} / (2 * pi())) * (2 * pi()))"


def packets(v):
    """packet_id, stamp_ns, data: packets of four blocks of four channels; the last of
    some orders is short."""
    u = v.blocks_li()
    unit = lambda k: F.concat(hex_le(c("raw_dist") + 100 * k, 2), hex_le((c("refl") + k) % 256, 1))
    h = u.select("packet_id", "block", F.concat(hex_le("raw_az", 2), *(unit(k) for k in range(4))).alias("h"))
    g = h.groupBy("packet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda s: s["h"]), "").alias("h"))
    return g.select("packet_id", (c("packet_id") * 100_000_000).alias("stamp_ns"), F.unhex("h").alias("data"))


_UNITS = "u4 AS (SELECT packet_id, block, k AS channel, raw_az, raw_dist + 100 * k AS raw_dist, (refl + k) % 256 AS refl, return_mode FROM blocks_li, (SELECT CAST(unnest(range(4)) AS INT) AS k) WHERE packet_id IN (SELECT packet_id FROM blocks_li WHERE block = 3))"


@query("d01_size_validation", "SELECT packet_id, CAST(14 * count(*) AS INT) AS n_bytes FROM blocks_li GROUP BY packet_id HAVING count(*) >= 4")
def d01(v):
    return D.valid_packets(packets(v), 56).select("packet_id", F.length("data").alias("n_bytes"))


@query("d02_open_packets", f"WITH {_UNITS} SELECT packet_id, block, channel, raw_az, raw_dist, refl FROM u4")
def d02(v):
    return D.open_packets(packets(v), 4, 4)


def _block_packets(v, header: int, order, words):
    """A packet of 12 blocks of 32 units for each supplier."""
    k = c("s_suppkey")

    def block(b):
        units = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda u: F.concat(order((k * 7 + b * 11 + u) * 5 % 65536, 2), order((k + b + u) % 256, 1))), "")
        return F.concat(order(F.element_at(F.array(*map(F.lit, words)), ((k + b) % len(words) + 1).cast("int")), 2), order((k * 37 + b * 20) % 36000, 2), units)

    text = F.concat(F.lit("00" * header), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), block), ""), F.lit("000000000000"))
    # A row becomes 384 units, so a file of few bytes is dealt to all cores first.
    rows = v.table("supplier").select("s_suppkey").repartition(4 * v.spark.sparkContext.defaultParallelism, "s_suppkey")
    return rows.select(k.alias("packet_id"), F.unhex(text).alias("data"))


_BLOCKS = """SELECT s_suppkey AS packet_id, CAST(b AS INT) AS block, CAST({first} + u AS INT) AS channel, CAST((s_suppkey * 37 + b * 20) % 36000 AS INT) AS raw_az, CAST((s_suppkey * 7 + b * 11 + u) * 5 % 65536 AS INT) AS raw_dist,
 CAST((s_suppkey + b + u) % 256 AS INT) AS refl FROM supplier, (SELECT unnest(range(12)) AS b), (SELECT unnest(range(32)) AS u)"""


@query("d25_robosense_blocks", _BLOCKS.format(first="0"))
def d25(v):
    """Big-endian blocks behind a header."""
    return D.open_blocks(_block_packets(v, 42, hex_be, [0xFFEE]), "Helios")


@query("d28_velodyne_blocks", _BLOCKS.format(first="(s_suppkey + b) % 2 * 32"))
def d28(v):
    """Banks of lasers by the word that a block begins with."""
    return D.open_blocks(_block_packets(v, 0, hex_le, [0xEEFF, 0xDDFF]), "VLP32")


@query("d28_velodyne_four_banks", _BLOCKS.format(first="(s_suppkey + b) % 5 * 32") + " WHERE b < 4 - s_suppkey % 5")
def d28_four(v):
    """A word that is of no bank ends its packet."""
    return D.open_blocks(_block_packets(v, 0, hex_le, [0xEEFF, 0xDDFF, 0xCCFF, 0xBBFF, 0x1234]), "VLS128")


@query("d23_model_dispatch", " UNION ALL ".join(f"SELECT '{m}' AS model, * FROM ({_BLOCKS.format(first='0')})" for m in ("VLP16", "Helios", "Bpearl")))
def d23(v):
    parts = [D.decode_units(_block_packets(v, D.LAYOUTS[m].header, hex_le if D.LAYOUTS[m].order == "<" else hex_be, [0xFFEE]), m).withColumn("model", F.lit(m)) for m in ("VLP16", "Helios", "Bpearl")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("d03_azimuth_variants", "SELECT packet_id, block, CAST(raw_az * 256 + refl AS INT) AS fine, R4((raw_az * 256 + refl) / 25600.0) AS fine_deg FROM units_li")
def d03(v):
    return v.units_li().select("packet_id", "block", D.fine_azimuth("raw_az", "refl").alias("fine"), out4(D.fine_azimuth("raw_az", "refl") / 25600.0).alias("fine_deg"))


@query("d04_packet_time", "SELECT o_orderkey, epoch_us(make_timestamp(1900 + 120 + o_orderkey % 10, 1 + o_orderkey % 12, 1 + o_orderkey % 28, o_orderkey % 24, o_orderkey % 60, CAST(o_orderkey % 59 AS DOUBLE))) * 1000 + o_orderkey % 1000000 * 1000 AS t_ns FROM orders")
def d04(v):
    k = c("o_orderkey")
    i = lambda x: x.cast("int")
    return v.table("orders").select("o_orderkey", D.packet_time(i(120 + k % 10), i(1 + k % 12), i(1 + k % 28), k % 24, k % 60, k % 59, k % 1000000).alias("t_ns"))


@query("d05_distance_unit", "SELECT packet_id, block, R4(raw_dist * CASE WHEN packet_id % 2 = 0 THEN 0.005 ELSE 0.0025 END) AS distance FROM units_li")
def d05(v):
    return v.units_li().select("packet_id", "block", out4(c("raw_dist") * D.robosense_unit(c("packet_id") % 2)).alias("distance"))


@query("d06_n_returns", f"SELECT packet_id, block, {_N} AS n_returns FROM units_li")
def d06(v):
    return v.units_li().join(F.broadcast(D.return_modes(v.spark)), "return_mode").select("packet_id", "block", "n_returns")


@query("d07_range_gate", "SELECT packet_id, block, R4(raw_dist * 0.004) AS distance FROM units_li WHERE raw_dist > 0 AND raw_dist * 0.004::DOUBLE BETWEEN 0.3 AND 200.0 AND raw_dist * 0.004::DOUBLE BETWEEN 5.0 AND 60.0")
def d07(v):
    return D.range_gate(v.units_li(), 0.004, 0.3, 200.0, 5.0, 60.0).select("packet_id", "block", out4("distance").alias("distance"))


_GROUPS = f"""{_UNITS}, r AS (SELECT *, {_N} AS n FROM u4), g AS (SELECT *, block // n AS group_no, block % n AS o FROM r),
w AS (SELECT *, max(refl) OVER p AS top, count(*) OVER (PARTITION BY packet_id, group_no, channel, raw_dist, refl) AS same FROM g WINDOW p AS (PARTITION BY packet_id, group_no, channel)),
k AS (SELECT *, CASE WHEN same > 1 THEN 'IDENTICAL' WHEN return_mode = 51 THEN 'FIRST' WHEN return_mode = 55 THEN 'STRONGEST' WHEN return_mode = 56 THEN 'LAST'
 WHEN return_mode = 57 THEN CASE WHEN refl = top THEN CASE WHEN o = 0 THEN 'LAST_STRONGEST' ELSE 'STRONGEST' END WHEN o = 0 THEN 'LAST' ELSE 'SECONDSTRONGEST' END
 WHEN return_mode = 59 THEN CASE WHEN o = 0 THEN 'FIRST' ELSE 'LAST' END
 WHEN return_mode = 60 THEN CASE WHEN refl = top THEN CASE WHEN o = 0 THEN 'FIRST_STRONGEST' ELSE 'STRONGEST' END WHEN o = 0 THEN 'FIRST' ELSE 'SECONDSTRONGEST' END END AS kind FROM w)"""


def _returns(v):
    modes = v.blocks_li().groupBy("packet_id").agg(F.min("return_mode").alias("return_mode")).join(F.broadcast(D.return_modes(v.spark)), "return_mode")
    return D.classify_returns(D.return_groups(D.open_packets(packets(v), 4, 4).join(modes, "packet_id")))


@query("d08_return_type", f"WITH {_GROUPS} SELECT packet_id, block, channel, kind FROM k")
def d08(v):
    return _returns(v).select("packet_id", "block", "channel", "kind")


@query("d09_first_last_flip", f"WITH {_GROUPS} SELECT packet_id, block, channel, CASE WHEN return_mode = 59 AND kind = 'FIRST' THEN 'LAST' WHEN return_mode = 59 AND kind = 'LAST' THEN 'FIRST' ELSE kind END AS kind FROM k")
def d09(v):
    return _returns(v).select("packet_id", "block", "channel", D.flip_first_last("kind", "return_mode", "PandarXT32").alias("kind"))


@query("d10_d11_dual_filter", f"""WITH {_GROUPS} SELECT a.packet_id, a.block, a.channel FROM k a WHERE o = n - 1 OR (same = 1 AND NOT EXISTS (
 SELECT 1 FROM k b WHERE b.packet_id = a.packet_id AND b.group_no = a.group_no AND b.channel = a.channel AND b.block <> a.block AND abs(b.raw_dist - a.raw_dist) < 3000))""")
def d10(v):
    return D.drop_repeated_returns(_returns(v), 3000).select("packet_id", "block", "channel")


_AZ = "radians(raw_az / 100.0::DOUBLE + azim_off_deg)"
_POLAR = f"pol AS (SELECT packet_id, block, channel, raw_az, raw_dist * 0.004::DOUBLE AS d, {_WRAP.format(a=_AZ)} AS az, radians(elev_deg) AS el FROM units_li JOIN calib USING (channel))"


def _polar(v):
    u = D.correct_angles(v.units_li(), v.calib(), 100)
    return u.withColumn("distance", c("raw_dist") * 0.004)


@query("d12_angle_correction", f"WITH {_POLAR} SELECT packet_id, block, R4(az) AS azimuth, R4(el) AS elevation FROM pol")
def d12(v):
    return _polar(v).select("packet_id", "block", out4("azimuth").alias("azimuth"), out4("elevation").alias("elevation"))


@query("d13_mirror_correction", """WITH f AS (SELECT * FROM (VALUES (0, 0, 3072000), (1, 3072000, 6144000), (2, 6144000, 9216000)) t(field, start, stop)),
u AS (SELECT packet_id, block, channel, raw_az * 256 AS a FROM units_li), m AS (SELECT *, a / 25600.0 / 2 AS pos FROM u JOIN f ON a >= start AND a < stop),
k AS (SELECT *, floor(pos) AS low, pos - floor(pos) AS part FROM m), z AS (SELECT *, (a - start) * 2.0 / 25600 - channel / 10.0 + (((channel + low) % 7 - 3) * (1 - part) + ((channel + low + 1) % 7 - 3) * part) / 100.0 AS w FROM k)
SELECT packet_id, block, field, R4(w - floor(w / 360) * 360) AS azimuth_deg, CAST(channel - 16 AS DOUBLE) AS elevation_deg FROM z""")
def d13(v):
    s = v.spark
    frames = s.createDataFrame([(0, 0, 3_072_000), (1, 3_072_000, 6_144_000), (2, 6_144_000, 9_216_000)], "field int, start int, stop int")
    channels = s.range(32).select(c("id").cast("int").alias("channel"), (c("id") / 10.0).alias("azimuth"), (c("id") - 16.0).alias("elevation"))
    grid = s.range(32 * 182).select((c("id") % 32).cast("int").alias("channel"), F.expr("cast(id div 32 as int)").alias("step"))
    grid = grid.withColumn("adjust", (c("channel") + c("step")) % 7 - 3)
    u = v.units_li().select("packet_id", "block", "channel", (c("raw_az") * 256).alias("raw_az"))
    return D.correct_angles_by_mirror(u, frames, grid, channels).select("packet_id", "block", "field", out4("azimuth_deg").alias("azimuth_deg"), "elevation_deg")


@query("d14_cartesian_hesai", f"WITH {_POLAR} SELECT packet_id, block, R4(d * cos(el) * sin(az)) AS x, R4(d * cos(el) * cos(az)) AS y, R4(d * sin(el)) AS z FROM pol")
def d14(v):
    return D.polar_to_cartesian(_polar(v)).select("packet_id", "block", *(out4(a).alias(a) for a in "xyz"))


@query("d15_cartesian_robosense", f"WITH {_POLAR} SELECT packet_id, block, R4(d * cos(el) * cos(az)) AS x, R4(-d * cos(el) * sin(az)) AS y, R4(d * sin(el)) AS z FROM pol")
def d15(v):
    return D.polar_to_cartesian(_polar(v), "robosense").select("packet_id", "block", *(out4(a).alias(a) for a in "xyz"))


@query("d16_fov_gate", "SELECT packet_id, block FROM units_li WHERE raw_az / 100.0::DOUBLE <= 90 OR 270 <= raw_az / 100.0::DOUBLE")
def d16(v):
    return v.units_li().filter(in_arc(c("raw_az") / 100.0, 270.0, 90.0)).select("packet_id", "block")


_OFF = {
    "PandarXT32": "5632 - 50000 * ((7 - block) // n) + 368 + 1512 * channel", "PandarXT16": "5632 - 50000 * ((7 - block) // n) + 368 + 3024 * channel",
    "Pandar40P": "-28580 - 55560 * ((9 - block) // n)", "Pandar64": "-42580 - 55560 * ((5 - block) // n)", "PandarQT64": "25710 + 500000 * (block // n) // 3",
    "PandarXT32M": "5632 - 50000 * ((7 - block) // n) + 368 + 2888 * (channel % 16)", "PandarAT128": "-9249 - 41666 * (CASE WHEN n = 1 THEN 2 - block ELSE 1 END)",
}


def _fired(model: str) -> str:
    return f"[{', '.join(map(str, FIRING_NS[model]))}][channel + 1]" if model in FIRING_NS else "0"


def _channels(model: str) -> int:
    return len(FIRING_NS.get(model, range(32)))


# Blocks of each model's own packets; channels are spread over all that the model has.
_D18 = """SELECT '{m}' AS model, packet_id, block, channel, CAST({e} + {f} AS BIGINT) AS offset_ns FROM
 (SELECT packet_id, block, CAST((channel * 5 + block * 32 + packet_id) % {n_ch} AS INT) AS channel, {n} AS n FROM (SELECT packet_id, channel, return_mode, block % {blocks} AS block FROM units_li))"""


@query("d18_time_offsets", " UNION ALL ".join(_D18.format(m=m, e=e, f=_fired(m), n_ch=_channels(m), n=_N, blocks=BLOCKS[m]) for m, e in _OFF.items()))
def d18(v):
    u = v.units_li().join(F.broadcast(D.return_modes(v.spark)), "return_mode")
    out = None
    for m in _OFF:
        own = u.withColumn("block", (c("block") % BLOCKS[m]).cast("int")).withColumn("channel", ((c("channel") * 5 + c("block") * 32 + c("packet_id")) % _channels(m)).cast("int"))
        own = own.select(F.lit(m).alias("model"), "packet_id", "block", "channel", (D.block_offset_ns(m, "block", "n_returns") + D.channel_offset_ns(m, "channel")).alias("offset_ns"))
        out = own if out is None else out.unionByName(own)
    return out


@query("d17_point_time", f"SELECT packet_id, block, CAST(((t % 4294967296) + 4294967296) % 4294967296 AS BIGINT) AS t_ns FROM (SELECT packet_id, block, packet_id * 1000000 - (packet_id // 16) * 16000000 + {_OFF['PandarXT32']} AS t FROM (SELECT *, {_N} AS n FROM units_li WHERE block < 8))")
def d17(v):
    u = v.units_li().filter("block < 8").join(F.broadcast(D.return_modes(v.spark)), "return_mode")
    u = u.withColumns({"stamp_ns": c("packet_id") * 1_000_000, "scan_ns": F.expr("(packet_id div 16) * 16000000")})
    return D.point_time(u, "PandarXT32").select("packet_id", "block", "t_ns")


# Slots of a cycle in which the 128E3X's channels fire, and their times by state.
_E3X_SLOTS = sorted(set(E3X_FAR))
_E3X_STATES = {
    "hs0": (776, 2431, 4436, 6441, 12666, 17236, 19521, 21806, -1, -1, -1, -1, 8096, 10381, 14951, 24091),
    "hs1": (-1, -1, -1, -1, 13016, 17586, 19871, 22156, 776, 2781, 4786, 6441, 8446, 10731, 15301, 24441),
    "hs2": (776, 2781, 4436, 6091, 12666, 17236, 19521, 21806, -1, -1, -1, -1, 8096, 10381, 14951, 24091),
    "hs3": (-1, -1, -1, -1, 12316, 16886, 19171, 21456, 776, 2431, 4086, 6091, 7746, 10031, 14601, 23741),
    "ss0": (776, 2431, 4436, 6441, 12666, 17236, 19521, 21806, 28554, 30559, 32564, 34219, 36224, 38509, 43079, 52219),
    "ss1": (776, 2781, 4436, 6091, 12666, 17236, 19521, 21806, 28554, 30209, 31864, 33869, 35524, 37809, 42379, 51519),
}
_E3X_CLOSE = {
    "hs0": {0: 5201, 2: 1541, 17: 7206, 20: 3196, 39: 27056, 74: 23201, 89: 3676, 104: 5681}, "hs1": {5: 4026, 8: 7206, 14: 3546, 25: 12126, 46: 27406, 101: 2021, 110: 7686, 119: 1541},
    "hs2": {11: 7336, 32: 14061, 53: 27056, 92: 6856, 95: 2021, 98: 3546, 113: 5201, 125: 1541}, "hs3": {23: 4851, 60: 26706, 67: 11426, 81: 25136, 107: 5331, 116: 3196, 122: 6856, 127: 1541},
    "ss0": E3X_NEAR[0], "ss1": E3X_NEAR[1],
}
_ROW = "SELECT packet_id, block % 2 AS block, CAST((channel * 5 + block * 32 + packet_id) % 128 AS INT) AS channel, raw_dist * 0.004 AS distance, packet_id % 2 AS mode, CASE WHEN packet_id % 2 = 0 THEN (packet_id * 7919 + block) % 65536 ELSE (packet_id * 7919 + block) & 21845 END AS bits, {n} AS n FROM units_li"


def _e3x_sql() -> str:
    slot = f"[{', '.join(str(_E3X_SLOTS.index(t) + 1) for t in E3X_FAR)}][channel + 1]"
    far = " ".join(f"WHEN '{k}' THEN [{', '.join(map(str, t))}][{slot}]" for k, t in _E3X_STATES.items())
    near = " ".join(f"WHEN '{k}' THEN CASE channel {' '.join(f'WHEN {ch} THEN {t}' for ch, t in t.items())} ELSE -1 END" for k, t in _E3X_CLOSE.items())
    return f"""SELECT 'Pandar128E3X' AS model, packet_id, block, channel, CAST(3148 - 55556 * (1 - block) // n + CASE WHEN distance <= 2.85 THEN CASE st {near} END WHEN st = 'hs2' AND channel = 6 THEN -185 ELSE CASE st {far} END END AS BIGINT) AS offset_ns
 FROM (SELECT *, CASE WHEN mode = 0 THEN 'hs' ELSE 'ss' END || (bits >> CAST(14 - 2 * block AS INT)) % 4 AS st FROM rows)"""


def _e4x_sql() -> str:
    lists = [f"[{', '.join(map(str, t))}][channel + 1]" for t in E4X_TABLES]
    return f"""SELECT 'Pandar128E4X', packet_id, block, channel, CAST(43346 - CASE WHEN n = 1 THEN 55556 * (1 - block) ELSE 0 END + CASE WHEN mode <> 0 THEN {lists[0]}
 WHEN (bits >> CAST(14 - 2 * block AS INT)) % 4 = 0 THEN {lists[1]} ELSE {lists[2]} END AS BIGINT) FROM rows"""


_LOOP = "CASE (CASE WHEN n = 1 THEN block ELSE 1 - mode END) WHEN 0 THEN CASE channel // 32 WHEN 1 THEN [27656, 53000, 2312, 78344] WHEN 2 THEN [1456, 77488, 26800, 52144] WHEN 3 THEN [25944, 51288, 600, 76632] END ELSE CASE channel // 32 WHEN 0 THEN [2312, 78344, 27656, 53000] WHEN 2 THEN [600, 76632, 25944, 51288] WHEN 3 THEN [26800, 52144, 1456, 77488] END END"
_QT128 = f"SELECT 'PandarQT128', packet_id, block, channel, CAST(9000 + 111110 * (1 - block) // n + coalesce(({_LOOP})[CASE WHEN channel // 4 % 2 = 0 THEN channel % 4 + 1 ELSE 4 - channel % 4 END] + 3168 * (channel % 32 // 4), 0) AS BIGINT) FROM rows"


@query("d18_offsets_by_state", f"WITH rows AS ({_ROW.format(n=_N)}) {_e3x_sql()} UNION ALL {_e4x_sql()} UNION ALL {_QT128}")
def d18_by_state(v):
    """Times of models that fire by the state their packets tell. Standard mode has the
    azimuth states 0 and 1 only."""
    u = v.units_li().join(F.broadcast(D.return_modes(v.spark)), "return_mode").withColumns({
        "channel": ((c("channel") * 5 + c("block") * 32 + c("packet_id")) % 128).cast("int"), "azimuth_state": F.when(c("packet_id") % 2 == 0, (c("packet_id") * 7919 + c("block")) % 65536).otherwise((c("packet_id") * 7919 + c("block")).bitwiseAND(F.lit(0x5555))),
        "operational_state": c("packet_id") % 2, "mode_flag": c("packet_id") % 2, "distance": c("raw_dist") * 0.004,
    }).withColumn("block", c("block") % 2)
    out = None
    for m in ("Pandar128E3X", "Pandar128E4X", "PandarQT128"):
        own = u.select(F.lit(m).alias("model"), "packet_id", "block", "channel", (D.block_offset_ns(m, "block", "n_returns") + D.channel_offset_ns(m, "channel")).alias("offset_ns"))
        out = own if out is None else out.unionByName(own)
    return out


_SHOT = "(CASE WHEN n = 2 THEN block // 2 ELSE block END)"
_TRADED = f"CASE WHEN n = 2 THEN channel WHEN channel IN (17, 18) THEN 35 - channel WHEN channel IN (21, 22) AND {_SHOT} > 0 THEN 43 - channel ELSE channel END"


@query("d18_robosense_offsets", f"""WITH rows AS (SELECT packet_id, block, channel, CASE WHEN {_N} = 2 THEN 2 ELSE 1 END AS n FROM units_li)
SELECT 'Helios' AS model, packet_id, block, channel, CAST(round(({_SHOT} * 500000 / 9.0::DOUBLE + [{', '.join(map(str, HELIOS_NS))}][{_TRADED} + 1]) / 10) * 10 AS BIGINT) AS offset_ns FROM rows
UNION ALL SELECT 'Bpearl', packet_id, block, channel, CAST(5555 * {_SHOT} + round(166.8::DOUBLE * channel) AS BIGINT) FROM rows""")
def d18_robosense(v):
    u = v.units_li().join(F.broadcast(D.return_modes(v.spark)), "return_mode")
    parts = [u.select(F.lit(m).alias("model"), "packet_id", "block", "channel", (D.block_offset_ns(m, "block", "n_returns") + D.channel_offset_ns(m, "channel")).alias("offset_ns")) for m in ("Helios", "Bpearl")]
    return parts[0].unionByName(parts[1])


@query("d19_earliest_offset", f"SELECT packet_id, CAST(min({_OFF['PandarXT32']}) AS BIGINT) AS earliest_ns FROM (SELECT *, {_N} AS n FROM units_li) WHERE block < n GROUP BY packet_id")
def d19(v):
    return D.earliest_offset("PandarXT32", v.units_li().join(F.broadcast(D.return_modes(v.spark)), "return_mode"))


_MASK = """mask AS (SELECT x, y, (x * 7 + y * 13) % 256 AS grey FROM (SELECT CAST(unnest(range(36)) AS INT) AS x), (SELECT CAST(unnest(range(32)) AS INT) AS y)),
kept AS (SELECT x, y, k > 0 AND len(list_filter(range(k), lambda i: CAST(round(10.0 * i / k) AS INT) = (x + y) % 10)) > 0 AS keep FROM (SELECT *, CAST(round(grey * 10 / 255.0) AS INT) AS k FROM mask))"""


def _mask(v):
    m = v.spark.range(36 * 32).select((c("id") % 36).cast("int").alias("x"), F.expr("cast(id div 36 as int)").alias("y"))
    return D.dither(m.withColumn("grey", (c("x") * 7 + c("y") * 13) % 256))


@query("d20_dither_mask", f"WITH {_MASK} SELECT x, y, keep FROM kept")
def d20(v):
    return _mask(v).select("x", "y", "keep")


@query("d21_tile_dither", """SELECT packet_id, block, x, y, k > 0 AND len(list_filter(range(k), lambda i: CAST(round(10.0 * i / k) AS INT) = (x // 2 * 2 + y // 4 * 4 + y % 2) % 10)) > 0 AS keep
 FROM (SELECT packet_id, block, raw_az // 100 AS x, channel AS y, CAST(round(refl * 10 / 255.0) AS INT) AS k FROM units_li)""")
def d21(v):
    """Units thinned by their reflectivity, in tiles of two columns by four channels."""
    u = v.units_li().select("packet_id", "block", F.floor(c("raw_az") / 100).cast("int").alias("x"), c("channel").alias("y"), c("refl").alias("grey"))
    return D.dither(u, place=D.tile_place("x", "y")).select("packet_id", "block", "x", "y", "keep")


@query("d22_mask_filter", f"WITH {_MASK} SELECT packet_id, block FROM units_li u JOIN kept k ON keep AND k.x = CAST(round(raw_az / 36000.0::DOUBLE * 36) AS INT) AND k.y = u.channel")
def d22(v):
    u = v.units_li().withColumn("azimuth", c("raw_az") / 36000.0)
    return D.mask_filter(u, _mask(v), 36, 0.0, 1.0).select("packet_id", "block")


@query("d24_sensor_specs", "SELECT * FROM (VALUES " + ", ".join(f"('{s.model}', {s.n_blocks}, {s.n_channels}, {s.max_returns}, {s.azimuth_steps}, {s.min_range}::DOUBLE, {s.max_range}::DOUBLE, {s.max_points})" for s in D.SPECS.values()) + ") v(model, n_blocks, n_channels, max_returns, azimuth_steps, min_range, max_range, max_points)")
def d24(v):
    return D.sensor_specs(v.spark)


@query("d26_robosense_return_type", f"SELECT packet_id, block, CASE WHEN n = 2 THEN CASE WHEN block % n = 0 THEN 'STRONGEST' ELSE 'LAST' END ELSE 'FIRST' END AS kind FROM (SELECT *, {_N} AS n FROM units_li)")
def d26(v):
    u = D.return_groups(v.units_li().join(F.broadcast(D.return_modes(v.spark)), "return_mode"))
    return u.select("packet_id", "block", D.robosense_return_type("n_returns", "offset", F.lit("FIRST")).alias("kind"))


@query("d27_robosense_info", "SELECT s_suppkey AS packet_id, round(((s_suppkey * 7) % 4096) / 4096.0::DOUBLE * 5 + 1e-9, 4) AS bot_5v, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END * ((s_suppkey * 3) % 9000) / 100.0::DOUBLE AS elev_deg FROM supplier")
def d27(v):

    k = c("s_suppkey")
    data = F.unhex(F.concat(hex_be(k % 4096, 2), hex_be(k * 7 % 4096, 2), hex_be(k * 11 % 4096, 2), hex_be(k * 13 % 4096, 2), hex_be(F.when(k % 2 == 0, 0).otherwise(1), 1), hex_be(k * 3 % 9000, 2)))
    p = v.table("supplier").select(k.alias("packet_id"), data.alias("data"))
    info = D.robosense_info(p).select("packet_id", out4(c("info")["bot_5v"].cast("double")).alias("bot_5v"))
    return info.join(D.robosense_calibration(p, 1, 8).drop("channel"), "packet_id")


@query("d29_velodyne_azimuth", """WITH b AS (SELECT packet_id, block, (raw_az + block * (17 + packet_id % 5)) % 36000 AS raw_az, channel AS laser FROM units_li),
s AS (SELECT *, ((36000 + lead(raw_az) OVER w - raw_az) % 36000 + 36000) % 36000 AS d FROM b WINDOW w AS (PARTITION BY packet_id ORDER BY block)),
f AS (SELECT *, coalesce(d, last_value(d IGNORE NULLS) OVER (PARTITION BY packet_id ORDER BY block ROWS UNBOUNDED PRECEDING), 0) AS diff FROM s), z AS (SELECT *, raw_az + diff * 2.304 / 55.296 * laser - degrees(0.01) * 100 AS a FROM f)
SELECT packet_id, block, CAST(diff AS BIGINT) AS diff, R4(a - floor(a / 36000.0) * 36000.0) AS azimuth FROM z""")
def d29(v):
    b = v.units_li().select("packet_id", "block", ((c("raw_az") + c("block") * (17 + c("packet_id") % 5)) % 36000).alias("raw_az"), c("channel").alias("laser"))
    u = D.velodyne_azimuth(D.velodyne_azimuth_step(b).withColumn("rot_corr", F.lit(0.01)))
    return u.select("packet_id", "block", c("diff").cast("long").alias("diff"), out4("azimuth").alias("azimuth"))


@query("d31_velodyne_xyz", """WITH u AS (SELECT packet_id, block, radians(raw_az / 100.0::DOUBLE) AS a, raw_dist * 0.004 + 0.02 AS d, radians(channel - 16.0) AS e, 0.02 AS c0, 0.03 AS c1, 0.01 AS c2, 0.2 AS vo, 0.05 AS ho FROM units_li),
w AS (SELECT *, d * cos(e) - vo * sin(e) AS fl FROM u), x0 AS (SELECT *, abs(fl * sin(a) - ho * cos(a)) AS xx, abs(fl * cos(a) + ho * sin(a)) AS yy FROM w),
q AS (SELECT *, (c0 - c1) * (xx - 2.4) / (25.04 - 2.4) + c1 - c0 AS cx, (c0 - c2) * (yy - 1.93) / (25.04 - 1.93) + c2 - c0 AS cy FROM x0)
SELECT packet_id, block, R4(((d + cy) * cos(e) - vo * sin(e)) * cos(a) + ho * sin(a)) AS x, R4(-(((d + cx) * cos(e) - vo * sin(e)) * sin(a) - ho * cos(a))) AS y, R4((d + cy) * sin(e) + vo * cos(e)) AS z FROM q""")
def d31(v):
    u = v.units_li().withColumns({"azimuth": c("raw_az").cast("double"), "distance": c("raw_dist") * 0.004, "vert": F.radians(c("channel") - 16.0), "dist_corr": F.lit(0.02), "dist_corr_x": F.lit(0.03), "dist_corr_y": F.lit(0.01), "vert_off": F.lit(0.2), "horiz_off": F.lit(0.05)})
    return D.velodyne_xyz(u).select("packet_id", "block", *(out4(a).alias(a) for a in "xyz"))


@query("d32_velodyne_intensity", """SELECT packet_id, block, R4(greatest(40.0, least(200.0, refl + 1.4 * abs(256 * power(1 - 1000.0 / 13100, 2) - 256 * power(1 - raw_dist * 0.004 * 500 / 65535, 2))))) AS intensity FROM units_li""")
def d32(v):
    i = D.velodyne_intensity("refl", c("raw_dist") * 0.004, F.lit(1000.0), F.lit(1.4), F.lit(40.0), F.lit(200.0))
    return v.units_li().select("packet_id", "block", out4(i).alias("intensity"))


@query("d33_velodyne_timing", "SELECT packet_id, block, R4((block // 2) * 55.296 + (channel // 2) * 2.304) AS t_us FROM units_li")
def d33(v):
    return v.units_li().select("packet_id", "block", out4(D.velodyne_time_us("block", "channel", dual=True)).alias("t_us"))


@query("d34_velodyne_dual", """WITH u AS (SELECT packet_id, block, raw_dist % 8 AS d, refl % 4 AS i FROM units_li), p AS (SELECT *, count(*) OVER w AS n, sum(d) OVER w - d AS od, sum(i) OVER w - i AS oi FROM u WINDOW w AS (PARTITION BY packet_id, block // 2))
SELECT packet_id, block, CASE WHEN n < 2 THEN 'STRONGEST' WHEN od = d AND oi = i THEN 'IDENTICAL' WHEN d < od AND i > oi THEN 'FIRST_STRONGEST' WHEN d < od THEN 'FIRST_WEAK' WHEN i > oi THEN 'LAST_STRONGEST' ELSE 'LAST_WEAK' END AS kind FROM p WHERE NOT (n = 2 AND od = d AND oi = i AND block % 2 = 1)""")
def d34(v):
    u = v.units_li().select("packet_id", "block", F.lit(0).alias("laser"), (c("raw_dist") % 8).alias("raw_dist"), (c("refl") % 4).alias("refl"))
    return D.velodyne_dual(u).select("packet_id", "block", "kind")


@query("d35_velodyne_gate", "SELECT packet_id, block FROM units_li WHERE raw_az >= 30000 OR raw_az <= 6000")
def d35(v):
    return v.units_li().filter(in_arc("raw_az", 30000, 6000)).select("packet_id", "block")


@query("d37_return_mode_names", "SELECT packet_id, CASE min(return_mode) WHEN 51 THEN 'SingleFirst' WHEN 55 THEN 'SingleStrongest' WHEN 56 THEN 'SingleLast' WHEN 57 THEN 'LastStrongest' WHEN 59 THEN 'LastFirst' WHEN 60 THEN 'FirstStrongest' END AS mode FROM units_li GROUP BY packet_id")
def d37(v):
    m = v.units_li().groupBy("packet_id").agg(F.min("return_mode").alias("return_mode"))
    return m.join(F.broadcast(D.return_modes(v.spark)), "return_mode").select("packet_id", "mode")


def _crc_sql(width: int, polynomial: int, start: int, xor: int) -> str:
    """Bit by bit: the state moves up by one, and takes the polynomial if the bit that
    leaves differs from the text's."""
    bits = "flatten([[(ord(substr(t, CAST(i AS INT), 1)) >> CAST(7 - j AS INT)) & 1 FOR j IN range(8)] FOR i IN range(1, length(t) + 1)])"
    step = f"xor((s << 1) & {(1 << width) - 1}, CASE WHEN xor((s >> {width - 1}) & 1, x) = 1 THEN {polynomial} ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(CAST({start} AS BIGINT), CAST({bits} AS BIGINT[])), lambda s, x: {step}), {xor})"


@query("fn_checksums", f"SELECT o_orderkey, {_crc_sql(16, 0x1021, 0xFFFF, 0)} AS crc16, {_crc_sql(8, 0x2F, 0xFF, 0xFF)} AS crc8 FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS t FROM orders)")
def fn_checksums(v):
    """CRC-16 and CRC-8 of order keys' decimal text."""
    t = v.table("orders").select("o_orderkey", F.col("o_orderkey").cast("string").cast("binary").alias("b"))
    return t.select("o_orderkey", crc16("b").alias("crc16"), crc8_h2f("b").alias("crc8"))


@query("fn_colour", """SELECT p_partkey, greatest(0, least(255, y + ((v * 37221) >> 15))) AS r, greatest(0, least(255, y - ((u * 12975 + v * 18949) >> 15))) AS g, greatest(0, least(255, y + ((u * 66883) >> 15))) AS b
FROM (SELECT p_partkey, p_partkey % 256 AS y, p_partkey * 7 % 256 - 128 AS u, p_partkey * 13 % 256 - 128 AS v FROM part)""")
def fn_colour(v):
    k = c("p_partkey")
    r, g, b = yuv_rgb(k % 256, k * 7 % 256, k * 13 % 256)
    return v.table("part").select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


