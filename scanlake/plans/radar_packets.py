"""Queries for radar payloads: written as bytes, read back as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions.binary import hex_be
from scanlake.functions.geometry import c, out4
from scanlake.operators import radar_packets as R
from scanlake.operators.radar import is_corner
from scanlake.plans.registry import query

# A list per hundred orders, its entries in the order of all columns of a line. Fractions
# are of powers of two, which numbers of four bytes hold exactly.
_ORDER = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_LINES = f"SELECT *, l_orderkey // 100 AS packet_id, CAST(row_number() OVER (PARTITION BY l_orderkey // 100 ORDER BY {_ORDER}) - 1 AS INT) AS idx FROM lineitem"


def _lists(v, kind: str, **fields):
    li = v.table("lineitem").withColumn("packet_id", F.expr("l_orderkey div 100"))
    names = _ORDER.split(", ")
    entry = F.struct(*names, *(e.alias(k) for k, e in fields.items()))
    g = li.groupBy("packet_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    g = g.withColumn("entries", F.transform(F.slice("e", 1, R.MOST[kind]), lambda x: F.struct(*(x[k].alias(k) for k in fields))))
    return R.to_lists(g.select("packet_id", (c("packet_id") * 100_000_007).alias("t_ns"), "entries"), kind)


@query("r02_detection_packets", f"""SELECT packet_id, packet_id * 100000007 AS t_ns, idx, (l_partkey % 628 - 314) / 128.0::DOUBLE AS azimuth, (l_suppkey % 50 - 25) / 64.0::DOUBLE AS elevation, l_quantity * 4.0::DOUBLE AS range,
 (l_partkey % 200 - 100) / 2.0::DOUBLE AS range_rate, CAST(l_suppkey % 256 - 128 AS INT) AS rcs, CAST(l_partkey % 65536 AS INT) AS object_id, (l_partkey % 256) & 1 <> 0 AS invalid_distance, (l_partkey % 256) & 128 <> 0 AS invalid_range_rate_std FROM ({_LINES}) WHERE idx < 800""")
def r02_packets(v):
    part, supp = c("l_partkey"), c("l_suppkey")
    p = _lists(
        v, "detection", azimuth=((part % 628 - 314) / 128).cast("float"), elevation=((supp % 50 - 25) / 64).cast("float"), range=(c("l_quantity") * 4).cast("float"),
        range_rate=((part % 200 - 100) / 2).cast("float"), rcs=(supp % 256 - 128).cast("int"), object_id=(part % 65536).cast("int"), invalid_flags=(part % 256).cast("int"),
    )
    return R.detection_rows(p).select("packet_id", "t_ns", "idx", "azimuth", "elevation", "range", "range_rate", "rcs", "object_id", "invalid_distance", "invalid_range_rate_std")


@query("r03_object_packets", f"""SELECT packet_id, CAST(least(50, count(*) OVER (PARTITION BY packet_id)) AS BIGINT) AS n, idx, l_orderkey AS object_id, CAST(l_partkey % 65536 AS INT) AS age, CAST(l_suppkey % 9 AS INT) AS reference, (l_partkey % 4000 - 2000) / 4.0::DOUBLE AS x,
 (l_suppkey % 100 - 50) / 8.0::DOUBLE AS y, (l_partkey % 50 - 25) / 8.0::DOUBLE AS orientation, CAST(l_partkey % 101 AS INT) AS p_car, CAST(l_suppkey % 101 AS INT) AS p_unknown, (l_suppkey % 64) / 4.0::DOUBLE AS rel_vel_x, (l_partkey % 64) / 8.0::DOUBLE AS rel_acc_x,
 l_quantity / 4::DOUBLE AS length, l_quantity / 8::DOUBLE AS width FROM ({_LINES}) WHERE NOT (abs(degrees((packet_id % 400) / 100.0::DOUBLE - 2)) > 5 AND abs(degrees((packet_id % 400) / 100.0::DOUBLE - 2)) < 90) QUALIFY idx < 50""")
def r03_packets(v):
    """The lists of radars that look ahead; each holds at most 50 objects."""
    part, supp = c("l_partkey"), c("l_suppkey")
    p = _lists(
        v, "object", object_id=c("l_orderkey").cast("long"), age=(part % 65536).cast("int"), reference=(supp % 9).cast("int"), x=((part % 4000 - 2000) / 4).cast("float"), y=((supp % 100 - 50) / 8).cast("float"),
        orientation=((part % 50 - 25) / 8).cast("float"), p_car=(part % 101).cast("int"), p_unknown=(supp % 101).cast("int"), rel_vel_x=((supp % 64) / 4).cast("float"), rel_acc_x=((part % 64) / 8).cast("float"),
        length=(c("l_quantity") / 4).cast("float"), width=(c("l_quantity") / 8).cast("float"),
    )
    ahead = p.filter(~is_corner((c("packet_id") % 400) / 100.0 - 2))
    return R.object_rows(ahead).select("packet_id", "n", "idx", "object_id", "age", "reference", "x", "y", "orientation", "p_car", "p_unknown", "rel_vel_x", "rel_acc_x", "length", "width")


def _code(expr: str, names: dict[int, str]) -> str:
    return f"({expr}) || ':' || CASE {expr} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in names.items()) + " ELSE 'Invalid' END"


def _mask(expr: str, names: dict[int, str]) -> str:
    each = ", ".join(f"CASE WHEN ({expr}) & {1 << b} <> 0 THEN '{n}' END" for b, n in names.items())
    return f"CASE WHEN ({expr}) = 0 THEN 'Ok' ELSE array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), ', ') END"


_SYNC, _RADAR, _SLOT = {1: "SYNC_OK", 2: "NEVER_SYNC", 3: "SYNC_LOST"}, {0: "STATE_INIT", 1: "STATE_OK", 2: "STATE_INVALID"}, {0: "Low (76.23 GHz)", 1: "Mid (76.48 GHz)", 2: "High (76.73 GHz)"}
_VOLT = {0: "Current undervoltage", 1: "Past undervoltage", 2: "Current overvoltage", 3: "Past overvoltage"}
_BLOCKED, _TESTED = {0: "Blind", 1: "High", 2: "Mid", 3: "Low", 4: "None"}, {0: "Self test failed", 1: "Self test passed", 2: "Self test ongoing"}


@query("r05_status_packets", f"""SELECT o_orderkey AS packet_id, k * 1000000000 + k % 1000 AS t_ns, {_code('k % 5', _SYNC)} AS sync, {_code('k % 4', _SLOT)} AS frequency_slot, {_code('k % 3', _RADAR)} AS radar, {_mask('k % 16', _VOLT)} AS voltage,
 {_code('k % 6', _BLOCKED)} || '. ' || {_code('k % 3', _TESTED)} AS blockage, CAST(k % 1515 AS BIGINT) AS max_distance, '10.0.' || k % 256 || '.' || k * 7 % 256 AS address0, CASE WHEN k % 2 = 0 THEN 1.5::DOUBLE ELSE -0.25 END AS yaw FROM (SELECT *, CAST(o_orderkey AS BIGINT) AS k FROM orders)""")
def r05_packets(v):
    k = c("o_orderkey").cast("long")
    h = lambda e, n=1: hex_be(e, n)
    zeros = lambda n: F.lit("00" * n)
    text = F.concat(
        h(F.lit(0), 2), h(F.lit(380), 2), h(F.lit(76), 4), h(k % 1000, 4), h(k, 4), h(k % 5), zeros(3), zeros(12), F.when(k % 2 == 0, "3FC00000").otherwise("BE800000"), zeros(4), zeros(1), zeros(16),
        h(k % 1515, 2), h(k % 4), zeros(4), F.lit("0A00"), h(k % 256), h(k * 7 % 256), zeros(4), zeros(8), h(k % 3), h(k % 16), zeros(1), h(k % 6 + k % 3 * 16),
    )
    p = v.table("orders").select(c("o_orderkey").alias("packet_id"), F.lit(0).alias("service_id"), F.lit(380).alias("method_id"), F.unhex(text).alias("data"))
    return R.status_rows(p).select("packet_id", "t_ns", "sync", "frequency_slot", "radar", "voltage", "blockage", "max_distance", "address0", "yaw")


@query("r16_object_fragments", """SELECT o_orderkey AS packet_id, CAST(i AS INT) AS idx, k % 256 AS object_id, R4((k * 31 % 65535) * 0.009155553 - 300) AS dist_x, R4((k * 7 % 16383) * 0.009156391 - 75) AS v_abs_x, R4((k * 3 % 1023) * 0.019569472 - 10) AS a_abs_y,
 R4((k * 5 % 16384) * 0.001831166) AS v_abs_x_std, R4((k * 11 % 16384) * 0.001831166) AS a_abs_y_std, R4((k * 13 % 4095) * 0.007326007) AS box_length, R4((k * 17 % 4095) * 0.001534729 - 3.14159) AS orientation, R4((k * 19 % 4095) * 0.024425989 - 50) AS rcs,
 R4((k % 16) * 6.666666667) AS score, k * 23 % 65536 AS life_cycles, k % 4 AS status, k % 2 = 1 AS box_valid
 FROM (SELECT o_orderkey, i, CAST(o_orderkey * 2 + i AS BIGINT) AS k FROM orders, (SELECT unnest(range(2)) AS i)) WHERE i < 1 + o_orderkey % 2""")
def r16(v):
    """Two fragments a message; in every other message the second is filler."""
    def fragment(k):
        return R.object_fragment_hex({
            "object_id": k % 256, "dist_x": k * 31 % 65535, "v_abs_x": k * 7 % 16383, "a_abs_y": k * 3 % 1023, "v_abs_x_std": k * 5 % 16384, "a_abs_y_std": k * 11 % 16384, "box_length": k * 13 % 4095,
            "orientation": k * 17 % 4095, "rcs": k * 19 % 4095, "score": k % 16, "life_cycles": k * 23 % 65536, "status": k % 4, "box_valid": k % 2,
        })

    k = c("o_orderkey").cast("long")
    p = v.table("orders").select(k.alias("packet_id"), F.lit(0).alias("message"), (1 + k % 2).alias("n_objects"), F.unhex(F.concat(F.lit("000004B1"), fragment(k * 2), fragment(k * 2 + 1), F.lit("0000"))).alias("data"))
    floats = ("dist_x", "v_abs_x", "a_abs_y", "v_abs_x_std", "a_abs_y_std", "box_length", "orientation", "rcs", "score")
    return R.object_fragments(p).select("packet_id", c("idx").cast("int").alias("idx"), "object_id", *(out4(f).alias(f) for f in floats), "life_cycles", "status", "box_valid")
