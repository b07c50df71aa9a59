"""Queries for info packets and status payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions.binary import hex_be
from scanlake.functions.geometry import c, out4
from scanlake.operators import sensor_info as S
from scanlake.plans.registry import query


def _byte(k: str, i: int) -> str:
    """What stands at a place of a made-up packet, in SQL."""
    if i in (300, 301, 302):
        return f"(({k} + {i}) % 7)"
    if 382 <= i < 468:
        return f"(48 + ({k} + {i}) % 64)"
    if 303 <= i < 306:
        return "0"
    return f"(({k} * {i % 17 + 3} + {i}) % 256)"


def _packets(v):
    """An info packet for each supplier, by the rule of _byte()."""
    k = c("s_suppkey").cast("long").alias("packet_id")
    byte = """CASE WHEN i IN (300, 301, 302) THEN (s_suppkey + i) % 7 WHEN i BETWEEN 382 AND 467 THEN 48 + (s_suppkey + i) % 64 WHEN i BETWEEN 303 AND 305 THEN 0
     ELSE (CAST(s_suppkey AS BIGINT) * (i % 17 + 3) + i) % 256 END"""
    text = F.expr(f"array_join(transform(sequence(0, {S.INFO_BYTES - 1}), i -> lpad(hex(CAST({byte} AS BIGINT)), 2, '0')), '')")
    return v.table("supplier").select(k, F.unhex(text).alias("data"))


def _uint(at: int, size: int) -> str:
    return "(" + " + ".join(f"CAST({_byte('k', at + i)} AS BIGINT) * {1 << 8 * (size - 1 - i)}" for i in range(size)) + ")"


def _hex(at: int, size: int, between: str = "") -> str:
    return f" || '{between}' || ".join(f"lower(printf('%02x', {_byte('k', at + i)}))" for i in range(size))


def _info_sql(name: str, at: int, size: int, kind) -> list[tuple[str, str]]:
    if kind == "gps":
        return [(bit, f"CASE WHEN {_byte('k', at)} & {1 << i} <> 0 THEN '{on}' ELSE '{off}' END") for i, (bit, (off, on)) in enumerate(S.GPS_BITS.items())]
    if isinstance(kind, dict):
        sql = f"CASE {_byte('k', at)} " + " ".join(f"WHEN {code} THEN '{n}'" for code, n in kind.items()) + " ELSE 'n/a' END"
    elif isinstance(kind, tuple):
        sql = f"printf('%.6f', {_uint(at, size)} * {kind[0]!r}::DOUBLE / {kind[1]!r}::DOUBLE + {kind[2]!r}::DOUBLE)"
    elif kind == "dots":
        sql = " || '.' || ".join(_byte("k", at + i) for i in range(size))
    elif kind == "colons":
        sql = _hex(at, size, ":")
    elif kind == "hex":
        sql = _hex(at, size)
    elif kind == "hundredths":
        sql = f"printf('%.6f', CAST(CAST({_uint(at, size)} / 100.0::DOUBLE AS FLOAT) AS DOUBLE))"
    elif kind == "time":
        sql = f"CAST({_uint(at, 6)} * 1000000000 + {_uint(at + 6, 4)} * 1000 AS VARCHAR)"
    elif kind == "text":
        sql = " || ".join(f"chr(CAST({_byte('k', at + i)} AS INT))" for i in range(size))
    else:
        sql = f"CAST({_uint(at, size)} AS VARCHAR)"
    return [(name, sql)]


def _all_info(model: str) -> str:
    pairs = [p for name, place in S.INFO[model].items() for p in _info_sql(name, *place)]
    values = ", ".join(f"{{'name': '{n}', 'value': {sql}}}" for n, sql in pairs)
    return f"SELECT k AS packet_id, e.name AS name, e.value AS value FROM (SELECT k, unnest([{values}]) AS e FROM (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier))"


@query("d27_helios_info", _all_info("Helios"))
def d27_helios(v):
    """All named values of the info packets of a Helios."""
    return S.info(_packets(v), "Helios").select("packet_id", F.explode_outer("info").alias("name", "value"))


@query("d27_bpearl_info", _all_info("Bpearl"))
def d27_bpearl(v):
    """All named values of the info packets of a Bpearl."""
    return S.info(_packets(v), "Bpearl").select("packet_id", F.explode_outer("info").alias("name", "value"))


def _rounded(value: str) -> str:
    """As out4(); these expressions nest too deep for R4()."""
    return f"(round(({value}) + 1e-9, 4) + 0.0::DOUBLE)"


def _signed(at: int) -> str:
    """An angle of channel ch, whose place is no constant."""
    b = lambda i: f"((k * (({at + i} + ch * 3) % 17 + 3) + {at + i} + ch * 3) % 256)"
    return f"CASE WHEN {b(0)} = 0 THEN 1 ELSE -1 END * ({b(1)} * 256 + {b(2)}) / 100.0::DOUBLE"


@query("d27_info_calibration", f"SELECT k AS packet_id, CAST(ch AS INT) AS channel, {_rounded(_signed(468))} AS elev_deg, {_rounded(_signed(564))} AS azim_deg FROM (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier), (SELECT unnest(range(32)) AS ch)")
def d27_calibration(v):
    """The calibration that an info packet holds."""
    p = S.info_calibration(_packets(v))
    return p.select("packet_id", c("channel").cast("int").alias("channel"), out4("elev_deg").alias("elev_deg"), out4("azim_deg").alias("azim_deg"))


# A status whose masks are clear in most packets, so that each level occurs.
_STATUS = {12: "(k % 3)", 32: "(CASE WHEN k % 5 = 0 THEN k % 256 ELSE 0 END)", 33: "(CASE WHEN k % 7 = 0 THEN k % 16 ELSE 0 END)", 34: "(CASE WHEN k % 11 = 0 THEN k % 16 ELSE 0 END)",
           35: "(CASE WHEN k % 4 = 0 THEN k % 256 ELSE 0 END)", 36: "(CASE WHEN k % 13 = 0 THEN k % 4 ELSE 0 END)", 37: "(CASE WHEN k % 17 = 0 THEN k % 256 ELSE 0 END)", 38: "(CASE WHEN k % 6 = 0 THEN k % 5 ELSE 0 END)",
           39: "0", 40: "(CASE WHEN k % 9 = 0 THEN k % 256 ELSE 0 END)"}


def _at(i: int) -> str:
    return _STATUS.get(i, f"((k * {i % 13 + 2} + {i}) % 256)")


def _field(name: str) -> str:
    at, size = S.NEAR_STATUS_AT[name]
    return "(" + " + ".join(f"{_at(at + i)} * {1 << 8 * (size - 1 - i)}" for i in range(size)) + ")"


def _scaled(name: str) -> str:
    step, least = S.NEAR_STATUS_SCALE[name]
    return f"{_rounded(f'{_field(name)} * {step!r}::DOUBLE + {least!r}::DOUBLE')} AS {name}"


def _bits_sql(value: str, names) -> str:
    each = ", ".join(f"CASE WHEN ({value}) & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(names))
    return f"coalesce(nullif(array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), ', '), ''), 'Ok')"


def _valid_sql(value: str) -> str:
    return f"CASE WHEN {value} > 3 THEN 'Invalid value' ELSE {_bits_sql(value, ('Current error', 'Error this OPC'))} END"


def _status_sql() -> str:
    f = _field
    bits = f"flatten([[(b >> CAST(7 - j AS INT)) & 1 FOR j IN range(8)] FOR b IN CAST([{', '.join(_at(i) for i in range(61))}] AS BIGINT[])])"
    step = "xor((s << 1) & 65535, CASE WHEN xor((s >> 15) & 1, x) = 1 THEN 4129 ELSE 0 END)"
    crc = f"list_reduce(list_prepend(CAST(65535 AS BIGINT), CAST({bits} AS BIGINT[])), lambda s, x: {step})"
    level = f"""CASE WHEN {f('sw_error')} & 15 <> 0 OR {f('com_error')} <> 0 OR {f('ext_disturbed')} <> 0 THEN 2 WHEN {f('_dynamics0')} <> 0 OR {f('_dynamics1')} <> 0 THEN 1
 WHEN {f('sensor_off_temp')} <> 0 OR {f('supply_voltage_limit')} <> 0 OR {f('defective')} <> 0 THEN 2 WHEN {f('global_time_stamp_sync_status')} <> 1 THEN 1 ELSE 0 END"""
    columns = [f"CAST({level} AS INT) AS level", *(f"CAST({f(n)} AS BIGINT) AS {n}" for n in ("time_stamp", "global_time_stamp_sync_status", "sensor_id", "crc", "sequence_counter"))]
    columns += [_scaled(n) for n in S.NEAR_STATUS_SCALE] + [f"{_bits_sql(f(n), names)} AS {n}" for n, names in S.NEAR_STATUS_BITS.items()]
    columns += [f"{_valid_sql(f'(({f(source)} >> {shift}) & 3)')} AS {n}" for n, (source, shift) in S.DYNAMICS.items()] + [f"{_valid_sql(f('com_error'))} AS com_error", f"CAST({crc} AS BIGINT) AS crc_computed"]
    columns += [f"{f('_major')} || '.' || {f('_minor')} || '.' || {f('_patch')} AS sw_version", f"CASE WHEN {f('plug_orientation')} % 2 = 0 THEN '0:PLUG_BOTTOM' ELSE '1:PLUG_TOP' END AS plug_orientation"]
    columns += [f"CASE WHEN {f('_aln')} & 1 <> 0 THEN 'Driving conditions met' ELSE 'Driving conditions NOT met' END AS aln_status_driving",
                f"CASE WHEN {f('_aln')} & 2 <> 0 THEN 'Sensor is adjusted' ELSE 'Sensor is not adjusted' END AS aln_status_sensor", f"CAST({f('_aln')} & 4 <> 0 AS INT) AS aln_azimuth_available"]
    return f"SELECT k AS packet_id, {', '.join(columns)} FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders)"


@query("r20_near_status", _status_sql())
def r20(v):
    """Status packets of near radars, from bytes: values, names, level, checksum."""
    k = v.table("orders").select(c("o_orderkey").cast("long").alias("k"))
    text = F.concat(F.lit("00000700"), *(hex_be(F.expr(_at(i)), 1) for i in range(64)))
    rows = S.near_status(k.select(c("k").alias("packet_id"), F.unhex(text).alias("data")))
    return rows.select(
        "packet_id", "level", "time_stamp", "global_time_stamp_sync_status", "sensor_id", "crc", "sequence_counter", *(out4(n).alias(n) for n in S.NEAR_STATUS_SCALE), *S.NEAR_STATUS_BITS, *S.DYNAMICS,
        "com_error", "crc_computed", "sw_version", "plug_orientation", "aln_status_driving", "aln_status_sensor", "aln_azimuth_available",
    )
