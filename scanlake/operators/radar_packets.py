"""Radar payloads to rows.

Lists have a fixed layout, so numpy views a batch of payloads as records without a
loop over fields or entries; what the entries mean is left to column expressions.
A row of packets is one payload of at most 35 KB: more data means more rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.binary import byte_at, float_be, uint_be
from scanlake.functions.geometry import c
from scanlake.operators.radar import ARS_MESSAGES, INVALID_BITS, coded, dispatch, flag_names

_HEAD = [("service_id", ">u2"), ("method_id", ">u2"), ("length", ">u4")]
_STAMP = [("nanoseconds", ">u4"), ("seconds", ">u4"), ("sync_status", "u1")]
#: What follows the head in the lists: ids and check values of the transport.
_TRANSPORT = [("transport", "V28")]


def _floats(*names: str) -> list[tuple[str, str]]:
    return [(n, ">f4") for n in names]


# Fields of a payload in order. No padding; big-endian.
DETECTION = np.dtype(
    _floats("azimuth", "azimuth_std") + [("invalid_flags", "u1")] + _floats("elevation", "elevation_std", "range", "range_std", "range_rate", "range_rate_std")
    + [("rcs", "i1"), ("measurement_id", ">u2"), ("positive_predictive_value", "u1"), ("classification", "u1"), ("multi_target_probability", "u1"), ("object_id", ">u2"), ("ambiguity_flag", "u1"), ("sort_index", ">u2")]
)


def _motion(name: str) -> list[tuple[str, str]]:
    return [(f"{name}_invalid", "u1"), *_floats(f"{name}_x", f"{name}_x_std", f"{name}_y", f"{name}_y_std", f"{name}_cov_xy")]


OBJECT = np.dtype(
    [("status_sensor", ">u2"), ("object_id", ">u4"), ("age", ">u2"), ("status", "u1"), ("movement", "u1"), ("position_invalid", ">u2"), ("reference", "u1")]
    + _floats("x", "std_x", "y", "std_y", "z", "std_z", "cov_xy", "orientation", "orientation_std") + [("existence_invalid", "u1")] + _floats("existence_probability", "existence_ppv")
    + [(f"p_{n}", "u1") for n in ("car", "truck", "motorcycle", "bicycle", "pedestrian", "animal", "hazard", "unknown")] + [("overdrivable", "u1"), ("underdrivable", "u1")]
    + _motion("abs_vel") + _motion("rel_vel") + _motion("abs_acc") + _motion("rel_acc") + [("turn_invalid", "u1")] + _floats("turn_rate", "turn_rate_std")
    + [("length_status", ">u4"), ("length_invalid", "u1"), *_floats("length", "length_std"), ("width_status", ">u4"), ("width_invalid", "u1"), *_floats("width", "width_std")]
)
MOST = {"detection": 800, "object": 50}
_ORIGIN = [(f"origin_{a}{s}", ">f4") for a in ("x", "y", "z", "roll", "pitch", "yaw") for s in ("", "_std")]
LISTS = {
    "detection": np.dtype(
        _HEAD + _TRANSPORT + _STAMP + [("qualifier", ">u4"), ("extended", "u1"), ("origin_invalid", ">u2")] + _ORIGIN + [("list_invalid", "u1"), ("entries", DETECTION, MOST["detection"])]
        + _floats("velocity_min", "velocity_max") + [("n", ">u4")] + _floats("alignment_azimuth", "alignment_elevation") + [("alignment_status", "u1"), ("reserved", "V14")]
    ),
    "object": np.dtype(_HEAD + _TRANSPORT + _STAMP + [("qualifier", ">u4"), ("extended", "u1"), ("n", "u1"), ("entries", OBJECT, MOST["object"])]),
}

_SQL = {"f": "double", "u1": "int", "i1": "int", "u2": "int", "u4": "long"}


def _spark_type(t: np.dtype) -> str:
    return _SQL["f" if t.kind == "f" else t.str[1:]]


#: Payloads that are numbers at a time: their entries have many times a payload's bytes.
PIECE = 256


def _pieces(batches):
    for b in batches:
        for at in range(0, b.num_rows, PIECE):
            yield b.slice(at, PIECE)


def _arrow(values: np.ndarray) -> pa.Array:
    t = values.dtype
    native = np.float64 if t.kind == "f" else np.int64 if t.itemsize == 4 else np.int32
    return pa.array(values.astype(native))


def entries(packets: DataFrame, kind: str) -> DataFrame:
    """packet_id, t_ns (the sensor's), sync_status, n, idx and the fields of a row for
    each entry of the lists. `packets`: packet_id, service_id, method_id, data; what
    isn't a list of this kind is passed over, and so is a null payload. Of a list that
    claims more entries than it holds, all that it holds count."""
    layout = LISTS[kind]
    record = layout["entries"].base
    head = [("packet_id", "long"), ("t_ns", "long"), ("sync_status", "int"), ("n", "long"), ("idx", "int")]
    schema = ", ".join(f"{k} {t}" for k, t in head + [(k, _spark_type(record[k])) for k in record.names])

    def run(batches):
        for b in _pieces(batches):
            lists = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=layout)
            n = np.minimum(lists["n"].astype(np.int64), MOST[kind])
            row = np.repeat(np.arange(len(lists)), n)
            idx = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            own = lists["entries"][row, idx]
            stamp = lists["seconds"].astype(np.int64) * 1_000_000_000 + lists["nanoseconds"]
            columns = [b.column(0).take(pa.array(row)), pa.array(stamp[row]), pa.array(lists["sync_status"][row].astype(np.int32)), pa.array(lists["n"].astype(np.int64)[row]), pa.array(idx)]
            yield pa.RecordBatch.from_arrays(columns + [_arrow(own[k]) for k in record.names], [k for k, _ in head] + list(record.names))

    return dispatch(packets, kind).select(c("packet_id").cast("long"), "data").mapInArrow(run, schema)


def detection_rows(packets: DataFrame) -> DataFrame:
    """Detections of payloads, with a flag for each bit of their mask."""
    rows = entries(packets, "detection")
    return rows.withColumns({f"invalid_{n}": c("invalid_flags").bitwiseAND(F.lit(1 << i)) != 0 for i, n in enumerate(INVALID_BITS)})


def object_rows(packets: DataFrame) -> DataFrame:
    """Objects of payloads. Relative acceleration has its own columns (rel_acc_*); it
    does not overwrite relative velocity. Corner radars' lists are left out by a filter
    on packets before, with radar.is_corner()."""
    return entries(packets, "object")


def to_lists(rows: DataFrame, kind: str) -> DataFrame:
    """Payloads of lists: the inverse of entries(). `rows`: packet_id, t_ns, entries
    (array of structs with any of the record's fields; the others are 0)."""
    service, method, size = ARS_MESSAGES[kind]
    layout = LISTS[kind]

    def run(batches):
        for b in _pieces(batches):
            lists = np.zeros(b.num_rows, dtype=layout)
            each = b.column(2)
            n = np.diff(each.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), n)
            idx = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            flat = each.flatten()
            for k in flat.type:
                lists["entries"][k.name][row, idx] = flat.field(k.name).to_numpy(zero_copy_only=False)
            t = b.column(1).to_numpy()
            lists["seconds"], lists["nanoseconds"], lists["sync_status"], lists["n"] = t // 1_000_000_000, t % 1_000_000_000, 1, n
            lists["service_id"], lists["method_id"], lists["length"] = service, method, size - 8
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in lists], pa.binary())], ["packet_id", "data"])

    made = rows.select(c("packet_id").cast("long"), c("t_ns").cast("long"), "entries").mapInArrow(run, "packet_id long, data binary")
    return made.select("packet_id", F.lit(service).alias("service_id"), F.lit(method).alias("method_id"), "data")


# Places of the fields of a status payload, and the names of its codes.
STATUS_AT = {
    "nanoseconds": (8, 4), "seconds": (12, 4), "sync": (16, 1), "version_major": (17, 1), "version_minor": (18, 1), "version_patch": (19, 1), "plug": (40, 1), "max_distance": (57, 2),
    "frequency_slot": (59, 1), "cycle_time": (60, 1), "time_slot": (61, 1), "country": (62, 1), "power_save": (63, 1), "configuration_counter": (72, 1), "longitudinal_velocity": (73, 1),
    "longitudinal_acceleration": (74, 1), "lateral_acceleration": (75, 1), "yaw_rate": (76, 1), "steering_angle": (77, 1), "driving_direction": (78, 1), "characteristic_speed": (79, 1),
    "radar": (80, 1), "voltage": (81, 1), "temperature": (82, 1), "blockage": (83, 1),
}
_VEHICLE = {0: "VDY_OK", 1: "VDY_NOTOK"}
STATUS_CODES = {
    "sync": {1: "SYNC_OK", 2: "NEVER_SYNC", 3: "SYNC_LOST"}, "plug": {0: "PLUG_RIGHT", 1: "PLUG_LEFT"},
    "frequency_slot": {0: "Low (76.23 GHz)", 1: "Mid (76.48 GHz)", 2: "High (76.73 GHz)"}, "country": {1: "Worldwide", 2: "Japan"}, "power_save": {0: "Off", 1: "On"},
    "longitudinal_velocity": _VEHICLE, "longitudinal_acceleration": _VEHICLE, "lateral_acceleration": _VEHICLE, "yaw_rate": _VEHICLE, "steering_angle": _VEHICLE,
    "driving_direction": _VEHICLE, "characteristic_speed": _VEHICLE, "radar": {0: "STATE_INIT", 1: "STATE_OK", 2: "STATE_INVALID"},
}
STATUS_FLAGS = {k: {0: f"Current under{k}", 1: f"Past under{k}", 2: f"Current over{k}", 3: f"Past over{k}"} for k in ("voltage", "temperature")}
BLOCKAGE = {0: "Blind", 1: "High", 2: "Mid", 3: "Low", 4: "None"}
BLOCKAGE_TEST = {0: "Self test failed", 1: "Self test passed", 2: "Self test ongoing"}
#: Places of the mounting, the vehicle's sizes (four-byte numbers) and two addresses.
STATUS_FLOATS_AT = {"longitudinal": 20, "lateral": 24, "vertical": 28, "yaw": 32, "pitch": 36, "length": 41, "width": 45, "height": 49, "wheel_base": 53}
ADDRESS_AT = {"address0": 64, "address1": 68}


def status_rows(packets: DataFrame) -> DataFrame:
    """packet_id and a status payload's fields: codes as '1:NAME' ('9:Invalid' where
    there is none), masks as joined names, addresses in dots."""
    p = dispatch(packets, "status")
    address = lambda at: F.concat_ws(".", *(byte_at("data", F.lit(at + i)).cast("string") for i in range(4)))
    fields = {k: uint_be("data", F.lit(at), size) for k, (at, size) in STATUS_AT.items()} | {k: float_be("data", F.lit(at)) for k, at in STATUS_FLOATS_AT.items()} | {k: address(at) for k, at in ADDRESS_AT.items()}
    raw = p.select("packet_id", *(e.alias(k) for k, e in fields.items()))
    out = {k: coded(k, names, "Invalid") for k, names in STATUS_CODES.items()} | {k: flag_names(k, names, "Ok") for k, names in STATUS_FLAGS.items()}
    out["blockage"] = F.concat(coded(c("blockage") % 16, BLOCKAGE, "Invalid"), F.lit(". "), coded(F.floor(c("blockage") / 16), BLOCKAGE_TEST, "Invalid"))
    out["t_ns"] = c("seconds") * 1_000_000_000 + c("nanoseconds")
    return raw.withColumns(out).drop("seconds", "nanoseconds")


# Fields of an object fragment of 31 bytes in order: bits, step and least value.
FRAGMENT_BYTES = 31
FRAGMENT = {
    "object_id": (8, None, None), "dist_x": (16, 0.009155553, -300.0), "dist_y": (16, 0.009155553, -300.0), "v_abs_x": (14, 0.009156391, -75.0), "v_abs_y": (14, 0.009156391, -75.0),
    "a_abs_x": (10, 0.019569472, -10.0), "a_abs_y": (10, 0.019569472, -10.0), "dist_x_std": (14, 0.001831166, 0.0), "dist_y_std": (14, 0.001831166, 0.0), "v_abs_x_std": (14, 0.001831166, 0.0),
    "v_abs_y_std": (14, 0.001831166, 0.0), "a_abs_x_std": (14, 0.001831166, 0.0), "a_abs_y_std": (14, 0.001831166, 0.0), "box_length": (12, 0.007326007, 0.0), "box_width": (12, 0.007326007, 0.0),
    "orientation": (12, 0.001534729, -3.14159), "rcs": (12, 0.024425989, -50.0), "score": (4, 6.666666667, 0.0), "life_cycles": (16, None, None), "reserved": (5, None, None), "status": (2, None, None), "box_valid": (1, None, None),
}


def bit_field(data, byte: Column, bit: int, width: int) -> Column:
    """`width` bits that begin `bit` bits after a byte, most significant first."""
    first, size = bit // 8, (bit + width + 7) // 8 - bit // 8
    value = uint_be(data, byte + first, size)
    return F.shiftrightunsigned(value, (first + size) * 8 - bit - width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def object_fragments(packets: DataFrame, per_packet: int = 2, at: int = 4) -> DataFrame:
    """packet_id, idx and the fields of object fragments; those beyond the list's
    count are filler. `packets`: packet_id, message (its number in the list), n_objects
    (the header's count), data. All bits of a field count, the lowest of the standard
    deviations included."""
    p = packets.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_packet - 1)))).withColumn("idx", c("message") * per_packet + c("k")).filter(c("idx") < c("n_objects"))
    start, bit, out = at + c("k") * FRAGMENT_BYTES, 0, {}
    for name, (width, step, least) in FRAGMENT.items():
        raw = bit_field("data", start, bit, width)
        out[name] = raw if step is None else raw * step + least
        bit += width
    out["box_valid"] = out["box_valid"] == 1
    return p.select("packet_id", "idx", *(e.alias(n) for n, e in out.items() if n != "reserved"))


def object_fragment_hex(raw: dict[str, Column]) -> Column:
    """Hexadecimal text of a fragment of raw field values; those not given are 0."""
    text = F.concat(*(F.lpad(F.conv(c(raw[n]).cast("string") if n in raw else F.lit("0"), 10, 2), w, "0") for n, (w, _, _) in FRAGMENT.items()))
    return F.concat(*(F.lpad(F.conv(F.substring(text, 8 * i + 1, 8), 2, 16), 2, "0") for i in range(FRAGMENT_BYTES)))
