"""What sensors tell of themselves: info packets and status payloads to named values.

A layout is a table of places; each packet is a row and each value a column
expression, so a log of any size is a projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.binary import byte_at, crc16, uint_be
from scanlake.functions.geometry import c
from scanlake.operators.radar import coded, flag_names

# Names of the codes of info packets.
RETURNS = {0: "dual", 4: "strongest", 5: "last", 6: "first"}
SYNC_MODES = {0: "gps", 1: "e2e", 2: "p2p", 3: "gptp"}
SYNC_STATES = {0: "time_sync_invalid", 1: "gps_time_sync_successful", 2: "ptp_time_sync_successful"}
GPS_BITS = {
    "pps_lock": ("invalid", "valid"), "gprmc_lock": ("invalid", "valid"), "utc_lock": ("not_synchronized", "synchronized"),
    "gprmc_input_status": ("no_gprmc", "received_gprmc"), "pps_input_status": ("no_pps", "received_pps"),
}

# Place, size and kind of the values of info packets; a tuple as kind is
# factor, divisor and summand of a measured value.
_ETHERNET = {
    "motor_speed": (8, 2, "uint"), "lidar_ip": (10, 4, "dots"), "dest_pc_ip": (14, 4, "dots"), "mac_addr": (18, 6, "colons"), "lidar_out_msop_port": (24, 2, "uint"),
    "lidar_out_difop_port": (28, 2, "uint"), "fov_start": (32, 2, "hundredths"), "fov_end": (34, 2, "hundredths"), "phase_lock": (38, 2, "uint"),
}
_COMMON = {"serial_number": (292, 6, "hex"), "return_mode": (300, 1, RETURNS), "time_sync_mode": (301, 1, SYNC_MODES), "time": (303, 10, "time"), "gprmc_string": (382, 86, "text")}
INFO_BYTES = 1248
INFO = {
    "Helios": {
        **_ETHERNET, **_COMMON, "pc_dest_msop_port": (26, 2, "uint"), "pc_dest_difop_port": (30, 2, "uint"), "top_firmware_version": (40, 5, "hex"), "bottom_firmware_version": (45, 5, "hex"), "bottom_software_version": (50, 5, "hex"),
        "motor_firmware_version": (55, 5, "hex"), "sensor_hw_version": (60, 3, "hex"), "web_page_version": (63, 4, "hex"), "top_backup_crc": (67, 4, "uint"), "bottom_backup_crc": (71, 4, "uint"),
        "software_backup_crc": (75, 4, "uint"), "webpage_backup_crc": (79, 4, "uint"), "ethernet_gateway": (83, 4, "dots"), "subnet_mask": (87, 4, "dots"), "zero_angle_offset": (298, 2, "uint"),
        "sync_status": (302, 1, SYNC_STATES), "i_dat": (313, 2, (5.0, 4096.0, 0.0)), "v_dat": (315, 2, (1.0, 4096.0, 0.0)), "v_dat_12v": (317, 2, (24.5, 4096.0, 0.0)),
        "v_dat_5v": (319, 2, (11.0, 4096.0, 0.0)), "v_dat_2v5": (321, 2, (10.0, 4096.0, 0.0)), "v_dat_apd": (323, 2, (516.65, 4096.0, -465.8)), "top_board_temp": (342, 2, (503.975, 4096.0, -273.15)),
        "temperature2": (344, 2, (200.0, 4096.0, -50.0)), "temperature3": (346, 2, (200.0, 4096.0, -50.0)), "temperature4": (348, 2, (200.0, 4096.0, -50.0)),
        "bottom_board_temp": (350, 2, (503.975, 4096.0, -273.15)), "real_time_rot_speed": (352, 2, "uint"), "lane_up": (354, 1, "uint"), "lane_up_cnt": (355, 2, "uint"), "top_status": (357, 2, "uint"),
        "gps_status": (359, 1, "gps"), "code_wheel_status": (360, 1, "uint"), "pps_trigger_mode": (361, 1, "uint"),
    },
    "Bpearl": {
        **_ETHERNET, **_COMMON, "tcp_msop_port": (36, 2, "uint"), "mainboard_firmware_version": (40, 5, "hex"), "bottom_firmware_version": (45, 5, "hex"),
        "app_software_version": (50, 5, "hex"), "motor_firmware_version": (55, 5, "hex"), "baud_rate": (288, 1, "uint"), "time_sync_state": (302, 1, SYNC_STATES), "machine_current": (314, 2, "hundredths"),
        "machine_voltage": (319, 2, "hundredths"), "rotation_direction": (337, 1, "uint"), "running_time": (338, 4, "uint"), "startup_times": (351, 2, "uint"), "gps_status": (357, 1, "gps"),
        "machine_temp": (358, 2, "hundredths"), "phase": (371, 2, "uint"), "rotation_speed": (373, 2, "uint"),
    },
}
CALIBRATION_AT = {"elev_deg": 468, "azim_deg": 564}


def _bytes(at: int, size: int) -> Column:
    return F.substr(c("data"), F.lit(at + 1), F.lit(size))


def _decimal(value: Column) -> Column:
    """Six decimals; a tie goes to the even digit."""
    return F.format_string("%.6f", F.bround(value, 6))


def _value(at: int, size: int, kind) -> Column:
    raw = uint_be("data", F.lit(at), size) if size <= 4 else None
    if isinstance(kind, dict):
        out = F.lit("n/a")
        for k, name in kind.items():
            out = F.when(raw == k, name).otherwise(out)
        return out
    if isinstance(kind, tuple):
        factor, divisor, summand = kind
        return _decimal(raw * factor / divisor + summand)
    if kind == "dots":
        return F.concat_ws(".", *(byte_at("data", F.lit(at + i)).cast("string") for i in range(size)))
    if kind == "colons":
        return F.concat_ws(":", *(F.lower(F.hex(_bytes(at + i, 1))) for i in range(size)))
    if kind == "hex":
        return F.lower(F.hex(_bytes(at, size)))
    if kind == "hundredths":
        return _decimal((raw / 100.0).cast("float").cast("double"))
    if kind == "time":
        return (uint_be("data", F.lit(at), 6) * 1_000_000_000 + uint_be("data", F.lit(at + 6), 4) * 1000).cast("string")
    if kind == "text":
        return F.decode(_bytes(at, size), "ISO-8859-1")
    return raw.cast("string")


def info(packets: DataFrame, model: str) -> DataFrame:
    """packet_id, info: a map of all named values of a Robosense info packet, as text;
    measured values have six decimals, unknown codes are n/a. `packets`: packet_id,
    data; null and short payloads are passed over, longer ones are read up to their
    known length."""
    pairs = []
    for name, (at, size, kind) in INFO[model].items():
        if kind == "gps":
            for i, (bit, (off, on)) in enumerate(GPS_BITS.items()):
                pairs += [F.lit(bit), F.when(byte_at("data", F.lit(at)).bitwiseAND(F.lit(1 << i)) != 0, on).otherwise(off)]
        else:
            pairs += [F.lit(name), _value(at, size, kind)]
    return packets.filter(F.length("data") >= INFO_BYTES).select("packet_id", F.create_map(*pairs).alias("info"))


def info_calibration(packets: DataFrame, n_channels: int = 32) -> DataFrame:
    """packet_id, channel, elev_deg, azim_deg of the calibration in an info packet: a sign
    (0 is plus) and hundredths of a degree a channel."""
    p = packets.filter(F.length("data") >= INFO_BYTES).withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(n_channels - 1))))

    def angle(at: int) -> Column:
        place = at + c("channel") * 3
        value = uint_be("data", place + 1, 2) / 100.0
        return F.when(byte_at("data", place) == 0, value).otherwise(-value)

    return p.select("packet_id", "channel", *(angle(at).alias(n) for n, at in CALIBRATION_AT.items()))


# Places of a near radar's status, behind the four bytes of its id.
NEAR_STATUS_BYTES = 68
NEAR_STATUS_AT = {
    "time_stamp": (0, 4), "global_time_stamp_sec": (4, 4), "global_time_stamp_nsec": (8, 4), "global_time_stamp_sync_status": (12, 1), "_major": (13, 1), "_minor": (14, 1), "_patch": (15, 1), "sensor_id": (16, 1),
    "long_pos": (17, 2), "lat_pos": (19, 2), "vert_pos": (21, 2), "long_pos_cog": (23, 2), "wheelbase": (25, 2), "yaw_angle": (27, 2), "cover_damping": (29, 2), "plug_orientation": (31, 1),
    "defective": (32, 1), "supply_voltage_limit": (33, 1), "sensor_off_temp": (34, 1), "_dynamics0": (35, 1), "_dynamics1": (36, 1), "ext_disturbed": (37, 1), "com_error": (38, 1), "sw_error": (39, 2), "_aln": (41, 1),
    "aln_current_azimuth_std": (42, 2), "aln_current_azimuth": (44, 2), "aln_current_delta": (46, 2), "crc": (61, 2), "sequence_counter": (63, 1),
}
#: Step and least value. The step of angles looks like a slip for 9.58766e-5;
#: results must agree.
_DISTANCE, _ANGLE = (1e-3, -32.767), (9.58766, -3.14159)
NEAR_STATUS_SCALE = {
    **{k: _DISTANCE for k in ("long_pos", "lat_pos", "vert_pos", "long_pos_cog", "cover_damping")}, "wheelbase": (1e-3, 0.0),
    **{k: _ANGLE for k in ("yaw_angle", "aln_current_azimuth", "aln_current_delta")}, "aln_current_azimuth_std": (1.52593e-05, 0.0),
}
# Names of the bits.
_SCAN_ERRORS = ("Current Near Scan RF Error", "Near Scan RF this OPC", "Current HRR Scan RF Error", "HRR Scan RF this OPC", "Current RF HW Error", "RF HW Error this OPC", "Current HW Error", "HW Error this OPC")
NEAR_STATUS_BITS = {
    "defective": _SCAN_ERRORS, "ext_disturbed": _SCAN_ERRORS,
    "supply_voltage_limit": ("Current Overvoltage Error", "Overvoltage Error this OPC", "Current Undervoltage Error", "Undervoltage Error this OPC"),
    "sensor_off_temp": ("Current Overtemperature Error", "Overtemperature Error this OPC", "Current Undertemperature Error", "Undertemperature Error this OPC"),
    "sw_error": ("Current Internal SW Error", "Internal SW Error this OPC", "Reset Error", "Current Nvm Integrity", "Nvm Integrity Error this OPC", "RF HW Error this OPC", "Runtime Error", "Last Sensor Config Message Rejected Upper"),
}
DYNAMICS = {"long_vel_invalid": ("_dynamics0", 0), "long_accel_invalid": ("_dynamics0", 2), "lat_accel_invalid": ("_dynamics0", 4), "long_dir_invalid": ("_dynamics0", 6), "yaw_rate_invalid": ("_dynamics1", 0)}
OK, WARN, ERROR = 0, 1, 2


def _validity(code: Column) -> Column:
    return F.when(code > 3, "Invalid value").otherwise(flag_names(code, {0: "Current error", 1: "Error this OPC"}, "Ok"))


def near_status(packets: DataFrame) -> DataFrame:
    """packet_id, level and the values of near radars' status packets: distances in
    metres, masks as joined names, and crc_computed beside the crc sent. Of all
    that is wrong, what stands last in the packet gives the level: 1 for a warning (sync,
    vehicle dynamics), 2 for an error (the rest). `packets`: packet_id, data; null and short
    payloads are passed over."""
    p = packets.filter(F.length("data") >= NEAR_STATUS_BYTES)
    p = p.select("packet_id", *(uint_be("data", F.lit(4 + at), size).alias(k) for k, (at, size) in NEAR_STATUS_AT.items()), crc16(_bytes(4, 61)).cast("long").alias("crc_computed"))
    wrong = {
        "global_time_stamp_sync_status": (c("global_time_stamp_sync_status") != 1, WARN), "defective": (c("defective") != 0, ERROR), "voltage": (c("supply_voltage_limit") != 0, ERROR),
        "temperature": (c("sensor_off_temp") != 0, ERROR), "dynamics": ((c("_dynamics0") != 0) | (c("_dynamics1") != 0), WARN), "disturbed": (c("ext_disturbed") != 0, ERROR), "com": (c("com_error") != 0, ERROR),
        "software": (c("sw_error") % 16 != 0, ERROR),
    }
    out = {"level": F.coalesce(*(F.when(test, level) for test, level in reversed(wrong.values())), F.lit(OK))}
    out |= {k: c(k) * step + least for k, (step, least) in NEAR_STATUS_SCALE.items()}
    out |= {k: flag_names(k, dict(enumerate(names)), "Ok") for k, names in NEAR_STATUS_BITS.items()}
    out |= {k: _validity(F.shiftright(c(source), shift).bitwiseAND(F.lit(3))) for k, (source, shift) in DYNAMICS.items()}
    out["com_error"] = _validity(c("com_error"))
    out["sw_version"] = F.concat_ws(".", "_major", "_minor", "_patch")
    out["plug_orientation"] = coded(c("plug_orientation") % 2, {0: "PLUG_BOTTOM", 1: "PLUG_TOP"})
    out["aln_status_driving"] = F.when(c("_aln") % 2 == 1, "Driving conditions met").otherwise("Driving conditions NOT met")
    out["aln_status_sensor"] = F.when(c("_aln").bitwiseAND(F.lit(2)) != 0, "Sensor is adjusted").otherwise("Sensor is not adjusted")
    out["aln_azimuth_available"] = F.when(c("_aln").bitwiseAND(F.lit(4)) != 0, 1).otherwise(0)
    return p.withColumns(out).drop("_major", "_minor", "_patch", "_dynamics0", "_dynamics1", "_aln")
