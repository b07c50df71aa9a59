"""Packets to points.

A packet is a row of bytes. Opening one makes a row per (block, channel) in Arrow
batches, as the layout is fixed and numpy views it without a loop; everything after
that is column expressions. What a sensor is like stands in SPECS and lookup tables
that are joined as dimensions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions.geometry import TAU, c, wrap
from scanlake.operators.firing import E3X_TABLES, E4X_TABLES, FIRING_NS, HELIOS_NS, NEAR_M, QT128_LOOPS


@dataclass(frozen=True)
class SensorSpec:
    """Blocks, channels, returns a packet can hold, azimuth steps a degree, range."""

    model: str
    n_blocks: int
    n_channels: int
    max_returns: int
    azimuth_steps: int
    min_range: float
    max_range: float
    max_points: int

    def packet_bytes(self, header: int = 12, tail: int = 22, unit: int = 3) -> int:
        return header + self.n_blocks * (2 + self.n_channels * unit) + tail


# Sensor constants.
SPECS = {
    s.model: s
    for s in (
        SensorSpec("Pandar40P", 10, 40, 2, 100, 0.3, 200.0, 144_000),
        SensorSpec("Pandar64", 6, 64, 2, 100, 0.3, 200.0, 230_400),
        SensorSpec("PandarQT64", 4, 64, 2, 100, 0.1, 60.0, 76_800),
        SensorSpec("PandarQT128", 2, 128, 2, 100, 0.05, 50.0, 172_800),
        SensorSpec("PandarXT16", 8, 16, 2, 100, 0.05, 120.0, 128_000),
        SensorSpec("PandarXT32", 8, 32, 2, 100, 0.05, 120.0, 256_000),
        SensorSpec("PandarXT32M", 6, 32, 3, 100, 0.5, 300.0, 384_000),
        SensorSpec("PandarAT128", 2, 128, 2, 25_600, 1.0, 180.0, 307_200),
        SensorSpec("Pandar128E3X", 2, 128, 2, 100, 0.1, 230.0, 691_200),
        SensorSpec("Pandar128E4X", 2, 128, 2, 100, 0.1, 230.0, 691_200),
        SensorSpec("Helios", 12, 32, 2, 100, 0.2, 150.0, 1_152_000),
        SensorSpec("Bpearl", 12, 32, 2, 100, 0.1, 30.0, 1_152_000),
    )
}

# Code, name, number of returns of a return mode.
RETURN_MODES = [
    (0x33, "SingleFirst", 1), (0x34, "SingleSecond", 1), (0x37, "SingleStrongest", 1), (0x38, "SingleLast", 1), (0x39, "LastStrongest", 2), (0x3A, "FirstSecond", 2),
    (0x3B, "LastFirst", 2), (0x3C, "FirstStrongest", 2), (0x3D, "Triple", 3), (0x3E, "StrongestSecondStrongest", 2),
]
# Codes of return types.
RETURN_TYPES = ("UNKNOWN", "LAST", "FIRST", "STRONGEST", "FIRST_WEAK", "LAST_WEAK", "IDENTICAL", "SECOND", "SECONDSTRONGEST", "FIRST_STRONGEST", "LAST_STRONGEST")


def return_modes(spark) -> DataFrame:
    return spark.createDataFrame(RETURN_MODES, "return_mode int, mode string, n_returns int")


def sensor_specs(spark) -> DataFrame:
    return spark.createDataFrame([(s.model, s.n_blocks, s.n_channels, s.max_returns, s.azimuth_steps, s.min_range, s.max_range, s.max_points) for s in SPECS.values()], "model string, n_blocks int, n_channels int, max_returns int, azimuth_steps int, min_range double, max_range double, max_points int")


def valid_packets(packets: DataFrame, n_bytes: int) -> DataFrame:
    """Packets that are long enough; the others are dropped."""
    return packets.filter(F.length("data") >= n_bytes)


def open_packets(packets: DataFrame, n_blocks: int, n_channels: int, header: int = 0) -> DataFrame:
    """packet_id, block, channel, raw_az, raw_dist, refl of packets that hold, after a
    header, blocks of a little-endian azimuth and three bytes a channel: distance,
    reflectivity."""
    size = 2 + 3 * n_channels

    def run(batches):
        for b in batches:
            raw = [x[header : header + n_blocks * size] for x in b.column(1).to_pylist()]
            units = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, n_blocks, size)
            az = units[:, :, 0].astype(np.int32) | units[:, :, 1].astype(np.int32) << 8
            u = units[:, :, 2:].reshape(len(raw), n_blocks, n_channels, 3).astype(np.int32)
            each = n_blocks * n_channels
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(len(raw)), each))), pa.array(np.tile(np.repeat(np.arange(n_blocks, dtype=np.int32), n_channels), len(raw))),
                    pa.array(np.tile(np.arange(n_channels, dtype=np.int32), len(raw) * n_blocks)), pa.array(np.repeat(az.ravel(), n_channels)),
                    pa.array((u[..., 0] | u[..., 1] << 8).ravel()), pa.array(u[..., 2].ravel()),
                ],
                ["packet_id", "block", "channel", "raw_az", "raw_dist", "refl"],
            )

    return valid_packets(packets, header + n_blocks * size).select("packet_id", "data").mapInArrow(run, "packet_id long, block int, channel int, raw_az int, raw_dist int, refl int")


@dataclass(frozen=True)
class BlockLayout:
    """Packets of blocks that begin with a word and an azimuth: bytes before the first
    block, blocks, channels, byte order, and for each word that can begin a block the
    channel of its first unit. Without words, any will do."""

    header: int
    n_blocks: int
    n_channels: int
    order: str
    banks: tuple[tuple[int, int], ...] = ()
    #: Whether a block of an unknown word ends the packet; else it counts from channel 0.
    strict: bool = False

    @property
    def packet(self) -> np.dtype:
        unit = np.dtype([("distance", f"{self.order}u2"), ("refl", "u1")])
        block = np.dtype([("word", f"{self.order}u2"), ("azimuth", f"{self.order}u2"), ("units", unit, self.n_channels)])
        return np.dtype([("header", f"V{self.header}"), ("blocks", block, self.n_blocks)] if self.header else [("blocks", block, self.n_blocks)])


# Layouts of packets whose blocks begin with a word.
LAYOUTS = {
    "VLP16": BlockLayout(0, 12, 32, "<"),
    "VLP32": BlockLayout(0, 12, 32, "<", ((0xEEFF, 0), (0xDDFF, 32))),
    "VLS128": BlockLayout(0, 12, 32, "<", ((0xEEFF, 0), (0xDDFF, 32), (0xCCFF, 64), (0xBBFF, 96)), strict=True),
    "Helios": BlockLayout(42, 12, 32, ">"),
    "Bpearl": BlockLayout(42, 12, 32, ">"),
}


def open_blocks(packets: DataFrame, model: str) -> DataFrame:
    """packet_id, block, channel, raw_az, raw_dist, refl of packets of a model in
    LAYOUTS. Longer packets are read up to the last block, shorter ones dropped. Where
    the layout is strict, blocks from the first of an unknown word on are left out."""
    layout = LAYOUTS[model]
    packet = layout.packet

    def run(batches):
        for b in batches:
            # Lengths are seen here: as a filter they would be sought where packets are made, before rows are dealt to tasks.
            b = b.filter(pc.greater_equal(pc.binary_length(b.column(1)), packet.itemsize))
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(x[: packet.itemsize] for x in b.column(1).to_pylist()), dtype=packet)["blocks"]
            word, first = raw["word"].astype(np.int32), np.zeros(raw.shape, dtype=np.int32)
            known = np.full(raw.shape, not layout.strict)
            for value, channel in layout.banks:
                first[word == value] = channel
                known |= word == value
            row, block = np.nonzero(np.logical_and.accumulate(known, axis=1))
            units, n = raw["units"][row, block], layout.n_channels
            channel = first[row, block][:, None] + np.arange(n, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(row, n))), pa.array(np.repeat(block.astype(np.int32), n)), pa.array(channel.ravel()),
                    pa.array(np.repeat(raw["azimuth"][row, block].astype(np.int32), n)), pa.array(units["distance"].astype(np.int32).ravel()), pa.array(units["refl"].astype(np.int32).ravel()),
                ],
                ["packet_id", "block", "channel", "raw_az", "raw_dist", "refl"],
            )

    return packets.select("packet_id", "data").mapInArrow(run, "packet_id long, block int, channel int, raw_az int, raw_dist int, refl int")


def decode_units(packets: DataFrame, model: str) -> DataFrame:
    """Units of packets by the model's own layout (d23): open_blocks() where blocks begin
    with a word, else open_packets() by the sensor's constants."""
    if model in LAYOUTS:
        return open_blocks(packets, model)
    spec = SPECS[model]
    return open_packets(packets, spec.n_blocks, spec.n_channels, header=12)


def fine_azimuth(coarse, fine) -> Column:
    """An azimuth of two bytes and a finer one, in 1/256 of its steps."""
    return F.shiftleft(c(coarse), 8) + c(fine)


def packet_time(year, month, day, hour, minute, second, microsecond, year_offset: int = 1900) -> Column:
    """Nanoseconds since 1970, UTC, of calendar fields."""
    date = F.make_date(c(year) + year_offset, c(month), c(day))
    days = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long")
    return ((days * 24 + c(hour)) * 60 + c(minute)) * 60_000_000_000 + c(second) * 1_000_000_000 + c(microsecond) * 1000


def robosense_unit(code) -> Column:
    """Metres a step by code; other codes are an error."""
    return F.when(c(code) == 0, 0.005).when(c(code) == 1, 0.0025).otherwise(F.raise_error(F.lit("unknown distance resolution")).cast("double"))


def range_gate(units: DataFrame, unit_m: float, spec_min: float, spec_max: float, user_min: float, user_max: float) -> DataFrame:
    """distance of units with a return, inside the sensor's and the user's range."""
    d = units.withColumn("distance", c("raw_dist") * unit_m).filter(c("raw_dist") > 0)
    return d.filter(c("distance").between(spec_min, spec_max) & c("distance").between(user_min, user_max))


def return_groups(units: DataFrame) -> DataFrame:
    """group_no, offset and the number of returns: blocks of a packet that hold the
    returns of one shot follow one another."""
    return units.withColumns({"group_no": F.floor(c("block") / c("n_returns")).cast("int"), "offset": (c("block") % c("n_returns")).cast("int")})


def return_type(mode, offset, identical, strongest) -> Column:
    """The class of a return from the mode, its place in the group, whether it
    repeats another and whether none is stronger."""
    m, o = c(mode), c(offset)
    first = lambda a, b: F.when(o == 0, a).otherwise(b)
    table = {
        0x33: F.lit("FIRST"), 0x34: F.lit("SECOND"), 0x37: F.lit("STRONGEST"), 0x38: F.lit("LAST"),
        0x39: F.when(c(strongest), first("LAST_STRONGEST", "STRONGEST")).otherwise(first("LAST", "SECONDSTRONGEST")),
        0x3A: first("FIRST", "SECOND"), 0x3B: first("FIRST", "LAST"),
        0x3C: F.when(c(strongest), first("FIRST_STRONGEST", "STRONGEST")).otherwise(first("FIRST", "SECONDSTRONGEST")),
        0x3E: first("STRONGEST", "SECONDSTRONGEST"), 0x3D: F.when(o == 0, "FIRST").when(o == 1, "LAST").otherwise("STRONGEST"),
    }
    out = F.lit("UNKNOWN")
    for code, name in table.items():
        out = F.when(m == code, name).otherwise(out)
    return F.when(c(identical), "IDENTICAL").otherwise(out)


#: Models whose dual first-last mode sends the last return first.
FLIPPED = ("Pandar128E3X", "Pandar128E4X", "PandarXT32", "PandarXT16")


def flip_first_last(kind, mode, model: str) -> Column:
    if model not in FLIPPED:
        return c(kind)
    return F.when((c(mode) == 0x3B) & (c(kind) == "FIRST"), "LAST").when((c(mode) == 0x3B) & (c(kind) == "LAST"), "FIRST").otherwise(c(kind))


_OTHERS = ("_o1", "_o2", "_o3", "_o4")


def _any_other(test) -> Column:
    """Whether any other return of the group passes; there are two others at most."""
    out = F.lit(False)
    for o in _OTHERS:
        out = out | F.coalesce(test(o), F.lit(False))
    return out


def classify_returns(units: DataFrame) -> DataFrame:
    """kind of each return of return_groups(). A group is at most three rows, so its
    other returns are the two before and the two after."""
    ordered = Window.partitionBy("packet_id", "group_no", "channel").orderBy("offset")
    own = F.struct("raw_dist", "refl")
    u = units.withColumns({o: f(own, k).over(ordered) for o, (f, k) in zip(_OTHERS, ((F.lag, 1), (F.lag, 2), (F.lead, 1), (F.lead, 2)))})
    same = _any_other(lambda o: (c(f"{o}.raw_dist") == c("raw_dist")) & (c(f"{o}.refl") == c("refl")))
    u = u.withColumns({"identical": same, "strongest": ~_any_other(lambda o: c(f"{o}.refl") > c("refl"))})
    return u.withColumn("kind", return_type("return_mode", "offset", "identical", "strongest"))


def drop_repeated_returns(units: DataFrame, apart: float) -> DataFrame:
    """Of identical returns the last stays; a return that isn't the last and lies
    within `apart` (raw units) of another of its group goes."""
    last = c("offset") == c("n_returns") - 1
    near = _any_other(lambda o: F.abs(c(f"{o}.raw_dist") - c("raw_dist")) < apart)
    return units.filter(last | (~c("identical") & ~near)).drop(*_OTHERS)


def correct_angles(units: DataFrame, calibration: DataFrame, steps: int) -> DataFrame:
    """azimuth and elevation in radians from the block's azimuth and the channel's
    calibration."""
    u = units.join(F.broadcast(calibration), "channel")
    return u.withColumns({"azimuth": wrap(F.radians(c("raw_az") / steps + c("azim_off_deg"))), "elevation": F.radians("elev_deg")}).drop("elev_deg", "azim_off_deg")


def correct_angles_by_mirror(units: DataFrame, frames: DataFrame, grid: DataFrame, channels: DataFrame, steps: int = 25_600) -> DataFrame:
    """AT128: a block lies in the field of the mirror whose start it has last passed;
    its azimuth is twice the way from there, less the channel's own and an adjustment
    between two grid entries. All tables but `units` are calibration.
    `frames`: field, start, stop (steps); `grid`: channel, step, adjust (1/100 degree
    by 2 degrees); `channels`: channel, azimuth, elevation (degrees)."""
    f = units.join(F.broadcast(frames), (c("raw_az") >= c("start")) & (c("raw_az") < c("stop")))
    at = c("raw_az") / steps / 2.0
    low = F.floor(at).cast("int")
    f = f.withColumns({"_low": low, "_part": at - low}).join(F.broadcast(channels.withColumnsRenamed({"azimuth": "ch_az", "elevation": "ch_el"})), "channel")
    a = F.broadcast(grid.select("channel", c("step").alias("_low"), c("adjust").alias("_a")))
    b = F.broadcast(grid.select("channel", (c("step") - 1).alias("_low"), c("adjust").alias("_b")))
    f = f.join(a, ["channel", "_low"]).join(b, ["channel", "_low"])
    adjust = (c("_a") * (1 - c("_part")) + c("_b") * c("_part")) / 100.0
    azimuth = wrap((c("raw_az") - c("start")) * 2.0 / steps - c("ch_az") + adjust, 360.0)
    return f.withColumns({"azimuth_deg": azimuth, "elevation_deg": c("ch_el")}).drop("_low", "_part", "_a", "_b", "ch_az", "ch_el", "start", "stop")


def polar_to_cartesian(units: DataFrame, vendor: str = "hesai") -> DataFrame:
    """Azimuth from the y axis, clockwise (hesai), or from the x axis, clockwise
    (robosense)."""
    flat = c("distance") * F.cos("elevation")
    s, k = flat * F.sin("azimuth"), flat * F.cos("azimuth")
    x, y = (s, k) if vendor == "hesai" else (k, -s)
    return units.withColumns({"x": x, "y": y, "z": c("distance") * F.sin("elevation")})


def block_offset_ns(model: str, block, n_returns) -> Column:
    """Nanoseconds from the packet's stamp to a block; divisions cut off."""
    b, n = c(block).cast("long"), c(n_returns).cast("long")
    div = lambda x: F.floor(x / n).cast("long")
    # Fixed values.
    table = {
        "Pandar40P": lambda: -28_580 - 55_560 * div(10 - b - 1), "Pandar64": lambda: -42_580 - 55_560 * div(6 - b - 1),
        "PandarQT64": lambda: 25_710 + F.floor(500_000 * div(b) / 3).cast("long"), "PandarQT128": lambda: 9_000 + div(111_110 * (2 - b - 1)),
        "PandarXT16": lambda: 5_632 - 50_000 * div(8 - b - 1), "PandarXT32": lambda: 5_632 - 50_000 * div(8 - b - 1),
        "PandarXT32M": lambda: 5_632 - 50_000 * F.when(n < 3, div(8 - b - 1)).otherwise(F.floor((6 - b - 1) / 3).cast("long")),
        "PandarAT128": lambda: -9_249 - 41_666 * F.when(n == 1, 2 - b).otherwise(1), "Pandar128E3X": lambda: 3_148 - div(55_556 * (2 - b - 1)),
        "Pandar128E4X": lambda: 43_346 - F.when(n == 1, 55_556 * (2 - b - 1)).otherwise(0), "Helios": lambda: F.lit(0).cast("long"), "Bpearl": lambda: F.lit(0).cast("long"),
    }
    return table[model]()


def _times(table, index) -> Column:
    """An entry of a constant array; null beyond its end."""
    return F.get(F.expr(f"array({', '.join(map(str, table))})"), c(index).cast("int")).cast("long")


def _azimuth_state(block) -> Column:
    """The two bits of a block in a packet's azimuth_state, those of block 0 uppermost."""
    return F.floor(c("azimuth_state") / F.pow(F.lit(2), 14 - 2 * c(block))).cast("long") % 4


def _e3x_time(ch: Column, block) -> Column:
    """By operational_state (0: high resolution, which has four azimuth states; others have
    two), azimuth_state and distance. Null where a state has no times."""
    state, high = _azimuth_state(block), c("operational_state") == 0
    place = F.when(high, state).when(state < 2, state + 4)
    return _times([t for table in E3X_TABLES for t in table], (place * 2 + (c("distance") <= NEAR_M).cast("int")) * 128 + ch)


def _e4x_time(ch: Column, block) -> Column:
    """By operational_state (0: high resolution) and azimuth_state."""
    table = F.when(c("operational_state") != 0, 0).when(_azimuth_state(block) == 0, 1).otherwise(2)
    return _times([t for table in E4X_TABLES for t in table], table * 128 + ch)


def _qt128_time(ch: Column, block, n_returns) -> Column:
    """Single returns alternate between two loops by block, others follow mode_flag."""
    first = F.when(c(n_returns) == 1, c(block) % 2 == 0).otherwise(c("mode_flag") % 2 == 1)
    return _times(QT128_LOOPS[0] + QT128_LOOPS[1], F.when(first, 0).otherwise(128) + ch)


def _shot(block, n_returns) -> Column:
    """A shot of a Robosense packet: a block of single returns or a pair of blocks."""
    return F.when(c(n_returns) == 2, F.floor(c(block) / 2)).otherwise(c(block)).cast("long")


def _helios_time(ch: Column, block, n_returns) -> Column:
    """In single mode two pairs of channels trade places, the second not in the first
    block; the time of block and channel is rounded to ten."""
    shot = _shot(block, n_returns)
    traded = F.when(c(n_returns) == 2, ch).when(ch.isin(17, 18), 35 - ch).when(ch.isin(21, 22) & (shot > 0), 43 - ch).otherwise(ch)
    return F.floor((shot * 1_000_000 + 18 * _times(HELIOS_NS, traded) + 90) / 180).cast("long") * 10


def _bpearl_time(ch: Column, block, n_returns) -> Column:
    """5555 ns from shot to shot, 166.8 from channel to channel, rounded."""
    return F.when(ch.between(0, 31), 5555 * _shot(block, n_returns) + F.floor((1668 * ch + 5) / 10).cast("long"))


def channel_offset_ns(model: str, channel, block="block", n_returns="n_returns") -> Column:
    """Nanoseconds from a block to a channel: by a rule where channels fire in order,
    else from the model's table. Some models fire by what their packets say, in further
    columns of the units: mode_flag (PandarQT128), operational_state and azimuth_state
    (Pandar128E3X, Pandar128E4X), distance in metres (Pandar128E3X). Robosense times
    hold a block's own time as well, whatever the number of blocks. Channels that don't fire have 0 or -1."""
    ch = c(channel).cast("long")
    # Fixed values.
    rule = {
        "PandarXT16": lambda: 368 + 3024 * ch, "PandarXT32": lambda: 368 + 1512 * ch, "PandarXT32M": lambda: 368 + 2888 * (ch % 16),
        "PandarQT128": lambda: _qt128_time(ch, block, n_returns), "Pandar128E3X": lambda: _e3x_time(ch, block), "Pandar128E4X": lambda: _e4x_time(ch, block),
        "Helios": lambda: _helios_time(ch, block, n_returns), "Bpearl": lambda: _bpearl_time(ch, block, n_returns),
    }
    if model in rule:
        return rule[model]()
    if model not in FIRING_NS:
        raise ValueError(f"no channel times of {model}")
    return F.element_at(F.array(*(F.lit(x).cast("long") for x in FIRING_NS[model])), (ch + 1).cast("int"))


def point_time(units: DataFrame, model: str) -> DataFrame:
    """t_ns: nanoseconds since the scan began, as 32 bits."""
    offset = block_offset_ns(model, "block", "n_returns") + channel_offset_ns(model, "channel")
    return units.withColumn("t_ns", F.pmod(c("stamp_ns") - c("scan_ns") + offset, F.lit(1 << 32)))


def earliest_offset(model: str, units: DataFrame) -> DataFrame:
    """Per packet the least offset in its first return group."""
    offset = block_offset_ns(model, "block", "n_returns") + channel_offset_ns(model, "channel")
    return units.filter(c("block") < c("n_returns")).groupBy("packet_id").agg(F.min(offset).alias("earliest_ns"))


def dither(mask: DataFrame, levels: int = 10, place: Column | None = None) -> DataFrame:
    """keep of each mask pixel: its grey says how many of `levels` diagonal places
    are kept, spread evenly. `place` is another than the diagonal (tile_place())."""
    kept = F.round(c("grey") * levels / 255.0).cast("int")
    place = F.pmod(c("x") + c("y") if place is None else place, F.lit(levels))
    one = F.exists(F.sequence(F.lit(0), F.greatest(kept - 1, F.lit(0))), lambda i: F.round(levels * i / kept).cast("int") == place)
    return mask.withColumn("keep", F.when(kept > 0, one).otherwise(F.lit(False)))


def mask_filter(points: DataFrame, mask: DataFrame, columns: int, start: float = 0.0, extent: float = TAU) -> DataFrame:
    """Points whose mask pixel is kept; outside the mask none are."""
    p = points.withColumn("_x", F.round((c("azimuth") - start) / extent * columns).cast("int"))
    return p.join(F.broadcast(mask.filter("keep").select(c("x").alias("_x"), c("y").alias("channel"))), ["_x", "channel"], "left_semi").drop("_x")


def tile_place(x, y) -> Column:
    """Place of a pixel in the dither of a sensor that fires pairs of channels in turn (128E4X): a
    tile of two blocks by four channels has one place, and the two channels of a pair are
    one apart."""
    return F.floor(c(x) / 2).cast("int") * 2 + F.floor(c(y) / 4).cast("int") * 4 + c(y) % 2


def robosense_return_type(n_returns, offset, mode) -> Column:
    """Dual packets hold the strongest, then the last; single ones what the mode says."""
    return F.when(c(n_returns) == 2, F.when(c(offset) == 0, "STRONGEST").otherwise("LAST")).otherwise(c(mode))


def robosense_info(packets: DataFrame) -> DataFrame:
    """packet_id, info: a map of named values of info packets: big-endian raw
    voltages by place, as volts."""
    from scanlake.functions.binary import uint_be

    names = ("bot_input_volt", "bot_5v", "bot_12v", "top_input_volt")
    pairs = [x for i, n in enumerate(names) for x in (F.lit(n), F.format_number(uint_be("data", F.lit(2 * i), 2) / 4096.0 * 5, 4))]
    return packets.select("packet_id", F.create_map(*pairs).alias("info"))


def robosense_calibration(packets: DataFrame, n_channels: int, at: int) -> DataFrame:
    """channel, elev_deg: three bytes a channel, a sign and hundredths of a degree."""
    from scanlake.functions.binary import byte_at, uint_be

    p = packets.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(n_channels - 1))))
    value = uint_be("data", at + c("channel") * 3 + 1, 2) / 100.0
    return p.select("packet_id", "channel", F.when(byte_at("data", at + c("channel") * 3) == 0, value).otherwise(-value).alias("elev_deg"))


# Velodyne: microseconds of a firing cycle and of one laser.
CYCLE_US, LASER_US = 55.296, 2.304


def velodyne_azimuth_step(blocks: DataFrame, dual: bool = False) -> DataFrame:
    """diff: hundredths of a degree to the next block (next but one in dual mode);
    the last block takes the one before."""
    order = Window.partitionBy("packet_id").orderBy("block")
    step = F.pmod(36_000 + F.lead("raw_az", 2 if dual else 1).over(order) - c("raw_az"), F.lit(36_000))
    b = blocks.withColumn("_d", step)
    return b.withColumn("diff", F.coalesce("_d", F.last("_d", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_d")


def velodyne_azimuth(units: DataFrame, rot_correction="rot_corr") -> DataFrame:
    """azimuth in hundredths of a degree at a laser's firing, less its correction."""
    a = c("raw_az") + c("diff") * LASER_US / CYCLE_US * c("laser") - F.degrees(c(rot_correction)) * 100
    return units.withColumn("azimuth", wrap(a, 36_000.0))


def velodyne_xyz(units: DataFrame) -> DataFrame:
    """Coordinates with the lasers' offsets and two-point distance correction.
    Columns: distance, azimuth (hundredths), vert, dist_corr, dist_corr_x,
    dist_corr_y, vert_off, horiz_off."""
    a = F.radians(c("azimuth") / 100.0)
    d = c("distance") + c("dist_corr")
    cv, sv = F.cos("vert"), F.sin("vert")
    flat = d * cv - c("vert_off") * sv
    xx, yy = F.abs(flat * F.sin(a) - c("horiz_off") * F.cos(a)), F.abs(flat * F.cos(a) + c("horiz_off") * F.sin(a))
    # Corrections hold at 2.4 m (x), 1.93 m (y) and 25.04 m, and are linear between.
    cx = (c("dist_corr") - c("dist_corr_x")) * (xx - 2.4) / (25.04 - 2.4) + c("dist_corr_x") - c("dist_corr")
    cy = (c("dist_corr") - c("dist_corr_y")) * (yy - 1.93) / (25.04 - 1.93) + c("dist_corr_y") - c("dist_corr")
    fx, fy = (d + cx) * cv - c("vert_off") * sv, (d + cy) * cv - c("vert_off") * sv
    x, y = fx * F.sin(a) - c("horiz_off") * F.cos(a), fy * F.cos(a) + c("horiz_off") * F.sin(a)
    return units.withColumns({"x": y, "y": -x, "z": (d + cy) * sv + c("vert_off") * cv})


def velodyne_intensity(raw, distance, focal_distance, focal_slope, low, high) -> Column:
    """Intensity corrected for the focal distance, between the laser's bounds."""
    offset = 256 * (1 - c(focal_distance) / 13_100) * (1 - c(focal_distance) / 13_100)
    away = 256 * (1 - c(distance) * 500 / 65_535) * (1 - c(distance) * 500 / 65_535)
    v = c(raw) + c(focal_slope) * F.abs(offset - away)
    return F.greatest(c(low), F.least(c(high), v))


def velodyne_time_us(block, laser, dual: bool = False) -> Column:
    b = F.floor(c(block) / 2) if dual else c(block)
    return b * CYCLE_US + F.floor(c(laser) / 2) * LASER_US


def velodyne_dual(units: DataFrame) -> DataFrame:
    """kind of dual returns: blocks come in pairs, and a pair's distances and
    intensities tell first from last and strong from weak. The second of two equal
    returns is left out."""
    pair = Window.partitionBy("packet_id", F.floor(c("block") / 2), "laser")
    both = units.withColumns({"_n": F.count("*").over(pair), "_sd": F.sum("raw_dist").over(pair), "_si": F.sum("refl").over(pair)})
    other_d, other_i, second = c("_sd") - c("raw_dist"), c("_si") - c("refl"), c("block") % 2 == 1
    alone = c("_n") < 2
    same = ~alone & (other_d == c("raw_dist")) & (other_i == c("refl"))
    nearer, stronger = c("raw_dist") < other_d, c("refl") > other_i
    kind = F.when(alone, "STRONGEST").when(same, "IDENTICAL").when(nearer & stronger, "FIRST_STRONGEST").when(nearer, "FIRST_WEAK").when(stronger, "LAST_STRONGEST").otherwise("LAST_WEAK")
    return both.withColumn("kind", kind).filter(~(same & second)).drop("_n", "_sd", "_si")


