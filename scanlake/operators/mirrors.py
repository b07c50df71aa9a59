"""Sensors of several mirrors: each sweeps a field of the encoder's turn, so a turn gives
as many scans as mirrors.

Where a field's view and its scan begin and end depends on the calibration of all its
channels: these are encoder steps, found once a calibration by bisection over the
corrected azimuths of all channels, for all fields at once. Blocks are then told apart by
comparisons with the few angles of the fields.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions.geometry import c
from scanlake.streaming.scans import cut_at_angles, passes


@dataclass
class MirrorAngles:
    """By field, in encoder steps: where it begins, where the first channel enters the
    view and the last leaves it, where the last passes the cut (a scan ends) and the
    first does (the next scan's time begins). `turn`: steps of a whole turn."""

    start: list[int]
    fov_start: list[int]
    fov_end: list[int]
    emit: list[int]
    reset: list[int]
    turn: int


def mirror_angles(frames: DataFrame, channels: DataFrame, grid: DataFrame, fov: tuple[float, float], cut: float, steps: int = 25_600) -> MirrorAngles:
    """Angles of a calibration: `frames` (field, start, stop), `channels` (channel,
    azimuth) and `grid` (channel, step, adjust), as of correct_angles_by_mirror(). A
    calibration is one sensor's: some fields, 128 channels, 180 steps."""
    turn = 360 * steps
    rows = sorted(frames.select("field", "start", "stop").collect())
    own = sorted(channels.select("channel", "azimuth").collect())
    index = {r.channel: i for i, r in enumerate(own)}
    adjust = np.zeros((len(own), 180))
    for r in grid.select("channel", "step", "adjust").collect():
        if r.channel in index and 0 <= r.step < 180:
            adjust[index[r.channel], r.step] = r.adjust
    start = np.array([r.start for r in rows])
    stop = np.array([r.stop + (turn if r.stop < r.start else 0) for r in rows])
    azimuth = np.array([r.azimuth for r in own], dtype=float)

    def corrected(step: np.ndarray) -> np.ndarray:
        at = step % turn / steps / 2.0
        low = np.floor(at).astype(int)
        between = adjust[:, low % 180] * (1 - (at - low)) + adjust[:, (low + 1) % 180] * (at - low)
        return ((step - start) * 2.0 / steps - azimuth[:, None] + between / 100.0) % 360.0

    def first(low: np.ndarray, high: np.ndarray, angle: float, every: bool) -> np.ndarray:
        """The first step at which every channel (any of them) has reached the angle."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high) // 2
            reached = corrected(middle) >= angle
            there = reached.all(0) if every else reached.any(0)
            open_ = low < high
            high, low = np.where(open_ & there, middle, high), np.where(open_ & ~there, middle + 1, low)
        return low

    begin = first(start, stop, fov[0], every=False)
    end = first(begin, stop, fov[1], every=True)
    emit, reset = first(begin, end, cut, every=True), first(begin, end, cut, every=False)
    if cut == fov[0]:
        emit, reset = begin, begin
    elif cut == fov[1]:
        emit, reset = end, begin
    return MirrorAngles(*((x % turn).tolist() for x in (start, begin, end, emit, reset)), turn)


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _between(lo: int, hi: int, x, above: bool) -> Column:
    """lo < x <= hi around the circle; lo <= x with `above`."""
    low = c(x) >= lo if above else c(x) > lo
    return (low & (c(x) <= hi)) if lo <= hi else (low | (c(x) <= hi))


def cut_mirrors(blocks: DataFrame, angles: MirrorAngles, key: str = "sensor") -> DataFrame:
    """scan_id of blocks (key, seq, azimuth in steps), the field they lie in, whether they
    touch a view or an overlap of two scans, and whether a scan's time begins with them."""
    out = cut_at_angles(blocks, angles.emit, key).withColumn("_last", F.lag("azimuth").over(Window.partitionBy(key).orderBy("seq")))
    upto = sum((F.lit(float(a)) <= c("azimuth")).cast("int") for a in angles.start)
    touches = lambda pairs, above: _any(F.coalesce(_between(a, z, x, above), F.lit(False)) for a, z in pairs for x in ("azimuth", "_last"))
    return out.withColumns({
        "field": F.when(upto == 0, len(angles.start) - 1).otherwise(upto - 1).cast("int"),
        "in_view": touches(zip(angles.fov_start, angles.fov_end), False), "in_overlap": touches(zip(angles.reset, angles.emit), True),
        "begins": c("_last").isNotNull() & _any(passes("_last", "azimuth", float(a)) for a in angles.reset),
    }).drop("_last")
