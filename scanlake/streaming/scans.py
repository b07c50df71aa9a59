"""Cutting the endless row of blocks into scans.

In a batch a cut is a lag and a running sum within a sensor, both carried from bucket to
bucket of its rows, so that no task takes a sensor's whole history. As a stream the same
rules run as a fold with a small state per sensor: the last azimuth and the number
of the open scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scanlake.functions.geometry import c, wrap


#: Rows of one sensor, by seq, that one task puts in order.
BUCKET = 1 << 16


def passes(last, now, angle: float) -> Column:
    """Whether (last, now] holds the angle, around the circle."""
    a, b = c(last), c(now)
    return F.when(a <= b, (a < angle) & (F.lit(angle) <= b)).otherwise((a < angle) | (F.lit(angle) <= b))


def carried(rows: DataFrame, cut: Callable[[Column], Column], value, keys: list[str], order: str, bucket: int, name: str, of_before: bool = False) -> DataFrame:
    """rows with the running number of cuts as `name`. cut(last) says, from the `value` of
    the row before, whether a row is a cut, `of_before` leaves it out of its own number.

    A key's rows are taken `bucket` of its order at a time, each bucket in a task of its
    own and put in order once. Its first row is judged as if none came before it; what that
    leaves to mend, and how many cuts came before, follow from a table of a row a bucket and
    are joined back where they are not zero: nothing, where keys have a bucket each. So a
    sensor's history of any length is no one task's. Rows without a key or an order are left out."""
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_cut = lambda last: F.coalesce(cut(c(last)), F.lit(False)).cast("long")
    b = rows.withColumns({"_bucket": F.floor(c(order) / bucket), "_value": value})
    for k in (*keys, "_bucket"):
        b = b.filter(c(k).isNotNull())
    # Rows are narrow and shuffle to little: by a number of their own, tasks aren't merged until they fill memory.
    b = b.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_bucket")
    b = b.withColumns({"_last": F.lag("_value").over(inside), "_first": F.row_number().over(inside) == 1}).withColumn("_cut", is_cut("_last"))
    heads = b.withColumns({"_end": F.last("_value").over(whole), "_n": F.sum("_cut").over(whole)}).filter("_first")
    earlier = Window.partitionBy(*keys).orderBy("_bucket")
    heads = heads.withColumn("_last", F.lag("_end").over(earlier)).withColumn("_mend", F.when(c("_last").isNull(), 0).otherwise(is_cut("_last") - c("_cut")))
    heads = heads.withColumn("_before", F.coalesce(F.sum(c("_n") + c("_mend")).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = heads.filter("_before <> 0 or _mend <> 0").select(*keys, "_bucket", "_before", "_mend")
    b = b.withColumn("_so_far", F.sum("_cut").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(heads, [*keys, "_bucket"], "left")
    mend = F.coalesce("_mend", F.lit(0))
    number = c("_so_far") + F.coalesce("_before", F.lit(0)) + mend - (c("_cut") + F.when(c("_first"), mend).otherwise(0) if of_before else F.lit(0))
    return b.select(*rows.columns, number.alias(name))


def cut_at_angle(blocks: DataFrame, angle: float, key: str = "sensor", bucket: int = BUCKET) -> DataFrame:
    """scan_id of blocks (sensor, seq, azimuth) of sensors that close a scan when the
    azimuth passes the angle; the block that does so still belongs to it."""
    return cut_at_angles(blocks, [angle], key, bucket)


def cut_at_angles(blocks: DataFrame, angles: list[float], key: str = "sensor", bucket: int = BUCKET) -> DataFrame:
    """scan_id as of cut_at_angle(), where any of several angles closes a scan: sensors of
    more than one mirror, with one angle a mirror. Angles are few and known, so how many
    lie before an azimuth is a sum of comparisons."""
    upto = lambda x: sum((F.lit(float(a)) <= x).cast("int") for a in angles)

    def cut(last):
        a, b = upto(last), upto(c("azimuth"))
        return F.when(last.isNull(), False).when(last <= c("azimuth"), a < b).otherwise((a < len(angles)) | (b > 0))

    return carried(blocks, cut, c("azimuth"), [key], "seq", bucket, "scan_id", of_before=True)


def into_next_scan(points: DataFrame, reset: float, emit: float, overlap: float = 20.0, period: float = 360.0) -> DataFrame:
    """Points of blocks between the reset and the emit angle whose corrected azimuth
    lies within `overlap` after it go to the scan that follows."""
    after = wrap(c("point_azimuth") - emit, period)
    near = wrap(c("azimuth") - reset, period) <= wrap(F.lit(emit - reset), period)
    return points.withColumn("scan_id", c("scan_id") + (near & (after <= overlap)).cast("long"))


def cut_on_wrap(blocks: DataFrame, phase: float, period: float = 36_000.0, key: str = "sensor", bucket: int = BUCKET) -> DataFrame:
    """scan_id of sensors whose block opens a scan when its azimuth, counted from the
    phase, is less than that of the block before."""
    turned = wrap(c("azimuth") - phase, period)
    return carried(blocks, lambda last: turned < last, turned, [key], "seq", bucket, "scan_id")


def cut_packets(packets: DataFrame, phase: float, period: float = 36_000.0, key: str = "sensor", bucket: int = BUCKET) -> DataFrame:
    """scan_id of packets (first, last azimuth): a packet in whose span, from the end
    of the packet before, the phase lies opens a scan that already has a packet."""
    turned = wrap(c("last") - phase, period)
    return carried(packets, lambda last: turned < last, turned, [key], "seq", bucket, "scan_id")


def overflow(points: DataFrame, phase: float, max_gap_ns: int = 50_000_000, key: str = "sensor") -> DataFrame:
    """Points past the phase at the end of a scan's last packet move to the next scan;
    if that begins over `max_gap_ns` later they are late and dropped. Points: sensor,
    scan_id, t_ns, tail (past the phase)."""
    starts = points.filter(~c("tail")).groupBy(key, "scan_id").agg(F.min("t_ns").alias("_start"))
    starts = starts.withColumn("scan_id", c("scan_id") - 1)
    p = points.join(starts, [key, "scan_id"], "left")
    late = c("tail") & (c("_start").isNull() | (c("_start") - c("t_ns") > max_gap_ns))
    return p.filter(~late).withColumn("scan_id", c("scan_id") + c("tail").cast("long")).drop("_start")


def scan_stamps(points: DataFrame, key: str = "sensor") -> DataFrame:
    """A scan's stamp: its earliest point."""
    return points.groupBy(key, "scan_id").agg(F.min("t_ns").alias("stamp_ns"), F.count("*").alias("n_points"))


def after_calibration(packets: DataFrame, infos: DataFrame, key: str = "sensor") -> DataFrame:
    """Packets with the calibration in force; those before the first are left out."""
    from scanlake.operators.joins import asof_backward

    return asof_backward(packets, infos, key)


def cut_stream(blocks: DataFrame, angle: float) -> DataFrame:
    """The streaming twin of cut_at_angle(). Within a trigger, a sensor's blocks are
    put in order; between triggers they must come in order."""
    schema = "sensor long, seq long, azimuth double, scan_id long"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, scan = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("seq")
        out = []
        for a in rows.azimuth:
            out.append(scan)
            if last is not None and ((last < angle <= a) if last <= a else (last < angle or angle <= a)):
                scan += 1
            last = a
        state.update((last, scan))
        yield rows.assign(scan_id=out)[["sensor", "seq", "azimuth", "scan_id"]]

    keyed = blocks.select(c("sensor").cast("long"), c("seq").cast("long"), c("azimuth").cast("double")).groupBy("sensor")
    return keyed.applyInPandasWithState(run, schema, "last double, scan long", "append", GroupStateTimeout.NoTimeout)


def late_stream(updates: DataFrame, interval: str, watermark: str = "10 minutes") -> DataFrame:
    """The watchdog as a stream: sessions of updates (sensor, ts) that follow each
    other within the interval; a session that ends is an alarm at its last update."""
    u = updates.withWatermark("ts", watermark)
    return u.groupBy(F.session_window("ts", interval).alias("w"), "sensor").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n_updates")).select("sensor", "last_ts", "n_updates")


def sync_streams(left: DataFrame, right: DataFrame, interval: str, watermark: str = "1 minute") -> DataFrame:
    """Pairs of two streams (key, id, ts) of one key, no farther apart than the
    interval; state is kept for as long as the watermark and the interval ask."""
    a = left.select("key", c("id").alias("left_id"), c("ts").alias("left_ts")).withWatermark("left_ts", watermark)
    b = right.select(c("key").alias("right_key"), c("id").alias("right_id"), c("ts").alias("right_ts")).withWatermark("right_ts", watermark)
    near = F.expr(f"key = right_key and right_ts between left_ts - interval {interval} and left_ts + interval {interval}")
    return a.join(b, near).drop("right_key")


def run_once(stream: DataFrame) -> DataFrame:
    """Run a query over what is there now; its rows as a table of the shared folder."""
    from scanlake.storage import shared_dir

    spark = stream.sparkSession
    path = shared_dir(spark)
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
