"""Operators that go through the points of a ring or the stamps of a sensor in
order. A ring or sensor is the window's key, so a frame never meets in one task
because of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions.geometry import TAU, c


def organize(points: DataFrame) -> DataFrame:
    """ring_pos: a point's place in its ring, by original index."""
    order = Window.partitionBy("frame_id", "channel").orderBy("point_idx")
    return points.withColumn("ring_pos", (F.row_number().over(order) - 1).cast("int"))


def ring_outliers(points: DataFrame, n: int = 5, ratio: float = 1.03, length: float = 0.1, step: float = 1.0) -> DataFrame:
    """keep: whether the walk through a point is long enough. A walk goes on while
    neighbours' distances differ by less than `ratio` and their azimuths (radians)
    by less than `step` degrees; it is cut to the window [i - n, i + n). A point
    stays if its walk has over n points or is at least `length` from end to end.

    Breaks between neighbours number the islands of a ring; where an island meets
    the window is index arithmetic, and the walk's ends are looked up by lead and
    lag within the window's reach."""
    order = Window.partitionBy("frame_id", "channel").orderBy("point_idx")
    p = organize(points)
    d0, a0 = F.lag("distance").over(order), F.lag("azimuth").over(order)
    turn = c("azimuth") - a0
    turn = F.when(turn < 0, turn + TAU).otherwise(turn)
    broken = d0.isNull() | (F.greatest(d0, c("distance")) >= F.least(d0, c("distance")) * ratio) | (F.degrees(turn) >= step)
    p = p.withColumn("_new", broken.cast("int")).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("frame_id", "channel", "_island")
    p = p.withColumns({"_lo": F.min("ring_pos").over(island), "_hi": F.max("ring_pos").over(island)})
    p = p.withColumns({"_lo": F.greatest("_lo", F.col("ring_pos") - n), "_hi": F.least("_hi", F.col("ring_pos") + n - 1)})
    around = order.rowsBetween(-n, n - 1)
    p = p.withColumn("_near", F.collect_list(F.struct("ring_pos", "x", "y", "z")).over(around))  # 2 n points
    end = lambda k: F.element_at("_near", (F.col(k) - F.element_at("_near", 1)["ring_pos"] + 1).cast("int"))
    p = p.withColumns({"_a": end("_lo"), "_b": end("_hi")})
    far = sum(((F.col(f"_a.{k}") - F.col(f"_b.{k}")) * (F.col(f"_a.{k}") - F.col(f"_b.{k}")) for k in "xyz"), F.lit(0.0))
    p = p.withColumn("walk", (F.col("_hi") - F.col("_lo") + 1).cast("int")).withColumn("keep", (F.col("walk") > n) | (far >= length * length))
    return p.drop("_new", "_island", "_lo", "_hi", "_near", "_a", "_b")


def integrate_2d(twists: DataFrame, *keys: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Poses by dead reckoning: at each twist the heading moves first, then the
    place, along the new heading. The first twist stands at the origin. Of equal stamps
    the first by `ties` moves."""
    order = Window.partitionBy(*keys).orderBy("t_ns", *ties)
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    dt = F.coalesce((c("t_ns") - F.lag("t_ns").over(order)) / 1e9, F.lit(0.0))
    t = twists.withColumn("dt", dt).withColumn("theta", F.sum(c("wz") * c("dt")).over(up_to))
    t = t.withColumns({"px": F.sum(c("vx") * c("dt") * F.cos("theta")).over(up_to), "py": F.sum(c("vx") * c("dt") * F.sin("theta")).over(up_to)})
    return t.drop("dt")


def rates(stream: DataFrame, n: int, low_hz: float, high_hz: float, key: str = "sensor") -> DataFrame:
    """Average rate over the last n gaps, and whether it is complete and in bounds."""
    order = Window.partitionBy(key).orderBy("t_ns", "event_id")
    gap = (c("t_ns") - F.lag("t_ns").over(order)) / 1e9
    s = stream.withColumn("_rate", F.when(gap > 0, 1 / gap))
    last = order.rowsBetween(-(n - 1), 0)
    s = s.withColumns({"n_gaps": F.count("_rate").over(last), "rate_hz": F.avg("_rate").over(last)})
    return s.withColumn("valid", (F.col("n_gaps") == n) & F.col("rate_hz").between(low_hz, high_hz)).drop("_rate")


def drops(stream: DataFrame, cycle_ns: int, key: str = "sensor", factor: float = 1.75) -> DataFrame:
    """Per sensor: messages, empty ones, and gaps of over `factor` cycles with the
    messages they stand for."""
    order = Window.partitionBy(key).orderBy("t_ns", "event_id")
    gap = c("t_ns") - F.lag("t_ns").over(order)
    s = stream.withColumn("_gap", gap).withColumn("_drop", F.col("_gap") > factor * cycle_ns)
    missed = F.when(F.col("_drop"), F.round(F.col("_gap") / cycle_ns).cast("long") - 1).otherwise(F.lit(0))
    return s.groupBy(key).agg(
        F.count("*").alias("n_messages"), F.count_if(F.col("n_objects") == 0).alias("n_empty"), F.count_if("_drop").alias("n_drops"), F.sum(missed).cast("long").alias("n_missed"),
        F.min("t_ns").alias("first_ns"), F.max("t_ns").alias("last_ns"),
    )


def drop_rates(counted: DataFrame, cycle_ns: int) -> DataFrame:
    """Shares of dropped and empty messages among those due between first and last."""
    due = F.round((F.col("last_ns") - F.col("first_ns")) / cycle_ns) + 1
    return counted.withColumns({"drop_rate": F.when(due > 0, F.greatest(F.lit(0.0), 1 - F.col("n_messages") / due)).otherwise(F.lit(0.0)), "empty_rate": F.col("n_empty") / F.col("n_messages")})


def late(stream: DataFrame, interval_ns: int, key: str = "sensor") -> DataFrame:
    """Watchdog: updates that nothing follows within the interval."""
    order = Window.partitionBy(key).orderBy("t_ns", "event_id")
    return stream.withColumn("next_ns", F.lead("t_ns").over(order)).withColumn("is_late", F.coalesce(F.col("next_ns") - c("t_ns") > interval_ns, F.lit(False)))


def counter_drops(stream: DataFrame, counter: str = "counter", key: str = "sensor") -> DataFrame:
    """Increments of a 32-bit counter that wraps."""
    order = Window.partitionBy(key).orderBy("t_ns", "event_id")
    step = c(counter) - F.lag(counter).over(order)
    return stream.withColumn("dropped", F.coalesce(F.pmod(step, F.lit(1 << 32)), F.lit(0)))


def trim_queue(twists: DataFrame, first_point_ns: int, keep_ns: int = 1_000_000_000) -> DataFrame:
    """Twists that may matter from the first point on: none older than `keep_ns`
    before the newest, from the last one before the first point."""
    edge = twists.agg(F.max("t_ns").alias("newest"), F.max(F.when(c("t_ns") < first_point_ns, c("t_ns"))).alias("before"))
    t = twists.join(F.broadcast(edge))
    return t.filter((c("t_ns") >= F.col("newest") - keep_ns) & ((c("t_ns") >= first_point_ns) | (c("t_ns") == F.col("before")))).drop("newest", "before")
