"""Bringing sensors together in time and into one frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions.geometry import c, rigid

_UNIT = {f"m{i}{j}": float(i == j) for i in (1, 2, 3) for j in (1, 2, 3)} | {"tx": 0.0, "ty": 0.0, "tz": 0.0}


def lookup_transform(rows: DataFrame, tf: DataFrame, target: str) -> DataFrame:
    """Rows (source, ...) with the transform to `target`: the identity where there
    is none. known: whether there is one, or source and target are the same."""
    own = tf.filter(F.col("target") == target).drop("target").withColumn("_found", F.lit(True))
    out = rows.join(F.broadcast(own), "source", "left")
    out = out.withColumn("known", F.coalesce("_found", F.lit(False)) | (F.col("source") == target)).drop("_found")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(x)) for k, x in _UNIT.items()})


def concatenate(points: DataFrame, tf: DataFrame, target: str) -> DataFrame:
    """Points (frame_id, sensor, stamp, x, y, z, ...) of all sensors of a frame in
    one frame of reference, at the frame's oldest stamp."""
    x, y, z = rigid("x", "y", "z")
    moved = lookup_transform(points.withColumnRenamed("sensor", "source"), tf, target)
    moved = moved.withColumns({"_x": x, "_y": y, "_z": z}).drop("x", "y", "z", "known", *_UNIT).withColumnsRenamed({"_x": "x", "_y": "y", "_z": "z", "source": "sensor"})
    # One row a frame: a grouped minimum, not a window over the frame's points.
    oldest = points.groupBy("frame_id").agg(F.min("stamp").alias("stamp"))
    return moved.drop("stamp").join(oldest, "frame_id")


def approximate_sync(left: DataFrame, right: DataFrame, interval_ns: int) -> DataFrame:
    """For each left row the right row nearest in time within the interval; ties go
    to the smaller event_id. `left`, `right`: event_id, t_ns.

    Only two right rows can be nearest: the last not after and the first not before. Both
    sides go into one ordered stream per bucket of the interval, the right ones also into
    the buckets beside, so the cost is a sort, however many stamps lie in a bucket."""
    # Of equal stamps the smallest id stands for all.
    r = right.groupBy("t_ns").agg(F.min("event_id").alias("other"))
    r = r.withColumn("_b", F.explode(F.array(*(F.floor(c("t_ns") / interval_ns) + k for k in (-1, 0, 1)))))
    l = left.select("event_id", "t_ns", F.floor(c("t_ns") / interval_ns).alias("_b"))  # noqa: E741
    stream = l.withColumn("_r", F.lit(None).cast("struct<t:bigint,other:bigint>")).unionByName(
        r.select(F.lit(None).cast(left.schema["event_id"].dataType).alias("event_id"), "t_ns", "_b", F.struct(c("t_ns").cast("long").alias("t"), c("other").cast("long").alias("other")).alias("_r"))
    )
    # Frames by stamp take in all rows of a stamp, so a right row at a left row's own is both.
    # What comes after is what came before in the opposite order: Spark begins a frame that
    # reaches to the end anew for each row, so its cost would be the square of a bucket.
    up_to = lambda order: Window.partitionBy("_b").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    met = stream.withColumns({
        "_p": F.last("_r", ignorenulls=True).over(up_to(F.asc("t_ns"))), "_n": F.last("_r", ignorenulls=True).over(up_to(F.desc("t_ns"))),
    }).filter("_r is null")
    near = lambda x: F.when(F.col(f"{x}.t").isNotNull(), F.struct(F.abs(F.col(f"{x}.t") - c("t_ns")).alias("dt"), F.col(f"{x}.other").alias("other")))
    best = met.withColumn("m", F.least(near("_p"), near("_n"))).filter(F.col("m.dt") <= interval_ns)
    return best.select("event_id", F.col("m.other").alias("other"), F.col("m.dt").alias("dt"))


def nearest_sets(lead: DataFrame, others: list[DataFrame], interval_ns: int) -> DataFrame:
    """For each row of `lead` the nearest of every other input within the interval (ties:
    the smaller id), where each has one: event_id, id_i and dt_i. All:
    event_id, t_ns."""
    out = lead.select("event_id")
    for i, x in enumerate(others, 1):
        found = approximate_sync(lead, x, interval_ns).select("event_id", c("other").alias(f"id_{i}"), c("dt").alias(f"dt_{i}"))
        out = out.join(found, "event_id")
    return out


def collect_groups(messages: DataFrame, timeout_ns: int) -> DataFrame:
    """Collector groups (t14): messages of a key that follow each other within the
    timeout form a group; of each sensor its first message counts. `messages`: key,
    sensor, t_ns, event_id."""
    order = Window.partitionBy("key").orderBy("t_ns", "event_id")
    gap = F.coalesce(c("t_ns") - F.lag("t_ns").over(order) > timeout_ns, F.lit(True))
    rows = messages.withColumn("_new", gap.cast("int")).withColumn("group_no", F.sum("_new").over(order))
    first = Window.partitionBy("key", "group_no", "sensor").orderBy("t_ns", "event_id")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_new")
