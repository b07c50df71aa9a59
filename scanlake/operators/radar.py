"""Radar lists: decoding, validation, assembly and conversions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions.binary import bits, crc16, uint_be
from scanlake.functions.geometry import c

# What a payload is, by service, method and length.
ARS_MESSAGES = {"status": (0, 380, 84), "detection": (0, 336, 35_336), "object": (0, 329, 9_401)}
#: Radars mounted at a corner send no objects of use.
CORNER_DEG = (5.0, 90.0)

# Field, least, most, resolution.
FIELDS = [
    ("azimuth", -math.pi, math.pi, None), ("azimuth_std", 0.0, 1.0, None), ("elevation", -math.pi, math.pi, None), ("elevation_std", 0.0, 1.0, None), ("range", 0.0, 301.0, None), ("range_std", 0.0, 1.0, None),
    ("range_rate", -100.0, 100.0, 0.0), ("range_rate_std", 0.0, 1.0, None), ("rcs", -128.0, 127.0, 1.0), ("measurement_id", 0.0, 65535.0, 1.0), ("positive_predictive_value", 0.0, 100.0, 1.0),
    ("classification", 0.0, 255.0, 1.0), ("multi_target_probability", 0.0, 1.0, 0.01), ("object_id", 0.0, 65535.0, 1.0), ("ambiguity_flag", 0.0, 1.0, 0.01), ("age", 0.0, 65535.0, 1.0),
    ("position_x", -1600.0, 1600.0, None), ("position_y", -1600.0, 1600.0, None), ("position_z", -1600.0, 1600.0, None), ("orientation", -math.pi, math.pi, None), ("existence_probability", 0.0, 1.0, 0.01),
]

#: Bits of a detection's mask of invalid values.
INVALID_BITS = ("distance", "distance_std", "azimuth", "azimuth_std", "elevation", "elevation_std", "range_rate", "range_rate_std")


def field_info(spark) -> DataFrame:
    return spark.createDataFrame(FIELDS, "field string, min_value double, max_value double, resolution double")


def dispatch(packets: DataFrame, kind: str) -> DataFrame:
    """Messages of a kind: their ids and their length must fit."""
    service, method, size = ARS_MESSAGES[kind]
    return packets.filter((c("service_id") == service) & (c("method_id") == method) & (F.length("data") == size))


def is_corner(yaw) -> Column:
    degrees = F.abs(F.degrees(c(yaw)))
    return (degrees > CORNER_DEG[0]) & (degrees < CORNER_DEG[1])


def detections(lists: DataFrame, most: int = 800) -> DataFrame:
    """A row for each of the first n entries of a list's arrays, with a flag for
    each bit of its mask. `lists`: list_id, n, entries (array of structs with
    invalid_flags)."""
    rows = lists.select("list_id", F.posexplode(F.slice("entries", 1, F.least(c("n"), F.lit(most)))).alias("idx", "e")).select("list_id", "idx", "e.*")
    return rows.withColumns({f"invalid_{n}": c("invalid_flags").bitwiseAND(F.lit(1 << i)) != 0 for i, n in enumerate(INVALID_BITS)})


def violations(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per field: rows, and those outside its bounds. One pass, partial sums."""
    known = {f: (lo, hi) for f, lo, hi, _ in FIELDS}
    bad = {n: ~c(n).between(*known[n]) for n in names}
    sums = rows.agg(F.count("*").alias("n"), *(F.count_if(b).alias(n) for n, b in bad.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), c("n").alias("n_rows"), c(n).alias("n_bad")) for n in names))).alias("x")).select("x.*")


def flag_names(mask, names: dict[int, str], none: str = "OK") -> Column:
    """The names of the bits set in a mask, joined; `none` without any."""
    each = F.filter(F.array(*(F.when(c(mask).bitwiseAND(F.lit(1 << b)) != 0, n) for b, n in names.items())), lambda x: x.isNotNull())
    return F.when(F.size(each) == 0, none).otherwise(F.array_join(each, ", "))


def coded(value, names: dict[int, str], other: str = "INVALID") -> Column:
    """'1:NAME' of an enumerated value."""
    out = F.lit(other)
    for k, n in names.items():
        out = F.when(c(value) == k, n).otherwise(out)
    return F.concat(c(value).cast("string"), F.lit(":"), out)


def detections_to_points(d: DataFrame) -> DataFrame:
    """Cartesian points; percentages as shares."""
    flat = F.cos("elevation") * c("range")
    return d.withColumns({"x": flat * F.cos("azimuth"), "y": flat * F.sin("azimuth"), "z": F.sin("elevation") * c("range"), "probability": c("positive_predictive_value") / 100.0})


def valid_scan(d: DataFrame) -> DataFrame:
    """Detections without any invalid value."""
    return d.filter(c("invalid_flags") == 0)


#: The nine reference points of a box, as shares of length and width from its centre.
REFERENCE = [(0, 0.5, 0.5), (1, 0.5, 0.0), (2, 0.5, -0.5), (3, 0.0, -0.5), (4, -0.5, -0.5), (5, -0.5, 0.0), (6, -0.5, 0.5), (7, 0.0, 0.5), (8, 0.0, 0.0)]
#: Classes in order of priority; of equals the first wins.
CLASSES = ("car", "truck", "motorcycle", "bicycle", "pedestrian", "animal", "hazard", "unknown")


def tracks(objects: DataFrame) -> DataFrame:
    """Centres of tracked boxes from the reference point given (any other counts as
    the centre), the likeliest class, variances, and a uuid made of the id."""
    fx, fy = F.lit(0.0), F.lit(0.0)
    for k, a, b in REFERENCE:
        fx, fy = F.when(c("reference") == k, a).otherwise(fx), F.when(c("reference") == k, b).otherwise(fy)
    ox, oy = -fx * c("length"), -fy * c("width")
    x = c("x") + ox * F.cos("orientation") - oy * F.sin("orientation")
    y = c("y") + ox * F.sin("orientation") + oy * F.cos("orientation")
    best, label = c(f"p_{CLASSES[0]}"), F.lit(CLASSES[0])
    for n in CLASSES[1:]:
        label = F.when(c(f"p_{n}") > best, n).otherwise(label)
        best = F.greatest(best, c(f"p_{n}"))
    return objects.withColumns({"cx": x, "cy": y, "label": label, "var_x": c("std_x") * c("std_x"), "var_y": c("std_y") * c("std_y"), "uuid": F.lpad(F.lower(F.hex("object_id")), 32, "0")})


def normalized_objects(objects: DataFrame) -> DataFrame:
    """Status codes as names, covariance as an array, classes as a list by score."""
    scores = F.array(*(F.struct(c(f"p_{n}").alias("score"), F.lit(n).alias("name")) for n in CLASSES))
    status = F.when(c("status") == 0, "measured").when(c("status") == 1, "new").when(c("status") == 2, "predicted").otherwise("invalid")
    return objects.withColumns({
        "status_name": status, "covariance": F.array(c("std_x") * c("std_x"), F.lit(0.0), F.lit(0.0), c("std_y") * c("std_y")),
        "classes": F.transform(F.array_sort(scores, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)), lambda s: s["name"]),
    })


def vanished(ids: DataFrame) -> DataFrame:
    """frame_no, object_id, each once: ids that the frame before had and this one lacks.
    What a frame has and what the one before had meet as sums by frame and id, without a
    sort; no frame is gathered."""
    here = ids.select("frame_no", "object_id", F.lit(True).alias("here"))
    before = ids.select((c("frame_no") + 1).alias("frame_no"), "object_id", F.lit(False).alias("here"))
    gone = here.unionByName(before).groupBy("frame_no", "object_id").agg(F.bool_or("here").alias("here")).filter(~c("here"))
    return gone.select("frame_no", "object_id").join(ids.select("frame_no").distinct(), "frame_no", "left_semi")


# Near detections, resolution and offset of a field.
NEAR = {"range": (0.024420024, 0.0), "azimuth": (0.006159986, -1.570796327), "range_rate": (0.014662757, -15.0), "rcs": (0.476190476, -40.0), "snr": (1.7, 11.0)}
FRAGMENT = 6


def near_detections(packets: DataFrame, per_packet: int = 10, at: int = 0) -> DataFrame:
    """packet_id, idx and fields of six-byte fragments: 12 bits of range, 9 of
    azimuth, 11 of range rate, 7 of cross section, five flags, 4 of signal to noise.
    Those beyond the list's count are filler."""
    p = packets.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_packet - 1))))
    p = p.withColumn("v", uint_be("data", at + c("k") * FRAGMENT, FRAGMENT)).withColumn("idx", c("message") * per_packet + c("k")).filter(c("idx") < c("n_detections"))
    raw = {"range": bits("v", 36, 12), "azimuth": bits("v", 27, 9), "range_rate": bits("v", 16, 11), "rcs": bits("v", 9, 7), "snr": bits("v", 0, 4)}
    fields = {n: raw[n] * NEAR[n][0] + NEAR[n][1] for n in raw}
    flags = {f"pdh0{i}": bits("v", b, 1) * 100 for i, b in enumerate((8, 7, 6, 5, 4))}
    return p.select("packet_id", "idx", *(e.alias(n) for n, e in (fields | flags).items()))


def fragment_hex(range_, azimuth, range_rate, rcs, flags, snr) -> Column:
    """Hexadecimal text of a fragment, as near_detections() takes apart."""
    v = F.shiftleft(c(range_).cast("long"), 36) + F.shiftleft(c(azimuth).cast("long"), 27) + F.shiftleft(c(range_rate).cast("long"), 16) + F.shiftleft(c(rcs).cast("long"), 9) + F.shiftleft(c(flags).cast("long"), 4) + c(snr)
    return F.lpad(F.hex(v), 12, "0")


def assemble(messages: DataFrame, expected: int, bucket: int = 1 << 16) -> DataFrame:
    """Groups header, elements, checksum of one sensor in order: group_no, n_elements
    and whether the group is whole: as many elements as expected and a matching
    CRC-16 over header and elements. `messages`: sensor, seq, kind (header, element,
    crc), data; a checksum's data is two bytes. A group is at most a few dozen
    messages, which bounds its array; the groups of a sensor are numbered `bucket`
    messages a task."""
    from scanlake.streaming.scans import carried

    header = c("kind") == "header"
    m = carried(messages, lambda last: header, header, ["sensor"], "seq", bucket, "group_no").filter("group_no > 0")
    body = F.array_sort(F.collect_list(F.when(c("kind") != "crc", F.struct("seq", F.hex("data").alias("h")))))
    g = m.groupBy("sensor", "group_no").agg(
        F.count_if(c("kind") == "element").alias("n_elements"), body.alias("_b"), F.max_by(F.when(c("kind") == "crc", uint_be("data", F.lit(0), 2)), F.when(c("kind") == "crc", c("seq"))).alias("_crc"),
    )
    text = F.unhex(F.array_join(F.transform("_b", lambda x: x["h"]), ""))
    return g.withColumn("whole", (c("n_elements") == expected) & F.coalesce(crc16(text) == c("_crc"), F.lit(False))).drop("_b", "_crc")


def radar_scan(d: DataFrame) -> DataFrame:
    """Near detections that are neither ghosts (pdh00) nor of a lobe beside (pdh02)."""
    return d.filter((c("pdh00") == 0) & (c("pdh02") == 0))


def srr_tracks(objects: DataFrame) -> DataFrame:
    """Objects with a valid box and a status."""
    return objects.filter(c("box_valid") & (c("status") != 0))


def diagnostics(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Per source the worst level and the metrics that are off. `rows`: source,
    metric, value; `rules`: metric, low, high, level (1 warning, 2 error)."""
    met = rows.join(F.broadcast(rules), "metric")
    off = ~c("value").between(c("low"), c("high"))
    return met.groupBy("source").agg(F.max(F.when(off, c("level")).otherwise(0)).alias("level"), F.array_join(F.array_sort(F.collect_set(F.when(off, c("metric")))), ", ").alias("message"))


