"""Images and labels as tables: pixel formats, sizes, label polygons, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions.binary import byte_at, yuv_rgb
from scanlake.functions.geometry import c
from scanlake.storage import materialize


def snapped_size(width, height, cap: int = 1280, step: int = 32) -> Column:
    """The longer side, at most `cap`, rounded up to whole steps."""
    return (F.ceil(F.least(F.greatest(c(width), c(height)), F.lit(cap)) / step) * step).cast("long")


#: Byte order of a packed pair of pixels: places of y0, u, y1, v.
PAIRS = {"yuyv": (0, 1, 2, 3), "uyvy": (1, 0, 3, 2)}

#: Name, colour, bytes a pixel, bits a channel, alpha, Bayer.
FORMATS = [
    ("rgb8", True, 3, 8, False, False), ("rgba8", True, 4, 8, True, False), ("bgr8", True, 3, 8, False, False), ("bgra8", True, 4, 8, True, False), ("mono8", False, 1, 8, False, False),
    ("mono16", False, 2, 16, False, False), ("yuv422", True, 2, 8, False, False), ("yuv422_yuy2", True, 2, 8, False, False), ("bayer_rggb8", False, 1, 8, False, True), ("bayer_bggr8", False, 1, 8, False, True),
    ("bayer_gbrg8", False, 1, 8, False, True), ("bayer_grbg8", False, 1, 8, False, True),
]
FORMAT_SCHEMA = "encoding string, is_color boolean, bytes_per_pixel int, bit_depth int, has_alpha boolean, is_bayer boolean"


def format_table(spark) -> DataFrame:
    f = spark.createDataFrame(FORMATS, FORMAT_SCHEMA)
    return f.withColumn("is_mono", ~F.col("is_color") & ~F.col("is_bayer"))


def packed_yuv_to_rgb(images: DataFrame, order: str = "yuyv") -> DataFrame:
    """image_id, pixel, r, g, b of images (image_id, data) of packed pixel pairs."""
    y0, u, y1, v = PAIRS[order]
    pairs = images.withColumn("pair", F.explode(F.sequence(F.lit(0), F.floor(F.length("data") / 4).cast("int") - 1)))
    at = {k: byte_at("data", F.col("pair") * 4 + o) for k, o in (("y0", y0), ("u", u), ("y1", y1), ("v", v))}
    pairs = pairs.select("image_id", "pair", *(e.alias(k) for k, e in at.items()))
    two = pairs.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("y", F.when(F.col("half") == 0, F.col("y0")).otherwise(F.col("y1")))
    r, g, b = yuv_rgb("y", "u", "v")
    return two.select("image_id", (F.col("pair") * 2 + F.col("half")).alias("pixel"), r.alias("r"), g.alias("g"), b.alias("b"))


def mono8(images: DataFrame) -> DataFrame:
    """image_id, pixel, grey of images of a byte a pixel."""
    p = images.withColumn("pixel", F.explode(F.sequence(F.lit(0), F.length("data") - 1))).filter(F.length("data") > 0)
    return p.select("image_id", "pixel", byte_at("data", F.col("pixel")).alias("grey"))


def planar_yuv_to_rgb(images: DataFrame) -> DataFrame:
    """image_id, pixel, r, g, b of images (image_id, width, height, data) that hold a
    plane of Y and planes of V and U at half the size, of studio range. Images too short
    for their size are left out. Widths and heights are even."""
    size, half = c("width") * c("height"), F.expr("width div 2")
    p = images.filter(F.length("data") * 2 >= size * 3).withColumn("pixel", F.explode(F.sequence(F.lit(0), size - 1)))
    x, y = c("pixel") % c("width"), F.floor(c("pixel") / c("width")).cast("int")
    chroma = F.floor(y / 2).cast("int") * half + F.floor(x / 2).cast("int")
    quarter = F.expr("(width div 2) * (height div 2)")
    p = p.select("image_id", "pixel", byte_at("data", c("pixel")).alias("y"), (byte_at("data", size + chroma) - 128).alias("v"), (byte_at("data", size + quarter + chroma) - 128).alias("u"))
    # Factors in units of 2^-20.
    light = F.greatest(F.lit(0).cast("long"), c("y") - 16) * 1_220_542 + (1 << 19)
    channel = lambda e: F.greatest(F.lit(0).cast("long"), F.least(F.lit(255).cast("long"), F.shiftright(e, 20)))
    r, g, b = light + c("v") * 1_673_527, light - c("v") * 852_492 - c("u") * 409_993, light + c("u") * 2_116_026
    return p.select("image_id", "pixel", channel(r).alias("r"), channel(g).alias("g"), channel(b).alias("b"))


def jpegs_to_rgb(spark, path: str) -> DataFrame:
    """image_id (the file), width, height, pixel, r, g, b of JPEG frames kept as files,
    read by Spark's image source; files that are no images are passed over."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").filter("nChannels = 3")
    p = i.withColumn("pixel", F.explode(F.sequence(F.lit(0), c("width") * c("height") - 1)))
    # The source's order is blue, green, red.
    b, g, r = (byte_at("data", c("pixel") * 3 + k) for k in range(3))
    return p.select(c("origin").alias("image_id"), "width", "height", "pixel", r.alias("r"), g.alias("g"), b.alias("b"))


def to_pixmap(pixels: DataFrame) -> DataFrame:
    """image_id, data: colour images (image_id, width, height, pixel, r, g, b) as portable
    pixmaps, for a file or message each. The bytes of one image are gathered in a task."""
    text = F.concat(*(F.lpad(F.hex(k), 2, "0") for k in "rgb"))
    g = pixels.groupBy("image_id", "width", "height").agg(F.array_sort(F.collect_list(F.struct("pixel", text.alias("h")))).alias("p"))
    head = F.hex(F.encode(F.concat(F.lit("P6\n"), c("width").cast("string"), F.lit(" "), c("height").cast("string"), F.lit("\n255\n")), "US-ASCII"))
    return g.select("image_id", F.unhex(F.concat(head, F.array_join(F.transform("p", lambda x: x["h"]), ""))).alias("data"))


def y10_to_mono8(images: DataFrame) -> DataFrame:
    """image_id, pixel, grey of images of little-endian 10-bit values in 16 bits."""
    p = images.withColumn("pixel", F.explode(F.sequence(F.lit(0), F.floor(F.length("data") / 2).cast("int") - 1)))
    value = byte_at("data", F.col("pixel") * 2) + byte_at("data", F.col("pixel") * 2 + 1) * 256
    return p.select("image_id", "pixel", F.shiftright(value, 2).bitwiseAND(F.lit(255)).alias("grey"))


def four_cc(code) -> Column:
    """A four-character code from its 32-bit value, first character lowest."""
    return F.concat(*(F.char(F.shiftright(c(code), 8 * i).bitwiseAND(F.lit(255))) for i in range(4)))


def parse_labels(lines: DataFrame) -> DataFrame:
    """file, line, class, poly (array of x, y) of label text: a class id, then
    pairs. Lines with a stray number or under three corners are left out."""
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    rows = lines.withColumn("w", words).filter((F.size("w") >= 7) & (F.size("w") % 2 == 1))
    point = lambda i: F.struct(F.element_at("w", 2 * i + 2).cast("double").alias("x"), F.element_at("w", 2 * i + 3).cast("double").alias("y"))
    poly = F.transform(F.sequence(F.lit(0), ((F.size("w") - 3) / 2).cast("int")), point)
    return rows.select("file", "line", F.element_at("w", 1).cast("int").alias("class"), poly.alias("poly"))


def merge_pairs(images: DataFrame, labels: DataFrame, prefix: str, digits: int = 6) -> DataFrame:
    """Images and labels of equal stem, renamed to the prefix and a running index."""
    stem = lambda n: F.regexp_replace(n, r"\.[^.]*$", "")
    both = images.withColumn("stem", stem("image")).join(labels.withColumn("stem", stem("label")), "stem")
    return running_index(both, "stem").withColumn("name", F.concat(F.lit(prefix), F.lpad(c("index").cast("string"), digits, "0"))).select("stem", "image", "label", "name")


def running_index(rows: DataFrame, key: str) -> DataFrame:
    """Rows with `index`, their place in the order of a column, from 0. Ranges of the key
    are sorted each on its own; where a range begins follows from a count for each. The
    ranges are written first, as both steps must see the same."""
    # Equal keys share a range, as it is cut by the key alone.
    parts = materialize(rows.repartitionByRange(c(key)).withColumn("_range", F.spark_partition_id()))
    starts = parts.groupBy("_range").agg(F.count("*").alias("_n"))
    # A row for each range: as many as there are partitions.
    before = starts.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - c("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return parts.withColumn("_own", own).join(before, "_range").withColumn("index", c("_before") + c("_own")).drop("_range", "_own", "_before")


def split_train_validation(files: DataFrame, key: str, percent: int) -> DataFrame:
    """is_validation by hash of the key; if that leaves validation empty, the row of
    smallest hash goes there. The guarantee costs one aggregate of two numbers."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100
    f = files.withColumn("_b", bucket)
    facts = f.agg(F.count_if(F.col("_b") < percent).alias("_n"), F.min(F.struct("_b", key)).alias("_first"))
    out = f.join(F.broadcast(facts)).withColumn("is_validation", (F.col("_b") < percent) | ((F.col("_n") == 0) & (F.col(key) == F.col(f"_first.{key}"))))
    return out.drop("_b", "_n", "_first")


def model_metadata(models: DataFrame) -> DataFrame:
    """Version, size letter and task from a model's file name, e.g. 'netv8n-seg.pt'."""
    name = F.lower(F.regexp_extract("file", r"([^/]+)$", 1))
    size = {"n": "nano", "s": "small", "m": "medium", "l": "large", "x": "extra large"}
    letter = F.regexp_extract(name, r"[0-9]+([nsmlx])(?:[-_.]|$)", 1)
    label = F.lit("unknown")
    for k, v in size.items():
        label = F.when(letter == k, v).otherwise(label)
    task = F.when(name.contains("-seg"), "segment").when(name.contains("-pose"), "pose").when(name.contains("-cls"), "classify").when(name.contains("-obb"), "obb").otherwise("detect")
    return models.withColumns({"version": F.regexp_extract(name, r"v?([0-9]+)", 1), "size": label, "task": task})
