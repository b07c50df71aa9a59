"""Bytes to rows and back, images, normals, and orders over many tasks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.functions.binary import float_be
from scanlake.operators import aggregates, decode, imaging, joins, radar_packets
from scanlake.operators.sync import approximate_sync


def test_numbers_of_four_bytes(spark):
    values = [0.0, 1.0, -1.5, 3.4e38, 1e-40, -0.1, math.pi, float("inf")]
    df = spark.createDataFrame([(i, np.array(x, ">f4").tobytes()) for i, x in enumerate(values)], "i int, data binary")
    got = {r.i: r.x for r in df.select("i", float_be("data", F.lit(0)).alias("x")).collect()}
    assert [got[i] for i in range(7)] == [float(np.float32(x)) for x in values[:7]] and got[7] is None


@pytest.mark.parametrize("kind", ["detection", "object"])
def test_lists_round_trip(spark, kind):
    rng, record = np.random.default_rng(1), radar_packets.LISTS[kind]["entries"].base
    sizes = [0, 3, radar_packets.MOST[kind], radar_packets.MOST[kind]]
    lists = np.zeros(4, radar_packets.LISTS[kind])
    for i, n in enumerate(sizes):
        for k in record.names:
            t = record[k]
            lists["entries"][k][i, :n] = rng.normal(size=n) if t.kind == "f" else rng.integers(0, 100, n)
        lists["seconds"][i], lists["nanoseconds"][i], lists["sync_status"][i], lists["n"][i] = i, 5, 1, n
    lists["n"][3] = 255 if kind == "object" else 4000  # claims more than it holds
    service, method, _ = radar_packets.ARS_MESSAGES[kind]
    rows = [(i, service, method, x.tobytes()) for i, x in enumerate(lists)] + [(8, service, method, b"short"), (9, service, 1, lists[1].tobytes()), (10, service, method, None)]
    packets = spark.createDataFrame(rows, "packet_id long, service_id int, method_id int, data binary")
    got = radar_packets.entries(packets, kind).toPandas().sort_values(["packet_id", "idx"])
    assert got.groupby("packet_id").size().to_dict() == {1: 3, 2: sizes[2], 3: sizes[3]} and set(got.t_ns) == {1_000_000_005, 2_000_000_005, 3_000_000_005}
    for k in record.names:
        want = np.concatenate([lists["entries"][k][i, :n] for i, n in enumerate(sizes)]).astype(float)
        assert np.array_equal(got[k].to_numpy().astype(float), want), k


def test_status_is_named(spark):
    data = bytearray(84)
    data[16], data[40], data[59], data[62], data[81], data[82], data[83] = 2, 1, 7, 1, 5, 0, 0x23
    data[32:36], data[64:68] = np.array(0.5, ">f4").tobytes(), bytes([10, 13, 1, 113])
    packets = spark.createDataFrame([(1, 0, 380, bytes(data)), (2, 0, 380, bytes(data[:-1]))], "packet_id long, service_id int, method_id int, data binary")
    r = radar_packets.status_rows(packets).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.sync, r.plug, r.frequency_slot, r.country, r.yaw, r.address0) == ("2:NEVER_SYNC", "1:PLUG_LEFT", "7:Invalid", "1:Worldwide", 0.5, "10.13.1.113")
    assert (r.voltage, r.temperature, r.blockage) == ("Current undervoltage, Current overvoltage", "Ok", "3:Low. 2:Self test ongoing")


def test_fragment_bits(spark):
    """All fields of a fragment at their greatest, each between fields of 0."""
    names = [n for n in radar_packets.FRAGMENT if n != "reserved"]
    for name in names:
        width, step, least = radar_packets.FRAGMENT[name]
        top = (1 << width) - 1
        h = radar_packets.object_fragment_hex({name: F.lit(top).cast("long")})
        p = spark.range(1).select(F.lit(1).alias("packet_id"), F.lit(0).alias("message"), F.lit(1).alias("n_objects"), F.unhex(F.concat(F.lit("00000000"), h, F.lit("00" * 33))).alias("data"))
        r = radar_packets.object_fragments(p).first()
        for n in names:
            _, s, at_least = radar_packets.FRAGMENT[n]
            raw = top if n == name else 0
            assert float(r[n]) == pytest.approx(raw if s is None else raw * s + at_least), (name, n)


def test_blocks_of_unknown_words(spark):
    def packet(model, words):
        p = np.zeros(1, decode.LAYOUTS[model].packet)
        p["blocks"]["word"][0] = words
        return p.tobytes() + b"tail"

    words = [0xEEFF, 0xBBFF, 0x1111] + [0xEEFF] * 9
    df = spark.createDataFrame([(1, packet("VLS128", words)), (2, b"short"), (3, None)], "packet_id long, data binary")
    got = decode.open_blocks(df, "VLS128").groupBy("packet_id", "block").agg(F.min("channel").alias("c"), F.count("*").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 32), (1, 1, 96, 32)]
    # Where no word is needed, an unknown one counts from the first channel.
    df = spark.createDataFrame([(1, packet("VLP32", words))], "packet_id long, data binary")
    assert decode.open_blocks(df, "VLP32").filter("channel >= 32").count() == 0 and decode.open_blocks(df, "VLP32").count() == 384


def test_images_as_files(spark, tmp_path):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(16, 8, 1)
    for x in range(16):
        for y in range(8):
            image.setRGB(x, y, 200 << 16 | 100 << 8 | 50)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / "a.jpg")))
    (tmp_path / "b.jpg").write_bytes(b"no image")
    rgb = imaging.jpegs_to_rgb(spark, str(tmp_path))
    r = rgb.agg(F.count("*"), *(F.avg(k) for k in "rgb")).first()
    assert r[0] == 128 and all(abs(x - w) < 6 for x, w in zip(r[1:], (200, 100, 50)))
    data = bytes(imaging.to_pixmap(rgb).first().data)
    assert data.startswith(b"P6\n16 8\n255\n") and len(data) == 12 + 128 * 3


def test_planar_images(spark):
    planes = bytes([16] * 8 + [128, 128, 128, 128]), bytes([235] * 8 + [128, 128, 128, 128]), bytes([235] * 8)
    df = spark.createDataFrame([(i, 4, 2, p) for i, p in enumerate(planes)], "image_id int, width int, height int, data binary")
    got = imaging.planar_yuv_to_rgb(df).groupBy("image_id").agg(F.min("r"), F.max("g"), F.max("b"), F.count("*")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 0, 0, 8), (1, 255, 255, 255, 8)]  # the third has no colour


def test_normals_equal_numpy(spark):
    rng = np.random.default_rng(2)
    cloud = np.concatenate([rng.uniform(-1, 1, (60, 3)) * [1, 1, 0.05] + [3, 0, 1], [[9, 9, 9]], np.linspace(0, 0.2, 4)[:, None] * [[1, 0, 0]] + [-5, 0, 0]])
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(cloud)], "frame_id int, point_idx long, x double, y double, z double")
    got = {r.point_idx: r for r in aggregates.normals(df, 0.6).collect()}
    assert len(got) == len(cloud)
    for i, p in enumerate(cloud):
        near = cloud[((cloud - p) ** 2).sum(1) <= 0.36]
        r = got[i]
        assert r.n_neighbours == len(near)
        if i >= 60 or len(near) < 3:
            assert r.nx is None or i < 60
            continue
        values, vectors = np.linalg.eigh(np.cov(near.T, bias=True))
        n = vectors[:, 0] * (-1 if vectors[:, 0] @ p > 0 else 1)
        assert r.curvature == pytest.approx(max(values[0], 0) / values.sum(), abs=1e-6)
        if values[1] - values[0] > 1e-3:
            assert np.allclose([r.nx, r.ny, r.nz], n, atol=1e-5)


@pytest.mark.parametrize("seed", range(3))
def test_nearest_in_time_equals_a_plain_search(spark, seed):
    rng = random.Random(seed)
    a, b = [(i, rng.randrange(-300, 300)) for i in range(60)], [(i, rng.randrange(-300, 300)) for i in range(25)]
    schema = "event_id long, t_ns long"
    got = {r.event_id: (r.other, r.dt) for r in approximate_sync(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 10).collect()}
    want = {}
    for i, t in a:
        dt, other = min((abs(u - t), j) for j, u in b)
        if dt <= 10:
            want[i] = (other, dt)
    assert got == want


@pytest.mark.parametrize("keyed", [False, True])
def test_asof_equals_a_plain_search(spark, keyed):
    rng = random.Random(5)
    left = [(rng.randrange(3), i, rng.randrange(400)) for i in range(80)]
    right = [(rng.randrange(2), i, t) for i, t in enumerate(rng.sample(range(400), 30))]
    by = ("drive",) if keyed else ()
    l, r = spark.createDataFrame(left, "drive int, i long, t_ns long"), spark.createDataFrame(right, "drive int, j long, t_ns long")
    r = r if keyed else r.drop("drive")
    got = {x.i: x.r_j for x in joins.asof_forward(l, r, bucket_ns=50, by=by).collect()}
    for drive, i, t in left:
        own = [(u, j) for d, j, u in right if d == drive or not keyed]
        later = [x for x in own if x[0] >= t]
        assert got[i] == (min(later)[1] if later else max(own)[1] if own else None)


def test_index_over_many_ranges(spark):
    rng = random.Random(1)
    words = [f"f{rng.randrange(10**6):06d}" for _ in range(500)]
    got = imaging.running_index(spark.createDataFrame([(w,) for w in words], "stem string").repartition(7), "stem").orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(500)) and [r.stem for r in got] == sorted(words)
    assert imaging.running_index(spark.createDataFrame([], "stem string"), "stem").count() == 0


def test_nearest_stamps_make_no_frame_to_the_end(spark):
    """A frame that reaches to the end is begun anew for each row; nearest rows are those of
    two frames that grow, at a row's own stamp as well."""
    from scanlake.operators import joins, sync

    df = lambda rows: spark.createDataFrame(rows, "event_id long, t_ns long")
    left, right = df([(1, 10), (2, 20), (3, 29), (4, 90)]), df([(7, 20), (6, 20), (5, 12), (8, 30), (9, 28)])
    met = sync.approximate_sync(left, right, 10)
    found = joins.asof_forward(left, right, bucket_ns=7)
    assert all("UNBOUNDED FOLLOWING" not in x._jdf.queryExecution().optimizedPlan().toString().upper().replace("UNBOUNDEDFOLLOWING$", "UNBOUNDED FOLLOWING") for x in (met, found))
    assert sorted(map(tuple, met.collect())) == [(1, 5, 2), (2, 6, 0), (3, 8, 1)]
    assert sorted((r.event_id, r.r_t_ns) for r in found.collect()) == [(1, 12), (2, 20), (3, 30), (4, 30)]


def test_payloads_are_read_in_pieces(spark, monkeypatch):
    """No more than a piece of payloads is opened at a time, and no entry is lost."""
    import pyarrow as pa

    from scanlake.operators import radar_packets as R

    b = pa.RecordBatch.from_pydict({"packet_id": list(range(2 * R.PIECE + 5))})
    assert [x.num_rows for x in R._pieces([b])] == [R.PIECE, R.PIECE, 5]
    rows = spark.range(0, 600, 1, 1).selectExpr("id as packet_id", "id * 1000000007 as t_ns", "transform(sequence(0, cast(id % 3 as int)), k -> struct(id * 10 + k as object_id, cast(k as float) as x)) as entries")
    got = R.object_rows(R.to_lists(rows, "object")).select("packet_id", "t_ns", "n", "idx", "object_id", "x").collect()
    assert sorted(map(tuple, got)) == [(i, i * 1000000007, i % 3 + 1, k, i * 10 + k, float(k)) for i in range(600) for k in range(i % 3 + 1)]
