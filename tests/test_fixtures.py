"""Hand-checkable inputs, and the stated deviations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.functions import binary as B
from scanlake.functions import geometry as G
from scanlake.operators import aggregates, clouds, clustering, decode, ground, imaging, joins, motion, ordered, radar
from scanlake.operators.grid_ground import Grid, GridParams, grid_filter, pseudo_angle, pseudo_tan
from scanlake.streaming import scans


def points(spark, rows, extra=""):
    return spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(rows)], "frame_id int, point_idx long, x double, y double, z double" + extra)


def one(df):
    return df.first()[0]


def stamps(spark, seconds):
    return spark.createDataFrame([("a", i, int(s * 1e9)) for i, s in enumerate(seconds)], "sensor string, event_id long, t_ns long")


def test_b01_rate_in_bounds(spark):
    r = ordered.rates(stamps(spark, [0.1 * i for i in range(6)]), 5, 8.0, 12.0).orderBy("event_id").collect()[-1]
    assert (r.n_gaps, round(r.rate_hz, 6), r.valid) == (5, 10.0, True)


@pytest.mark.parametrize("gap,hz", [(0.2, 5.0), (1 / 15, 15.0)])
def test_b02_rate_out_of_bounds(spark, gap, hz):
    r = ordered.rates(stamps(spark, [gap * i for i in range(4)]), 3, 8.0, 12.0).orderBy("event_id").collect()[-1]
    assert round(r.rate_hz, 3) == hz and not r.valid


def test_b03_circular_interval(spark):
    df = spark.createDataFrame([(0.0,), (300.0,), (180.0,)], "a double")
    assert [r[0] for r in df.select(G.in_arc("a", 270.0, 90.0)).collect()] == [True, True, False]


def test_b04_crop_boundary_stays(spark):
    box = dict(min_x=-1.0, max_x=1.0, min_y=-1.0, max_y=1.0, min_z=-1.0, max_z=1.0)
    kept = clouds.crop(points(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)]), [box])
    assert sorted(r.point_idx for r in kept.collect()) == [1, 2]


def test_b05_roi_boundary_stays(spark):
    box = dict(min_x=0.0, max_x=2.0, min_y=-1.5, max_y=1.5, min_z=-0.5, max_z=1.5)
    kept = clouds.roi(points(spark, [(0, 0, 0), (2, 1.5, 1.5), (2.01, 0, 0)]), box)
    assert sorted(r.point_idx for r in kept.collect()) == [0, 1]


def ring(spark, distances):
    rows = [(0, i, 0, d, math.radians(0.2 * i)) for i, d in enumerate(distances)]
    df = spark.createDataFrame(rows, "frame_id int, point_idx long, channel int, distance double, azimuth double")
    return df.withColumns({"x": F.col("distance") * F.cos("azimuth"), "y": F.col("distance") * F.sin("azimuth"), "z": F.lit(0.0)})


def test_b06_b07_ring_outlier(spark):
    even = ordered.ring_outliers(ring(spark, [10.0] * 12))
    assert even.filter("keep").count() == 12
    odd = ordered.ring_outliers(ring(spark, [10.0] * 6 + [20.0] + [10.0] * 5))
    gone = [(r.point_idx, r.walk) for r in odd.filter("not keep").collect()]
    assert (6, 1) in gone


def test_b08_asof(spark):
    left = spark.createDataFrame([(5,), (10,), (11,), (35,)], "t_ns long")
    right = spark.createDataFrame([(10, 1.0), (20, 2.0), (30, 3.0)], "t_ns long, v double")
    for bucket in (7, 100):
        assert sorted((r.t_ns, r.r_t_ns) for r in joins.asof_forward(left, right, bucket_ns=bucket).collect()) == [(5, 10), (10, 10), (11, 20), (35, 30)]


def test_b09_undistort_2d(spark):
    twists = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1_000_000_000, 1.0, 0.0)], "k string, t_ns long, vx double, wz double")
    poses = joins.with_previous(ordered.integrate_2d(twists, "k"), "k").drop("k")
    p = spark.createDataFrame([(500_000_000, 0.0, 0.0)], "t_ns long, x double, y double")
    r = joins.undistort_2d(p, poses).first()
    assert (r.ux, r.uy) == (0.5, 0.0)


def test_undistort_3d_agrees_with_2d_in_the_plane(spark):
    twists = [("a", int(i * 1e8), 1.0 + i, 0.3) for i in range(6)]
    flat = spark.createDataFrame(twists, "k string, t_ns long, vx double, wz double")
    full = flat.select("k", "t_ns", "vx", F.lit(0.0).alias("vy"), F.lit(0.0).alias("vz"), F.lit(0.0).alias("wx"), F.lit(0.0).alias("wy"), "wz")
    pose = motion.integrate_3d(full, "k").orderBy("t_ns").collect()[-1]
    assert math.isclose(math.atan2(pose.r21, pose.r11), 0.3 * 0.5, abs_tol=1e-9)
    import numpy as np

    m = motion.exp_se3(np.array([[1.0, 0, 0]]), np.array([[0, 0, 2.0]]), np.array([1e-9]))
    assert math.isclose(m[0, 0, 3], 1e-9, rel_tol=1e-6)


def test_poses_are_carried_from_bucket_to_bucket(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2], int(i * 1e8), *map(float, rng.normal(size=6))) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t_ns long, vx double, vy double, vz double, wx double, wy double, wz double")
    one, many = (motion.integrate_3d(df, "k", b).orderBy("k", "t_ns").collect() for b in (10**12, 7 * 10**8))
    assert np.allclose(np.array([r[1:] for r in one], float), np.array([r[1:] for r in many], float), atol=1e-9) and len(one) == 200
    # One after another.
    pose, last = np.eye(4), None
    for r, (_, t, *tw) in zip((r for r in one if r.k == "a"), (r for r in rows if r[0] == "a")):
        pose = pose @ motion.exp_se3(np.array([tw[:3]]), np.array([tw[3:]]), np.array([(t - (t if last is None else last)) / 1e9]))[0]
        last = t
        assert np.allclose([r.px, r.py, r.pz, r.r11, r.r23], [*pose[:3, 3], pose[0, 0], pose[1, 2]], atol=1e-9)


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_cuts_are_carried_from_bucket_to_bucket(spark, bucket):
    import random

    from scanlake.streaming import scans

    rng = random.Random(bucket)
    rows = [(s, i * rng.choice([1, 1, 9]) + 100 * i, float(rng.randrange(360))) for s in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "sensor long, seq long, azimuth double")
    want, wrapped = {}, {}
    for s in range(3):
        last, scan, turn = None, 0, 0
        for _, seq, a in sorted(r for r in rows if r[0] == s):
            want[s, seq] = scan
            if last is not None:
                scan += (last < 90 <= a) if last <= a else (last < 90 or 90 <= a)
                turn += (a - 90) % 360 < (last - 90) % 360
            wrapped[s, seq], last = turn, a
    assert {(r.sensor, r.seq): r.scan_id for r in scans.cut_at_angle(df, 90.0, bucket=bucket).collect()} == want
    assert {(r.sensor, r.seq): r.scan_id for r in scans.cut_on_wrap(df, 90.0, 360.0, bucket=bucket).collect()} == wrapped


def test_b10_components(spark):
    p = points(spark, [(0, 0, 0), (0.5, 0, 0), (1.0, 0, 0), (3.0, 0, 0)])
    r = sorted((x.point_idx, x.label, x.cluster_id) for x in clustering.euclidean(p, 0.6, min_size=2).collect())
    assert [x[1] for x in r] == [0, 0, 0, 3] and [x[2] for x in r] == [0, 0, 0, -1]


def test_b11_range_image(spark):
    r = aggregates.range_image(points(spark, [(1, 0, 0)])).first()
    assert (r.col, r.row) == (180, 16)


def test_b12_colour(spark):
    df = spark.createDataFrame([(128, 128, 128), (255, 128, 128), (81, 90, 240)], "y int, u int, v int")
    assert [tuple(r) for r in df.select(*B.yuv_rgb("y", "u", "v")).collect()] == [(128, 128, 128), (255, 255, 255), (208, 32, 3)]


def test_b13_checksums(spark):
    df = spark.createDataFrame([(bytearray(b"123456789"),)], "d binary").select(B.crc16("d"), B.crc8_h2f("d"))
    assert tuple(df.first()) == (0x29B1, 0xDF)


def test_b14_timing(spark):
    df = spark.createDataFrame([(0, 0), (7, 31), (2, 1)], "block int, channel int")
    off = decode.block_offset_ns("PandarXT32", "block", F.lit(2)) + decode.channel_offset_ns("PandarXT32", "channel")
    assert [r[0] for r in df.select(off).collect()] == [-144_000, 52_872, -92_488]


def test_b15_image_size(spark):
    df = spark.createDataFrame([(640, 480), (1920, 1080)], "w int, h int")
    assert [r[0] for r in df.select(imaging.snapped_size("w", "h")).collect()] == [640, 1280]


@pytest.mark.parametrize("units,kinds,kept", [([(100, 5), (200, 9)], ["LAST", "STRONGEST"], 2), ([(100, 9), (100, 9)], ["IDENTICAL", "IDENTICAL"], 1)])
def test_b16_b17_return_types(spark, units, kinds, kept):
    df = spark.createDataFrame([(1, i, 0, d, r, 0x39, 2) for i, (d, r) in enumerate(units)], "packet_id long, block int, channel int, raw_dist int, refl int, return_mode int, n_returns int")
    u = decode.classify_returns(decode.return_groups(df))
    assert [r.kind for r in u.orderBy("block").collect()] == kinds
    left = decode.drop_repeated_returns(u, 1).collect()
    assert len(left) == kept and left[-1].offset == 1


def test_b18_pixel(spark):
    cam = dict(fx=100.0, fy=100.0, cx=50.0, cy=40.0, width=100, height=80)
    r = clouds.pinhole(points(spark, [(0, 0, 1), (0, 0, -1), (1, 0, 1)]), cam).collect()
    assert [(x.u, x.v) for x in r] == [(50, 40)]


def blocks(spark):
    return spark.createDataFrame([(1, i, a) for i, a in enumerate([35000.0, 35900.0, 100.0, 9000.0])], "sensor long, seq long, azimuth double")


def test_b19_robosense_cut(spark):
    assert [r.scan_id for r in scans.cut_on_wrap(blocks(spark), 0.0).orderBy("seq").collect()] == [0, 0, 1, 1]


def test_b21_hesai_cut(spark):
    assert [r.scan_id for r in scans.cut_at_angle(blocks(spark), 0.0).orderBy("seq").collect()] == [0, 0, 0, 1]


@pytest.mark.parametrize("grey,n", [(255, 100), (0, 0)])
def test_b20_mask(spark, grey, n):
    m = spark.range(100).select((F.col("id") % 10).cast("int").alias("x"), F.expr("cast(id div 10 as int)").alias("y"), F.lit(grey).alias("grey"))
    assert decode.dither(m).filter("keep").count() == n


def test_x03_tolerance_beyond_voxel(spark):
    p = points(spark, [(0, 0, 0), (0.65, 0, 0)])
    assert joins.neighbours(p, 0.7, cell=0.3).count() == 1


def test_x11_edges_do_not_depend_on_order(spark):
    far, near = (12.0, 0.5, 0.0), (3.0, 0.1, 0.0)
    counts = {clustering.range_image_clusters(points(spark, order), 10.0, 0.5).filter("cluster_id >= 0").count() for order in ([far, near], [near, far])}
    assert len(counts) == 1


def test_x17_second_flag_filters(spark):
    df = spark.createDataFrame([(0, 0), (100, 0), (0, 100)], "pdh00 int, pdh02 int")
    assert radar.radar_scan(df).count() == 1


def test_x21_equal_angles_share_a_ring(spark):
    from scanlake.sources.calibration import with_rings

    df = spark.createDataFrame([(0, 0.1), (1, 0.1), (2, 0.3)], "laser_id int, vert_correction double")
    assert [r.ring for r in with_rings(df).orderBy("laser_id").collect()] == [0, 0, 1]


def test_x25_counter_wraps(spark):
    s = spark.createDataFrame([("a", 0, 0, (1 << 32) - 1), ("a", 1, 1, 2)], "sensor string, event_id long, t_ns long, counter long")
    assert [r.dropped for r in ordered.counter_drops(s).orderBy("event_id").collect()] == [0, 3]


def ramp(spark, n=200):
    """A flat floor with a wall at 16 to 18 metres."""
    rows = [(0.2 * i * math.cos(a), 0.2 * i * math.sin(a), 4.0 if 80 <= i < 90 else 0.0) for i in range(1, n) for a in (0.3, 1.3)]
    return points(spark, rows), {k for k, r in enumerate(rows) if r[2] == 4.0}


@pytest.mark.parametrize("f", [ground.ray_filter, ground.scan_filter, lambda p: grid_filter(p, GridParams(step=0.5, azimuth_deg=3.0))])
def test_ground_filters_find_the_wall(spark, f):
    p, wall = ramp(spark)
    found = {r.point_idx for r in f(p).filter("label = 'obstacle'").collect()}
    assert len(found & wall) >= 0.9 * len(wall) and len(found - wall) <= 0.1 * len(found)


def test_ransac_finds_the_floor_and_repeats(spark):
    p, wall = ramp(spark)
    a, b = ({r.point_idx for r in ground.ransac(p, iterations=40, voxel=0.05).filter("is_obstacle").collect()} for _ in range(2))
    assert a == b == wall


def test_a_ray_starts_where_it_leaves_the_footprint(spark):
    rows = [(0.5, 0.0, 0.0), (2.0, 0.0, 0.05), (-0.004, 1.1, 0.0)]
    label = lambda **k: [r.label for r in ground.ray_filter(points(spark, rows), divider=5.0, **k).orderBy("point_idx").collect()]
    # The first point lies inside and is passed over; the last is 0.1 from the border, too near to judge.
    assert label(footprint=(-1.0, 1.0, -1.0, 1.0)) == ["obstacle", "ground", "obstacle"]
    assert label() == ["ground", "ground", "ground"]


def test_virtual_ground_is_measured_in_space(spark):
    # 10 m beside the virtual origin: far, though its radius is only 7.65 m more.
    assert [r.label for r in ground.scan_filter(points(spark, [(3.0, 10.0, 0.3)]), tolerance=9.0).collect()] == ["ground"]
    assert [r.label for r in ground.scan_filter(points(spark, [(3.0, 10.0, 0.3)]), tolerance=10.5).collect()] == ["follow"]


def test_pseudo_functions(spark):
    assert pseudo_tan(0.0) == 0.0 and math.isclose(pseudo_tan(math.pi / 4), 1.0)
    at = [(1.0, 0.0, 0), (1.0, 1.0, 1), (0.0, 1.0, 2), (-1.0, 0.0, 4), (1.0, -1.0, 7), (-1.0, 1.0, 3), (-1.0, -1.0, 5), (0.0, -1.0, -2), (0.0, 0.0, 0), (2.0, 1.0, 0.5), (-1.0, 2.0, 2.5), (1.0, -2.0, 6.5)]
    got = spark.createDataFrame([(x, y, float(e)) for x, y, e in at], "x double, y double, eighths double").select(pseudo_angle("x", "y").alias("a"), "eighths").collect()
    assert all(math.isclose(r.a, r.eighths * math.pi / 4, abs_tol=1e-12) for r in got)
    g = Grid(GridParams(step=0.5, azimuth_deg=3.0))
    assert all(b < i or b == g.none for i, b in enumerate(g.before)) and all(n == 1 or not 120 % n for n in g.count)


def plain_grid(g, rows):
    """Labels by cell and the survey's table, cell by cell and by recursion."""
    p, inside, out, known = g.p, {}, {}, {}
    tg, tl, lift = (math.tan(math.radians(a)) for a in (p.global_slope_deg, p.local_slope_deg, 5.0))
    for r in rows:
        inside.setdefault(r.cell, []).append(r)
    inside.pop(-1, None)

    def root_of(k):
        k = g.before[k]
        while k != g.none and k not in inside:
            k = g.before[k]
        return None if k == g.none else int(k)

    def grounds(k, n):
        found = []
        while k is not None and len(found) < n:
            if cell(k)["ground"]:
                found.append(cell(k))
            k = root_of(k)
        return found

    def judge(e, parent, line, mode):
        dz, dr = e.z - parent["z"], e.radius - parent["r"]
        if dz > p.z_max:
            return "unknown"
        if e.z > tg * e.radius:
            return "obstacle"
        if mode == "continuous":
            a, b = 0.0, 0.0
            if len(line) == 1:
                a = line[0]["z"] / line[0]["r"]
            elif line:
                n, sr, sz = len(line), sum(q["r"] for q in line), sum(q["z"] for q in line)
                a = max(-tg, min(tg, (n * sum(q["r"] * q["z"] for q in line) - sr * sz) / (n * sum(q["r"] ** 2 for q in line) - sr * sr)))
                b = (sz - a * sr) / n
            err, band = e.z - (a * e.radius + b), p.height + lift * dr
            return "ground" if abs(dz) < tl * dr or abs(err) <= band else "obstacle" if err > band else "unknown"
        if mode == "discontinuous":
            return "ground" if abs(dz) < tl * dr or abs(dz) < p.height or abs(e.z - parent["top"]) < p.height else "obstacle" if dz >= tl * dr else "unknown"
        return "ground" if abs(dz) < tg * dr else "obstacle" if dz >= tg * dr else "unknown"

    def cell(k):
        if k in known:
            return known[k]
        ring, root, points_ = int(g.ring_of[k]), root_of(k), inside[k]
        parent = cell(root) if root is not None else None
        if parent is None or not parent["started"]:
            for e in points_:
                out[e.point_idx] = "obstacle" if e.z >= tg * e.radius and e.z > p.height else "ground" if abs(e.z) < min(tg * e.radius, p.height) else "unknown"
            parent = None
        else:
            line = grounds(root, p.ancestors)
            oldest = (line[-1]["ring"] if line else parent["ring"]) + len(line)
            gap = g.middle[ring] - g.middle[parent["ring"]]
            mode = "break" if gap >= p.continual * g.size[ring] else "continuous" if ring - oldest < p.continual else "discontinuous"
            for e in points_:
                out[e.point_idx] = judge(e, parent, line, mode)
            low = [e.z for e in points_ if out[e.point_idx] == "ground"]
            for e in points_:
                if low and parent["r"] > p.switch_grid_radius and out[e.point_idx] == "ground" and e.z >= min(low) + p.height:
                    out[e.point_idx] = "obstacle"
        kept = [e for e in points_ if out[e.point_idx] == "ground"]
        me = {"ring": ring, "ground": bool(kept), "started": parent is not None or bool(kept), "r": 0.0, "z": 0.0, "top": 0.0}
        if kept:
            me |= {"r": sum(e.radius for e in kept) / len(kept), "z": sum(e.z for e in kept) / len(kept), "top": max(e.z for e in kept)}
        elif parent:
            me |= {n: parent[n] for n in ("r", "z", "top")}
        known[k] = me
        return me

    for k in sorted(inside):
        cell(k)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_grid_filter_equals_the_plain_rules(spark, seed):
    rng = np.random.default_rng(seed)
    radius, angle = rng.uniform(0, 60, 4000), rng.uniform(0, 2 * math.pi, 4000)
    angle[:2000] = rng.choice([0.1, 0.7, 2.0, 4.0], 2000)  # dense rays beside sparse ground
    z = rng.normal(0, 0.05, 4000) + 0.05 * radius * rng.choice([0, 0, 1], 4000) + rng.choice([0, 0, 0, 0.3, 1.0, 7.0], 4000)
    rows = [*zip((radius * np.cos(angle)).tolist(), (radius * np.sin(angle)).tolist(), z.tolist()), (300.0, 0.0, 0.0), (0.0, -3.0, 0.0)]
    p, params = points(spark, rows), GridParams(step=0.5, azimuth_deg=3.0)
    g = Grid(params)
    want = plain_grid(g, g.cells(p).collect())
    got = {r.point_idx: r.label for r in grid_filter(p, params).collect()}
    assert len(got) == len(rows) and {k: want.get(k, "unknown") for k in got} == got
    assert min(sum(v == k for v in got.values()) for k in ("ground", "obstacle")) > 300


@pytest.mark.parametrize("model,block,channel,n,want", [
    ("Pandar40P", 9, 0, 1, -28_580 - 42_220), ("Pandar40P", 0, 39, 2, -28_580 - 4 * 55_560 - 3_620), ("Pandar64", 5, 63, 1, -42_580 - 12_748),
    ("PandarQT64", 3, 55, 1, 25_710 + 500_000 + 12_960), ("PandarAT128", 1, 127, 1, -9_249 - 41_666 + 8_264), ("PandarXT32", 7, 31, 1, 5_632 + 368 + 1_512 * 31),
])
def test_times_of_channels(spark, model, block, channel, n, want):
    offset = decode.block_offset_ns(model, F.lit(block), F.lit(n)) + decode.channel_offset_ns(model, F.lit(channel))
    assert one(spark.range(1).select(offset)) == want


def test_models_without_times_are_named():
    with pytest.raises(ValueError, match="Nameless"):
        decode.channel_offset_ns("Nameless", 0)


@pytest.mark.parametrize("model,n,block,channel,state,want", [
    # state: operational_state, azimuth_state, mode_flag, distance
    ("Pandar128E3X", 1, 0, 7, (0, 0b01 << 14, 0, 50.0), 3_148 - 55_556 + 4_786), ("Pandar128E3X", 1, 1, 7, (0, 0b01 << 14, 0, 50.0), 3_148 - 1),
    ("Pandar128E3X", 2, 0, 127, (2, 0b01 << 14, 0, 2.85), 3_148 - 27_778 + 29_319), ("Pandar128E3X", 2, 1, 25, (0, 0b11 << 12, 0, 9.0), 3_148 + 10_031),
    ("Pandar128E3X", 2, 1, 6, (0, 0b10 << 12, 0, 9.0), 3_148 - 185), ("Pandar128E3X", 2, 1, 6, (2, 0b10 << 12, 0, 9.0), None),
    ("Pandar128E4X", 1, 0, 0, (1, 0, 0, 9.0), 43_346 - 55_556 + 49_758), ("Pandar128E4X", 2, 0, 0, (0, 0, 0, 9.0), 43_346 - 1), ("Pandar128E4X", 2, 0, 0, (0, 0b01 << 14, 0, 9.0), 43_346 + 21_980),
    ("PandarQT128", 1, 0, 32, (0, 0, 0, 9.0), 9_000 + 111_110 + 27_656), ("PandarQT128", 1, 1, 32, (0, 0, 1, 9.0), 9_000), ("PandarQT128", 2, 1, 127, (0, 0, 1, 9.0), 9_000 + 48_120),
    ("Helios", 1, 0, 17, (0, 0, 0, 9.0), 29_010), ("Helios", 1, 11, 31, (0, 0, 0, 9.0), 656_260), ("Helios", 2, 11, 21, (0, 0, 0, 9.0), 310_510), ("Helios", 1, 0, 21, (0, 0, 0, 9.0), 32_730), ("Helios", 1, 4, 21, (0, 0, 0, 9.0), 256_200),
    ("Bpearl", 1, 11, 31, (0, 0, 0, 9.0), 66_276), ("Bpearl", 2, 10, 12, (0, 0, 0, 9.0), 29_777),
])
def test_times_of_channels_by_state(spark, model, n, block, channel, state, want):
    u = spark.createDataFrame([(block, channel, n, *state)], "block int, channel int, n_returns int, operational_state int, azimuth_state int, mode_flag int, distance double")
    assert one(u.select(decode.block_offset_ns(model, "block", "n_returns") + decode.channel_offset_ns(model, "channel"))) == want


@pytest.mark.parametrize("model", sorted(decode.SPECS))
def test_every_model_has_point_times(spark, model):
    state = "0 AS block, 9 AS channel, 1 AS n_returns, 0 AS operational_state, 0 AS azimuth_state, 0 AS mode_flag, 5D AS distance, 1000000000L AS stamp_ns, 0L AS scan_ns"
    assert one(decode.point_time(spark.sql(f"SELECT {state}"), model).select("t_ns")) is not None


@pytest.mark.parametrize("seed", range(5))
def test_components_of_frames_equal_a_plain_search(spark, seed):
    from scanlake.operators.components import components_of_frames

    rng = np.random.default_rng(seed)
    edges = [(int(rng.integers(3)), int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(9, i, i + 1) for i in range(300)]
    want = {}
    for f in {e[0] for e in edges}:
        label = {n: n for e in edges if e[0] == f for n in e[1:]}
        for _ in range(len(label)):
            for _, a, b in (e for e in edges if e[0] == f):
                label[a] = label[b] = min(label[a], label[b])
        want |= {(f, n): v for n, v in label.items()}
    got = {(r.frame_id, r.point_idx): r.label for r in components_of_frames(spark.createDataFrame(edges, "frame_id int, a long, b long")).collect()}
    assert got == want


def test_greedy_merge_restarts(spark):
    p = points(spark, [(0, 0, 0), (1, 0, 0), (1.8, 0, 0), (9, 0, 0)]).withColumn("cluster_id", F.col("point_idx").cast("int"))
    r = {x.cluster_id: x.merged_id for x in clustering.merge_greedily(p, 1.4).collect()}
    assert r == {0: 0, 1: 0, 2: 0, 3: 3}


def test_matching_fills_a_detection_before_a_cluster_is_taken(spark):
    votes = spark.createDataFrame([(0, 1, 5, 9), (0, 1, 6, 8), (0, 2, 6, 7)], "frame_id int, det_idx long, cluster_id int, votes long")
    totals = spark.createDataFrame([(0, 5, 10), (0, 6, 10)], "frame_id int, cluster_id int, total long")
    r = clustering.match(votes, totals, max_clusters=1)
    assert sorted((x.det_idx, x.cluster_id) for x in r.collect()) == [(1, 5), (2, 6)]


def test_quaternion_and_eigenvalues(spark):
    m = G.quaternion_matrix(0, 0, math.sqrt(0.5), math.sqrt(0.5))
    assert [round(x, 9) for x in m[0]] == [0.0, -1.0, 0.0]
    df = spark.createDataFrame([(2.0, 3.0, 4.0, 1.0, 0.0, 0.0)], "a double, b double, d double, e double, f double, g double")
    r = df.select(*G.symmetric_eigenvalues(*"abdefg")).first()
    assert [round(v, 6) for v in r] == [4.0, round(2.5 + math.sqrt(5) / 2, 6), round(2.5 - math.sqrt(5) / 2, 6)]


def test_schema_guard(spark):
    from scanlake.schemas import require_columns

    with pytest.raises(ValueError, match="missing columns"):
        require_columns(spark.range(1), "x")


@pytest.mark.parametrize("seed", range(6))
def test_greedy_merge_equals_plain_restarts(spark, seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, 14, (160, 3)) * [1.0, 1.0, 0.0] if seed % 2 else rng.uniform(0, 12, (160, 3))
    p = points(spark, rows.tolist()).withColumn("cluster_id", (F.col("point_idx") % 110).cast("int"))
    now = [([k], *rows[k::110].sum(axis=0), len(rows[k::110])) for k in range(110)]

    def first():
        mean = [(x / n, y / n, z / n) for _, x, y, z, n in now]
        return next(((i, j) for i in range(len(now)) for j in range(i + 1, len(now)) if math.dist(mean[i], mean[j]) < 1.3), None)

    while pair := first():
        a, b = now[pair[0]], now.pop(pair[1])
        now[pair[0]] = (a[0] + b[0], *(x + y for x, y in zip(a[1:], b[1:])))
    want = {k: ids[0] for ids, *_ in now for k in ids}
    assert {r.cluster_id: r.merged_id for r in clustering.merge_greedily(p, 1.3).collect()} == want and 1 < len(now) < 110


def test_info_of_short_and_null_packets(spark):
    from scanlake.operators import sensor_info

    whole = bytearray(1300)
    whole[8:10], whole[32:34], whole[300], whole[301], whole[302] = b"\x02\x58", (12345).to_bytes(2, "big"), 4, 9, 2
    whole[315:317], whole[359], whole[382:388], whole[468:471], whole[564:567] = (32).to_bytes(2, "big"), 0b10101, b"$GPRMC", b"\x01\x00\x7b", b"\x00\x01\xc8"
    p = spark.createDataFrame([(1, bytes(whole)), (2, bytes(100)), (3, None)], "packet_id long, data binary")
    rows = sensor_info.info(p, "Helios").collect()
    got = rows[0].info
    assert [r.packet_id for r in rows] == [1] and got["motor_speed"] == "600" and got["fov_start"] == "123.449997" and got["return_mode"] == "strongest" and got["time_sync_mode"] == "n/a"
    # 32 / 4096 lies between two texts of six decimals: the even one counts.
    assert got["v_dat"] == "0.007812" and got["v_dat_apd"] == "-465.800000" and got["sync_status"] == "ptp_time_sync_successful"
    assert (got["pps_lock"], got["gprmc_lock"], got["utc_lock"], got["pps_input_status"]) == ("valid", "invalid", "synchronized", "received_pps") and got["gprmc_string"].startswith("$GPRMC\0")
    first = sensor_info.info_calibration(p).orderBy("channel").first()
    assert (first.elev_deg, first.azim_deg) == (-1.23, 4.56)


def test_near_status_levels(spark):
    from scanlake.operators import sensor_info

    def status(**at):
        raw = bytearray(64)
        raw[12] = 1
        for k, value in at.items():
            raw[int(k[1:])] = value
        raw[61:63] = int(crc(bytes(raw[:61]))).to_bytes(2, "big")
        return bytes(4) + bytes(raw)

    def crc(data):
        state = 0xFFFF
        for byte in data:
            state ^= byte << 8
            for _ in range(8):
                state = (state << 1 ^ 0x1021 if state & 0x8000 else state << 1) & 0xFFFF
        return state

    # A later warning stands over an earlier error; reset and runtime errors aside, bits above the fourth are named only.
    cases = [(status(), 0), (status(b12=2), 1), (status(b32=3), 2), (status(b32=3, b35=0b1000), 1), (status(b36=1, b38=4), 2), (status(b40=0x40), 0), (status(b40=0x04), 2), (bytes(67), None), (None, None)]
    rows = {r.packet_id: r for r in sensor_info.near_status(spark.createDataFrame(list(enumerate(x for x, _ in cases)), "packet_id long, data binary")).collect()}
    assert {k: r.level for k, r in rows.items()} == {i: want for i, (_, want) in enumerate(cases) if want is not None}
    assert all(r.crc == r.crc_computed for r in rows.values()) and rows[3].long_accel_invalid == "Error this OPC" and rows[4].com_error == "Invalid value" and rows[5].sw_error == "Runtime Error"
    assert rows[2].defective == "Current Near Scan RF Error, Near Scan RF this OPC" and rows[0].wheelbase == 0.0 and rows[0].long_pos == -32.767


def test_robosense_times_beyond_twelve_blocks(spark):
    """A block more than a packet of 12 has keeps its own time, in either mode."""
    rows = [("s", 1, 11, 22), ("s", 1, 12, 22), ("s", 1, 16, 31), ("d", 2, 23, 0), ("d", 2, 24, 3), ("d", 2, 40, 31)]
    u = spark.createDataFrame(rows, "kind string, n_returns int, block int, channel int")
    got = u.select("n_returns", "block", "channel", *(decode.channel_offset_ns(m, "channel").alias(m) for m in ("Helios", "Bpearl"))).collect()
    helios = lambda shot, ns: round((shot * 500_000 / 9 + ns) / 10) * 10
    assert [r.Helios for r in got] == [helios(11, 32734), helios(12, 32734), helios(16, 45148), helios(11, 0), helios(12, 4724), helios(20, 45148)]
    assert [r.Bpearl for r in got] == [5555 * 11 + 3670, 5555 * 12 + 3670, 5555 * 16 + 5171, 5555 * 11, 5555 * 12 + 500, 5555 * 20 + 5171]


def test_ring_step_at_a_right_angle(spark):
    """Two points a right angle apart, whose azimuths as the C library rounds them lie a last
    place below it: no break at a step of 90 degrees, as in the SQL."""
    import pandas as pd

    p = spark.createDataFrame(pd.DataFrame({"frame_id": 0, "channel": 0, "point_idx": [0, 1], "x": [13.600000000000001, -8.1], "y": [8.100000000000001, 13.600000000000001], "z": 0.0, "distance": 15.83}))
    assert [r.a for r in p.select(G.exact_atan2("y", "x").alias("a")).collect()] == [math.atan2(8.100000000000001, 13.600000000000001), math.atan2(13.600000000000001, -8.1)]
    r = ordered.ring_outliers(p.withColumn("azimuth", G.exact_atan2("y", "x")), 5, 1.3, 6.0, 90.0).collect()
    assert [x.walk for x in r] == [2, 2]


def test_points_go_with_each_twist_of_equal_stamps(spark):
    """Two twists of one stamp: a point goes with both, the first by id has moved, in two and
    in three dimensions."""
    at = lambda s: int(s * 1e9)
    rows = [(0, 7, 0, 1.0), (0, 9, at(2), 3.0), (0, 8, at(2), 1.0), (0, 5, at(4), 2.0)]
    t = spark.createDataFrame(rows, "k int, id long, t_ns long, vx double").withColumn("wz", F.lit(0.0))
    poses = joins.with_previous(ordered.integrate_2d(t, "k", ties=("id",)), "k", ties=("id",)).drop("k", "id")
    p = points(spark, [(0, 0, 0), (0, 0, 0)]).withColumn("t_ns", F.when(F.col("point_idx") == 0, at(1)).otherwise(at(3)))
    want = [(0, 1.0), (0, 2.0), (1, 4.0)]
    assert sorted((r.point_idx, round(r.ux, 9)) for r in joins.undistort_2d(p, poses).collect()) == want
    full = t.select("k", "id", "t_ns", "vx", F.lit(0.0).alias("vy"), F.lit(0.0).alias("vz"), F.lit(0.0).alias("wx"), F.lit(0.0).alias("wy"), "wz")
    for bucket in (10**12, 10**9):
        poses = motion.integrate_3d(full, "k", bucket, ("id",)).drop("k")
        assert sorted((r.point_idx, round(r.ux, 9)) for r in motion.undistort_3d(p, poses).collect()) == want


def test_neighbours_are_of_a_whole_label(spark, tmp_path):
    """Vectors 0 and 640 of one label meet; 0 and 1, of two, don't."""
    from scanlake.plans.catalog import QUERIES

    rows = [(0, [0.5] * 64, 3), (1, [0.5] * 64, 4), (640, [0.5] * 64, 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    met = {(r.frame_id, r.a // 21, r.b // 21) for r in QUERIES["j07_neighbours"](spark, str(tmp_path)).collect()}
    assert met == {(3, 0, 640), (3, 0, 0), (3, 640, 640), (4, 1, 1)}


def test_block_packets_are_built_by_many_tasks(spark, tmp_path):
    """A small file of suppliers is one split; before, its packets were one task's."""
    from scanlake.plans.catalog import QUERIES

    spark.range(1, 65).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    got = QUERIES["d28_velodyne_four_banks"](spark, str(tmp_path))
    assert got.count() == 32 * sum(4 - k % 5 for k in range(1, 65) if k % 5 < 4)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_frames_are_settled_side_by_side(spark, monkeypatch):
    """Each as if alone; a ring of all frames is one step. Before, a frame was a step of its own."""
    from scanlake.operators import grid_ground

    grid, rng, calls, lines = Grid(GridParams(step=0.5, azimuth_deg=3.0)), np.random.default_rng(4), [], grid_ground._lines
    n = 70 * 30
    frame, ring = rng.permutation(np.repeat(np.arange(70), 30)), rng.integers(0, 60, n)
    cell = grid.first[ring] + (rng.random(n) * grid.count[ring]).astype(int)
    radius, z = grid.inner[ring] + rng.random(n) * grid.size[ring], rng.normal(0, 0.3, n)
    monkeypatch.setattr(grid_ground, "_lines", lambda *a: calls.append(1) or lines(*a))
    got = grid_ground.settle(grid, frame, ring, cell, radius, z)
    assert len(calls) <= 60
    for f in range(70):
        own = frame == f
        assert (got[own] == grid_ground.settle(grid, np.zeros(30, dtype=int), ring[own], cell[own], radius[own], z[own])).all()
    # Over batches of 100 rows and a null frame: all points, each frame as in a run of its own.
    angle = rng.uniform(0, 2 * math.pi, n)
    rows = [(None if f == 69 else f, i, float(r * math.cos(a)), float(r * math.sin(a)), float(h)) for i, (f, r, a, h) in enumerate(zip(frame.tolist(), radius, angle, z))]
    points = spark.createDataFrame(rows, "frame_id int, point_idx long, x double, y double, z double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        run = lambda p: {(r.frame_id, r.point_idx): r.label for r in grid_filter(p, GridParams(step=0.5, azimuth_deg=3.0)).collect()}
        every = run(points)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(every) == n
    for f in (None, 0, 33):
        assert run(points.filter(F.col("frame_id").eqNullSafe(F.lit(f)))) == {k: v for k, v in every.items() if k[0] == f}


def test_vanished_ids_come_once(spark):
    """Rows that repeat and ids that stay; before, a repeated row gave its id twice."""
    from scanlake.operators.radar import vanished

    ids = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (2, 8), (2, 8), (2, 9), (4, 9), (5, 9), (5, 7)], "frame_no long, object_id long")
    assert sorted(map(tuple, vanished(ids).collect())) == [(2, 7)]


def test_cuts_of_short_histories_join_nothing(spark):
    """Where each key has one bucket, rows are put in order once and meet no table; before,
    they were joined twice, and a null inside a bucket was followed by the bucket before."""
    rows = [(s, i, a) for s in range(3) for i, a in enumerate([50.0, 60.0, 80.0, 85.0, None, 70.0])]
    df = spark.createDataFrame(rows, "sensor int, seq long, azimuth double")
    for bucket in (3, 1000):
        cut = scans.cut_on_wrap(df, 0.0, 360.0, bucket=bucket)
        assert {r.scan_id for r in cut.collect()} == {0}
        plan = cut._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "Final Plan" in plan and ("Join" in plan) <= (bucket == 3) and plan.count("Sort [") <= 1 + 2 * (bucket == 3)


def test_ransac_deals_points_once(spark):
    """Points, planes and leaves were joined by frame five times, each with shuffles of its own.
    Frames of too few points, of points without numbers and without an id pass whole."""
    flat = [(f, 100 * f + i, float(i % 10), float(i // 10), 0.0 if i else 3.0) for f in (1, 2) for i in range(60)]
    odd = [(3, 301, 0.0, 0.0, 0.0), (3, 302, 1.0, 0.0, 0.0), *((4, 400 + i, None, float(i), 0.0) for i in range(5)), *((None, 500 + i, float(i % 3), float(i // 3), 0.0) for i in range(9))]
    odd += [(1, 190, None, 0.0, 0.0), (2, 290, float("nan"), 0.0, 0.0)]
    p = spark.createDataFrame(flat + odd, "frame_id int, point_idx long, x double, y double, z double")
    found = ground.ransac(p, iterations=40)
    assert {r.point_idx for r in found.filter("is_obstacle").collect()} == {100, 200, 190, 290, *(r[1] for r in odd)}
    assert found.count() == p.count()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Join") == 1 and plan.count("Exchange hashpartitioning") <= 3


TINY_DEPTHS = {
    "p08_pinhole": {(0, i, 361, 55) for i in range(21)},
    "a05_votes": {(0, 10, k, 2 if k < 9 else 1) for k in range(12)},
    "a06_cluster_totals": {(0, k, 2 if k < 9 else 1) for k in range(12)},
    "c16_match": {(0, 10, k, 2, k + 1) for k in range(3)},
    "c16_match_exclusive": {(0, 10, k, 2, k + 1) for k in range(9)},
    "j09_points_in_detections": {(i, 10) for i in range(21)},
    "j10_points_in_mask": {(i,) for i in range(21)},
    "o06_top_k": {(0, 10, 0, 2, 1)},
}


@pytest.mark.parametrize("name", TINY_DEPTHS)
def test_tiny_depths_fall_off_the_image(spark, tmp_path, name):
    """Of vectors 0 to 3, one lies in detection 10 and in the mask; u and v of the second, v
    of the third are more than an int holds, and the last has no depth."""
    from scanlake.plans.catalog import QUERIES

    rows = [(i, xyz * 21 + [0.0], 0) for i, xyz in enumerate([[0.13, -0.615, 1.0], [0.13, 0.1, 1e-12], [0.0, 0.1, 1e-12], [0.13, 0.1, 0.0]])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(10, 1)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    found = QUERIES[name](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == TINY_DEPTHS[name] and len(found) == len(TINY_DEPTHS[name])
