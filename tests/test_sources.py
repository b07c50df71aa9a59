"""Files, datagrams, labels and streams."""

import socket
import struct
import time

import pytest
from pyspark.sql import functions as F

from scanlake.operators import imaging
from scanlake.sources import calibration, clouds, packets
from scanlake.streaming import scans


def test_channel_csv_round_trip(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Laser id,Elevation,Azimuth\n1,1.5,-0.5\nbad,line\n2,2.5,0.5\n")
    c = calibration.read_channel_csv(spark, str(tmp_path / "c.csv"))
    assert sorted(map(tuple, c.collect())) == [(0, 1.5, -0.5), (1, 2.5, 0.5)]
    calibration.write_channel_csv(c, str(tmp_path / "out"))
    assert sorted(map(tuple, calibration.read_channel_csv(spark, str(tmp_path / "out")).collect())) == [(0, 1.5, -0.5), (1, 2.5, 0.5)]


def test_mirror_correction(spark, tmp_path):
    blob = b"junk\xee\xff\x01\x05\x02\x03\x03" + bytes(8) + b"\x02" + struct.pack("<3I3I2i2i", 0, 10, 20, 10, 20, 30, 5, -5, 7, -7) + bytes([1] * 360) + bytes([255] * 360)
    (tmp_path / "a.dat").write_bytes(blob)
    frames, channels, grid = calibration.read_mirror_correction(spark, str(tmp_path / "a.dat"))
    assert [tuple(r) for r in frames.orderBy("field").collect()] == [(0, 0, 20), (1, 20, 40), (2, 40, 60)]
    assert channels.orderBy("channel").first().azimuth == 10 / 25_600.0
    assert grid.count() == 360 and grid.agg(F.min("adjust"), F.min("elevation_adjust")).first()[:] == (2, -2)
    with pytest.raises(ValueError):
        calibration.parse_mirror_correction(b"nothing here")


def test_lasers_round_trip(spark, tmp_path):
    lasers = [{"laser_id": float(i), "rot_correction": 0.1 * i, "vert_correction": -0.2 * (i % 2)} for i in range(4)]
    text = calibration.lasers_text(lasers, {"num_lasers": 4.0, "distance_resolution": 0.002})
    back, rest = calibration.parse_lasers(text)
    assert back == lasers and rest["num_lasers"] == 4.0
    (tmp_path / "v.yaml").write_text(text)
    assert [r.ring for r in calibration.read_lasers(spark, str(tmp_path / "v.yaml")).orderBy("laser_id").collect()] == [1, 0, 1, 0]


def test_pcd_keeps_points_and_fields(spark):
    p = clouds.synthetic(spark).withColumn("intensity", F.lit(3.0))
    files = clouds.to_pcd(p, "intensity", "x", "y", "z")
    assert files.first().pcd.startswith(b"# .PCD") and clouds.from_pcd(files).count() == 3000
    assert abs(clouds.from_pcd(files).agg(F.max("x")).first()[0] - 2.5) < 1e-2


def test_udp_source(spark):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    reader = packets.UdpPackets({"port": str(port)}).simpleStreamReader(None)
    rows, end = reader.read(reader.initialOffset())
    assert list(rows) == [] and end == {"n": 0}
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for i in range(3):
            s.sendto(bytes([i]) * 4, ("127.0.0.1", port))
    rows, end = reader.read({"n": 0})
    assert [r[2] for r in rows] == [bytes([i]) * 4 for i in range(3)] and end == {"n": 3}
    assert len(list(reader.readBetweenOffsets({"n": 0}, {"n": 3}))) == 3


def test_log_and_senders(spark, tmp_path):
    rows = [("a", 1, "10.0.0.1", bytearray(b"xx")), ("b", 2, "10.0.0.2", bytearray(b"yyyy"))]
    spark.createDataFrame(rows, "topic string, stamp_ns long, sender string, data binary").write.parquet(str(tmp_path / "log"))
    log = packets.read_log(spark, str(tmp_path / "log"), ["b"])
    assert [r.stamp_ns for r in log.collect()] == [2]
    assert [r.truncated for r in packets.accept(packets.read_log(spark, str(tmp_path / "log")), "10.0.0.2", 3).collect()] == [True]
    q = scans.run_once(packets.replay(spark, str(tmp_path / "log"), "topic string, stamp_ns long, sender string, data binary"))
    assert q.count() == 2


@pytest.mark.parametrize("percent", [0, 30])
def test_split_never_leaves_validation_empty(spark, percent):
    s = imaging.split_train_validation(spark.range(50).withColumnRenamed("id", "key"), "key", percent)
    assert s.filter("is_validation").count() >= 1 and s.count() == 50


def test_stream_keeps_its_state_between_triggers(spark, tmp_path):
    from scanlake.storage import shared_dir

    schema = "sensor long, seq long, azimuth double"
    rows = [(s, i, float(i * 130 % 360)) for s in (1, 2) for i in range(20)]
    src = str(tmp_path / "in")
    for half in (rows[:10] + rows[20:30], rows[10:20] + rows[30:]):
        spark.createDataFrame(half, schema).coalesce(1).write.mode("append").parquet(src)
        path = getattr(test_stream_keeps_its_state_between_triggers, "path", None) or shared_dir(spark)
        test_stream_keeps_its_state_between_triggers.path = path
        stream = scans.cut_stream(spark.readStream.schema(schema).parquet(src), 90.0)
        stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r.sensor, r.seq): r.scan_id for r in spark.read.parquet(f"{path}/rows").collect()}
    want = {(r.sensor, r.seq): r.scan_id for r in scans.cut_at_angle(spark.createDataFrame(rows, schema), 90.0).collect()}
    assert got == want


def test_streams_meet_within_the_interval(spark, tmp_path):
    for side, second in (("a", 0), ("b", 3)):
        df = spark.range(5).select(F.lit(1).alias("key"), "id", F.timestamp_seconds(F.col("id") * 60 + 1000 + second).alias("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / side))
    read = lambda side: spark.readStream.schema("key int, id long, ts timestamp").parquet(str(tmp_path / side))
    pairs = scans.run_once(scans.sync_streams(read("a"), read("b"), "10 seconds"))
    assert sorted((r.left_id, r.right_id) for r in pairs.collect()) == [(i, i) for i in range(5)]


def test_watchdog_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 100), ("a", 5000)], "sensor string, s long").select("sensor", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "u"))
    alarms = scans.run_once(scans.late_stream(spark.readStream.schema("sensor string, ts timestamp").parquet(str(tmp_path / "u")), "10 seconds", "1 minute"))
    assert sorted(r.n_updates for r in alarms.collect()) == [1, 2]


def test_frame_files_are_written_whole_or_not_at_all(spark, tmp_path):
    import os

    from scanlake.sources import files

    path = str(tmp_path / "frames")
    points = spark.range(600).select((F.col("id") % 7).cast("int").alias("frame_id"), F.col("id").alias("point_idx"), *(F.col("id").cast("double").alias(a) for a in "xyz"))
    # A straggler of a failed job may still write below its staging folder, which no reader sees.
    found = lambda: sorted(f for d, _, names in os.walk(path) for f in names if f.endswith(".pcd") and "_staging-" not in d)
    files.register(spark)
    rows = clouds.to_pcd(points).select(F.col("frame_id").cast("string").alias("name"), F.col("pcd").alias("content"))
    # A task that fails after others have written leaves nothing.
    broken = rows.repartition(4, "name").withColumn("content", F.when(F.col("name") == "3", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception):
        broken.write.format("frame_files").mode("append").option("path", path).option("suffix", ".pcd").save()
    assert found() == []
    files.write_pcd(points, path)
    assert found() == [f"{i}.pcd" for i in range(7)] and os.path.exists(f"{path}/_SUCCESS")
    assert files.read(spark, path).count() == 7
    back = clouds.from_pcd(files.read(spark, path))
    assert sorted(map(tuple, back.groupBy("frame_id").agg(F.count("*"), F.sum("x")).collect())) == sorted(map(tuple, points.groupBy("frame_id").agg(F.count("*"), F.sum("x")).collect()))
    # Written again: the same files, once each.
    files.write_pcd(points.filter("frame_id < 5"), path, overwrite=True)
    assert found() == [f"{i}.pcd" for i in range(5)]
    spark.createDataFrame([("a/b c%.1", bytearray(b"x"))], "name string, content binary").write.format("frame_files").mode("append").option("path", str(tmp_path / "odd")).save()
    assert [tuple(r) for r in files.read(spark, str(tmp_path / "odd"), "", "string").collect()] == [("a/b c%.1", bytearray(b"x"))]


def test_can_frames_loop_back(spark, tmp_path):
    from scanlake.sources import can

    sent = [(i, i.to_bytes(4, "big") + bytes([i % 256]) * n) for i, n in ((1, 0), (0x7FF, 8), (0x800, 64), (0x1FFFFFFF, 48), (5, 31))]
    frames = can.to_frames(spark.createDataFrame([(n, d) for n, d in sent], "stamp_ns long, data binary"))
    assert {len(r.frame) for r in frames.collect()} == {can.FRAME_BYTES}
    path = str(tmp_path / "bus")
    reader = can.CanFrames({"socket": path}).simpleStreamReader(None)
    assert list(reader.read({"n": 0})[0]) == []
    spark.dataSource.register(can.CanFrames)
    frames.coalesce(1).write.format("can_fd").mode("append").option("socket", path).save()
    with socket.socket(socket.AF_UNIX, socket.SOCK_DGRAM) as s:
        s.connect(path)
        s.send(struct.pack("<IB67x", can.ERROR | 3, 8))
        s.send(struct.pack("<IB67x", 3, 65))
        s.send(b"short")
    rows, end = reader.read({"n": 0})
    rows = list(rows)
    assert end == {"n": 8} and list(reader.readBetweenOffsets({"n": 0}, {"n": 8})) == rows
    reader.commit(end)
    assert not reader.held
    got = can.to_packets(spark.createDataFrame([*rows, (0, None)], "stamp_ns long, frame binary")).collect()
    # 31 bytes go in a frame of 32.
    want = {(n, d + bytes(1) if n == 5 else d) for n, d in sent}
    assert {(r.can_id, bytes(r.data)) for r in got} == want and all(r.stamp_ns > 0 for r in got)


def test_can_frames_as_a_stream(spark, tmp_path):
    from scanlake.sources import can

    spark.dataSource.register(can.CanFrames)
    path = str(tmp_path / "bus")
    with socket.socket(socket.AF_UNIX, socket.SOCK_DGRAM) as receiver:
        receiver.bind(path)
        receiver.settimeout(30)
        can.to_frames(spark.createDataFrame([(i, (i).to_bytes(4, "big") + b"abcd") for i in range(20)], "stamp_ns long, data binary")).write.parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema("stamp_ns long, frame binary").parquet(str(tmp_path / "log"))
        q = stream.writeStream.format("can_fd").option("socket", path).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        got = {struct.unpack("<IB", receiver.recv(100)[:5]) for _ in range(20)}
        q.awaitTermination()
    assert got == {(i, 4) for i in range(20)}


@pytest.mark.parametrize("size", [3, 69])
def test_no_frame_for_such_data(spark, size):
    from scanlake.sources import can

    with pytest.raises(Exception, match="data without an id|more than 64 bytes"):
        can.to_frames(spark.createDataFrame([(bytes(size),)], "data binary")).collect()


def test_times_of_frames(spark, tmp_path):
    from scanlake.streaming import metrics

    for i in range(3):
        spark.range(10 * (i + 1)).write.parquet(str(tmp_path / "in" / str(i)))
    times = metrics.CycleTimes(keep=2)
    spark.streams.addListener(times)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = metrics.observed(stream.filter("id % 2 = 0")).writeStream.format("noop").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        # Progress reaches listeners after the trigger.
        for _ in range(100):
            rows = times.table(spark, bound_ms=1e9).collect()
            if len(rows) == 2 and sum(p.numInputRows for p in q.recentProgress[-2:]) == sum(r.n_rows for r in rows):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(times)
    assert len(rows) == 2 and all(r.query == "frames" and r.trigger_ms > 0 and 2 * r.n_frames >= r.n_rows > 0 and r.ms_a_frame == r.trigger_ms / r.n_frames and not r.late for r in rows)
    assert metrics.CycleTimes().table(spark).count() == 0
