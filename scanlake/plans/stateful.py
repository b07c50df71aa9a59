"""Queries for streams with state: the tables as file sources, run until all is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions.binary import crc16
from scanlake.functions.geometry import c, out4
from scanlake.operators.mirrors import cut_mirrors, mirror_angles
from scanlake.plans.registry import query
from scanlake.streaming import scans as T
from scanlake.streaming import stateful as S

NOW = "0 seconds"


def _events(v):
    """The events table as a stream: sensor, seq, ts, t_ns and its own columns."""
    schema = v.table("events").schema
    stream = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    t_ns = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) * 1000")
    return stream.withColumns({"sensor": c("user_id"), "seq": c("event_id"), "t_ns": t_ns, "ts": F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"))})


@query("t09_group_stream", """
SELECT user_id AS sensor, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS group_no,
  CAST(CASE WHEN event_id % 5 = 0 THEN 3 ELSE 4 END AS BIGINT) AS n_elements, event_id % 5 <> 0 AND event_id % 3 <> 0 AND event_id % 7 <> 0 AS whole
FROM events""")
def t09(v):
    """Groups of four elements each: one of five lacks an element, one of three has a wrong
    checksum, one of seven has none and is closed by the next header or the timer."""
    hex_of = lambda x, n: F.lpad(F.hex(x), n, "0")
    e = _events(v).withColumn("body", F.transform(F.sequence(F.lit(0), F.when(c("event_id") % 5 == 0, 2).otherwise(3)), lambda k: hex_of(c("event_id") * 31 + k, 12)))
    crc = crc16(F.unhex(F.concat(F.lit("AB01"), F.array_join("body", ""))))
    message = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    end = message("crc", hex_of(crc.bitwiseXOR(F.when(c("event_id") % 3 == 0, 1).otherwise(0)), 4))
    all_ = F.concat(F.array(message("header", F.lit("AB01"))), F.transform("body", lambda h: message("element", h)), F.when(c("event_id") % 7 == 0, F.array().cast("array<struct<kind:string,text:string>>")).otherwise(F.array(end)))
    rows = e.select("sensor", "seq", "ts", F.posexplode(all_).alias("k", "m"))
    rows = rows.select("sensor", (c("seq") * 8 + c("k")).alias("seq"), "ts", c("m.kind").alias("kind"), F.unhex("m.text").alias("data"))
    return T.run_once(S.assemble_stream(rows, 4, 0, NOW))


@query("t02_overlap_stream", """
WITH b AS (SELECT sensor, event_id AS seq, CAST(event_id * 977 % 36000 AS DOUBLE) / 100 AS azimuth FROM stream_ev),
l AS (SELECT *, lag(azimuth) OVER (PARTITION BY sensor ORDER BY seq) AS l FROM b),
k AS (SELECT *, CASE WHEN l IS NULL THEN 0 WHEN l <= azimuth THEN CASE WHEN l < 90 AND 90 <= azimuth THEN 1 ELSE 0 END WHEN l < 90 OR 90 <= azimuth THEN 1 ELSE 0 END AS cut FROM l),
s AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY sensor ORDER BY seq) - cut AS BIGINT) AS scan_id, azimuth + 3 - floor((azimuth + 3) / 360) * 360 AS pa FROM k)
SELECT seq, scan_id + CASE WHEN (azimuth - 85) - floor((azimuth - 85) / 360) * 360 <= 5 AND (pa - 90) - floor((pa - 90) / 360) * 360 <= 20 THEN 1 ELSE 0 END AS scan_id FROM s""")
def t02_stream(v):
    """Two open scans a sensor, handed on scan by scan."""
    azimuth = (c("event_id") * 977 % 36000).cast("double") / 100
    p = _events(v).select("sensor", "seq", "ts", azimuth.alias("azimuth"), ((azimuth + 3) % 360).alias("point_azimuth"))
    return T.run_once(S.scan_stream(p, [90.0], [85.0], timeout_ms=0, watermark=NOW)).select("seq", "scan_id")


#: Steps a degree of the encoder, the view and the cut of the mirror queries, in degrees.
STEPS, VIEW, CUT = 64, (30.0, 200.0), 150.0


def _mirrors(v):
    """Three mirrors and eight channels."""
    turn = 360 * STEPS
    frames = v.spark.createDataFrame([(f, f * turn // 3, (f + 1) * turn // 3 % turn) for f in range(3)], "field int, start int, stop int")
    channels = v.spark.createDataFrame([(ch, -0.25 * ch) for ch in range(8)], "channel int, azimuth double")
    grid = v.spark.createDataFrame([(ch, s, ch * s % 7 - 3) for ch in range(8) for s in range(180)], "channel int, step int, adjust int")
    return mirror_angles(frames, channels, grid, VIEW, CUT, STEPS)


_MIRRORS = """
steps AS (SELECT f AS field, f * 7680 + i AS raw FROM (SELECT unnest(range(3)) AS f), (SELECT unnest(range(7680)) AS i)),
own AS (
  SELECT field, raw, i * 2.0::DOUBLE / 64 + 0.25 * ch + ((ch * (raw // 128) % 7 - 3) * (1 - part) + (ch * ((raw // 128 + 1) % 180) % 7 - 3) * part) / 100 AS az
  FROM (SELECT *, raw - field * 7680 AS i, raw / 128.0::DOUBLE - raw // 128 AS part FROM steps), (SELECT unnest(range(8)) AS ch)
), reach AS (SELECT field, raw, min(az) AS least, max(az) AS most FROM own GROUP BY field, raw
), view_ AS (SELECT field, min(CASE WHEN most >= 30 THEN raw END) AS v0, min(CASE WHEN least >= 200 THEN raw END) AS v1 FROM reach GROUP BY field
), cuts AS (
  SELECT r.field, any_value(v0) AS v0, any_value(v1) AS v1, min(CASE WHEN least >= 150 THEN raw END) AS emit, min(CASE WHEN most >= 150 THEN raw END) AS reset
  FROM reach r JOIN view_ USING (field) WHERE raw BETWEEN v0 AND v1 GROUP BY r.field
), b AS (SELECT sensor, event_id AS seq, event_id * 977 % 23040 AS azimuth FROM stream_ev
), l AS (SELECT *, lag(azimuth) OVER (PARTITION BY sensor ORDER BY seq) AS l FROM b
), met AS (
  SELECT sensor, seq, l.azimuth, bool_or(CASE WHEN l IS NULL THEN false WHEN l <= azimuth THEN l < emit AND emit <= azimuth ELSE l < emit OR emit <= azimuth END) AS cut,
    bool_or(CASE WHEN l IS NULL THEN false WHEN l <= azimuth THEN l < reset AND reset <= azimuth ELSE l < reset OR reset <= azimuth END) AS begins,
    bool_or((v0 < azimuth AND azimuth <= v1) OR coalesce(v0 < l AND l <= v1, false)) AS in_view,
    bool_or((reset <= azimuth AND azimuth <= emit) OR coalesce(reset <= l AND l <= emit, false)) AS in_overlap
  FROM l, cuts GROUP BY sensor, seq, l.azimuth
), s AS (SELECT *, CAST(sum(cut::INT) OVER (PARTITION BY sensor ORDER BY seq) - cut::INT AS BIGINT) AS scan_id FROM met)"""


@query("t03_mirror_cut", f"WITH {_MIRRORS} SELECT seq, scan_id, CAST(azimuth // 7680 AS INT) AS field, in_view, in_overlap, begins FROM s")
def t03(v):
    """A scan a mirror, by angles from the calibration of all channels."""
    blocks = v.stream_ev().select("sensor", c("event_id").alias("seq"), (c("event_id") * 977 % (360 * STEPS)).cast("double").alias("azimuth"))
    return cut_mirrors(blocks, _mirrors(v)).select("seq", "scan_id", "field", "in_view", "in_overlap", "begins")


@query("t03_mirror_cut_stream", f"WITH {_MIRRORS} SELECT seq, scan_id FROM s")
def t03_stream(v):
    blocks = _events(v).select("sensor", "seq", "ts", (c("event_id") * 977 % (360 * STEPS)).cast("double").alias("azimuth"))
    return T.run_once(S.scan_stream(blocks, _mirrors(v).emit, timeout_ms=0, watermark=NOW)).select("seq", "scan_id")


@query("t12_asof_stream", """
WITH p AS (SELECT sensor, event_id, t_ns FROM stream_ev), q AS (SELECT DISTINCT sensor, t_ns FROM stream_ev WHERE event_type IN ('click', 'view')),
last AS (SELECT sensor, max(t_ns) AS t FROM q GROUP BY sensor)
SELECT p.event_id, coalesce(q.t_ns, last.t) AS twist_ns FROM p ASOF LEFT JOIN q ON p.sensor = q.sensor AND p.t_ns <= q.t_ns JOIN last ON last.sensor = p.sensor""")
def t12(v):
    """Points wait for their vehicle's first twist not before them."""
    e = _events(v)
    twists = e.filter("event_type in ('click', 'view')").select("sensor", "t_ns", "ts", (c("value") / 100).alias("vx"), F.lit(0.0).alias("wz"))
    found = T.run_once(S.asof_stream(e.select("sensor", c("event_id").alias("id"), "t_ns", "ts"), twists, "sensor", 0, watermark=NOW))
    return found.select(c("id").alias("event_id"), "twist_ns")


_SETS = """
WITH x AS (SELECT sensor % 10 AS key, event_id, t_ns, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS input FROM stream_ev WHERE event_type IN ('click', 'error', 'purchase')),
near AS (
  SELECT a.key, a.event_id, a.t_ns, b.input, b.event_id AS other, abs(b.t_ns - a.t_ns) AS dt FROM x a JOIN x b ON a.key = b.key AND a.input = 0 AND b.input > 0 AND abs(b.t_ns - a.t_ns) <= 600000000000
  QUALIFY row_number() OVER (PARTITION BY a.event_id, b.input ORDER BY abs(b.t_ns - a.t_ns), b.event_id) = 1
)"""


@query("t13_nearest_sets_stream", f"""{_SETS}
SELECT a.event_id, a.other AS error_id, a.dt AS error_dt, b.other AS purchase_id, b.dt AS purchase_dt FROM near a JOIN near b ON a.event_id = b.event_id AND a.input = 1 AND b.input = 2
WHERE (a.t_ns + 600000000000) // 1000000 <= (SELECT max(t_ns) // 1000000 FROM x)""")
def t13(v):
    """Sets of three inputs of a vehicle, decided once all that could be nearer has come."""
    e = _events(v).select((c("sensor") % 10).alias("key"), c("event_id").alias("id"), "t_ns", "ts", "event_type")
    found = T.run_once(S.nearest_sets([e.filter(c("event_type") == x) for x in ("click", "error", "purchase")], "key", 600_000_000_000, NOW))
    return found.select(c("id_0").alias("event_id"), c("id_1").alias("error_id"), c("dt_1").alias("error_dt"), c("id_2").alias("purchase_id"), c("dt_2").alias("purchase_dt"))


@query("j05_three_inputs", """
WITH x AS (SELECT event_id, t_ns, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS input FROM stream_ev WHERE event_type IN ('click', 'error', 'purchase')),
near AS (
  SELECT a.event_id, b.input, b.event_id AS other, abs(b.t_ns - a.t_ns) AS dt FROM x a JOIN x b ON a.input = 0 AND b.input > 0 AND abs(b.t_ns - a.t_ns) <= 600000000000
  QUALIFY row_number() OVER (PARTITION BY a.event_id, b.input ORDER BY abs(b.t_ns - a.t_ns), b.event_id) = 1
)
SELECT a.event_id, a.other AS error_id, a.dt AS error_dt, b.other AS purchase_id, b.dt AS purchase_dt FROM near a JOIN near b ON a.event_id = b.event_id AND a.input = 1 AND b.input = 2""")
def j05_three(v):
    from scanlake.operators.sync import nearest_sets

    s = v.stream_ev()
    lead, *others = (s.filter(c("event_type") == x).select("event_id", "t_ns") for x in ("click", "error", "purchase"))
    found = nearest_sets(lead, others, 600_000_000_000)
    return found.select("event_id", c("id_1").alias("error_id"), c("dt_1").alias("error_dt"), c("id_2").alias("purchase_id"), c("dt_2").alias("purchase_dt"))


@query("t16_configuration_stream", """
WITH q AS (SELECT sensor, t_ns, event_id, row_number() OVER (PARTITION BY sensor ORDER BY t_ns, event_id) AS version FROM stream_ev WHERE event_type = 'signup')
SELECT p.event_id, CAST(q.version AS BIGINT) AS version, R4(p.value * (1 + q.event_id % 7) + q.event_id % 11) AS value
FROM (SELECT * FROM stream_ev WHERE event_type <> 'signup') p ASOF JOIN q ON p.sensor = q.sensor AND p.t_ns >= q.t_ns""")
def t16(v):
    """Each packet by the scale and offset of its sensor's configuration in force."""
    e = _events(v)
    text = F.to_json(F.struct((1 + c("event_id") % 7).alias("scale"), (c("event_id") % 11).alias("offset"))).cast("binary")
    configurations = e.filter("event_type = 'signup'").select("sensor", "seq", "ts", text.alias("configuration"))

    def prepare(blob):
        import json

        return json.loads(blob)

    def decode(table, packets):
        return packets[["event_id"]].assign(value=packets["value"] * table["scale"] + table["offset"])

    packets = e.filter("event_type <> 'signup'").select("sensor", "seq", "ts", "event_id", "value")
    found = T.run_once(S.configured_stream(packets, configurations, prepare, decode, "event_id long, value double", NOW))
    return found.select("event_id", "version", out4("value").alias("value"))


@query("t11_rates_stream", """WITH g AS (SELECT *, (t_ns - lag(t_ns) OVER (PARTITION BY sensor ORDER BY t_ns, event_id)) / 1e9 AS gap FROM stream_ev)
SELECT event_id, n_gaps, R4(rate * 1e6) AS rate_uhz, (n_gaps = 5 AND rate BETWEEN 0.00001 AND 0.001) AS valid FROM (
 SELECT event_id, count(CASE WHEN gap > 0 THEN 1 / gap END) OVER w AS n_gaps, avg(CASE WHEN gap > 0 THEN 1 / gap END) OVER w AS rate FROM g
 WINDOW w AS (PARTITION BY sensor ORDER BY t_ns, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""")
def t11(v):
    """Rates of each sensor's messages, carried from trigger to trigger."""
    r = T.run_once(S.rates_stream(_events(v), 5, 0.00001, 0.001, NOW))
    return r.select("event_id", "n_gaps", out4(F.col("rate_hz") * 1e6).alias("rate_uhz"), "valid")
