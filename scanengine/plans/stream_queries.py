"""Queries of replay and association: event types of the events table play the sensor streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanengine.operators import replay
from scanengine.plans.common import registrar
from scanengine.sources.derived import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)

MINUTE = 60_000_000
_EV = "WITH st AS (SELECT event_id AS id, epoch_us(ts) AS ts, event_type FROM events), "


def stream(s, sf, kind: str | None = None) -> DataFrame:
    """(id, ts): events of one type with their timestamps in microseconds."""
    e = table(s, sf, "events")
    if kind:
        e = e.where(F.col("event_type") == kind)
    return e.select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))


_FRAMES = "fr AS (SELECT id, ts, row_number() OVER (ORDER BY ts, id) - 1 AS seq, lag(ts) OVER (ORDER BY ts, id) AS previous FROM st WHERE event_type = 'view')"


@query("w2_frame_sequence", _EV + _FRAMES + " SELECT id, ts, seq, previous FROM fr")
def w2(s, sf):
    return replay.sequenced(stream(s, sf, "view"))


@query(
    "j1_replay",
    _EV
    + _FRAMES
    + """, dp AS (SELECT ts, id AS depth_id FROM fr WHERE id % 3 <> 0), ps AS (SELECT ts, id AS pose_id FROM fr WHERE id % 5 <> 0)
    SELECT seq, previous, fr.ts, id AS rgb_id, depth_id, pose_id FROM fr LEFT JOIN dp ON dp.ts = fr.ts LEFT JOIN ps ON ps.ts = fr.ts""",
)
def j1(s, sf):
    rgb = stream(s, sf, "view")
    return replay.replay(rgb, rgb.where("id % 3 <> 0"), rgb.where("id % 5 <> 0"))


@query(
    "j2_imu_windows",
    _EV
    + _FRAMES
    + """ SELECT seq, s.id, s.ts FROM st s JOIN fr ON s.ts <= fr.ts AND (fr.previous IS NULL OR s.ts > fr.previous) WHERE s.event_type = 'click'""",
)
def j2(s, sf):
    return replay.imu_windows(replay.sequenced(stream(s, sf, "view")), stream(s, sf, "click"), 30 * MINUTE)


@query(
    "j3_candidates",
    _EV + "a AS (SELECT * FROM st WHERE event_type = 'view'), b AS (SELECT * FROM st WHERE event_type = 'error') "
    f"SELECT a.id AS ia, a.ts AS ta, b.id AS ib, b.ts AS tb FROM a JOIN b ON abs(a.ts - b.ts) < {5 * MINUTE}",
)
def j3_candidates(s, sf):
    return replay.candidates(stream(s, sf, "view"), stream(s, sf, "error"), 5 * MINUTE)


_NEAREST = "row_number() OVER (PARTITION BY {} ORDER BY abs(ta - tb), ta, tb, ia, ib) = 1"


@query(
    "j3_associate",
    "WITH RECURSIVE " + _EV.strip()[len("WITH") :]
    + f""" a AS (SELECT * FROM st WHERE event_type = 'view'), b AS (SELECT * FROM st WHERE event_type = 'error'),
    r(ia, ta, ib, tb, best) AS (
      SELECT a.id, a.ts, b.id, b.ts, false FROM a JOIN b ON abs(a.ts - b.ts) < {5 * MINUTE}
      UNION ALL SELECT ia, ta, ib, tb, best FROM (SELECT *, bool_or(best) OVER (PARTITION BY ia) OR bool_or(best) OVER (PARTITION BY ib) AS taken
        FROM (SELECT ia, ta, ib, tb, {_NEAREST.format("ia")} AND {_NEAREST.format("ib")} AS best FROM r WHERE NOT r.best) q) w WHERE best OR NOT taken)
    SELECT ia, ta, ib, tb FROM r WHERE best""",
)
def j3(s, sf):
    return replay.associate(stream(s, sf, "view"), stream(s, sf, "error"), 5 * MINUTE)


@query("a29_duration", _EV + "x AS (SELECT 1) SELECT event_type, max(ts) - min(ts) AS duration FROM st GROUP BY 1")
def a29(s, sf):
    e = table(s, sf, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return e.groupBy("event_type").agg((F.max("ts") - F.min("ts")).alias("duration"))


@query(
    "w1_not_increasing",
    "WITH o AS (SELECT o_orderkey AS line, epoch_us(o_orderdate) AS ts, lag(epoch_us(o_orderdate)) OVER (ORDER BY o_orderkey) AS previous FROM orders) "
    "SELECT line, ts, previous FROM o WHERE ts <= previous",
)
def w1(s, sf):
    o = table(s, sf, "orders").select(F.col("o_orderkey").alias("line"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    return replay.increasing(o)


@query("a24_row_digests", "SELECT event_id, sha256(event_id || '|' || user_id || '|' || event_type) AS digest FROM events")
def a24(s, sf):
    return replay.row_digests(table(s, sf, "events"), ["event_id", "user_id", "event_type"], "event_id")


@query(
    "s9_exact_nanoseconds",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN h = 5 AND q % 2 = 0 THEN q WHEN h >= 5 THEN q + 1 ELSE q END AS BIGINT) AS ns
    FROM (SELECT l_orderkey, l_linenumber, l_orderkey * 1000000 + l_linenumber AS q, CAST(l_quantity AS BIGINT) % 10 AS h FROM lineitem)""",
)
def s9(s, sf):
    """Decimal seconds with ten digits, rounded to nanoseconds with halves to even."""
    q = F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber")
    text = F.concat(F.floor(q / 1_000_000_000).cast("string"), F.lit("."), F.lpad((q % 1_000_000_000).cast("string"), 9, "0"), (F.col("l_quantity").cast("long") % 10).cast("string"))
    return table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", replay.nanoseconds(text).alias("ns"))
