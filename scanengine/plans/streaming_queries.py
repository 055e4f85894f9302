"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanengine.operators import fuse, replay
from scanengine.plans.common import registrar
from scanengine.plans.fusion_queries import COARSE, blocks
from scanengine.plans.scan_sql import fused_with, plan_sql, scan_with
from scanengine.sources import derived
from scanengine.sources.derived import CAMERA
from scanengine.sources.scratch import scratch
from scanengine.plans import stream_queries
from scanengine.streaming import fusion, windows

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)

C = (COARSE.voxel, COARSE.truncation)


@query("t1_stream_fusion", fused_with(*C) + "SELECT bx, by, bz, l, tsdf_sum, weight FROM vo")
def t1(s, sf):
    """The scan in two advances of a stream; the second one sees the first one's frames again and ignores them."""
    folder = scratch(s, "stream-fusion")
    frames = derived.scan(s, sf)
    plan = blocks(s, sf)
    plan.write.parquet(f"{folder}/plan")
    plan = s.read.parquet(f"{folder}/plan")
    half = frames.agg(F.floor(F.max("seq") / 2).alias("h")).first()["h"]
    for part in (frames.where(F.col("seq") <= half), frames):
        part.sortWithinPartitions("seq").write.mode("append").parquet(f"{folder}/frames")
        fusion.advance(s, f"{folder}/frames", frames.schema, plan, CAMERA, COARSE, folder)
    return fusion.state_of(s, folder)


@query("u4_pending_blocks", scan_with(plan_sql(*C)) + "SELECT bx, by, bz FROM pl WHERE NOT is_surface")
def u4(s, sf):
    b = blocks(s, sf)
    return fusion.pending(b, b.where("is_surface"))


_HALF = "(SELECT CAST(floor(max(seq) / 2) AS BIGINT) FROM fr)"


@query(
    "u4_pending_after_half",
    fused_with(*C) + f"SELECT bx, by, bz FROM pl EXCEPT SELECT bx, by, bz FROM ev WHERE status = 'contributes' AND seq <= {_HALF}",
)
def u4_half(s, sf):
    """Blocks that the first half of the frames has not reached."""
    frames, b = derived.scan(s, sf), blocks(s, sf)
    half = frames.agg(F.floor(F.max("seq") / 2).alias("h")).first()["h"]
    return fusion.pending(b, fuse.observed_blocks(frames.where(F.col("seq") <= half), b, CAMERA, COARSE))


@query("t10_event_windows", "SELECT event_type, CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def t10(s, sf):
    """Hourly windows, as a stream with a watermark would count them."""
    e = derived.table(s, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    n = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return n.select("event_type", F.unix_seconds("w.start").alias("start"), "n")


@query("t10_stream_windows", stream_queries.SQL["j2_imu_windows"])
def t10_stream(s, sf):
    """J2 by streams: frames and samples arrive in files, in the order of time, two files of each stream a batch."""
    out = scratch(s, "stream-windows")
    frames = replay.sequenced(stream_queries.stream(s, sf, "view")).select("seq", "ts", "previous")
    samples = stream_queries.stream(s, sf, "click").select("id", "ts")
    ends = samples.agg(F.percentile_approx("ts", [0.25, 0.5, 0.75], 1000).alias("q")).first()["q"] or []
    for low, high in zip([None, *ends], [*ends, None]):
        part = (F.lit(True) if low is None else F.col("ts") > low) & (F.lit(True) if high is None else F.col("ts") <= high)
        for name, rows in (("frames", frames), ("samples", samples)):
            rows.where(part).coalesce(1).write.mode("append").parquet(f"{out}/{name}")
        windows.run(s, f"{out}/frames", f"{out}/samples", out, 30 * stream_queries.MINUTE, "7 days", "1 day", files=2)
    return windows.windows(s, out)
