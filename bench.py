"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from scanengine.plans import registry
from scanengine.session import local_session
from scanengine.sources import scratch

HEADLINE = (
    "g1_plan_blocks", "a1_fuse_voxels", "a1_fuse_blocks_arrow", "a2_status_histogram", "a7_cross_view_blocks", "f1_cull_verdicts", "f4_observed_expansion",
    "m9_mesh_triangles", "m5_surface_points", "a9_free_space_columns", "a10_route_clearance", "a11_w5_residual_summary", "j16_a15_view_survey",
    "j1_replay", "j2_imu_windows", "o3_block_sample", "a23_merkle_root",
)


def wide_fusion(spark, sf_dir: str) -> dict:
    """Plans and fuses frames of 640 by 480 pixels, as the published figures do, from a scan that lies in a table."""
    from pyspark.sql import functions as F

    from scanengine.functions.geometry import Grid
    from scanengine.operators import expansion, fuse, plan
    from scanengine.sources import derived

    grid, cam = Grid(0.005, 0.02), derived.WIDE
    scan = scratch.kept(derived.wide_scan(spark, sf_dir), "wide")
    px = scan.select("seq", F.posexplode("depth").alias("i", "raw"))
    px = px.select("seq", (F.col("i") % cam.width).alias("u"), F.floor(F.col("i") / cam.width).cast("int").alias("v"), F.col("raw").cast("long").alias("raw"))
    began = time.time()
    blocks = scratch.kept(plan.plan(plan.points(px, scan.drop("depth"), cam, 1, 4), grid), "wide-plan")
    n, frames = blocks.count(), scan.where("has_pose").count()
    planned = time.time()
    fuse.fuse(scan, blocks, cam, grid).write.format("noop").mode("overwrite").save()
    took = time.time() - planned
    seen = n * 512 * frames
    box, expand = expansion.candidate_box(scan, cam, grid), {}
    for name, hide in (("wide_expand_unpruned_sec", False), ("wide_expand_sec", True)):
        start = time.time()
        expand["wide_expand_blocks"] = expansion.observed(scan, cam, grid, hide, box).count()
        expand[name] = round(time.time() - start, 3)
    return expand | {"wide_frames": frames, "wide_blocks": n, "wide_plan_sec": round(planned - began, 3), "wide_fuse_sec": round(took, 3), "wide_observations": seen, "wide_observations_per_second": round(seen / took)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", 16)
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    took, failed = {}, {}
    found["g1_plan_blocks"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        scratch.forget()  # no query reads what another one made
        began = time.time()
        try:
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
        except Exception as e:  # one failing query must not hide the others' times
            failed[name] = str(e)[:200]
    # voxel-observations of the flagship: every voxel of the plan in every integrated frame, as the published figures count them
    from scanengine.plans.fusion_queries import FINE, blocks
    from scanengine.sources import derived

    frames = derived.frames(spark, sf_dir).where("has_depth and has_pose").count()
    observations = blocks(spark, sf_dir, FINE).count() * 512 * frames
    wide = wide_fusion(spark, sf_dir)
    out = {"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    out["voxel_observations"] = observations
    out |= wide
    if "a1_fuse_voxels" in took:
        out["voxel_observations_per_second"] = round(observations / took["a1_fuse_voxels"])
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
