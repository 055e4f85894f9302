"""Voxel evaluation and order-exact fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import vector, views

BLOCK = ["bx", "by", "bz"]
VOXEL = [*BLOCK, "l"]
#: Plans hold at most this many blocks, so a plan of (int, int, int) rows is sent to all executors whole.
MOST_BLOCKS = 250_000
#: Outcomes of a voxel in a frame, in the order in which they are tested.
STATUSES = (
    "missing-depth-and-pose", "missing-depth", "missing-pose", "camera-point-nonfinite", "camera-z-nonpositive", "projection-nonfinite",
    "projection-outside-image", "depth-invalid", "signed-distance-nonfinite", "behind-truncation", "contributes",
)




def small_plan(blocks: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """blocks, marked for broadcast if they are within the plan limit; larger ones are joined as Spark sees fit."""
    b = blocks.select(*BLOCK)
    return F.broadcast(b) if b.limit(most + 1).count() <= most else b


def fenced(df: DataFrame) -> DataFrame:
    """df behind a fence that filters do not pass, so that none of them repeats the arithmetic below it."""
    return df.withColumn("_fence", F.spark_partition_id()).where("_fence >= 0").drop("_fence")


def with_corners(pairs: DataFrame, grid: g.Grid) -> DataFrame:
    """pairs with the camera coordinates of the block's eight extreme voxel centres (x0.. y0.. z0..) and _slack."""
    s = g.lit(grid.voxel)
    ends = {a: [(F.col(f"b{a}") * g.SIDE + F.lit(k) + g.lit(0.5)) * s for k in (0, 7)] for a in "xyz"}
    m = g.pose()
    pts = [g.inverse_transform(m, x, y, z) for x in ends["x"] for y in ends["y"] for z in ends["z"]]
    deltas = [F.abs(e - m[3 + 4 * k]) for k, a in enumerate("xyz") for e in ends[a]]
    slack = g.lit(1e-9) * (g.lit(1.0) + F.greatest(*deltas))
    named = [c.alias(f"_{a}{i}") for i, p in enumerate(pts) for a, c in zip("xyz", p)]
    return fenced(pairs.select("*", *named, slack.alias("_slack")))


def corner(axis: str) -> list[Column]:
    return [F.col(f"_{axis}{i}") for i in range(8)]


CORNERS = [f"_{a}{i}" for i in range(8) for a in "xyz"] + ["_slack"]


def culled_pairs(pairs: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """pairs with corners and a verdict: 'behind', 'outside' or 'evaluate'.

    It follows from the camera coordinates of the block's extreme voxel centres; what rounding could change is evaluated.
    """
    xs, ys, zs = corner("x"), corner("y"), corner("z")
    edge = lambda c, f, off: [g.lit(f) * x + g.lit(off) * z for x, z in zip(c, zs)]
    left = F.greatest(*edge(xs, cam.fx, cam.cx + 0.5 + 0.5)) < 0
    right = F.least(*edge(xs, cam.fx, cam.cx - (cam.width - 0.5) - 0.5)) > 0
    top = F.greatest(*edge(ys, cam.fy, cam.cy + 0.5 + 0.5)) < 0
    bottom = F.least(*edge(ys, cam.fy, cam.cy - (cam.height - 0.5) - 0.5)) > 0
    safe = abs(cam.fx) <= 1e4 and abs(cam.fy) <= 1e4 and max(cam.width, cam.height, abs(cam.cx), abs(cam.cy)) <= 1e5
    behind = F.greatest(*zs) < -F.col("_slack")
    outside = (F.least(*zs) > F.col("_slack")) & (left | right | top | bottom)
    verdict = F.when(behind, "behind").when(outside, "outside").otherwise("evaluate") if safe else F.lit("evaluate")
    return fenced(with_corners(pairs, grid).withColumn("verdict", verdict))


def pairs_of(scan: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every integrated frame with every block of the plan, which is sent to the frames.

    Frames are dealt out by number first: a frame is a few kilobytes and millions of voxel evaluations, so partitions sized
    by bytes would leave most cores idle.
    """
    spark = scan.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = scan.where("has_depth and has_pose").select("seq", "depth", *[f"m{i}" for i in range(12)])
    whole = whole if scan.isStreaming else whole.repartition(parts, "seq")
    return whole.crossJoin(small_plan(blocks))  # the plan is bounded, see MOST_BLOCKS


def evaluated(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid, culled: bool = True) -> DataFrame:
    """(seq, bx, by, bz, l, status, sd) of each voxel in each integrated frame that the cull lets through.

    A frame's depth image rides along as an array and a voxel reads its pixel from it, so no voxel is shuffled to be
    evaluated.  sd is the signed distance where the pixel has depth.
    """
    p = pairs_of(scan, blocks)
    if culled:
        p = culled_pairs(p, cam, grid).where("verdict = 'evaluate'")
    v = p.select("seq", "depth", *[f"m{i}" for i in range(12)], *BLOCK, F.explode(F.sequence(F.lit(0), F.lit(511))).alias("l"))
    part = {"x": F.col("l") % 8, "y": F.floor(F.col("l") / 8) % 8, "z": F.floor(F.col("l") / 64)}
    v = v.select("seq", "depth", *[f"m{i}" for i in range(12)], *VOXEL, *[g.centre(F.col(f"b{a}") * g.SIDE + part[a], grid.voxel).alias(f"p{a}") for a in "xyz"])
    xc, yc, zc = g.inverse_transform(g.pose(), F.col("px"), F.col("py"), F.col("pz"))
    v = v.select("seq", "depth", *VOXEL, xc.alias("xc"), yc.alias("yc"), zc.alias("zc"))
    u, w = g.projected(F.col("xc"), F.col("zc"), cam.fx, cam.cx), g.projected(F.col("yc"), F.col("zc"), cam.fy, cam.cy)
    v = v.select("seq", "depth", *VOXEL, "zc", u.alias("u"), w.alias("v"))
    seen = g.in_image(F.col("u"), cam.width) & g.in_image(F.col("v"), cam.height)
    pixel = g.nearest_pixel(F.col("v")) * cam.width + g.nearest_pixel(F.col("u"))
    v = fenced(v.select("seq", *VOXEL, "zc", "u", "v", F.when(seen, F.get("depth", pixel)).alias("raw"), seen.alias("seen")))
    depth = g.metric(F.col("raw"), cam)
    v = v.select("seq", *VOXEL, "zc", "u", "v", "seen", "raw", F.when(F.col("raw") > 0, depth - F.col("zc")).alias("sd"))
    status = (
        F.when(F.isnan("zc") | (F.abs("zc") > g.lit(1e300)), STATUSES[3])
        .when(F.col("zc") <= 0, STATUSES[4])
        .when(F.isnan("u") | F.isnan("v"), STATUSES[5])
        .when(~F.col("seen"), STATUSES[6])
        .when(F.col("raw") <= 0, STATUSES[7])
        .when(F.isnan("sd"), STATUSES[8])
        .when(F.col("sd") < g.lit(-grid.truncation), STATUSES[9])
        .otherwise(STATUSES[10])
    )
    return v.select("seq", *VOXEL, status.alias("status"), "sd")


def contributions(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid, culled: bool = True) -> DataFrame:
    """(seq, bx, by, bz, l, delta) of voxels that a frame adds to."""
    e = evaluated(scan, blocks, cam, grid, culled).where(F.col("status") == "contributes")
    return e.select("seq", *VOXEL, g.truncated(F.col("sd"), grid.truncation).alias("delta"))


def ordered_sum(order: str, value: str) -> Column:
    """A sum in the order of observations, the same bits whatever the partitioning."""
    rows = F.array_sort(F.collect_list(F.struct(order, value)))
    return F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + x[value])


def fuse(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid, culled: bool = True) -> DataFrame:
    """A1: (bx, by, bz, l, tsdf_sum, weight) of observed voxels.

    A frame is evaluated where its image lies; one shuffle brings a row for each frame and block that it adds to, and sums
    are made in the order of frames.  Without the cull, and for streams, contributions are rows of their own: the same
    bits by built-in functions alone.
    """
    if culled and not scan.isStreaming:
        return vector.folded(vector.packed_contributions(scan, blocks, cam, grid))
    c = contributions(scan, blocks, cam, grid, culled)
    return c.groupBy(*VOXEL).agg(ordered_sum("seq", "delta").alias("tsdf_sum"), F.count("*").alias("weight"))


def status_histogram(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """A2: how often each outcome came over all voxels and frames.

    Frames without depth or pose add all voxels of the plan under their own status; whole blocks that the cull settles
    are counted as blocks where every voxel has the one outcome.
    """
    n = blocks.agg((F.count("*") * 512).alias("voxels"))
    lacking = scan.where("not (has_depth and has_pose)").select(
        F.when(~F.col("has_depth") & ~F.col("has_pose"), STATUSES[0]).when(~F.col("has_depth"), STATUSES[1]).otherwise(STATUSES[2]).alias("status")
    )
    whole = lacking.groupBy("status").count().crossJoin(n).select("status", (F.col("count") * F.col("voxels")).alias("n"))
    some = vector.status_counts(scan, blocks, cam, grid).select(F.get(F.array(*map(F.lit, STATUSES)), F.col("code")).alias("status"), "n")
    return whole.unionByName(some).groupBy("status").agg(F.sum("n").alias("n"))


def volume_report(volume: DataFrame, blocks: DataFrame) -> DataFrame:
    """A4: voxels of the plan, observed, fused (seen more than once), unknown, and the largest weight."""
    v = volume.agg(F.count("*").alias("observed"), F.count_if(F.expr("weight > 1")).alias("fused"), F.coalesce(F.max("weight"), F.lit(0)).alias("max_weight"))
    n = blocks.agg((F.count("*") * 512).alias("voxels"))
    return n.crossJoin(v).withColumn("unknown", F.col("voxels") - F.col("observed"))


def cross_view(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """Each planned voxel's verdict over all frames: surface, else free-space, else occluded, else unseen.

    Tasks keep the best sample of each voxel of the blocks that their frames see, 512 bytes a block; those are spread into
    voxels only after the blocks met.
    """
    v = vector.best_of_voxels(scan, blocks, cam, grid)
    name = F.get(F.array(*map(F.lit, ("unseen", "occluded", "free-space", "surface"))), F.col("kind"))
    return v.select(*VOXEL, name.alias("verdict"))


def sampling(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """How often each sampling status comes: free, band or occluded where depth was read, else why not."""
    t = g.lit(grid.truncation)
    kind = F.when(F.col("sd") > t, "free-space").when(F.col("sd") >= -t, "surface-band").when(F.col("sd") < -t, "occluded").otherwise(F.col("status"))
    return evaluated(scan, blocks, cam, grid, culled=False).groupBy(kind.alias("sample")).agg(F.count("*").alias("n"))


def observed_blocks(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """Candidate blocks in which some voxel contributes (F4's approval)."""
    return vector.contributing(scan, blocks, cam, grid).distinct()


def expansion_parts(plan: DataFrame, candidates: DataFrame, approved: DataFrame) -> DataFrame:
    """(bx, by, bz, part) of each candidate: surface or halo of the plan, approved beside it, or rejected."""
    d = candidates.select(*BLOCK).join(plan.select(*BLOCK, "is_surface"), BLOCK, "left").join(approved.select(*BLOCK).distinct().withColumn("_seen", F.lit(True)), BLOCK, "left")
    part = F.when(F.col("is_surface"), "surface").when(F.col("is_surface").isNotNull(), "halo").when(F.col("_seen"), "approved").otherwise("rejected")
    return d.select(*BLOCK, part.alias("part"))


def depth_tiles(px: DataFrame, cam: g.Camera, side: int = 8) -> DataFrame:
    """The largest depth of each tile of pixels: (seq, tu, tv, depth)."""
    z = F.when(F.col("raw") > 0, g.metric(F.col("raw"), cam)).otherwise(g.lit(0.0))
    return px.groupBy("seq", F.floor(F.col("u") / side).alias("tu"), F.floor(F.col("v") / side).alias("tv")).agg(F.max(z).alias("depth"))


def hidden(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """(seq, bx, by, bz) of blocks that lie behind all depth in the rectangle they project to.

    The rectangle spans the nearest pixels of the corners, one more on each side, widened to whole tiles; without a
    reading its largest depth is 0.  Blocks that reach behind the camera are never called hidden.
    """
    return vector.block_verdicts(scan, blocks, cam, grid, True, (views.HIDDEN,)).drop("code")


def verdicts(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """(seq, bx, by, bz, verdict) of each integrated frame and block: behind, outside or evaluate."""
    code = F.col("code")
    named = F.when(code == views.BEHIND, "behind").when(code == views.OUTSIDE, "outside").otherwise("evaluate")
    return vector.block_verdicts(scan, blocks, cam, grid).select("seq", *BLOCK, named.alias("verdict"))


def compare_volumes(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each block of a: identical, different or absent in b; sums are compared by their bytes."""
    side = lambda d: d.groupBy(*BLOCK).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("l").cast("string"), 3, "0"), F.col("tsdf_sum").cast("string"), F.col("weight").cast("string")))), ","), 256).alias("digest")
    )
    x, y = side(a), side(b).withColumnRenamed("digest", "other")
    verdict = F.when(F.col("other").isNull(), "absent").when(F.col("other") == F.col("digest"), "identical").otherwise("different")
    return x.join(y, BLOCK, "left").select(*BLOCK, verdict.alias("verdict"))
