"""Point clouds, sparse block plans and world bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanengine.functions import geometry as g


def selected(frames: DataFrame, stride: int = 1) -> DataFrame:
    """Frames whose sequence is a multiple of stride."""
    return frames if stride == 1 else frames.where(F.col("seq") % stride == 0)


def points(px: DataFrame, frames: DataFrame, cam: g.Camera, stride: int = 1, pixel_stride: int = 1) -> DataFrame:
    """M1 (P1-P4): world points of valid pixels: (seq, u, v, raw, wx, wy, wz).  The filters run before the join."""
    p = selected(px, stride).where("raw > 0")
    if pixel_stride > 1:
        p = p.where((F.col("u") % pixel_stride == 0) & (F.col("v") % pixel_stride == 0))
    z = g.metric(F.col("raw"), cam)
    x, y = g.camera_point(F.col("u"), F.col("v"), z, cam)
    p = p.select("seq", "u", "v", "raw", x.alias("x"), y.alias("y"), z.alias("z"))
    posed = selected(frames, stride).where("has_pose").select("seq", *[f"m{i}" for i in range(12)])
    w = g.transform(g.pose(), F.col("x"), F.col("y"), F.col("z"))
    return p.join(posed, "seq").select("seq", "u", "v", "raw", *[c.alias(n) for c, n in zip(w, ("wx", "wy", "wz"))])


def plan(pts: DataFrame, grid: g.Grid) -> DataFrame:
    """Distinct blocks within truncation of a point: (bx, by, bz, is_surface).

    Spans are made distinct before they are exploded, so the explosion grows with the surface, not with the pixels; a
    block is a surface block if a point lies in it.
    """
    axes = ("x", "y", "z")
    cols = []
    for a in axes:
        lo, hi = g.span_of(F.col(f"w{a}"), grid.extent, grid.truncation)
        cols += [lo.alias(f"lo_{a}"), hi.alias(f"hi_{a}"), g.block_of(F.col(f"w{a}"), grid.extent).alias(f"b{a}")]
    spans = pts.select(*cols).distinct()
    out = spans
    for a in axes:
        out = out.withColumn(f"i{a}", F.explode(F.sequence(F.col(f"lo_{a}"), F.col(f"hi_{a}"))))
    hit = (F.col("ix") == F.col("bx")) & (F.col("iy") == F.col("by")) & (F.col("iz") == F.col("bz"))
    out = out.select(*[F.col(f"i{a}").cast("int").alias(f"b{a}") for a in axes], hit.alias("hit"))
    return out.groupBy("bx", "by", "bz").agg(F.max("hit").alias("is_surface"))


def plan_report(blocks: DataFrame) -> DataFrame:
    """Counts and bounds of a plan, its halo among them (U3: active blocks that are not surface)."""
    ends = [f(f"b{a}").cast("long").alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    return blocks.agg(
        F.count("*").alias("active_blocks"),
        F.count_if("is_surface").alias("surface_blocks"),
        F.count_if(~F.col("is_surface")).alias("halo_blocks"),
        *ends,
    )


def bounds(pts: DataFrame, grid: g.Grid, padding: float) -> DataFrame:
    """A5: padded world bounds snapped outward to whole voxels: origin and size in voxels by axis."""
    s, pad = g.lit(grid.voxel), g.lit(padding)
    raw = pts.agg(*[f(f"w{a}").alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])
    out = []
    for a in "xyz":
        low, high = F.col(f"min_{a}") - pad, F.col(f"max_{a}") + pad
        lo, hi = F.floor(low / s), F.ceil(high / s)
        lo = F.when(lo * s > low, lo - 1).otherwise(lo)
        hi = F.when(hi * s < high, hi + 1).otherwise(hi)
        out += [(lo * s).alias(f"origin_{a}"), (hi - lo).alias(f"voxels_{a}")]
    return raw.select(*out)


def counters(frames: DataFrame, px: DataFrame, stride: int = 1) -> DataFrame:
    """A3: frames in all, selected, integrated, lacking depth or pose (a frame that lacks both counts in both), and pixels
    of integrated frames by validity."""
    chosen = F.col("seq") % stride == 0
    whole = F.col("has_depth") & F.col("has_pose")
    f = frames.agg(
        F.count("*").alias("frames"),
        F.count_if(chosen).alias("selected"),
        F.count_if(chosen & whole).alias("integrated"),
        F.count_if(chosen & ~F.col("has_depth")).alias("missing_depth"),
        F.count_if(chosen & ~F.col("has_pose")).alias("missing_pose"),
    )
    used = px.join(frames.where(chosen & whole).select("seq"), "seq", "left_semi")
    p = used.agg(F.count_if(F.expr("raw > 0")).alias("valid_pixels"), F.count_if(F.expr("raw <= 0")).alias("invalid_pixels"))
    return f.crossJoin(p)  # one row each
