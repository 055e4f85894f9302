"""Expansion of a plan into observed free space (F3, F4, F5, G4, P24): which blocks to propose, and which frames observe them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import vector, views

BLOCK = ["bx", "by", "bz"]
#: Metres by which bounds are widened, far beyond what rounding moves a coordinate.
PAD = 1e-6


def frame_bounds(scan: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """(seq, x0, x1, y0, y1, z0, z1): a box in metres that holds every voxel centre that a frame can observe.

    Such a centre projects into the image and lies at most a truncation behind the frame's largest reading, so it is inside
    the pyramid from the camera to the image's four outer corners at that depth; the pyramid's five points bound it.
    Frames without a reading observe nothing and have no row.
    """
    f = scan.where("has_depth and has_pose").withColumn("_deepest", F.array_max("depth")).where("_deepest > 0")
    z = g.metric(F.col("_deepest"), cam) + g.lit(grid.truncation)
    ends = [[F.col(f"m{k}")] for k in (3, 7, 11)]
    for u in (-0.5, cam.width - 0.5):
        for v in (-0.5, cam.height - 0.5):
            x, y = g.camera_point(g.lit(u), g.lit(v), z, cam)
            for axis, c in zip(ends, g.transform(g.pose(), x, y, z)):
                axis.append(c)
    return f.select("seq", *[c for a, e in zip("xyz", ends) for c in ((F.least(*e) - g.lit(PAD)).alias(f"{a}0"), (F.greatest(*e) + g.lit(PAD)).alias(f"{a}1"))])


def box_of(bounds: DataFrame, grid: g.Grid) -> DataFrame:
    """(x0, x1, y0, y1, z0, z1): the lowest and highest block of all bounds; null of none."""
    block = lambda c: F.floor(c / g.lit(grid.extent)).cast("long")
    return bounds.agg(*[block(f(f"{a}{k}")).alias(f"{a}{k}") for a in "xyz" for k, f in ((0, F.min), (1, F.max))])


def candidate_box(scan: DataFrame, cam: g.Camera, grid: g.Grid) -> views.Box:
    """The box of all blocks that some frame may observe, as its lowest and highest block: six numbers, whatever it holds."""
    r = box_of(frame_bounds(scan, cam, grid), grid).first()
    if r["x0"] is None:
        return np.zeros(3, np.int64), np.full(3, -1, np.int64)
    return np.array([r[f"{a}0"] for a in "xyz"]), np.array([r[f"{a}1"] for a in "xyz"])


def margin(cam: g.Camera, grid: g.Grid, diagonal: float) -> float:
    """How far from the convex hull of the cameras and the surfaces an observed voxel centre can lie.

    Let a reading of depth d <= diagonal stand on the ray through its pixel's centre.  A centre that falls on this pixel lies
    at most half a pixel aside of that ray, which is at most (d + truncation) times half a pixel's diagonal in metres a
    metre of depth; and along the ray at most a truncation of depth beyond the reading, which is longest at the corner of
    the image farthest from its centre.
    """
    aside = math.hypot(0.5 / cam.fx, 0.5 / cam.fy)
    corner = [max(c, n - 1 - c) / f for c, n, f in ((cam.cx, cam.width, cam.fx), (cam.cy, cam.height, cam.fy))]
    return grid.truncation * math.hypot(1.0, *corner) + (diagonal + grid.truncation) * aside


def hull_box(blocks: DataFrame, frames: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """(margin, x0, x1, y0, y1, z0, z1): the box of a plan's blocks and the cameras of frames with depth, widened by the
    margin, as its lowest and highest block.  It needs no depth images, and is wider than candidate_box()."""
    e = g.lit(grid.extent)
    held = blocks.agg(*[c for a in "xyz" for c in ((F.min(f"b{a}") * e).alias(f"{a}0"), ((F.max(f"b{a}") + 1) * e).alias(f"{a}1"))])
    seen = frames.where("has_depth and has_pose").agg(*[f(f"m{k}").alias(f"{a}{n}") for k, a in ((3, "x"), (7, "y"), (11, "z")) for n, f in ((0, F.min), (1, F.max))])
    both = held.unionByName(seen).agg(*[f(f"{a}{n}").alias(f"{a}{n}") for a in "xyz" for n, f in ((0, F.min), (1, F.max))])
    span = [F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz"]
    at_none, a_metre = margin(cam, grid, 0.0), margin(cam, grid, 1.0) - margin(cam, grid, 0.0)
    wide = both.withColumn("margin", g.lit(at_none) + g.lit(a_metre) * F.sqrt(span[0] * span[0] + span[1] * span[1] + span[2] * span[2]))
    low = [F.floor((F.col(f"{a}0") - F.col("margin")) / e).cast("long").alias(f"{a}0") for a in "xyz"]
    high = [F.floor((F.col(f"{a}1") + F.col("margin")) / e).cast("long").alias(f"{a}1") for a in "xyz"]
    return wide.select("margin", *[c for pair in zip(low, high) for c in pair])


def observed(scan: DataFrame, cam: g.Camera, grid: g.Grid, hide: bool = True, box: views.Box | None = None) -> DataFrame:
    """(bx, by, bz) of every block in which some voxel contributes in some frame.  The candidates are those of the frames'
    own bounds unless a box is given; nobody lists them."""
    return vector.contributing_in_box(scan, candidate_box(scan, cam, grid) if box is None else box, cam, grid, hide).distinct()


def expanded(scan: DataFrame, plan: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """(bx, by, bz, planned, approved): a plan's blocks and those that frames observe, wherever they lie."""
    both = plan.select(*BLOCK, F.lit(True).alias("planned"), F.lit(False).alias("approved")).unionByName(
        observed(scan, cam, grid).select(*BLOCK, F.lit(False).alias("planned"), F.lit(True).alias("approved"))
    )
    return both.groupBy(*BLOCK).agg(F.max("planned").alias("planned"), F.max("approved").alias("approved"))


def pruned(scan: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """(seq, candidates, judged, in_view, evaluated): what the cubes and the largest depths spare each frame."""
    return vector.pruning(scan, candidate_box(scan, cam, grid), cam, grid)
