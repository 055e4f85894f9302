"""Colours and rasters as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ramp(value: Column, stops: list[tuple[float, float, float]]) -> list[Column]:
    """Red, green and blue of a value in [0, 1], linear between evenly spaced stops; values outside take the ends."""
    n = len(stops) - 1
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)) * F.lit(float(n))
    lower = F.least(F.lit(n - 1), F.floor(scaled).cast("int"))
    part = scaled - lower
    table = [F.array(*[F.lit(float(s[k])) for s in stops]) for k in range(3)]
    return [F.get(t, lower) * (F.lit(1.0) - part) + F.get(t, lower + 1) * part for t in table]


def rasterise(tri: DataFrame, pixel: float) -> DataFrame:
    """(px, py, depth, face): the nearest triangle of each pixel whose centre it covers, seen along z.

    tri: face, ax ay az .. cz in view coordinates.  Each triangle is exploded over the pixels of its bounding box; of
    equal depths the lowest face wins.  Triangles seen edge-on cover nothing.
    """
    s = F.lit(float(pixel))
    x, y, z = ([F.col(f"{v}{a}") for v in "abc"] for a in "xyz")
    lo = lambda c: F.ceil(F.least(*c) / s - F.lit(0.5))
    hi = lambda c: F.floor(F.greatest(*c) / s - F.lit(0.5))
    area = (x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0])
    t = tri.withColumn("area", area).where("area <> 0").select("*", lo(x).alias("x0"), hi(x).alias("x1"), lo(y).alias("y0"), hi(y).alias("y1"))
    t = t.where("x1 >= x0 and y1 >= y0").withColumn("px", F.explode(F.sequence("x0", "x1"))).withColumn("py", F.explode(F.sequence("y0", "y1")))
    u, v = (F.col("px") + F.lit(0.5)) * s, (F.col("py") + F.lit(0.5)) * s
    edge = lambda i, j: (x[j] - x[i]) * (v - y[i]) - (u - x[i]) * (y[j] - y[i])
    w = [edge(1, 2) / F.col("area"), edge(2, 0) / F.col("area"), edge(0, 1) / F.col("area")]
    t = t.select("face", "px", "py", *[c.alias(f"w{k}") for k, c in enumerate(w)], "az", "bz", "cz").where("w0 >= 0 and w1 >= 0 and w2 >= 0")
    t = t.select("px", "py", F.struct((F.col("w0") * F.col("az") + F.col("w1") * F.col("bz") + F.col("w2") * F.col("cz")).alias("depth"), "face").alias("s"))
    return t.groupBy("px", "py").agg(F.min("s").alias("s")).select("px", "py", "s.depth", "s.face")


def view_basis(azimuth: float, elevation: float) -> list[list[float]]:
    """The right, down and forward directions of a camera that looks at the scene from an azimuth and an elevation, in
    degrees, with z up."""
    import math

    a, e = math.radians(azimuth), math.radians(elevation)
    forward = [-math.cos(e) * math.cos(a), -math.cos(e) * math.sin(a), -math.sin(e)]
    right = [-math.sin(a), math.cos(a), 0.0]
    down = [forward[1] * right[2] - forward[2] * right[1], forward[2] * right[0] - forward[0] * right[2], forward[0] * right[1] - forward[1] * right[0]]
    return [right, down, forward]


def fitted(points: DataFrame, basis: list[list[float]], width: int, height: int, margin: float = 0.05) -> DataFrame:
    """Points (x, y, z and others) with px, py: the largest flat view along a basis in which all of them are in the
    picture but for a margin.  One row of bounds is all that is gathered."""
    along = lambda d: sum((F.col(a) * F.lit(float(x)) for a, x in zip("xyz", d)), F.lit(0.0))
    p = points.withColumn("_r", along(basis[0])).withColumn("_d", along(basis[1]))
    b = p.agg(F.min("_r").alias("r0"), F.max("_r").alias("r1"), F.min("_d").alias("d0"), F.max("_d").alias("d1")).first()
    if b["r0"] is None:
        return p.drop("_r", "_d").select("*", F.lit(0.0).alias("px"), F.lit(0.0).alias("py"))
    room = 1 - 2 * margin
    scale = min(room * width / max(b["r1"] - b["r0"], 1e-9), room * height / max(b["d1"] - b["d0"], 1e-9))
    px = F.lit(width / 2) + (F.col("_r") - F.lit((b["r0"] + b["r1"]) / 2)) * F.lit(scale)
    py = F.lit(height / 2) + (F.col("_d") - F.lit((b["d0"] + b["d1"]) / 2)) * F.lit(scale)
    return p.select(*points.columns, px.alias("px"), py.alias("py"))
