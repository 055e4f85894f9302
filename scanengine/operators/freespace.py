"""Free-space columns and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def band(low: float, high: float, voxel: float) -> tuple[int, int]:
    """the voxel layers whose centres lie in [low, high]."""
    import math

    return math.ceil(low / voxel - 0.5), math.floor(high / voxel - 0.5)


def window(v: DataFrame, voxel: float, a: tuple[float, float], b: tuple[float, float], up: str = "y") -> DataFrame:
    """the voxels whose centres lie in a rectangle of the ground, ends included."""
    flat = [x for x in "xyz" if x != up]
    for axis, (low, high) in zip(flat, (a, b)):
        v = v.where(((F.col(f"g{axis}").cast("double") + F.lit(0.5)) * F.lit(voxel)).between(F.lit(float(low)), F.lit(float(high))))
    return v


def columns(v: DataFrame, first: int, last: int, up: str = "y") -> DataFrame:
    """(a, b, verdict) of each column that holds a known voxel of the band: occupied if any is at or behind a surface,
    free if all of the band are known and none is, else unknown.  v: gx, gy, gz, value."""
    flat = [x for x in "xyz" if x != up]
    inside = v.where(F.col(f"g{up}").between(first, last))
    c = inside.groupBy(F.col(f"g{flat[0]}").alias("a"), F.col(f"g{flat[1]}").alias("b")).agg(F.count("*").alias("known"), F.max(F.col("value") <= 0).alias("hit"))
    return c.select("a", "b", F.when(F.col("hit"), "occupied").when(F.col("known") == last - first + 1, "free").otherwise("unknown").alias("verdict"))


def voxel_verdicts(points: DataFrame, v: DataFrame, voxel: float) -> DataFrame:
    """The verdict of the voxel that each point (id, x, y, z) lies in."""
    at = points.select("id", *[F.floor(F.col(a) / F.lit(voxel)).alias(f"g{a}") for a in "xyz"])
    verdict = F.when(F.col("value").isNull(), "unobserved").when(F.col("value") <= 0, "occupied").otherwise("free")
    return at.join(v, ["gx", "gy", "gz"], "left").select("id", "gx", "gy", "gz", verdict.alias("verdict"))


def chain(waypoints: DataFrame) -> DataFrame:
    """(leg, step, a, b): the cells of integer lines between waypoints (leg, a0, b0, a1, b1), ends included.

    The line's error is carried through a fold over the steps, so a leg is one row until it is exploded.
    """
    da, db = F.abs(F.col("a1") - F.col("a0")), F.abs(F.col("b1") - F.col("b0"))
    w = waypoints.select("leg", "a0", "b0", da.alias("da"), db.alias("db"), F.signum(F.col("a1") - F.col("a0")).cast("long").alias("sa"), F.signum(F.col("b1") - F.col("b0")).cast("long").alias("sb"), F.greatest(da, db).alias("n"))
    path = F.expr(
        "aggregate(sequence(1L, n), named_struct('e', da - db, 'a', a0, 'b', b0, 'p', array(named_struct('a', a0, 'b', b0))), "
        "(s, i) -> named_struct('e', s.e + if(2 * s.e > -db, -db, 0L) + if(2 * s.e < da, da, 0L), "
        "'a', s.a + if(2 * s.e > -db, sa, 0L), 'b', s.b + if(2 * s.e < da, sb, 0L), "
        "'p', concat(s.p, array(named_struct('a', s.a + if(2 * s.e > -db, sa, 0L), 'b', s.b + if(2 * s.e < da, sb, 0L))))), s -> s.p)"
    )
    whole = F.when(F.col("n") > 0, path).otherwise(F.array(F.struct(F.col("a0").alias("a"), F.col("b0").alias("b"))))
    return w.select("leg", F.posexplode(whole).alias("step", "c")).select("leg", "step", "c.a", "c.b")


def swept(cells: DataFrame, radius: int) -> DataFrame:
    """The distinct columns within radius of a chain."""
    r = F.sequence(F.lit(-radius), F.lit(radius))
    d = cells.select("a", "b").distinct().withColumn("da", F.explode(r)).withColumn("db", F.explode(r))
    d = d.where(F.col("da") * F.col("da") + F.col("db") * F.col("db") <= radius * radius)
    return d.select((F.col("a") + F.col("da")).alias("a"), (F.col("b") + F.col("db")).alias("b")).distinct()


def touched_blocks(cols: DataFrame, first: int, last: int, up: str = "y") -> DataFrame:
    """The blocks that a route's columns reach in the band."""
    flat = [x for x in "xyz" if x != up]
    b = cols.select(F.shiftright("a", 3).cast("int").alias(f"b{flat[0]}"), F.shiftright("b", 3).cast("int").alias(f"b{flat[1]}")).distinct()
    return b.withColumn(f"b{up}", F.explode(F.sequence(F.lit(first >> 3), F.lit(last >> 3)))).select("bx", "by", "bz")


def clearance(cols: DataFrame, volume: DataFrame, first: int, last: int, min_weight: int, up: str = "y") -> DataFrame:
    """Voxels of the route not seen often enough, those occupied, and the first of either in z, y, x order.

    volume: gx, gy, gz, tsdf_sum, weight; voxels of blocks that are not held count as unobserved.
    """
    flat = [x for x in "xyz" if x != up]
    need = cols.withColumn(f"g{up}", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
    need = need.select(F.col("a").cast("long").alias(f"g{flat[0]}"), F.col("b").cast("long").alias(f"g{flat[1]}"), f"g{up}")
    met = need.join(volume, ["gx", "gy", "gz"], "left")
    weak = F.coalesce(F.col("weight") < min_weight, F.lit(True))
    full = ~weak & (F.col("tsdf_sum") <= 0)
    n = met.agg(
        F.count("*").alias("voxels"), F.count_if(weak).alias("unobserved"), F.count_if(full).alias("occupied"), F.min(F.when(weak | full, F.struct("gz", "gy", "gx"))).alias("first")
    )
    verdict = F.when((F.col("unobserved") == 0) & (F.col("occupied") == 0), "clear").otherwise("not-clear")
    return n.select("voxels", "unobserved", "occupied", verdict.alias("verdict"), F.col("first.gx").alias("first_x"), F.col("first.gy").alias("first_y"), F.col("first.gz").alias("first_z"))


def waypoints(spark: SparkSession, points: list[tuple[int, int]]) -> DataFrame:
    """A route's legs from its waypoints (at most 4,096)."""
    if not 2 <= len(points) <= 4096:
        raise ValueError("a route has 2 to 4,096 waypoints")
    return spark.createDataFrame([(k, *a, *b) for k, (a, b) in enumerate(zip(points, points[1:]))], "leg int, a0 long, b0 long, a1 long, b1 long")
