"""A depth scan derived from the driver's tables by plain SQL, so that every operator has real rows to run on.

Frames are runs of 625 orders; pixels come from line items; poses alternate between no turn and a turn by the rational
angle (0.6, 0.8), so both engines agree on every bit.  Some frames lack a pose or a depth image, as real scans do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanengine.functions.batches import whole_runs
from scanengine.functions.geometry import Camera

CAMERA = Camera()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequence_of() -> Column:
    return F.floor(F.col("l_orderkey") / 625).cast("long")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, u, v, raw): depth in thousandths of a metre; frames with seq % 7 = 6 have none."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            sequence_of().alias("seq"),
            (F.col("l_partkey") % 32).cast("int").alias("u"),
            ((F.col("l_orderkey") + F.col("l_linenumber") * 5) % 24).cast("int").alias("v"),
            (F.col("l_quantity") * 100).cast("long").alias("raw"),
        )
        .where("seq % 7 <> 6")
        .groupBy("seq", "u", "v")
        .agg(F.min("raw").alias("raw"))
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, has_depth, has_pose, m0..m11): a row a frame; m is null without a pose (seq % 11 = 10)."""
    seq = table(spark, sf_dir, "lineitem").select(sequence_of().alias("seq")).distinct()
    return with_poses(seq)


def with_poses(seq: DataFrame) -> DataFrame:
    odd = F.col("seq") % 2 == 1
    step = (F.col("seq") % 24).cast("double")
    pick = lambda a, b: F.when(odd, F.lit(b)).otherwise(F.lit(a))
    m = [
        pick(1.0, 0.6), F.lit(0.0), pick(0.0, 0.8), step * F.lit(0.013),
        F.lit(0.0), F.lit(1.0), F.lit(0.0), step * F.lit(0.007),
        pick(0.0, -0.8), F.lit(0.0), pick(1.0, 0.6), F.lit(0.0),
    ]
    posed = F.col("seq") % 11 != 10
    return seq.select(
        "seq", (F.col("seq") % 7 != 6).alias("has_depth"), posed.alias("has_pose"), *[F.when(posed, x).alias(f"m{i}") for i, x in enumerate(m)]
    )


def depth_images(px: DataFrame, cam: Camera = CAMERA) -> DataFrame:
    """(seq, depth): a row-major array a frame, 0 where there is no reading.  Readings come sorted by frame and are put in
    their places, so a frame costs as much as it has pixels."""
    size = cam.width * cam.height
    most = max(1, 1_000_000 // size)

    def image(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, ["seq"]):
            seq, place, raw = (batch[c].to_numpy() for c in ("seq", "i", "raw"))
            which, first = np.unique(seq, return_index=True)
            ends = np.append(first, len(seq))
            for k in range(0, len(which), most):
                some = slice(ends[k], ends[min(k + most, len(which))])
                n = len(which[k : k + most])
                out = np.zeros((n, size), np.int32)
                out[np.searchsorted(which, seq[some]) - k, place[some]] = raw[some]
                depth = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(which[k : k + most]), depth], ["seq", "depth"])

    at = px.select("seq", (F.col("v") * cam.width + F.col("u")).alias("i"), F.col("raw").cast("int").alias("raw"))
    return at.repartition("seq").sortWithinPartitions("seq").mapInArrow(image, "seq long, depth array<int>")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames with their depth images (null where there is none)."""
    return frames(spark, sf_dir).join(depth_images(pixels(spark, sf_dir)), "seq", "left")


#: A camera of the size that published figures are for.
WIDE = Camera(640, 480, 525.0, 525.0, 319.5, 239.5)


def wide_scan(spark: SparkSession, sf_dir: str, most: int = 64, cam: Camera = WIDE) -> DataFrame:
    """frames as scan() has them, with full-size depth images of a slanted surface that moves with the frame."""
    seq = table(spark, sf_dir, "lineitem").select((F.floor(F.col("l_orderkey") / 625) % most).cast("long").alias("seq")).distinct()
    spots = F.sequence(F.lit(0), F.lit(cam.width * cam.height - 1))
    raw = lambda i: (1400 + F.floor(i % cam.width / 4) + F.floor(i / (cam.width * 3)) + F.col("seq") * 2).cast("int")
    f = with_poses(seq).withColumn("has_depth", F.lit(True))
    return f.withColumn("depth", F.transform(spots, raw))


#: The same tables for the SQL twins.
SCAN_SQL = """
px AS (
  SELECT CAST(floor(l_orderkey / 625) AS BIGINT) AS seq, CAST(l_partkey % 32 AS INTEGER) AS u,
         CAST((l_orderkey + l_linenumber * 5) % 24 AS INTEGER) AS v, min(CAST(l_quantity * 100 AS BIGINT)) AS raw
  FROM lineitem WHERE CAST(floor(l_orderkey / 625) AS BIGINT) % 7 <> 6 GROUP BY 1, 2, 3),
fr0 AS (SELECT DISTINCT CAST(floor(l_orderkey / 625) AS BIGINT) AS seq FROM lineitem),
fr AS (
  SELECT seq, seq % 7 <> 6 AS has_depth, seq % 11 <> 10 AS has_pose,
         CASE WHEN seq % 11 <> 10 THEN CASE WHEN seq % 2 = 1 THEN CAST('0.6' AS DOUBLE) ELSE CAST(1 AS DOUBLE) END END AS m0,
         CASE WHEN seq % 11 <> 10 THEN CAST(0 AS DOUBLE) END AS m1,
         CASE WHEN seq % 11 <> 10 THEN CASE WHEN seq % 2 = 1 THEN CAST('0.8' AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END AS m2,
         CASE WHEN seq % 11 <> 10 THEN CAST(seq % 24 AS DOUBLE) * CAST('0.013' AS DOUBLE) END AS m3,
         CASE WHEN seq % 11 <> 10 THEN CAST(0 AS DOUBLE) END AS m4,
         CASE WHEN seq % 11 <> 10 THEN CAST(1 AS DOUBLE) END AS m5,
         CASE WHEN seq % 11 <> 10 THEN CAST(0 AS DOUBLE) END AS m6,
         CASE WHEN seq % 11 <> 10 THEN CAST(seq % 24 AS DOUBLE) * CAST('0.007' AS DOUBLE) END AS m7,
         CASE WHEN seq % 11 <> 10 THEN CASE WHEN seq % 2 = 1 THEN CAST('-0.8' AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END AS m8,
         CASE WHEN seq % 11 <> 10 THEN CAST(0 AS DOUBLE) END AS m9,
         CASE WHEN seq % 11 <> 10 THEN CASE WHEN seq % 2 = 1 THEN CAST('0.6' AS DOUBLE) ELSE CAST(1 AS DOUBLE) END END AS m10,
         CASE WHEN seq % 11 <> 10 THEN CAST(0 AS DOUBLE) END AS m11
  FROM fr0),
cp AS (
  SELECT p.seq, p.u, p.v, p.raw, p.raw * CAST('0.001' AS DOUBLE) AS z,
         (p.u - CAST('15.5' AS DOUBLE)) * (p.raw * CAST('0.001' AS DOUBLE)) / CAST(24 AS DOUBLE) AS x,
         (p.v - CAST('11.5' AS DOUBLE)) * (p.raw * CAST('0.001' AS DOUBLE)) / CAST(24 AS DOUBLE) AS y
  FROM px p WHERE p.raw > 0),
pt AS (
  SELECT c.seq, c.u, c.v, c.raw, m0 * x + m1 * y + m2 * z + m3 AS wx, m4 * x + m5 * y + m6 * z + m7 AS wy, m8 * x + m9 * y + m10 * z + m11 AS wz
  FROM cp c JOIN fr f ON f.seq = c.seq WHERE f.has_pose)"""
