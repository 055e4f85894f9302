"""Sensor noise on depth images."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanengine.functions import geometry as g


def drawn(frames: DataFrame, seed: int, height: int, width: int, shift: float, disparity: float) -> DataFrame:
    """(seq, nx, ny, nd): three fields of normal noise a frame, each an array in row order, that follow from the seed
    and the frame alone: no function of Spark draws the same numbers."""
    import numpy as np

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for seq in pdf.seq:
                r = np.random.default_rng([seed, int(seq)])
                fields = [r.normal(0.0, s, size=(height, width)).ravel() for s in (shift, shift, disparity)]
                rows.append({"seq": seq, "nx": fields[0], "ny": fields[1], "nd": fields[2]})
            yield pd.DataFrame(rows)

    return frames.select("seq").mapInPandas(draw, "seq long, nx array<double>, ny array<double>, nd array<double>")


def noisy(images: DataFrame, cam: g.Camera, constant: float) -> DataFrame:
    """P20: (seq, u, v, depth) in metres: each pixel reads the image at its shifted place, between four pixels, and keeps
    what a whole disparity says.

    images: seq, depth (raw, row-major), nx, ny, nd.  A reading off the image is taken at its edge; one that draws on a
    missing pixel, or whose disparity rounds below one, is 0.
    """
    w, h = cam.width, cam.height
    p = images.select("*", F.explode(F.sequence(F.lit(0), F.lit(w * h - 1))).alias("i"))
    u, v = F.col("i") % w, F.floor(F.col("i") / w).cast("int")
    x = F.least(F.lit(w - 1.0), F.greatest(F.lit(0.0), u + F.get("nx", F.col("i"))))
    y = F.least(F.lit(h - 1.0), F.greatest(F.lit(0.0), v + F.get("ny", F.col("i"))))
    p = p.select("seq", u.alias("u"), v.alias("v"), "depth", F.get("nd", F.col("i")).alias("nd"), x.alias("x"), y.alias("y"))
    p = p.withColumn("x0", F.least(F.lit(w - 2), F.floor("x").cast("int"))).withColumn("y0", F.least(F.lit(h - 2), F.floor("y").cast("int")))
    ax, ay = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    one = F.lit(1.0)
    total, valid = None, F.lit(True)
    for dy, dx, part in ((0, 0, (one - ay) * (one - ax)), (0, 1, (one - ay) * ax), (1, 0, ay * (one - ax)), (1, 1, ay * ax)):
        raw = F.get("depth", (F.col("y0") + dy) * w + F.col("x0") + dx)
        term = part * F.when(raw > 0, g.metric(raw, cam)).otherwise(F.lit(0.0))
        valid = valid & ((raw > 0) | (part == 0))
        total = term if total is None else total + term
    p = p.select("seq", "u", "v", "nd", total.alias("z"), valid.alias("valid"))
    whole = F.floor(F.lit(constant) / (F.col("z") * F.lit(100.0)) + F.col("nd") + F.lit(0.5))
    p = p.select("seq", "u", "v", F.when(F.col("valid") & (F.col("z") > 0), whole).alias("whole"))
    return p.select("seq", "u", "v", F.when(F.col("whole") >= 1, F.lit(constant) / F.col("whole") / F.lit(100.0)).otherwise(F.lit(0.0)).alias("depth"))
