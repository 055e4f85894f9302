"""Rasters, noise and verdicts against NumPy and expectations."""

from pathlib import Path

import numpy as np
import pytest

from scanengine.functions.geometry import Camera
from scanengine.operators import noise, render


def test_noise_equals_numpy(spark):
    cam = Camera(5, 4, 4.0, 4.0, 2.0, 1.5)
    r = np.random.default_rng(1)
    raw = r.integers(0, 4, (4, 5)) * 700
    images = spark.createDataFrame([(3, [int(x) for x in raw.ravel()])], "seq long, depth array<int>")
    d = noise.drawn(images, 7, 4, 5, 0.5, 0.2)
    got = {(x.v, x.u): x.depth for x in noise.noisy(images.join(d, "seq"), cam, 35130.0).collect()}
    g = np.random.default_rng([7, 3])
    nx, ny, nd = (g.normal(0.0, s, (4, 5)) for s in (0.5, 0.5, 0.2))
    z = raw * 0.001
    for v in range(4):
        for u in range(5):
            x, y = min(max(u + nx[v, u], 0), 4), min(max(v + ny[v, u], 0), 3)
            x0, y0 = min(int(x), 3), min(int(y), 2)
            parts = [(z[y0 + j, x0 + i], ((y - y0) if j else 1 - (y - y0)) * ((x - x0) if i else 1 - (x - x0))) for j in (0, 1) for i in (0, 1)]
            want = 0.0
            if all(c > 0 or p == 0 for c, p in parts) and sum(c * p for c, p in parts) > 0:
                whole = np.floor(35130.0 / (sum(c * p for c, p in parts) * 100) + nd[v, u] + 0.5)
                want = 35130.0 / whole / 100 if whole >= 1 else 0.0
            assert got[(v, u)] == pytest.approx(want, abs=1e-9)


def test_nearest_triangle_wins(spark):
    names = "face long, " + ", ".join(f"{v}{a} double" for v in "abc" for a in "xyz")
    tri = [(1, 0.0, 0.0, 5.0, 4.0, 0.0, 5.0, 0.0, 4.0, 5.0), (2, 0.0, 0.0, 2.0, 2.0, 0.0, 2.0, 0.0, 2.0, 2.0), (3, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 1.0)]
    got = {(r.px, r.py): (r.face, r.depth) for r in render.rasterise(spark.createDataFrame(tri, names), 1.0).collect()}
    assert got[(0, 0)] == (2, 2.0) and got[(2, 1)] == (1, 5.0) and (3, 3) not in got


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_verdicts(spark):
    from scanengine.plans import registry

    got = {r.what: r.verdict for r in registry.queries()["v11_v14_verdicts"](spark, "/root/testdata/sf0.001").collect()}
    assert got["blocks"] == got["audit"] == "verified" and got["forged-root"] == got["short-audit"] == "invalid" and got["route"] in ("clear", "not-clear")
