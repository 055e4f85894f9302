"""Blocks with halos against voxels one by one."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from scanengine.operators import halo, surface

VOXELS = "gx long, gy long, gz long, value double"


def scattered(seed, n=1900):
    """Voxels in clumps around corners of blocks, on both sides of zero, some exactly zero, some alone far away."""
    r, held = random.Random(seed), {}
    centres = [(0, 0, 0), (7, 8, -8), (-1, -9, 16)]
    while len(held) < n:
        c = r.choice(centres)
        held[tuple(x + r.randrange(-4, 5) for x in c)] = 0.0 if r.random() < 0.03 else r.uniform(-2, 2)
    held[1_000_000, -1_000_000, 5] = 0.0
    return held


@pytest.fixture(scope="module", params=[1, 2])
def voxels(spark, request):
    held = scattered(request.param)
    return held, spark.createDataFrame([(*k, x) for k, x in held.items()], VOXELS).repartition(5).cache()


CORNERS = [(k & 1, k >> 1 & 1, k >> 2) for k in range(8)]


def test_cells_are_those_of_every_voxel(voxels):
    held, v = voxels
    want = {}
    for k in held:
        for c in CORNERS:
            low = tuple(a - b for a, b in zip(k, c))
            want[low] = [held.get(tuple(a + b for a, b in zip(low, d))) for d in CORNERS]
    got = halo.cells(v).collect()
    assert len(got) == len(want)
    assert {(r.gx, r.gy, r.gz): (r.known, list(r["values"])) for r in got} == {k: (8 - x.count(None), x) for k, x in want.items()}
    active = {k: x for k, x in want.items() if None not in x and 0.0 not in x and min(x) < 0 < max(x)}
    assert {(r.gx, r.gy, r.gz): list(r["values"]) for r in halo.cells(v, True).collect()} == active
    rows = lambda t: sorted(map(tuple, t.collect()))
    assert active and rows(surface.triangles(halo.cells(v, True))) == rows(surface.triangles(halo.cells(v)))


def test_crossings_are_those_of_every_pair(voxels):
    held, v = voxels
    want = {(0, *k, x, None) for k, x in held.items() if x == 0}
    for k, x in held.items():
        for axis in range(3):
            y = held.get(tuple(a + (i == axis) for i, a in enumerate(k)))
            if y is not None and x * y < 0:
                want.add((axis + 1, *k, x, y))
    got = halo.crossings(v).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_a_full_block_sends_217_voxels(spark):
    v = spark.createDataFrame([(*k, 1.0) for k in itertools.product(range(8), repeat=3)], VOXELS)
    p = halo.padded(v).select("bx", "by", "bz", F.size("s").alias("n")).collect()
    assert sorted(r.n for r in p) == [1, 8, 8, 8, 64, 64, 64, 512] and sum(r.n for r in p) == 512 + 217
    assert halo.cells(v).count() == 9**3 and halo.cells(v.where("1 = 0")).count() == 0 and halo.crossings(v).count() == 0
