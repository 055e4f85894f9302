"""Cubes of blocks, largest depths and expansion against judging every block and voxel."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scanengine.functions.geometry import Camera, Grid
from scanengine.operators import expansion, fuse, plan, vector, views
from scanengine.sources import derived

CAM, GRID = Camera(), Grid(0.1, 0.3)


def pose(r, spread=4.0):
    q = r.normal(size=4)
    w, x, y, z = q / np.linalg.norm(q)
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    return np.column_stack([turn, r.normal(size=3) * spread]).ravel()


def image(r):
    out = r.integers(300, 6000, CAM.width * CAM.height)
    out[r.random(len(out)) < r.random()] = 0
    if r.random() < 0.5:
        out = np.minimum(out, r.integers(200, 1500))
    return out.astype(np.int64)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_cubes_say_what_their_blocks_would(seed):
    r = np.random.default_rng(seed)
    b = np.unique(r.integers(-20, 20, (r.integers(1, 3000), 3)), axis=0).astype(np.int32)
    m, depth = pose(r), image(r)
    cubes = views.Cubes(b)
    assert sorted(map(tuple, cubes.blocks)) == sorted(map(tuple, b))
    for depths in (None, views.Depths(depth, CAM)):
        assert (cubes.verdicts(m, CAM, GRID, depths) == views.judged(cubes.blocks, cubes.blocks, m, CAM, GRID, depths, False)).all()
    # what is not evaluated does not contribute
    left = cubes.blocks[cubes.verdicts(m, CAM, GRID, views.Depths(depth, CAM)) != views.SEEN].astype(float)
    if len(left):
        sd = vector.voxels_of(left, (0, depth, m), CAM, GRID)[4]
        assert not (sd >= -GRID.truncation).any()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_a_box_is_halved_into_the_blocks_in_view(seed):
    r = np.random.default_rng(seed)
    first = r.integers(-9, 5, 3)
    last = first + r.integers(0, 14, 3)
    every = np.stack(np.meshgrid(*[np.arange(a, b + 1) for a, b in zip(first, last)], indexing="ij"), -1).reshape(-1, 3)
    m, depths = pose(r), views.Depths(image(r), CAM)
    for d in (None, depths):
        got, _ = views.blocks_in_view((first, last), m, CAM, GRID, d)
        want = every[views.judged(every, every, m, CAM, GRID, d, False) == views.SEEN]
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert len(views.blocks_in_view((last + 1, last), m, CAM, GRID, None)[0]) == 0


@pytest.mark.parametrize("size", [(32, 24), (8, 8), (7, 3), (33, 65), (1, 1)])
def test_largest_depths_of_rectangles(size):
    r = np.random.default_rng(7)
    cam = Camera(*size, 24.0, 24.0, 0.0, 0.0)
    img = r.integers(-5, 5000, (cam.height, cam.width))
    depths = views.Depths(img.ravel(), cam)
    v, u = (np.sort(r.integers(0, n, (200, 2)), 1) for n in (cam.height, cam.width))
    got = depths.largest(v[:, 0], v[:, 1], u[:, 0], u[:, 1])
    for k in range(200):
        (v0, v1), (u0, u1) = ((x // 8 * 8, (y // 8 + 1) * 8) for x, y in (v[k], u[k]))
        assert got[k] == max(0, img[v0:v1, u0:u1].max()) * cam.scale


def scene(spark, poses, depth):
    rows = [(k, True, True, *map(float, m), depth[k].tolist()) for k, m in enumerate(poses)]
    return spark.createDataFrame(rows, "seq long, has_depth boolean, has_pose boolean, " + ", ".join(f"m{i} double" for i in range(12)) + ", depth array<int>")


def test_free_space_outside_of_the_plan_is_approved(spark):
    """A camera looks past a near wall's edge at nothing, and from afar at the wall: the way to it is free, and not planned."""
    grid = Grid(0.1, 0.2)
    here, back = np.eye(3, 4).ravel(), np.eye(3, 4).ravel()
    back[11] = -3.0
    far = np.full(CAM.width * CAM.height, 4000)
    scan = scene(spark, [here, back], [np.full(CAM.width * CAM.height, 1000), far])
    px = scan.selectExpr("seq", "posexplode(depth) as (i, raw)").selectExpr("seq", f"i % {CAM.width} as u", f"cast(floor(i / {CAM.width}) as int) as v", "cast(raw as long) as raw")
    planned = plan.plan(plan.points(px, scan.drop("depth"), CAM), grid)
    inside = planned.selectExpr("min(bz) as z0", "max(bz) as z1").first()
    rows = expansion.expanded(scan, planned, CAM, grid).where("approved").collect()
    assert any(r.bz < inside.z0 for r in rows) and not any(r.planned for r in rows if r.bz < inside.z0)
    # every block of a box around all of it, voxel by voxel
    first, last = expansion.candidate_box(scan, CAM, grid)
    every = spark.range(1).selectExpr(f"explode(sequence({first[0] - 1}, {last[0] + 1})) as bx").selectExpr("bx", f"explode(sequence({first[1] - 1}, {last[1] + 1})) as by").selectExpr("bx", "by", f"explode(sequence({first[2] - 1}, {last[2] + 1})) as bz")
    brute = fuse.evaluated(scan, every.selectExpr("cast(bx as int) bx", "cast(by as int) by", "cast(bz as int) bz"), CAM, grid, culled=False).where("status = 'contributes'").select("bx", "by", "bz").distinct()
    key = lambda x: {(r.bx, r.by, r.bz) for r in x}
    assert key(rows) == key(brute.collect()) == key(expansion.observed(scan, CAM, grid, hide=False).collect())
    wide = expansion.hull_box(planned, scan, CAM, grid).first()
    assert all(wide[f"{a}0"] <= getattr(r, f"b{a}") <= wide[f"{a}1"] for r in rows for a in "xyz")


def test_largest_depths_spare_what_lies_behind_a_wall(spark):
    r = np.random.default_rng(3)
    near = np.full(CAM.width * CAM.height, 700)
    far = near.copy()
    far[0] = 9000  # one far reading of one frame widens the box for all
    scan = scene(spark, [pose(r, 0.2) for _ in range(4)], [near] * 3 + [far])
    rows = expansion.pruned(scan, CAM, GRID).orderBy("seq").collect()
    total = lambda c: sum(x[c] for x in rows)
    assert total("evaluated") < total("in_view") / 4 and total("judged") < total("candidates") / 4
    with_, without = (sorted(map(tuple, expansion.observed(scan, CAM, GRID, hide).collect())) for hide in (True, False))
    assert with_ == without


def test_frames_without_depth_observe_nothing(spark):
    scan = scene(spark, [np.eye(3, 4).ravel()], [np.zeros(CAM.width * CAM.height, np.int64)])
    assert expansion.observed(scan, CAM, GRID).count() == 0
    assert expansion.frame_bounds(derived.scan(spark, "/root/testdata/sf0.001").where("1 = 0"), CAM, GRID).count() == 0
