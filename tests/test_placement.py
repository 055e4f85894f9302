"""Scans placed in models by their planes, order statistics and views, against plain computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import evaluate, order, placement, render, replay

ORIENTED = "id long, x double, y double, z double, nx double, ny double, nz double"


def room(r, n=1500):
    """Points on the floor, three walls and a shelf of a lopsided room, facing inwards."""
    out = []
    for k in range(n):
        a, b = r.random(), r.random()
        out.append([(4 * a, 3 * b, 0.0, 0, 0, 1), (0.0, 3 * a, 2.2 * b, 1, 0, 0), (4 * a, 0.0, 2.2 * b, 0, 1, 0), (4.0, 3 * a, 1.1 * b, -1, 0, 0), (1 + a, 2.1, 0.9 * b, 0, -1, 0)][k % 5])
    return np.array(out, float) * [0.4, 0.4, 0.4, 1, 1, 1]


def test_a_scan_finds_its_place_in_a_model(spark):
    r = random.Random(3)
    model, seen = room(r, 8000), room(r, 900)
    c, s = math.cos(0.4), math.sin(0.4)
    turn = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, 0, -1], [0, 1, 0]])
    moved = np.column_stack([(seen[:, :3] - [1.0, 2.0, 0.5]) @ turn, seen[:, 3:] @ turn])
    frame = lambda x: spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], ORIENTED)
    axes, shares = placement.dominant_axes(frame(moved))
    assert np.allclose(np.abs(axes.T @ turn.T).max(0), 1, atol=0.01) and shares.min() > 0.1
    found = placement.placements(frame(moved), frame(model).withColumnRenamed("id", "idx"))
    assert len(found) == 24 and len(placement.turns()) == 24
    t = placement.choose(found)
    assert found[0][0] > 0.8 and np.allclose(t[:, :3], turn, atol=0.02) and np.abs(t[:, 3] - [1.0, 2.0, 0.5]).max() < 0.03
    with pytest.raises(placement.PlacementError, match="no placement"):
        placement.choose([(0.4, t), (0.1, t)])
    with pytest.raises(placement.PlacementError, match="two placements"):
        placement.choose([(0.8, t), (0.75, t)])
    with pytest.raises(placement.PlacementError, match="three perpendicular"):
        placement.dominant_axes(frame(seen[seen[:, 5] == 1]))


def test_axes_of_noisy_scenes_and_the_cubes_turns(spark):
    """Axes from fourth moments under noise, clutter and uneven surfaces; all turns are rotations, and each other's products."""
    r = np.random.default_rng(4)
    for weights in ((1, 1, 1), (8, 2, 1), (5, 5, 1)):
        q = np.linalg.qr(r.normal(size=(3, 3)))[0]
        q *= np.sign(np.linalg.det(q))
        n = np.concatenate([np.repeat(q[:, k][None] * s, 200 * w, 0) for k, w in enumerate(weights) for s in (1, -1)] + [r.normal(size=(300, 3))])
        n += r.normal(size=n.shape) * 0.03
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        d = spark.createDataFrame([(k, 0.0, 0.0, 0.0, *map(float, x)) for k, x in enumerate(n)], ORIENTED)
        axes, shares = placement.dominant_axes(d)
        assert np.allclose(axes.T @ axes, np.eye(3), atol=1e-9) and np.linalg.det(axes) > 0
        assert np.abs(axes.T @ q).max(1).min() > 0.999 and list(shares) == sorted(shares, reverse=True)
    turns = placement.turns()
    assert len({tuple(t.ravel()) for t in turns}) == 24 and all(np.linalg.det(t) == 1 for t in turns)
    assert all(any((a @ b == c).all() for c in turns) for a in turns[:6] for b in turns)


def test_depth_of_a_plane_has_its_normal(spark):
    cam = g.Camera()
    rows = []
    for u in range(cam.width):
        for v in range(cam.height):
            ray = np.array([(u - cam.cx) / cam.fx, (v - cam.cy) / cam.fy, 1.0])
            rows.append((0, u, v, int(round(1000 * 2.0 / (ray @ [0.0, 0.6, 0.8])))))
    got = placement.oriented(spark.createDataFrame(rows, "seq long, u int, v int, raw long"), cam).collect()
    assert len(got) == (cam.width - 8) * (cam.height - 8)
    assert all(np.allclose([r.nx, r.ny, r.nz], [0, -0.6, -0.8], atol=0.02) for r in got)


def test_alignments_are_used_again_only_where_they_apply(spark):
    m = {"registration": list(np.eye(4).ravel()), "inputs": {"model": "m", "trajectory": "t"}}
    assert (placement.reusable(m, "m", "t") == np.eye(4)[:3]).all()
    poses = spark.createDataFrame([(k, *map(float, np.eye(4)[:3].ravel())) for k in range(3)], "seq long, " + ", ".join(f"m{k} double" for k in range(12)))
    near = poses.withColumn("m3", F.col("m3") + 1e-8)
    placement.reusable(m, "m", "other", placement.trajectory_difference(poses, near))
    for bad, args in ((m, ("x", "t")), (m, ("m", "x")), (m | {"registration": [1.0] * 16}, ("m", "t")), ({}, ("m", "t"))):
        with pytest.raises(placement.PlacementError):
            placement.reusable(bad, *args)
    for far in (poses.withColumn("m3", F.col("m3") + 0.1), poses.where("seq > 0")):
        with pytest.raises(placement.PlacementError, match="another trajectory"):
            placement.reusable(m, "m", "x", placement.trajectory_difference(poses, far))


def test_order_statistics_by_counting(spark):
    r = random.Random(8)
    v = [r.choice([r.gauss(0, 1), r.gauss(1e6, 1), 3.0, 3.0, -1e-9, 1e300]) for _ in range(3000)] + [None] * 10
    d = spark.createDataFrame([(x,) for x in v], "x double")
    s = sorted(x for x in v if x is not None)
    ranks = [0, 1, 700, 1500, 2200, 2998, 2999]
    for gather in (50_000, 100, 1):
        assert order.order_statistics(d, "x", ranks, gather, bins=16) == [s[k] for k in ranks]
    assert np.allclose(order.quantiles(d.where("x < 1e299"), "x", [0.25, 0.5, 0.95]), np.quantile([x for x in s if x < 1e299], [0.25, 0.5, 0.95]))
    assert order.quantiles(d.where("1 = 0"), "x", [0.5]) == [None]
    with pytest.raises(ValueError):
        order.order_statistics(d, "x", [3000])
    numbered = order.dense_numbers(d.where("x is not null").select(F.monotonically_increasing_id().alias("i"), "x"), [F.col("x"), F.col("i")], F.floor(F.log10(F.abs("x") + 1) * F.signum("x")), "k").orderBy("k").collect()
    assert [q.k for q in numbered] == list(range(len(s))) and [q.x for q in numbered] == s


def test_residuals_and_all_pairs(spark):
    r = random.Random(2)
    e = [r.gauss(0.01, 0.05) for _ in range(500)]
    got = evaluate.residual_summary(spark.createDataFrame([(x,) for x in e] + [(None,)], "r double"), "r", 0.05).first()
    a = np.abs(e)
    assert got.n == 500 and np.allclose([got.mean_mm, got.rms_mm, got.median, got.p95, got.within], [1000 * np.mean(e), 1000 * np.sqrt(np.mean(np.square(e))), np.median(a), np.percentile(a, 95), np.mean(a <= 0.05)], atol=1e-6)
    p = [(k, r.random(), r.random(), r.random()) for k in range(200)]
    q, ref = spark.createDataFrame(p[:100], "id long, x double, y double, z double"), spark.createDataFrame(p[100:], "idx long, x double, y double, z double")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(evaluate.nearest(q, ref, 0.2)) == key(evaluate.nearest_by_all(q, ref, 0.2, slice_rows=30))
    tri = spark.createDataFrame([(k, *[x for i in r.sample(range(200), 3) for x in p[i][1:]]) for k in range(40)], "face long, " + ", ".join(f"{c}{x} double" for c in "abc" for x in "xyz"))
    assert key(evaluate.triangle_distance(q, tri, 0.1)) == key(evaluate.triangle_distance_by_all(q, tri, 0.1, slice_rows=15))


def test_association_of_ever_closer_pairs(spark):
    """Each pair competes with the next, closer one: more rounds than are made."""
    n = 40
    a = [(k, 1000 * k) for k in range(n)]
    b = [(k, 1000 * k + 500 - k) for k in range(n)]
    pairs = sorted((abs(t - u), t, u, i, j) for i, t in a for j, u in b if abs(t - u) < 700)
    left, right, want = set(), set(), set()
    for _, t, u, i, j in pairs:
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            want.add((i, t, j, u))
    frame = lambda x: spark.createDataFrame(x, "id long, ts long")
    assert {tuple(x) for x in replay.associate(frame(a), frame(b), 700, rounds=3).collect()} == want
    tied = replay.sequenced(spark.createDataFrame([(k, 5) for k in range(30)] + [(99, 1)], "id long, ts long"), "ts", "id", rows_a_range=4).orderBy("seq").collect()
    assert [(x.seq, x.id) for x in tied] == [(0, 99)] + [(k + 1, k) for k in range(30)]


def test_digests_of_ordered_rows(spark):
    d = spark.createDataFrame([(k, f"v{k}", None if k % 3 else k) for k in range(100)], "i long, a string, b long")
    one = replay.ordered_digest(d, ["a", "b"], "i", span=7).first()
    assert replay.ordered_digest(d.repartition(5), ["a", "b"], "i", span=7).first() == one
    assert replay.ordered_digest(d.withColumn("i", 99 - F.col("i")), ["a", "b"], "i", span=7).first() != one


def test_views_hold_all_points(spark):
    right, down, forward = (np.array(x) for x in render.view_basis(30, 20))
    assert np.allclose([right @ down, right @ forward, down @ forward], 0) and np.allclose(np.cross(right, down), forward) and down[2] < 0
    p = spark.createDataFrame([(float(k), float(k * k % 7), float(k % 3)) for k in range(20)], "x double, y double, z double")
    got = render.fitted(p, render.view_basis(30, 20), 200, 100).collect()
    assert all(0 <= r.px <= 200 and 0 <= r.py <= 100 for r in got) and max(max(r.px for r in got) - min(r.px for r in got) - 180, max(r.py for r in got) - min(r.py for r in got) - 90) == pytest.approx(0, abs=1e-6)
