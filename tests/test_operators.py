"""Operators against brute force on small inputs."""

import hashlib
import itertools
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import commit, evaluate, freespace, rays, replay, surface
from scanengine.sources import files, session


def tree_root(leaves):
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 13])
def test_merkle_roots_and_paths(spark, n):
    data = [f"leaf {k}".encode() for k in range(n)]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(data)], "idx long, data binary")
    want = tree_root(data)
    assert commit.root(d) == want
    if n:
        proof = commit.paths(commit.tree(d), d)
        assert {r.verdict for r in commit.check_path_proofs(d, proof, n, want).collect()} == {"verified"}
        assert {r.verdict for r in commit.check_path_proofs(d.withColumn("data", F.lit(b"x")), proof, n, want).collect()} == {"refuted"}
    if n > 1:
        assert {r.verdict for r in commit.check_path_proofs(d, proof.where("level > 0"), n, want).collect()} <= {"invalid", "refuted", "verified"}
        with pytest.raises(ValueError):
            commit.root_from_path(b"x" * 32, 0, n, [])


def test_audit_draw_is_the_hash_sequence(spark):
    digest, seed, rows = hashlib.sha256(b"s").digest(), b"abc", 37
    seen, i = [], 0
    while len(seen) < 37:
        h = hashlib.sha256(commit.AUDIT_TAG + digest + struct.pack("<H", 3) + seed + struct.pack("<Q", i)).digest()
        v = int.from_bytes(h[:8], "little")
        if v < (1 << 64) // rows * rows and v % rows not in seen:
            seen.append(v % rows)
        i += 1
    assert [r.row for r in commit.audit_rows(spark, digest, seed, rows, 37).orderBy("i").collect()] == seen


def test_wrong_blocks_caught_by_counting():
    for blocks, drawn, one_in in [(10, 3, 5), (20, 20, 100), (7, 1, 2), (50, 10, 100)]:
        want = next(w for w in range(1, blocks + 1) if one_in * math.comb(blocks - w, drawn) <= math.comb(blocks, drawn))
        assert commit.wrong_blocks_caught(blocks, drawn, one_in) == want


def test_packing_refuses_what_follows():
    packed = commit.pack(b"proof" * 100)
    assert commit.unpack(packed, 500) == b"proof" * 100
    for bad in (packed + b"x", packed[:-1]):
        with pytest.raises(ValueError):
            commit.unpack(bad, 500)
    with pytest.raises(ValueError):
        commit.unpack(packed, 499)


def test_association_is_globally_greedy(spark):
    r = random.Random(4)
    a = [(k, r.randrange(2000)) for k in range(60)]
    b = [(k, r.randrange(2000)) for k in range(60)]
    pairs = sorted((abs(t - u), t, u, i, j) for i, t in a for j, u in b if abs(t - u) < 20)
    left, right, want = set(), set(), set()
    for _, t, u, i, j in pairs:
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            want.add((i, t, j, u))
    frame = lambda x: spark.createDataFrame(x, "id long, ts long").dropDuplicates(["id"])
    assert {tuple(x) for x in replay.associate(frame(a), frame(b), 20).collect()} == want


def test_twenty_milliseconds_do_not_match(spark):
    one = spark.createDataFrame([(1, 0)], "id long, ts long")
    assert replay.candidates(one, spark.createDataFrame([(1, 20_000_000)], "id long, ts long"), 20_000_000).count() == 0
    assert replay.candidates(one, spark.createDataFrame([(1, 19_999_999)], "id long, ts long"), 20_000_000).count() == 1


def test_nanoseconds_round_halves_to_even(spark):
    rows = spark.createDataFrame([("1.0000000005",), ("1.0000000015",), ("0.1",)], "s string").select(replay.nanoseconds(F.col("s")).alias("n")).collect()
    assert [r.n for r in rows] == [1_000_000_000, 1_000_000_002, 100_000_000]


def paths(spark, segments, extent):
    rows = spark.createDataFrame([(k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(segments)], "k long, ax double, ay double, az double, zx double, zy double, zz double")
    got = rays.with_path(rows, ("ax", "ay", "az"), ("zx", "zy", "zz"), extent).orderBy("k").collect()
    return [[tuple(p) for p in r.path] for r in got]


def test_rays_pass_the_blocks_that_samples_find(spark):
    r = random.Random(9)
    segments = [tuple([r.uniform(-3, 3) for _ in range(3)] for _ in range(2)) for _ in range(200)]
    for (a, b), path in zip(segments, paths(spark, segments, 0.8)):
        assert all(max(abs(x - y) for x, y in zip(p, q)) == 1 for p, q in zip(path, path[1:]))
        assert path[-1] == tuple(math.floor(c / 0.8) for c in b)
        for k in range(300):
            p = [x + (y - x) * k / 299 for x, y in zip(a, b)]
            assert tuple(math.floor(c / 0.8) for c in p) in path


def test_rays_through_corners_along_axes_and_backwards(spark):
    segments = [((0.5, 0.5, 0.5), (2.5, 2.5, 0.5)), ((2.5, 2.5, 0.5), (0.5, 0.5, 0.5)), ((0.5, 0.5, 0.5), (0.5, 0.5, -1.5)), ((0.2, 0.2, 0.2), (0.2, 0.2, 0.2)), ((0.5, 0.5, 0.5), (2.0, 0.5, 0.5))]
    want = [[(0, 0, 0), (1, 1, 0), (2, 2, 0)], [(2, 2, 0), (1, 1, 0), (0, 0, 0)], [(0, 0, 0), (0, 0, -1), (0, 0, -2)], [(0, 0, 0)], [(0, 0, 0), (1, 0, 0), (2, 0, 0)]]
    assert paths(spark, segments, 1.0) == want


def test_route_chain_is_a_line_of_cells(spark):
    legs = [((0, 0), (7, 3)), ((7, 3), (2, 12)), ((2, 12), (2, 12)), ((2, 12), (-5, -1))]
    w = spark.createDataFrame([(k, *a, *b) for k, (a, b) in enumerate(legs)], "leg int, a0 long, b0 long, a1 long, b1 long")
    rows = freespace.chain(w).orderBy("leg", "step").collect()
    for k, (a, b) in enumerate(legs):
        path = [(r.a, r.b) for r in rows if r.leg == k]
        x, y = a
        dx, dy = abs(b[0] - a[0]), abs(b[1] - a[1])
        err, want = dx - dy, [(x, y)]
        while (x, y) != b:
            e2 = 2 * err
            if e2 > -dy:
                err, x = err - dy, x + (1 if b[0] > a[0] else -1)
            if e2 < dx:
                err, y = err + dx, y + (1 if b[1] > a[1] else -1)
            want.append((x, y))
        assert path == want


def test_nearest_equals_brute_force(spark):
    r = random.Random(2)
    q = [(k, *[r.uniform(-1, 1) for _ in range(3)]) for k in range(40)]
    p = [(k, *[r.uniform(-1, 1) for _ in range(3)]) for k in range(60)]
    p[7] = (7, *p[3][1:])
    got = {x.id: (x.idx, x.d2) for x in evaluate.nearest(spark.createDataFrame(q, "id long, x double, y double, z double"), spark.createDataFrame(p, "idx long, x double, y double, z double"), 0.5).collect()}
    for i, *a in q:
        best = min((sum((x - y) ** 2 for x, y in zip(a, b)), k) for k, *b in p)
        assert got[i] == ((best[1], pytest.approx(best[0])) if best[0] <= 0.25 else (None, None))


def test_triangle_distance_equals_brute_force(spark):
    import numpy as np

    r = random.Random(3)
    pts = [(k, *[r.uniform(0, 1) for _ in range(3)]) for k in range(30)]
    tri = [(k, *[r.uniform(0, 1) for _ in range(9)]) for k in range(10)]
    names = ", ".join(f"{v}{a} double" for v in "abc" for a in "xyz")
    got = {x.id: x.d2 for x in evaluate.triangle_distance(spark.createDataFrame(pts, "id long, x double, y double, z double"), spark.createDataFrame(tri, "face long, " + names), 0.3).collect()}
    grid = [(u, v) for u in np.linspace(0, 1, 81) for v in np.linspace(0, 1, 81) if u + v <= 1 + 1e-12]
    uv = np.array(grid)
    for i, *p in pts:
        best = min(((np.array(t[1:4]) + uv[:, :1] * (np.array(t[4:7]) - np.array(t[1:4])) + uv[:, 1:] * (np.array(t[7:10]) - np.array(t[1:4])) - np.array(p)) ** 2).sum(1).min() for t in tri)
        if got[i] is None:
            assert best > 0.09 - 1e-3
        else:
            assert got[i] <= best + 1e-12 and math.sqrt(best) - math.sqrt(got[i]) < 0.02


def test_registration_finds_a_small_motion(spark):
    r = random.Random(5)
    model = []
    for k in range(300):
        axis = k % 3
        p = [r.uniform(0, 1) for _ in range(3)]
        p[axis] = 0.0
        model.append((k, *p, *[1.0 if i == axis else 0.0 for i in range(3)]))
    m = spark.createDataFrame(model, "idx long, x double, y double, z double, nx double, ny double, nz double").cache()
    moved = m.select(F.col("idx").alias("id"), (F.col("x") - 0.02).alias("x"), (F.col("y") + 0.01).alias("y"), (F.col("z") - 0.015).alias("z"))
    pose = evaluate.register(moved, m, 0.1, rounds=4)
    assert abs(pose[:, 3] - [0.02, -0.01, 0.015]).max() < 2e-3


def test_mesh_of_a_sphere_is_closed(spark):
    rows = [(x, y, z, math.sqrt((x - 4.1) ** 2 + (y - 4.2) ** 2 + (z - 3.9) ** 2) - 2.6) for x, y, z in itertools.product(range(9), repeat=3)]
    v = spark.createDataFrame(rows, "gx long, gy long, gz long, value double")
    k = surface.corners(surface.triangles(surface.active_cells(v)), 1.0).cache()
    r = surface.edge_report(k).first()
    assert r.boundary == 0 and r.non_manifold == 0 and r.manifold > 0
    n_v, n_f = surface.vertices(k).count(), k.count() // 3
    assert n_v - r.manifold + n_f == 2
    c = surface.face_components(k)
    assert c.select("component").distinct().count() == 1 and c.first().triangles == n_f
    assert surface.fans(k).groupBy("v").count().where("count > 1").count() == 0
    # normals look outward: towards positive values
    for face in itertools.groupby(k.orderBy(*surface.FACE, "corner").collect(), key=lambda x: (x.gx, x.gy, x.gz, x.tetra, x.tri)):
        a, b, c3 = ([p.x - 0.5, p.y - 0.5, p.z - 0.5] for p in face[1])
        e, f = [y - x for x, y in zip(a, b)], [y - x for x, y in zip(a, c3)]
        n = [e[1] * f[2] - e[2] * f[1], e[2] * f[0] - e[0] * f[2], e[0] * f[1] - e[1] * f[0]]
        assert sum(x * (y - z) for x, y, z in zip(n, a, (4.1, 4.2, 3.9))) > -1e-9


def test_voxel_addresses_floor_for_negatives(spark):
    rows = spark.createDataFrame([(x,) for x in (-9, -8, -1, 0, 7, 8)], "g long").select("g", g.block_part(F.col("g")).alias("b"), g.local_part(F.col("g")).alias("l")).collect()
    assert [(r.b, r.l) for r in rows] == [divmod(r.g, 8) for r in rows]


def test_session_problems_are_told_together(spark, tmp_path):
    lines = [{"id": "a", "timestamp_ns": 0, "path": "ok.png"}, {"id": "a", "timestamp_ns": 0, "path": "../out.png"}, {"timestamp_ns": 5, "path": "/abs"}]
    (tmp_path / "rgb.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    s = session.read_stream(spark, str(tmp_path / "rgb.jsonl"))
    p = session.stream_problems(s.cache(), "rgb", spark.createDataFrame([("other.png",)], "path string"))
    found = {r.problem for r in p.collect()}
    assert found == {"missing field", "not a record", "repeated id", "timestamps do not rise", "unsafe path", "no such file"}
    with pytest.raises(session.SessionError, match="unsafe path"):
        session.refuse(p)
    unit = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    cams = {"cameras": [{"id": "d", "model": "pinhole", "width": 2, "height": 2, "fx": 2, "fy": 2, "cx": 0.5, "cy": 0.5, "t_rig_camera": unit}, {"id": "e", "model": "fisheye", "width": 2, "height": 2, "fx": 0, "fy": 2, "cx": 9, "cy": 0.5, "t_rig_camera": [2.0, *unit[1:]]}]}
    (tmp_path / "cameras.json").write_text(json.dumps(cams))
    bad = session.calibration_problems(session.read_calibrations(spark, str(tmp_path / "cameras.json"))).collect()
    assert {r.where for r in bad} == {"e"} and len(bad) == 4


def test_images_volumes_and_points_round_trip(spark, tmp_path):
    import zlib

    raster = struct.pack(">6H", 1, 500, 65535, 0, 7, 8)
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.pgm").write_bytes(b"P5\n# c\n3 2\n65535\n" + raster)
    body = zlib.compress(b"\0" + raster[:6] + b"\2" + bytes((x - y) & 255 for x, y in zip(raster[6:], raster[:6])))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    (tmp_path / "img/b.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 16, 0, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b""))
    for r in files.read_depth_images(spark, str(tmp_path / "img")).collect():
        assert (r.width, r.height, list(r.depth)) == (3, 2, [1, 500, 65535, 0, 7, 8])
    sums, weights = [0.0] * 512, [0] * 512
    sums[5], weights[5] = -1.5, 2
    data = files.encode_volume({"blocks": 1}, [(-1, 0, 2)], struct.pack("<512d", *sums), struct.pack("<512I", *weights))
    (tmp_path / "v.vol").write_bytes(data)
    assert [tuple(r)[1:] for r in files.read_volumes(spark, str(tmp_path / "v.vol")).collect()] == [(-1, 0, 2, 5, -1.5, 2)]
    for bad in (data[:-1], data + b"x", data.replace(struct.pack("<d", -1.5), struct.pack("<d", 9.0))):
        with pytest.raises(ValueError):
            files.decode_volume(bad)
    p = spark.createDataFrame([(0.25, -1e-12, 3.0), (1.0, 2.0, 4.0)], "x double, y double, z double")
    files.write_points_ply(p, str(tmp_path / "p"), comments=("made here",), order=["x"])
    assert sorted(map(tuple, files.read_points_ply(spark, str(tmp_path / "p")).collect())) == [(0.25, 0.0, 3.0), (1.0, 2.0, 4.0)]
    with pytest.raises(Exception, match="exists"):
        files.write_points_ply(p, str(tmp_path / "p"))


def test_text_sequences(spark, tmp_path):
    (tmp_path / "rgb.txt").write_text("# c\n\n102.000000 rgb/1.png\n102.033333 rgb/2.png\n")
    assert [(r.ts, r.path) for r in files.read_listing(spark, str(tmp_path / "rgb.txt")).orderBy("ts").collect()] == [(102000000000, "rgb/1.png"), (102033333000, "rgb/2.png")]
    q = spark.createDataFrame([(1, "1", "2", "-3", "a", "b", "c", "d"), (2, "1", "2", "0.5", "a", "b", "c", "d")], "ts long, tx string, ty string, tz string, qx string, qy string, qz string, qw string")
    assert [tuple(r) for r in files.other_hand(q).collect()] == [(1, "1", "2", "3", "d", "c", "b", "a"), (2, "1", "2", "-0.5", "d", "c", "b", "a")]
