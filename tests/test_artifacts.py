"""Files: written, read back, and refused where they are not what they say."""

import hashlib
import itertools
import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import mesh, surface
from scanengine.sources import artifacts as a
from scanengine.sources import files

GRID = g.Grid(0.1, 0.3)


def edited(path, change):
    doc = json.loads(path.read_bytes())
    change(doc)
    path.write_bytes(a.canonical(doc))


def test_json_is_strict():
    for bad in (b'{"a":1,"a":2}', b'{"a":NaN}', b"[Infinity]", b"\xff", b"{"):
        with pytest.raises(a.ArtifactError):
            a.strict_json(bad)
    assert a.canonical({"b": 1, "a": "é"}) == b'{"a":"\\u00e9","b":1}\n'


def test_files_appear_whole_and_once(tmp_path):
    path = tmp_path / "deep" / "x.bin"
    assert a.publish(str(path), [b"ab", b"c"]) == hashlib.sha256(b"abc").hexdigest() and path.read_bytes() == b"abc"
    with pytest.raises(FileExistsError):
        a.publish(str(path), [b"d"])
    a.publish(str(path), [b"d"], replace=True)

    def broken():
        yield b"half"
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        a.publish(str(tmp_path / "deep" / "y.bin"), broken())
    assert [p.name for p in path.parent.iterdir()] == ["x.bin"] and path.read_bytes() == b"d"


def dense(spark):
    rows = [(x, y, z, float(x - 2) * 2, 2 if z else 1) for x, y, z in itertools.product(range(5), range(4), range(3)) if (x + y + z) % 3]
    return spark.createDataFrame(rows, "gx long, gy long, gz long, tsdf_sum double, weight long").withColumn("tsdf_sum", F.col("tsdf_sum") / 8)


def test_dense_volumes_round_trip(spark, tmp_path):
    v = dense(spark)
    digest = a.write_dense(v, GRID, (1, 0, 0), (4, 4, 3), str(tmp_path / "v.json"), {"session": "s"})
    data = (tmp_path / "v.json").read_bytes()
    assert hashlib.sha256(data).hexdigest() == digest and a.canonical(json.loads(data)) == data
    head, back = a.load_dense(spark, str(tmp_path / "v.json"))
    want = {(r.gx - 1, r.gy, r.gz, r.tsdf_sum / r.weight, r.weight) for r in v.collect() if 1 <= r.gx < 5}
    assert {tuple(r) for r in back.collect()} == want and head["integration"]["observed_voxels"] == len(want)
    for change in (lambda d: d["integration"].update(fused_voxels=0), lambda d: d["voxels"].reverse(), lambda d: d["voxels"][0].update(index=[9, 0, 0]), lambda d: d["voxels"][0].update(tsdf=1.5)):
        (tmp_path / "bad.json").write_bytes(data)
        edited(tmp_path / "bad.json", change)
        with pytest.raises(a.ArtifactError):
            a.load_dense(spark, str(tmp_path / "bad.json"))


def test_plans_round_trip_and_are_checked(spark, tmp_path):
    r = random.Random(3)
    rows = sorted({(r.randrange(-4, 4), r.randrange(3), r.randrange(2)) for _ in range(30)})
    plan = spark.createDataFrame([(*b, k % 3 == 0) for k, b in enumerate(rows)], "bx int, by int, bz int, is_surface boolean")
    counters = {"frame_stride": 2, "selected_observations": 5}
    path = tmp_path / "p.json"
    a.write_plan(plan, GRID, counters, str(path))
    doc, back = a.load_plan(spark, str(path))
    assert {tuple(x) for x in back.collect()} == {tuple(x) for x in plan.collect()} and doc["planning"]["frame_stride"] == 2
    assert a.plan_differences(doc, back, plan, counters).count() == 0
    other = a.plan_differences(doc, back, plan.where("bx <> 0"), counters | {"frame_stride": 3})
    assert {x.field for x in other.collect()} == {"frame_stride", "blocks", "n"}
    more = spark.createDataFrame([(9, 9, 9), rows[0]], "bx int, by int, bz int")
    a.write_plan(plan, GRID, counters, str(tmp_path / "e.json"), expanded=more)
    doc, wide = a.load_plan(spark, str(tmp_path / "e.json"))
    assert wide.count() == len(rows) + 1 and doc["schema_version"] == "0.2.0" and wide.where("is_surface").count() == plan.where("is_surface").count()
    for change in (lambda d: d["active_blocks"].reverse(), lambda d: d["active_blocks"].pop(), lambda d: d["surface_blocks"].append([99, 99, 99]), lambda d: d["planning"].update(halo_blocks=0)):
        (tmp_path / "bad.json").write_bytes(path.read_bytes())
        edited(tmp_path / "bad.json", change)
        with pytest.raises(a.ArtifactError):
            a.load_plan(spark, str(tmp_path / "bad.json"))


def volume(spark):
    r = random.Random(5)
    rows = [(x, 0, z, l, r.choice([-0.5, 0.25, 1.0]), 2) for x, z in ((0, 1), (-1, 0), (2, 0)) for l in r.sample(range(512), 20)]
    return spark.createDataFrame(rows, "bx int, by int, bz int, l int, tsdf_sum double, weight long")


def test_volume_files_hold_what_was_fused(spark, tmp_path):
    v = volume(spark)
    a.write_volume(v, {"session": "s"}, str(tmp_path / "v.vol"))
    data = (tmp_path / "v.vol").read_bytes()
    assert {tuple(x)[1:] for x in files.read_volumes(spark, str(tmp_path / "v.vol")).collect()} == {tuple(x) for x in v.collect()}
    header, index, _, _ = files.decode_volume(data)
    assert [tuple(x) for x in index.tolist()] == [(-1, 0, 0), (2, 0, 0), (0, 0, 1)] and header["observed_voxels"] == 60
    with pytest.raises(FileExistsError):
        a.write_volume(v, {}, str(tmp_path / "v.vol"))
    at = len(data) - 3 * 2048 - 8
    with pytest.raises(ValueError):
        files.decode_volume(data[:at] + struct.pack("<d", 0.125) + data[at + 8 :])
    assert a.volume_problems(v).count() == 0
    bad = v.withColumn("tsdf_sum", F.when(F.col("bx") == 2, 7.0).otherwise(F.col("tsdf_sum")))
    assert [tuple(x) for x in a.volume_problems(bad).collect()] == [(2, 0, 0, "sum above weight")]


def test_checkpoints_refuse_what_is_foreign(spark, tmp_path):
    v = volume(spark)
    plan = v.select("bx", "by", "bz").distinct().unionByName(spark.createDataFrame([(7, 7, 7)], "bx int, by int, bz int"))
    path = str(tmp_path / "c.ckpt")
    a.write_volume(v, {"scan": "one", "processed": 3}, path, magic=a.CHECKPOINT_MAGIC, blocks=plan)
    head, back = a.load_checkpoint(spark, path, plan, {"scan": "one"})
    assert head["processed"] == 3 and head["blocks"] == 4 and {tuple(x) for x in back.collect()} == {tuple(x) for x in v.collect()}
    a.write_volume(v, {"scan": "one", "processed": 4}, path, replace=True, magic=a.CHECKPOINT_MAGIC, blocks=plan)
    with pytest.raises(a.ArtifactError, match="another plan"):
        a.load_checkpoint(spark, path, plan.where("bx < 7"), {"scan": "one"})
    with pytest.raises(a.ArtifactError, match="another fusion: scan"):
        a.load_checkpoint(spark, path, plan, {"scan": "two"})
    data = (tmp_path / "c.ckpt").read_bytes()
    for bad in (data[:-1], data[:-1] + b"\1", data.replace(b'"processed":4', b'"processed": 4'), b"SFTVOL01" + data[8:]):
        (tmp_path / "bad.ckpt").write_bytes(bad)
        with pytest.raises(a.ArtifactError):
            a.load_checkpoint(spark, str(tmp_path / "bad.ckpt"), plan, {"scan": "one"})


def test_meshes_round_trip_and_name_their_volume(spark, tmp_path):
    v = spark.createDataFrame([(k, k / 7, -k / 3, 0.5) for k in range(40)], "id long, x double, y double, z double")
    f = spark.createDataFrame([(k, k, (k + 1) % 40, (k + 7) % 40) for k in range(25)], "face long, v0 long, v1 long, v2 long")
    path = str(tmp_path / "m.ply")
    a.write_mesh(v, f, path, ("source_volume_sha256 abc", "made here"), rows_a_piece=8)
    vertices, faces, comments = a.read_mesh(spark, path)
    assert sorted(map(tuple, vertices.collect())) == sorted(map(tuple, v.collect())) and sorted(map(tuple, faces.collect())) == sorted(map(tuple, f.collect()))
    assert a.check_mesh_source(path, "abc")["triangles"] == 25 and "made here" in comments
    with pytest.raises(a.ArtifactError, match="records the volume abc"):
        a.check_mesh_source(path, "def")
    (tmp_path / "short.ply").write_bytes((tmp_path / "m.ply").read_bytes()[:-1])
    with pytest.raises(a.ArtifactError):
        a.read_mesh(spark, str(tmp_path / "short.ply"))
    text = "ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty float nx\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0 1\n1 0 0 1\n0 1 0 1\n3 0 1 2\n"
    (tmp_path / "t.ply").write_text(text)
    vertices, faces, _ = a.read_mesh(spark, str(tmp_path / "t.ply"))
    assert vertices.columns == ["id", "x", "y", "z", "nx"] and [tuple(x) for x in faces.collect()] == [(0, 0, 1, 2)]


def test_manifests_and_pictures(spark, tmp_path):
    (tmp_path / "in.txt").write_bytes(b"data")
    a.write_manifest("distance", spark.createDataFrame([(3, 0.5)], "n int, median double"), [str(tmp_path / "in.txt")], str(tmp_path / "m.json"), {"clean": True})
    doc = a.strict_json((tmp_path / "m.json").read_bytes())
    assert doc["inputs"] == {"in.txt": hashlib.sha256(b"data").hexdigest()} and doc["metrics"] == {"n": 3, "median": 0.5}
    (tmp_path / "img").mkdir()
    a.write_picture(spark.createDataFrame([(1, 0, 10, 20, 30), (9, 9, 1, 1, 1)], "px int, py int, r int, g int, b int"), 3, 2, str(tmp_path / "img/p.png"))
    (tmp_path / "img/q.ppm").write_bytes(b"P6 3 2 255\n" + bytes(range(18)))
    got = {x.path.rsplit("/", 1)[1]: x for x in a.read_rgb_images(spark, str(tmp_path / "img")).collect()}
    assert (got["p.png"].width, got["p.png"].height, bytes(got["p.png"].rgb)) == (3, 2, b"\xff" * 3 + bytes([10, 20, 30]) + b"\xff" * 12) and bytes(got["q.ppm"].rgb) == bytes(range(18))
    px = {(x.u, x.v): (x.r, x.g, x.b) for x in a.pixels_of_rgb(a.read_rgb_images(spark, str(tmp_path / "img")).where("path like '%ppm'")).collect()}
    assert px == {(k % 3, k // 3): (3 * k, 3 * k + 1, 3 * k + 2) for k in range(6)}


def python_fans(faces):
    """(vertex, fan) -> faces, by walking from face to face."""
    out = {}
    for v in {x for f in faces.values() for x in f}:
        left = {f for f, c in faces.items() if v in c}
        while left:
            group, todo = set(), [min(left)]
            while todo:
                f = todo.pop()
                if f in group:
                    continue
                group.add(f)
                todo += [h for h in left if h not in group and len(set(faces[f]) & set(faces[h]) - {v})]
            left -= group
            out[v, min(group)] = group
    return out


def test_pinches_components_and_verdicts(spark):
    # two tetrahedra that share a vertex, one apart, a flat face and a repeated one
    tetra = lambda a, b, c, e: [(a, b, c), (a, c, e), (a, e, b), (b, e, c)]
    listed = tetra(0, 1, 2, 3) + tetra(3, 4, 5, 6) + tetra(7, 8, 9, 10) + [(0, 1, 11), (2, 1, 0), (12, 13, 14)]
    points = {k: (float(k % 3), float(k // 3 % 3), float(k * k % 7)) for k in range(15)} | {11: (0.0, 0.0, 0.0), 12: (0.0, 0.0, 0.0), 13: (1.0, 1.0, 1.0), 14: (2.0, 2.0, 2.0)}
    vertices = spark.createDataFrame([(k, *p) for k, p in points.items()], "id long, x double, y double, z double")
    faces = spark.createDataFrame([(k, *f) for k, f in enumerate(listed)], "face long, v0 long, v1 long, v2 long")
    bad = {(x.face, x.problem) for x in mesh.face_problems(faces, vertices).collect()}
    area = lambda f: np.cross(np.subtract(points[f[1]], points[f[0]]), np.subtract(points[f[2]], points[f[0]])).any()
    assert bad == {(13, "repeated")} | {(k, "degenerate") for k, f in enumerate(listed) if not area(f)} and (14, "degenerate") in bad
    good = spark.createDataFrame([(k, *f) for k, f in enumerate(listed[:12])], "face long, v0 long, v1 long, v2 long")
    v = mesh.verdict(good).first()
    assert (v.faces, v.boundary, v.inner, v.crowded, v.pinched, v.verdict) == (12, 0, 18, 0, 1, "non-manifold")
    split, more = mesh.split_pinches(good, vertices.where("id < 11"))
    rows = {r.face: (r.v0, r.v1, r.v2) for r in split.collect()}
    fans = python_fans({k: f for k, f in enumerate(listed[:12])})
    want, new = {k: list(f) for k, f in enumerate(listed[:12])}, 11
    for (vertex, fan), group in sorted(fans.items()):
        if fan > min(f for x, f in fans if x == vertex):
            for k in group:
                want[k][want[k].index(vertex)] = new
            new += 1
    assert rows == {k: tuple(x) for k, x in want.items()} and more.count() == new == 12
    assert mesh.verdict(split).first().verdict == "closed"
    few, left = mesh.keep_components(spark.createDataFrame([(k, *f) for k, f in enumerate(listed[:13])], faces.schema), vertices, 5)
    assert few.count() == 9 and sorted(r.id for r in left.collect()) == list(range(left.count())) and sorted(r.face for r in few.collect()) == list(range(9))


def test_indexed_meshes_have_dense_numbers(spark):
    rows = [(x, y, z, ((x - 4.1) ** 2 + (y - 4.2) ** 2 + (z - 3.9) ** 2) ** 0.5 - 2.6) for x, y, z in itertools.product(range(9), repeat=3)]
    k = surface.corners(surface.triangles(surface.active_cells(spark.createDataFrame(rows, "gx long, gy long, gz long, value double"))), 1.0, ("n", "p"))
    faces, vertices = mesh.indexed(k)
    f, n = faces.orderBy("face").collect(), vertices.count()
    assert [r.face for r in f] == list(range(len(f))) and sorted(r.id for r in vertices.collect()) == list(range(n))
    seen = list(dict.fromkeys(x for r in f[:40] for x in sorted((r.v0, r.v1, r.v2))))
    assert max(seen) == len(seen) - 1  # numbered in the order of their first use
    assert mesh.verdict(faces).first().verdict == "closed" and mesh.face_problems(faces, vertices).count() == 0
