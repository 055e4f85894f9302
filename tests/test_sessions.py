"""Sessions: imported, loaded with every problem told at once, and the frames that poses are put in."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.sources import files, importer, session


def quaternion(r):
    q = np.array([r.gauss(0, 1) for _ in range(4)])
    return q / np.linalg.norm(q)


def matrix(q, t):
    x, y, z, w = q / np.linalg.norm(q)
    m = np.eye(4)
    m[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    m[:3, 3] = t
    return m


def recorded(folder, n=7, turned=0.3):
    r = random.Random(4)
    (folder / "rgb").mkdir(parents=True)
    (folder / "depth").mkdir()
    rgb, depth, poses = ["# colour"], ["# depth"], ["# poses"]
    for k in range(n):
        (folder / f"rgb/{k}.ppm").write_bytes(b"P6 2 1 255\n" + bytes([k] * 6))
        (folder / f"depth/{k}.pgm").write_bytes(b"P5 2 1 65535\n" + struct.pack(">2H", k, 5000))
        rgb.append(f"{100 + k / 10:.6f} rgb/{k}.ppm")
        if k != 3:
            depth.append(f"{100.004 + k / 10:.6f} depth/{k}.pgm")
        if k != 1:
            q = quaternion(r)
            poses.append(f"{99.999 + k / 10:.4f} {r.random():.4f} {r.random():.4f} {r.random():.4f} " + " ".join(f"{x:.6f}" for x in q))
    for name, lines in (("rgb", rgb), ("depth", depth), ("groundtruth", poses)):
        (folder / f"{name}.txt").write_text("\n".join(lines) + "\n")
    return [[float(x) for x in p.split()] for p in poses[1:]]


CAMERA = dict(width=2, height=1, fx=2.0, fy=2.0, cx=0.5, cy=0.5)


@pytest.mark.parametrize("up", [None, "z", "-y"])
def test_a_sequence_becomes_a_session(spark, tmp_path, up):
    poses = recorded(tmp_path / "seq")
    target = str(tmp_path / "x.session")
    assert importer.import_sequence(spark, str(tmp_path / "seq"), target, "seq-1", **CAMERA, up=up) == {"pairs": 6, "poses": 5, "files": 12}
    s = session.load_session(spark, target)
    assert {k: d.count() for k, d in s.streams.items()} == {"rgb": 6, "depth": 6, "pose": 5}
    first = matrix(poses[0][4:], poses[0][1:4])
    if up is None:
        frame = np.array([*importer.RIG_CAMERA, 0, 0, 0, 1]).reshape(4, 4) @ np.linalg.inv(first)
    else:
        u = np.array(importer.UP_AXES[up])
        along = first[:3, 2] - (first[:3, 2] @ u) * u
        forward = along / np.linalg.norm(along)
        frame = np.eye(4)
        frame[:3, :3] = [forward, np.cross(u, forward), u]
        frame[:3, 3] = -frame[:3, :3] @ first[:3, 3]
    by = {round(p[0] * 1e4): p for p in poses}
    for r in s.streams["pose"].collect():
        p = by[round(999990 + r.timestamp_ns / 1e5)]
        assert np.allclose(np.array(r.T_world_camera).reshape(4, 4), frame @ matrix(np.array(p[4:]), p[1:4]), atol=1e-9)
    assert (tmp_path / "x.session/data/rgb/000003.ppm").read_bytes() == (tmp_path / "seq/rgb/4.ppm").read_bytes()
    with pytest.raises(Exception, match="exists"):
        importer.import_sequence(spark, str(tmp_path / "seq"), target, "seq-1", **CAMERA)


def test_every_problem_of_a_session_is_told(spark, tmp_path):
    recorded(tmp_path / "seq")
    root = tmp_path / "x.session"
    importer.import_sequence(spark, str(tmp_path / "seq"), str(root), "seq-1", **CAMERA)
    m = json.loads((root / "manifest.json").read_text())
    m["schema_version"], m["created_at_utc"], m["timebase"]["unit"] = "9", "2020-01-01T00:00:00", "seconds"
    m["streams"]["rgb"]["calibration_id"], m["streams"]["odd"], m["streams"]["depth"]["depth_scale_m"] = "none", {"kind": "smell"}, 0
    (root / "manifest.json").write_text(json.dumps(m))
    c = json.loads((root / "calibration/cameras.json").read_text())
    c["cameras"][0]["intrinsics"]["fx"] = -1
    (root / "calibration/cameras.json").write_text(json.dumps(c))
    lines = (root / "streams/rgb.jsonl").read_text().splitlines()
    (root / "streams/rgb.jsonl").write_text("\n".join([lines[1], lines[0], "{no"]) + "\n")
    (root / "data/depth/000002.pgm").unlink()
    with pytest.raises(session.SessionError) as e:
        session.load_session(spark, str(root))
    said = str(e.value)
    for part in ("schema_version", "created_at_utc", "timebase", "no camera none", "odd: unknown kind", "depth: no depth scale", "camera-rgb: focal lengths", "rgb-000000: timestamps do not rise", "not a record", "depth-000002: no such file"):
        assert part in said, part
    with pytest.raises(session.SessionError, match="manifest: no such file"):
        session.load_session(spark, str(tmp_path / "seq"))


def test_a_first_camera_that_looks_up_has_no_heading(spark):
    turn = lambda q, up: spark.range(1).select(*[c.alias(f"m{k}") for k, c in enumerate(importer.session_frame(importer.pose_matrix(tuple(g.lit(x) for x in (1, 2, 3)), tuple(g.lit(x) for x in q)), up))]).first()
    assert turn((0, 0, 0, 1), "z").m0 is None and turn((0, 0, 0, 1), "y").m0 is not None
    got = turn((0, math.sqrt(0.5), 0, math.sqrt(0.5)), "y")
    assert np.allclose([got[f"m{k}"] for k in range(12)], [1, 0, 0, -1, 0, 0, -1, 3, 0, 1, 0, -2], atol=1e-12)


def test_pairs_and_folders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 depth/1.png 1.01 rgb/1.png\n# c\n2 depth/2.png 2.01 rgb/2.png\n")
    assert [tuple(r) for r in importer.read_pairs(spark, str(tmp_path / "a.txt")).orderBy("ts").collect()][0] == (10**9, "depth/1.png", 1010000000, "rgb/1.png")
    for d in ("clean", "noisy"):
        (tmp_path / d).mkdir()
        for t in ("0.5", "1.5", "2.5") if d == "clean" else ("0.5", "2.5", "3.5"):
            (tmp_path / d / f"{t}.png").write_bytes(b"x")
    got = importer.paired(*(importer.read_folder(spark, str(tmp_path / d)) for d in ("clean", "noisy"))).collect()
    assert [(r.seq, r.ts) for r in sorted(got)] == [(0, 500000000), (1, 2500000000)]
    (tmp_path / "t.txt").write_text("1 0.1 -0.2 0.30 0.5 0.6 0.7 0.8\n")
    flipped = files.other_hand(importer.read_pose_text(spark, str(tmp_path / "t.txt"))).first()
    assert tuple(flipped)[1:] == ("0.1", "-0.2", "-0.30", "0.8", "0.7", "0.6", "0.5")
