"""The command line from a recorded sequence to a checked proof."""

import struct

import pytest

from scanengine.__main__ import main

W, H = 48, 36


def recorded(folder, n=8):
    """A camera that moves along a wall with a step in it."""
    (folder / "rgb").mkdir(parents=True)
    (folder / "depth").mkdir()
    rgb, depth, poses = [], [], []
    for k in range(n):
        (folder / f"rgb/{k}.ppm").write_bytes(b"P6 %d %d 255\n" % (W, H) + bytes([k]) * (3 * W * H))
        raw = [1000 + (200 if u > 30 else 0) + (3 * v) % 40 for v in range(H) for u in range(W)]
        (folder / f"depth/{k}.pgm").write_bytes(b"P5 %d %d 65535\n" % (W, H) + struct.pack(f">{W * H}H", *raw))
        rgb.append(f"{10 + k / 10:.3f} rgb/{k}.ppm")
        depth.append(f"{10 + k / 10:.3f} depth/{k}.pgm")
        poses.append(f"{10 + k / 10:.3f} {k * 0.01:.3f} 0 0 0 0 0 1")
    for name, lines in (("rgb", rgb), ("depth", depth), ("groundtruth", poses)):
        (folder / f"{name}.txt").write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    recorded(folder / "seq")

    def run(*words):
        import contextlib
        import io

        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            code = main([str(folder / w[1:]) if isinstance(w, str) and w.startswith("@") else str(w) for w in words], spark)
        return code, dict(line.split(": ", 1) for line in out.getvalue().splitlines())

    assert run("import", "@seq", "@s.session", "wall", "--camera", f"{W},{H},40,40,23.5,17.5", "--scale", "0.001") == (0, {"pairs": "8", "poses": "8", "files": "16"})
    return run


def test_sessions_plans_and_volumes(at):
    assert at("validate", "@s.session") == (0, {"session": "wall", "cameras": "1", "depth samples": "8", "pose samples": "8", "rgb samples": "8"})
    code, said = at("replay", "@s.session")
    assert code == 0 and said["frames"] == said["with depth"] == "8" and len(said["digest"]) == 64
    assert at("plan", "@s.session", "@p.json", "--voxel", 0.02, "--truncation", 0.06, "--stride", 2)[0] == 0
    assert at("plan-verify", "@s.session", "@p.json") == (0, {"verdict": "agrees"})
    code, said = at("volume", "@s.session", "@v.vol", "--voxel", 0.02, "--plan", "@p.json")
    assert code == 0 and int(said["observed"]) > 1000
    assert at("volume", "@s.session", "@v.vol", "--voxel", 0.02, "--plan", "@p.json")[0] == 1
    code, said = at("score", "@s.session", "@v.vol")
    assert code == 0 and float(said["median"]) < 0.02 and int(said["n"]) > 50
    code, said = at("check", "@s.session", "@v.vol", "--blocks", 5)
    assert (code, said) == (0, {"blocks": "5", "identical": "5"})
    code, said = at("mesh", "@v.vol", "@m.ply", "--min-triangles", 20)
    assert code == 0 and int(said["faces"]) > 500 and said["pinched"] == said["crowded"] == "0"
    code, said = at("locate", "@v.vol", "1.0,0.0,0.0", "50,0,0")
    assert "observed" in said["point 0"] and "no-block" in said["point 1"]


def test_statements_and_proofs(at):
    assert at("volume", "@s.session", "@x.vol", "--voxel", 0.03, "--truncation", 0.09)[0] == 0
    assert at("commit", "@s.session", "@x.vol", "@s.json", "--tile", 12)[0] == 0
    assert at("commit-check", "@s.session", "@x.vol", "@s.json") == (0, {"verdict": "agrees"})
    assert at("prove", "@s.session", "@x.vol", "@s.json", "@a.prf", "--audit", 3, "--seed", "z", "--packed")[0] == 0
    code, said = at("proof-check", "@s.json", "@a.prf", "--audit", 3, "--seed", "z")
    assert code == 0 and said["verdict"] == "verified" and int(said["wrong blocks caught"]) > 0
    assert at("proof-check", "@s.json", "@a.prf", "--audit", 3, "--seed", "y")[0] == 1
    route = ("--waypoint", "20,0", "--waypoint", "24,2", "--radius", 1, "--band", "0,1")
    assert at("prove", "@s.session", "@x.vol", "@s.json", "@r.prf", *route)[0] == 0
    code, said = at("proof-check", "@s.json", "@r.prf", *route, "--min-weight", 1)
    assert said["verdict"] in ("clear", "not-clear") and code == (said["verdict"] != "clear")
    assert at("proof-check", "@s.json", "@r.prf", "--waypoint", "0,0")[0] == 1
    code, said = at("proof-check", "@s.json", "@r.prf")
    assert code == 0 and said["verdict"] == "verified"
