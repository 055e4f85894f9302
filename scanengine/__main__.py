"""Command line over sessions, artifacts and the registered queries.

    python -m scanengine validate SESSION
    python -m scanengine volume SESSION OUT --voxel 0.02
    python -m scanengine run a1_fuse_voxels /root/testdata/sf0.01 [--to FOLDER]

Every command prints `key: value` lines.  Exit codes: 0 done, 1 refused or not as stated, 2 bad arguments.
"""

from __future__ import annotations

import argparse
import sys

from scanengine import commands
from scanengine.plans import registry
from scanengine.session import local_session

#: What a verdict must be for exit code 0.
GOOD = {"agrees", "verified", "clear", "closed", "manifold-with-boundary"}


def triple(kind):
    def read(text: str) -> list:
        parts = [kind(x) for x in text.split(",")]
        if len(parts) not in (2, 3, 6):
            raise argparse.ArgumentTypeError(f"not a list of numbers: {text}")
        return parts

    return read


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scanengine", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *places: str, grid: bool = False, stride: bool = False) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for x in places:
            s.add_argument(x)
        if grid:
            s.add_argument("--voxel", type=float, required=True)
            s.add_argument("--truncation", type=float)
        if grid or stride:
            s.add_argument("--stride", type=int, default=1)
        return s

    add("list")
    add("run", "query", "folder").add_argument("--to")
    add("explain", "query", "folder")
    add("validate", "session")
    add("replay", "session")
    s = add("import", "source", "target", "name")
    s.add_argument("--camera", type=triple(float), required=True, help="width,height,fx,fy,cx,cy")
    s.add_argument("--scale", type=float, default=0.0002)
    s.add_argument("--up")
    add("point-cloud", "session", "out", stride=True).add_argument("--pixel-stride", type=int, default=1)
    add("plan", "session", "out", grid=True).add_argument("--expand", action="store_true")
    add("plan-verify", "session", "plan")
    add("volume", "session", "out", grid=True).add_argument("--plan")
    s = add("mesh", "volume", "out")
    s.add_argument("--min-weight", type=int, default=1)
    s.add_argument("--min-triangles", type=int, default=1)
    add("surface-points", "volume", "out").add_argument("--min-weight", type=int, default=1)
    add("locate", "volume").add_argument("points", nargs="+", type=triple(float))
    s = add("score", "session", "volume")
    s.add_argument("--offset", type=int)
    s.add_argument("--pixel-stride", type=int, default=4)
    s = add("check", "session", "volume")
    s.add_argument("--blocks", type=int, default=200)
    s.add_argument("--seed", default="0")
    add("commit", "session", "volume", "out").add_argument("--tile", type=int, default=16)
    add("commit-check", "session", "volume", "statement")
    for name, places in (("prove", ("session", "volume", "statement", "out")), ("proof-check", ("statement", "proof"))):
        s = add(name, *places)
        s.add_argument("--block", type=triple(int), action="append")
        s.add_argument("--waypoint", type=triple(int), action="append")
        s.add_argument("--radius", type=int, default=4)
        s.add_argument("--band", type=triple(int), default=[0, 0], help="first,last voxel layer")
        s.add_argument("--min-weight", type=int, default=3)
        s.add_argument("--audit", type=int, help="blocks to draw")
        s.add_argument("--seed", default="")
        s.add_argument("--packed", action="store_true")
    return p


def act(a: argparse.Namespace, spark) -> dict:
    c = commands
    route = (a.waypoint, a.radius, *a.band) if getattr(a, "waypoint", None) else None
    audit = (a.seed, a.audit) if getattr(a, "audit", None) else None
    return {
        "validate": lambda: c.validate(spark, a.session),
        "replay": lambda: c.replayed(spark, a.session),
        "import": lambda: c.import_sequence(spark, a.source, a.target, a.name, a.camera, a.scale, a.up),
        "point-cloud": lambda: c.point_cloud(spark, a.session, a.out, a.stride, a.pixel_stride),
        "plan": lambda: c.plan_blocks(spark, a.session, a.out, a.voxel, a.truncation, a.stride, a.expand),
        "plan-verify": lambda: c.verify_plan(spark, a.session, a.plan),
        "volume": lambda: c.fuse_volume(spark, a.session, a.out, a.voxel, a.truncation, a.stride, a.plan),
        "mesh": lambda: c.extract_mesh(spark, a.volume, a.out, a.min_weight, a.min_triangles),
        "surface-points": lambda: c.surface_points(spark, a.volume, a.out, a.min_weight),
        "locate": lambda: c.locate(spark, a.volume, a.points),
        "score": lambda: c.score(spark, a.session, a.volume, a.offset, a.pixel_stride),
        "check": lambda: c.check_volume(spark, a.session, a.volume, a.blocks, a.seed),
        "commit": lambda: c.commit_map(spark, a.session, a.volume, a.out, a.tile),
        "commit-check": lambda: c.check_commit(spark, a.session, a.volume, a.statement),
        "prove": lambda: c.prove(spark, a.session, a.volume, a.statement, a.out, a.packed, a.block, route, audit),
        "proof-check": lambda: c.check_proof(spark, a.statement, a.proof, route and (*route, a.min_weight), audit),
    }[a.command]()


def main(arguments: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(arguments)
    if a.command in ("list", "run", "explain"):
        found = registry.queries()
        if a.command == "list":
            for name in sorted(found):
                print(f"{name}: {'with' if name in registry.oracle_sql() else 'without'} an SQL twin")
            return 0
        if a.query not in found:
            print(f"no such query: {a.query}", file=sys.stderr)
            return 2
        df = found[a.query](spark or local_session("*"), a.folder)
        if a.command == "explain":
            df.explain("formatted")
        elif a.to:
            df.write.mode("errorifexists").parquet(a.to)
        else:
            df.show(50, truncate=False)
        return 0
    try:
        lines = act(a, spark or local_session("*"))
    except (ValueError, FileExistsError) as e:
        print(f"refused: {e}", file=sys.stderr)
        return 1
    for k, v in lines.items():
        print(f"{k}: {v}")
    return 0 if lines.get("verdict", "agrees") in GOOD else 1


if __name__ == "__main__":
    sys.exit(main())
