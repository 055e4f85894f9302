"""What the command line does with sessions and artifacts; each command returns the lines that it prints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import commit, expansion, freespace, fuse, mesh, plan, proof, replay, surface
from scanengine.operators.evaluate import residual_summary, trilinear
from scanengine.sources import artifacts, files, importer, session
from scanengine.sources.scratch import kept

Lines = dict[str, object]


@dataclass
class Scan:
    """A session's frames (seq, ts, has_depth, has_pose, m0..m11, depth), its camera and its name."""

    frames: DataFrame
    camera: g.Camera
    name: str

    def pixels(self) -> DataFrame:
        px = self.frames.where("has_depth").select("seq", F.posexplode("depth").alias("i", "raw"))
        return px.select("seq", (F.col("i") % self.camera.width).alias("u"), F.floor(F.col("i") / self.camera.width).cast("int").alias("v"), F.col("raw").cast("long").alias("raw"))


def read_scan(spark: SparkSession, root: str) -> Scan:
    """A checked session's frames: each colour image with the depth image and the pose of its very time."""
    s = session.load_session(spark, root)
    by = {k: n for n, k in ((n, x["kind"]) for n, x in sorted(s.manifest["streams"].items(), reverse=True))}
    of = lambda kind: s.streams.get(by.get(kind, "")) if kind in by else None
    none = spark.createDataFrame([], "id string, ts long, path string, T_world_camera array<double>")
    stream = lambda kind: none if of(kind) is None else of(kind).select("id", F.col("timestamp_ns").alias("ts"), "path", "T_world_camera")
    rgb, depth, poses = stream("rgb"), stream("depth"), stream("pose")
    about = s.manifest["streams"].get(by.get("depth", ""), {})
    c = s.cameras.where(F.col("id") == about.get("calibration_id", "")).first() or s.cameras.orderBy("id").first()
    camera = g.Camera(c["width"], c["height"], c["fx"], c["fy"], c["cx"], c["cy"], float(about.get("depth_scale_m", 0.001)))
    rows = replay.replay(rgb, depth, poses)
    m = [F.get("T_world_camera", F.lit(k)).alias(f"m{k}") for k in range(12)]
    rows = rows.join(poses.select(F.col("id").alias("pose_id"), *m), "pose_id", "left")
    folders = [r["d"] for r in depth.select(F.regexp_replace("path", "/[^/]*$", "").alias("d")).distinct().orderBy("d").collect()]
    frames = rows.join(depth.select(F.col("id").alias("depth_id"), "path"), "depth_id", "left")
    if folders:
        images = None
        for d in folders:  # a session keeps its images in a few folders
            one = files.read_depth_images(spark, f"{root}/{d}")
            one = one.select(F.concat(F.lit(f"{d}/"), F.regexp_extract("path", "([^/]*)$", 1)).alias("path"), "width", "height", "depth")
            images = one if images is None else images.unionByName(one)
        frames = frames.join(images, "path", "left")
        odd = frames.where(F.col("path").isNotNull() & ~((F.col("width") == camera.width) & (F.col("height") == camera.height))).limit(1).collect()
        if odd:
            raise session.SessionError(f"{odd[0]['path']}: not of the camera's size")
    else:
        frames = frames.withColumn("depth", F.lit(None).cast("array<int>"))
    frames = frames.select("seq", "ts", F.col("depth").isNotNull().alias("has_depth"), F.col("m0").isNotNull().alias("has_pose"), *[f"m{k}" for k in range(12)], "depth")
    return Scan(kept(frames, "scan"), camera, s.manifest["session_id"])


def grid_of(voxel: float, truncation: float | None) -> g.Grid:
    return g.Grid(voxel, 4 * voxel if truncation is None else truncation)


def _strided(scan: Scan, stride: int) -> DataFrame:
    return scan.frames.where(F.col("seq") % stride == 0)


def _plan(scan: Scan, grid: g.Grid, stride: int) -> tuple[DataFrame, dict]:
    px = scan.pixels()
    blocks = kept(plan.plan(plan.points(px, scan.frames.drop("depth"), scan.camera, stride, 1), grid), "plan")
    counters = plan.counters(scan.frames.drop("depth"), px, stride).first().asDict()
    return blocks, {"frame_stride": stride} | counters


def validate(spark: SparkSession, root: str) -> Lines:
    s = session.load_session(spark, root)
    return {"session": s.manifest["session_id"], "cameras": s.cameras.count()} | {f"{n} samples": d.count() for n, d in sorted(s.streams.items())}


def replayed(spark: SparkSession, root: str) -> Lines:
    scan = read_scan(spark, root)
    f = scan.frames
    n = f.agg(F.count("*").alias("frames"), F.count_if("has_depth").alias("with depth"), F.count_if("has_pose").alias("with pose"), (F.max("ts") - F.min("ts")).alias("duration ns")).first().asDict()
    rows = f.select("seq", "ts", "has_depth", "has_pose", *[f"m{k}" for k in range(12)], F.xxhash64("depth").alias("image"))
    return {"session": scan.name} | n | {"digest": replay.ordered_digest(rows, [c for c in rows.columns], "seq").first()["digest"]}


def import_sequence(spark: SparkSession, source: str, target: str, name: str, camera: list[float], scale: float, up: str | None) -> Lines:
    width, height, fx, fy, cx, cy = camera
    return importer.import_sequence(spark, source, target, name, int(width), int(height), fx, fy, cx, cy, scale, up)


def point_cloud(spark: SparkSession, root: str, out: str, stride: int, pixel_stride: int) -> Lines:
    scan = read_scan(spark, root)
    p = kept(plan.points(scan.pixels(), scan.frames.drop("depth"), scan.camera, stride, pixel_stride).select("seq", "v", "u", F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z")), "points")
    files.write_points_ply(p, out, comments=(f"session {scan.name}",), order=["seq", "v", "u"])
    return {"session": scan.name, "points": p.count(), "output": out}


def plan_blocks(spark: SparkSession, root: str, out: str, voxel: float, truncation: float | None, stride: int, expand: bool) -> Lines:
    scan, grid = read_scan(spark, root), grid_of(voxel, truncation)
    blocks, counters = _plan(scan, grid, stride)
    more = None
    if expand:
        more = expansion.observed(_strided(scan, stride), scan.camera, grid)
    digest = artifacts.write_plan(blocks, grid, counters, out, more)
    return {"session": scan.name, "blocks": blocks.count(), "surface blocks": blocks.where("is_surface").count(), "sha256": digest, "output": out}


def verify_plan(spark: SparkSession, root: str, path: str) -> Lines:
    doc, loaded = artifacts.load_plan(spark, path)
    grid = g.Grid(doc["grid"]["voxel_size_m"], doc["activation"]["truncation_m"])
    scan = read_scan(spark, root)
    blocks, counters = _plan(scan, grid, doc["planning"]["frame_stride"])
    wrong = artifacts.plan_differences(doc, loaded.where("is_surface") if doc["schema_version"] == "0.2.0" else loaded, blocks.where("is_surface") if doc["schema_version"] == "0.2.0" else blocks, counters).collect()
    return {"verdict": "differs" if wrong else "agrees"} | {r["field"]: f"{r['left']} / {r['right']}" for r in wrong}


def fuse_volume(spark: SparkSession, root: str, out: str, voxel: float, truncation: float | None, stride: int, plan_file: str | None) -> Lines:
    scan, grid = read_scan(spark, root), grid_of(voxel, truncation)
    if plan_file:
        doc, blocks = artifacts.load_plan(spark, plan_file)
        grid, stride = g.Grid(doc["grid"]["voxel_size_m"], doc["activation"]["truncation_m"]), doc["planning"]["frame_stride"]
    else:
        blocks, _ = _plan(scan, grid, stride)
    v = kept(fuse.fuse(_strided(scan, stride), blocks, scan.camera, grid), "volume")
    digest = artifacts.write_volume(v, {"frame_stride": stride, "session": scan.name, "truncation": grid.truncation, "voxel": grid.voxel}, out)
    report = fuse.volume_report(v, blocks).first().asDict()
    return {"session": scan.name, "blocks": blocks.count()} | report | {"sha256": digest, "output": out}


def read_volume(spark: SparkSession, path: str) -> tuple[dict, DataFrame, g.Grid]:
    header = files.decode_volume(artifacts.content(path))[0]
    return header, kept(files.read_volumes(spark, path).drop("path"), "volume"), g.Grid(header["voxel"], header["truncation"])


def extract_mesh(spark: SparkSession, path: str, out: str, min_weight: int, min_triangles: int) -> Lines:
    """The volume's mesh without bad faces, a vertex for each fan, small components left out."""
    import hashlib

    header, v, grid = read_volume(spark, path)
    k = surface.corners(surface.triangles(surface.active_cells(surface.samples(v, min_weight))), grid.voxel, ("n", "p"))
    faces, vertices = mesh.indexed(k)
    problems = {r["problem"]: r["count"] for r in mesh.face_problems(faces, vertices).groupBy("problem").count().collect()}
    faces, vertices = (kept(d, "mesh") for d in mesh.split_pinches(mesh.clean(faces, vertices), vertices))
    if min_triangles > 1:
        faces, vertices = (kept(d, "mesh") for d in mesh.keep_components(faces, vertices, min_triangles))
    source = hashlib.sha256(artifacts.content(path)).hexdigest()
    digest = artifacts.write_mesh(vertices, faces, out, (f"session {header['session']}", f"source_volume_sha256 {source}", f"minimum_weight {min_weight}", f"minimum_component_triangles {min_triangles}"))
    v = mesh.verdict(faces).first().asDict()
    return v | {f"{n} faces left out": c for n, c in sorted(problems.items())} | {"sha256": digest, "output": out}


def surface_points(spark: SparkSession, path: str, out: str, min_weight: int) -> Lines:
    header, v, grid = read_volume(spark, path)
    p = kept(surface.surface_points(surface.samples(v, min_weight), grid.voxel), "surface")
    files.write_points_ply(p, out, comments=(f"session {header['session']}",), order=["kind", "gz", "gy", "gx"])
    return {"points": p.count(), "output": out}


def locate(spark: SparkSession, path: str, points: list[list[float]]) -> Lines:
    """The voxels that some points lie in."""
    _, v, grid = read_volume(spark, path)
    p = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(points)], "id int, wx double, wy double, wz double")
    rows = surface.locate(p, v, grid.voxel).orderBy("id").collect()
    return {f"point {r['id']}": f"block {r['bx']},{r['by']},{r['bz']} voxel {r['l']} {r['status']}" + (f" weight {r['weight']} mean {r['tsdf_sum'] / r['weight']:.9f}" if r["weight"] else "") for r in rows}


def score(spark: SparkSession, root: str, path: str, offset: int | None, pixel_stride: int) -> Lines:
    """A volume against frames that were not fused."""
    header, v, grid = read_volume(spark, path)
    stride = header["frame_stride"]
    at = stride // 2 if offset is None else offset
    if not 0 < at < stride:
        raise ValueError("every frame was fused, or the offset is not between the fused frames")
    scan = read_scan(spark, root)
    p = plan.points(scan.pixels(), scan.frames.drop("depth"), scan.camera, 1, pixel_stride).where(F.col("seq") % stride == at)
    p = p.select(F.xxhash64("seq", "u", "v").alias("id"), F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"))
    r = trilinear(p, surface.samples(v), grid.voxel).select((F.col("value") * F.lit(grid.truncation)).alias("r"))
    return {"held-out points": p.count()} | residual_summary(r, "r", grid.voxel).first().asDict()


def _leaves(v: DataFrame) -> DataFrame:
    return kept(commit.numbered(commit.block_leaves(v)), "leaves")


def _stated(scan: Scan, leaves: DataFrame, header: dict, grid: g.Grid, side: int) -> dict:
    frames = kept(proof.frame_leaves(scan.frames, proof.depth_trees(proof.image_tiles(scan.frames, scan.camera, side))), "frame-leaves")
    return proof.statement(frames, leaves, scan.name, scan.camera, grid, side, header["frame_stride"])


def commit_map(spark: SparkSession, root: str, path: str, out: str, side: int) -> Lines:
    header, v, grid = read_volume(spark, path)
    scan = read_scan(spark, root)
    stated = _stated(scan, _leaves(v), header, grid, side)
    proof.write_statement(stated, out)
    return {k: stated[k] for k in ("session", "frames", "blocks", "scan_root", "map_root")} | {"statement": proof.digest_of(stated), "output": out}


def check_commit(spark: SparkSession, root: str, path: str, statement: str) -> Lines:
    stated = proof.load_statement(statement)
    header, v, grid = read_volume(spark, path)
    again = _stated(read_scan(spark, root), _leaves(v), header, grid, stated["tile_pixels"])
    wrong = proof.statement_differences(spark, stated, again).collect()
    return {"verdict": "differs" if wrong else "agrees"} | {r["field"]: f"{r['left']} / {r['right']}" for r in wrong}


def check_volume(spark: SparkSession, root: str, path: str, count: int, seed: str) -> Lines:
    """V8, O3: blocks drawn from a volume, fused again on their own."""
    header, v, grid = read_volume(spark, path)
    scan = read_scan(spark, root)
    drawn = kept(commit.sample_blocks(v.select("bx", "by", "bz").distinct(), seed, count), "sample")
    again = fuse.fuse(_strided(scan, header["frame_stride"]), drawn, scan.camera, grid)
    n = fuse.compare_volumes(v.join(drawn.select("bx", "by", "bz"), ["bx", "by", "bz"], "left_semi"), again).groupBy("verdict").count().collect()
    return {"blocks": drawn.count()} | {r["verdict"]: r["count"] for r in sorted(n)}


def _route(spark: SparkSession, waypoints: list[list[int]], radius: int) -> DataFrame:
    return freespace.swept(freespace.chain(freespace.waypoints(spark, [tuple(w) for w in waypoints])), radius)


def prove(spark: SparkSession, root: str, path: str, statement: str, out: str, packed: bool, blocks: list[list[int]] | None = None, route: tuple | None = None, audit: tuple | None = None) -> Lines:
    """The proof of some blocks, of those that a route touches, or of those that an audit draws."""
    stated = proof.load_statement(statement)
    _, v, grid = read_volume(spark, path)
    scan, leaves = read_scan(spark, root), _leaves(v)
    if route:
        waypoints, radius, first, last = route
        wanted = freespace.touched_blocks(_route(spark, waypoints, radius), first, last)
    elif audit:
        seed, count = audit
        wanted = proof.audit_blocks(spark, stated, seed.encode(), count, leaves)
    else:
        wanted = spark.createDataFrame([tuple(b) for b in blocks or []], "bx int, by int, bz int")
    p = proof.prove(stated, scan.frames, leaves, wanted, scan.camera, grid)
    digest = proof.write_proof(p, out, packed)
    return {"blocks": p.blocks.count(), "tiles": p.tiles.count(), "sha256": digest, "output": out}


def check_proof(spark: SparkSession, statement: str, path: str, route: tuple | None = None, audit: tuple | None = None) -> Lines:
    """A proof against a statement; nothing else is read."""
    stated, p = proof.load_statement(statement), proof.load_proof(spark, path)
    if route:
        waypoints, radius, first, last, weight = route
        return proof.check_route(stated, p, _route(spark, waypoints, radius), first, last, weight).first().asDict()
    if audit:
        seed, count = audit
        row = proof.check_audit(stated, p, seed.encode(), count).first().asDict()
        return row | {"wrong blocks caught": commit.wrong_blocks_caught(stated["blocks"], count)}
    return {k: x for k, x in proof.held_verdict(proof.check_blocks(stated, p)).first().asDict().items() if x is not None}
