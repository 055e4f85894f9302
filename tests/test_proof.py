"""Proofs of blocks, routes and audits: verified as they are, and refused at the first check that a change breaks."""

import hashlib
import struct
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import commit, freespace, fuse, proof
from scanengine.plans.fusion_queries import COARSE, blocks
from scanengine.sources import artifacts, derived
from scanengine.sources.derived import CAMERA

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
SIDE = 10


@pytest.fixture(scope="module")
def world(spark):
    s = derived.scan(spark, SF)
    scan = s.select("*", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k")).withColumn("seq", F.col("seq") * 3 + F.col("k"))
    scan = scan.withColumn("m3", F.col("m3") + F.col("k") * 0.1).drop("k").withColumn("has_pose", F.col("has_pose") & (F.col("seq") != 5)).cache()
    volume = fuse.fuse(scan.where("seq % 2 = 0"), blocks(spark, SF), CAMERA, COARSE).cache()
    leaves = commit.numbered(commit.block_leaves(volume)).cache()
    frames = proof.frame_leaves(scan, proof.depth_trees(proof.image_tiles(scan, CAMERA, SIDE)))
    stated = proof.statement(frames, leaves, "s", CAMERA, COARSE, SIDE, 2)
    few = leaves.where("idx % 5 = 1")
    p = proof.prove(stated, scan, leaves, few, CAMERA, COARSE)
    p = replace(p, **{n: getattr(p, n).cache() for n in ("frames", "blocks", "paths", "tiles", "tile_paths")})
    return scan, volume, leaves, stated, p


def found(stated, p):
    return {(r.verdict, r.failed) for r in proof.check_blocks(stated, p).collect()}


def test_tiles_and_depth_roots(world):
    scan, _, _, _, p = world
    image = {r.seq: np.array(r.depth).reshape(CAMERA.height, CAMERA.width) for r in scan.where("has_depth").collect()}
    for r in p.frames.collect():
        seq, pose, root = proof.read_frame(bytes(r.data))
        assert seq == r.seq and (root is None) == (seq not in image)
        if root:
            cut = [image[seq][y : y + SIDE, x : x + SIDE].astype("<u2").tobytes() for y in range(0, 24, SIDE) for x in range(0, 32, SIDE)]
            level = [hashlib.sha256(b"\0" + commit.TILE_TAG + c).digest() for c in cut]
            while len(level) > 1:
                level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            assert level[0] == root
    for bad in (b"x", commit.frame_leaf(3, None, None)[:-1], commit.frame_leaf(3, None, None)[:-1] + b"\1"):
        with pytest.raises(ValueError):
            proof.read_frame(bad)


def test_a_proof_verifies_and_its_evidence_is_least(world):
    _, _, leaves, stated, p = world
    n = p.blocks.count()
    assert n == leaves.where("idx % 5 = 1").count() > 3 and found(stated, p) == {("verified", None)}
    v = proof.held_verdict(proof.check_blocks(stated, p)).first()
    assert (v.verdict, v.failed, v.blocks) == ("verified", None, n)
    counts = proof.evidence_counts(p.tiles, CAMERA, SIDE).collect()
    sizes = {}
    for r in p.tiles.collect():
        sizes[r.bx, r.by, r.bz] = sizes.get((r.bx, r.by, r.bz), 0) + len(r.data) - len(commit.TILE_TAG)
    assert {(r.bx, r.by, r.bz): r.bytes for r in counts} == sizes


def test_the_first_broken_check_is_named(world, spark):
    _, _, leaves, stated, p = world
    assert found(stated | {"rule": "other"}, p) == {("invalid", "statement")}
    assert found(stated | {"voxel": 0.3}, p) == {("invalid", "statement")}
    named = lambda s, **k: replace(p, shape=proof.shape_of(s), **k)
    assert found(stated, replace(p, shape=p.shape | {"width": 31})) == {("invalid", "shape")}
    assert found(stated, replace(p, frames=p.frames.where("idx > 0"))) == {("invalid", "shape")}
    moved = p.frames.withColumn("data", F.when(F.col("seq") == 2, F.lit(commit.frame_leaf(2, [1.0] * 16, None))).otherwise(F.col("data")))
    assert found(stated, replace(p, frames=moved)) == {("invalid", "scan root")}
    # a scan stated with a pose that is no rigid motion
    torn = stated | {"scan_root": commit.root(moved.select("idx", "data")).hex()}
    assert ("invalid", "poses") in found(torn, named(torn, frames=moved))
    one = p.blocks.orderBy("idx").first()
    at = F.col("idx") == one.idx
    n = len(commit.BLOCK_TAG) + 12
    sums = struct.pack("<d", 0.25) + bytes(one.data)[n + 8 :]
    wrong = bytes(one.data)[:n] + sums
    other = p.blocks.withColumn("data", F.when(at, F.lit(wrong)).otherwise(F.col("data")))
    rows = proof.check_blocks(stated, replace(p, blocks=other)).collect()
    assert {(r.verdict, r.failed) for r in rows if (r.bx, r.by, r.bz) == (one.bx, one.by, one.bz)} == {("invalid", "map root")}
    assert sum(r.verdict == "verified" for r in rows) == len(rows) - 1
    shifted = p.blocks.withColumn("bx", F.when(at, F.col("bx") + 100).otherwise(F.col("bx")))
    assert ("invalid", "map root") in found(stated, replace(p, blocks=shifted))
    # a map that states wrong sums is refuted
    false = leaves.withColumn("data", F.when(F.col("idx") == one.idx, F.lit(wrong)).otherwise(F.col("data")))
    lying = stated | {"map_root": commit.root(false.select("idx", "data")).hex()}
    tree = commit.paths(commit.tree(false.select("idx", "data")), p.blocks.select("idx"))
    checked = proof.check_blocks(lying, named(lying, blocks=other, paths=tree))
    assert {(r.verdict, r.failed, r.differing > 0) for r in checked.collect()} == {("verified", None, False), ("refuted", "fusion", True)}
    assert proof.held_verdict(checked).first().verdict == "refuted"
    tile = p.tiles.orderBy("bz", "by", "bx", "seq", "tile").first()
    here = (F.col("seq") == tile.seq) & (F.col("tile") == tile.tile)
    changed = p.tiles.withColumn("data", F.when(here, F.lit(bytes(tile.data)[:-2] + b"\7\7")).otherwise(F.col("data")))
    assert ("invalid", "depth roots") in found(stated, replace(p, tiles=changed))
    assert ("invalid", "pixels") in found(stated, replace(p, tiles=p.tiles.where(~(here & (F.col("bx") == tile.bx) & (F.col("by") == tile.by) & (F.col("bz") == tile.bz)))))
    key = {(r.bx, r.by, r.bz, r.seq, r.tile) for r in p.tiles.collect()}
    spare = next(r for r in p.tiles.orderBy("seq", "tile").collect() if (tile.bx, tile.by, tile.bz, r.seq, r.tile) not in key)
    more = spark.createDataFrame([(tile.bx, tile.by, tile.bz, spare.seq, spare.tile, spare.data)], p.tiles.schema)
    assert ("invalid", "pixels") in found(stated, replace(p, tiles=p.tiles.unionByName(more)))


def test_statements_routes_and_audits(world, spark, tmp_path):
    scan, volume, leaves, stated, p = world
    again = proof.statement(p.frames, leaves, "s", CAMERA, COARSE, SIDE, 2)
    assert again == stated and proof.statement_differences(spark, stated, again).count() == 0
    assert [r.field for r in proof.statement_differences(spark, stated, stated | {"map_root": "00"}).collect()] == ["map_root"]
    proof.write_statement(stated, str(tmp_path / "s.json"))
    assert proof.load_statement(str(tmp_path / "s.json")) == stated
    (tmp_path / "t.json").write_bytes((tmp_path / "s.json").read_bytes().replace(b'"session":"s"', b'"session": "s"'))
    with pytest.raises(artifacts.ArtifactError):
        proof.load_statement(str(tmp_path / "t.json"))
    columns = freespace.swept(freespace.chain(freespace.waypoints(spark, [(0, 6), (2, 9)])), 1)
    touched = freespace.touched_blocks(columns, -1, 1)
    route = proof.prove(stated, scan, leaves, touched, CAMERA, COARSE)
    part = {"x": F.col("l") % 8, "y": F.floor(F.col("l") / 8) % 8, "z": F.floor(F.col("l") / 64)}
    flat = volume.select(*[(F.col(f"b{a}").cast("long") * 8 + part[a]).alias(f"g{a}") for a in "xyz"], "tsdf_sum", "weight")
    want = freespace.clearance(columns, flat, -1, 1, 1).first()
    got = proof.check_route(stated, route, columns, -1, 1, 1).first()
    assert (got.verdict, got.unobserved, got.occupied) == (want.verdict, want.unobserved, want.occupied)
    assert proof.check_route(stated, replace(route, shape=route.shape | {"height": 1}), columns, -1, 1, 1).first().verdict == "invalid"
    drawn = proof.audit_blocks(spark, stated, b"seed", 4, leaves)
    answer = proof.prove(stated, scan, leaves, drawn, CAMERA, COARSE)
    assert answer.blocks.count() == 4 and proof.check_audit(stated, answer, b"seed", 4).first().verdict == "verified"
    assert proof.check_audit(stated, answer, b"other", 4).first().verdict == "invalid"
    for packed in (False, True):
        path = tmp_path / f"p{packed}"
        proof.write_proof(answer, str(path), packed)
        assert found(stated, proof.load_proof(spark, str(path))) == {("verified", None)}
        data = path.read_bytes()
        for bad in (data[:-1], data + b"x", data[:-9] + bytes([data[-9] ^ 1]) + data[-8:]):
            (tmp_path / "bad").write_bytes(bad)
            with pytest.raises(ValueError):
                proof.load_proof(spark, str(tmp_path / "bad"))
