"""Commitments of a scan and its map, and proofs held against them.

A statement names a scan and a map by their roots.  A proof of some blocks holds, as tables: the leaf data of all frames; the
blocks' leaf data with their paths into the map's root; and the depth tiles that the blocks read, each with its path into its
frame's depth root.  With these alone the blocks are fused again.  The checks are made in a fixed order and the first that
fails is the verdict's reason: everything but a different fusion makes a proof invalid, a different fusion refutes the map.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.functions.batches import whole_runs
from scanengine.operators import commit, fuse, vector
from scanengine.sources import artifacts
from scanengine.sources.scratch import kept

BLOCK = ["bx", "by", "bz"]
RULE = "projective-signed-distance/mean/v1"
#: The checks, in the order in which they are made.
CHECKS = ("statement", "shape", "scan root", "map root", "depth roots", "poses", "pixels", "fusion")
EVIDENCE = "bx int, by int, bz int, seq long, tile int"


def tiles_across(cam: g.Camera, side: int) -> int:
    return -(-cam.width // side)


def tile_count(cam: g.Camera, side: int) -> int:
    return tiles_across(cam, side) * -(-cam.height // side)


def cut(image: np.ndarray, cam: g.Camera, side: int) -> list[bytes]:
    """The data of an image's tiles, row by row; tiles at the right and bottom edge are smaller."""
    if image.min() < 0 or image.max() > 65535:
        raise ValueError("a reading does not fit 16 bits")
    image = image.reshape(cam.height, cam.width).astype("<u2")
    return [commit.TILE_TAG + image[y : y + side, x : x + side].tobytes() for y in range(0, cam.height, side) for x in range(0, cam.width, side)]


def image_tiles(scan: DataFrame, cam: g.Camera, side: int = 16) -> DataFrame:
    """(seq, tile, data): every tile of every depth image, row by row, as its leaf's data; tiles at the right and bottom
    edge are smaller."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = cut(batch.column(1)[k].values.to_numpy(zero_copy_only=False), cam, side)
                n = len(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[k].as_py())), pa.array(np.arange(n, dtype=np.int32)), pa.array(data, pa.binary())], ["seq", "tile", "data"])

    return scan.where("has_depth").select("seq", "depth").mapInArrow(tiles, "seq long, tile int, data binary")


def levels_of(hashes: list[bytes]) -> list[list[bytes]]:
    """All levels of the tree over some leaf hashes."""
    out = [hashes]
    while len(out[-1]) > 1:
        h = out[-1]
        out.append([hashlib.sha256(b"\x01" + h[i] + h[i + 1]).digest() if i + 1 < len(h) else h[i] for i in range(0, len(h), 2)])
    return out


def depth_trees(tiles: DataFrame) -> DataFrame:
    """(seq, root, nodes): each image's depth root, and all hashes of its tree from the leaves up; tiles come sorted by image."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, ["seq"]):
            leaves: dict[int, list[bytes]] = {}
            for seq, x in zip(batch["seq"].to_pylist(), batch["data"].to_pylist()):
                leaves.setdefault(seq, []).append(hashlib.sha256(b"\x00" + x).digest())
            trees = [levels_of(x) for x in leaves.values()]
            nodes = [b"".join(h for level in x for h in level) for x in trees]
            yield pa.RecordBatch.from_arrays([pa.array(list(leaves), pa.int64()), pa.array([x[-1][0] for x in trees], pa.binary()), pa.array(nodes, pa.binary())], ["seq", "root", "nodes"])

    return tiles.select("seq", "tile", "data").repartition("seq").sortWithinPartitions("seq", "tile").mapInArrow(grow, "seq long, root binary, nodes binary")


def frame_leaves(scan: DataFrame, trees: DataFrame) -> DataFrame:
    """V4: (idx, seq, data): a leaf for every frame of the scan, whatever it lacks, in the order of seq."""
    f = scan.select("seq", "has_pose", *[f"m{k}" for k in range(12)]).join(trees.select("seq", "root"), "seq", "left")

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                pose = [float(getattr(r, f"m{k}")) for k in range(12)] + [0.0, 0.0, 0.0, 1.0] if r.has_pose else None
                out.append(commit.frame_leaf(int(r.seq), pose, None if r.root is None else bytes(r.root)))
            yield pd.DataFrame({"seq": pdf.seq, "data": out})

    from scanengine.operators.order import dense_numbers

    rows = f.mapInPandas(leaves, "seq long, data binary")
    return dense_numbers(rows, [F.col("seq")], F.floor(F.col("seq") / 65_536), "idx").select("idx", "seq", "data")


def read_frame(data: bytes) -> tuple[int, list[float] | None, bytes | None]:
    """(seq, pose, depth root) of a frame's leaf; a leaf that is not canonical is refused."""
    n = len(commit.FRAME_TAG)
    if len(data) != n + 9 + 128 + 32 or data[:n] != commit.FRAME_TAG:
        raise ValueError("not a frame's leaf")
    seq, flags = struct.unpack("<QB", data[n : n + 9])
    pose, root = list(struct.unpack("<16d", data[n + 9 : n + 137])), data[n + 137 :]
    if flags > 3 or not flags & 2 and any(pose) or not flags & 1 and any(root):
        raise ValueError("a frame's leaf holds what its flags deny")
    return seq, pose if flags & 2 else None, root if flags & 1 else None


def statement(scan_leaves: DataFrame, volume_leaves: DataFrame, session: str, cam: g.Camera, grid: g.Grid, side: int, stride: int = 1) -> dict:
    """V5: what is stated of a scan (idx, data of frames) and a map (idx, data of blocks)."""
    return {
        "blocks": volume_leaves.count(), "camera": {k: getattr(cam, k) for k in ("width", "height", "fx", "fy", "cx", "cy")}, "depth_scale": cam.scale, "frame_stride": stride,
        "frames": scan_leaves.count(), "map_root": commit.root(volume_leaves.select("idx", "data")).hex(), "rule": RULE, "scan_root": commit.root(scan_leaves.select("idx", "data")).hex(),
        "session": session, "tile_pixels": side, "truncation": grid.truncation, "voxel": grid.voxel,
    }


def digest_of(stated: dict) -> str:
    return hashlib.sha256(artifacts.canonical(stated)).hexdigest()


def statement_differences(spark: SparkSession, stated: dict, again: dict) -> DataFrame:
    """V6: (field, left, right) where two statements differ."""
    text = lambda x: x if isinstance(x, str) else artifacts.canonical(x).decode().strip()
    row = lambda d: spark.createDataFrame([tuple(text(d[k]) for k in sorted(d))], ", ".join(f"`{k}` string" for k in sorted(d)))
    return commit.differences(row(stated), row(again))


# --- evidence


def evidence_tiles(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid, side: int = 16, held: bool = False) -> DataFrame:
    """V9: (bx, by, bz, seq, tile): the tiles that each block reads a pixel of, whatever the pixel holds; held: and their data,
    cut where the image lies."""
    across = tiles_across(cam, side)

    def work(frames: Iterator) -> Iterator[pa.RecordBatch]:
        for frame, b, _, _ in frames:
            data = pa.array(cut(frame[1], cam, side), pa.binary()) if held else None
            for k in range(0, len(b), vector.CHUNK):
                some = b[k : k + vector.CHUNK]
                _, u, v, raw, _ = vector.voxels_of(some, frame, cam, grid)
                seen = np.flatnonzero(raw >= 0)
                tile = np.floor(v[seen] + 0.5).astype(np.int64) // side * across + np.floor(u[seen] + 0.5).astype(np.int64) // side
                read = np.zeros(len(some) * tile_count(cam, side), bool)
                read[(seen >> 9) * tile_count(cam, side) + tile] = True
                both = np.flatnonzero(read)
                at = some[both // tile_count(cam, side)].astype(np.int32)
                if len(both):
                    tile = pa.array((both % tile_count(cam, side)).astype(np.int32))
                    cols = [*[pa.array(at[:, i]) for i in range(3)], pa.array(np.full(len(both), frame[0])), tile]
                    yield pa.RecordBatch.from_arrays(cols + [data.take(tile)] if held else cols, [*BLOCK, "seq", "tile"] + ["data"] * held)

    return vector.over_frames(scan, blocks, cam, grid, work, EVIDENCE + ", data binary" * held)


def evidence_counts(evidence: DataFrame, cam: g.Camera, side: int = 16) -> DataFrame:
    """(bx, by, bz, frames, tiles, bytes, samples) that a block's evidence takes."""
    across = tiles_across(cam, side)
    wide = F.least(F.lit(side), F.lit(cam.width) - F.col("tile") % across * side)
    high = F.least(F.lit(side), F.lit(cam.height) - F.floor(F.col("tile") / across) * side)
    n = evidence.withColumn("samples", (wide * high).cast("long"))
    return n.groupBy(*BLOCK).agg(F.countDistinct("seq").alias("frames"), F.count("*").alias("tiles"), (2 * F.sum("samples")).alias("bytes"), F.sum("samples").alias("samples"))


POSES = "seq long, has_pose boolean, has_depth boolean, " + ", ".join(f"m{k} double" for k in range(12))


def poses_of(frames: DataFrame) -> DataFrame:
    """(seq, has_pose, has_depth, m0..m11) as frame leaves (data) state them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_frame(x.as_py()) for x in batch.column(0)]
            at = [[None if pose is None else float(pose[k]) for _, pose, _ in rows] for k in range(12)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] is not None for r in rows]), pa.array([r[2] is not None for r in rows]), *[pa.array(c, pa.float64()) for c in at]],
                ["seq", "has_pose", "has_depth", *[f"m{k}" for k in range(12)]],
            )

    return frames.select("data").mapInArrow(read, POSES)


def reads(poses: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """(bx, by, bz, seq, pose): the frames that each block is evaluated in, from their poses and the cull alone; pose: m0 to
    m11 as bytes."""

    def work(frames: Iterator) -> Iterator[pa.RecordBatch]:
        for (seq, _, m), b, _, _ in frames:
            pose = m.astype("<f8").tobytes()
            for k in range(0, len(b), 65_536):
                some = b[k : k + 65_536].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[pa.array(some[:, i]) for i in range(3)], pa.array(np.full(len(some), seq)), pa.array([pose] * len(some), pa.binary())], [*BLOCK, "seq", "pose"])

    return vector.over_frames(poses.withColumn("depth", F.array().cast("array<int>")), blocks, cam, grid, work, "bx int, by int, bz int, seq long, pose binary")


def fused_from_evidence(frames: DataFrame, blocks: DataFrame, tiles: DataFrame, cam: g.Camera, grid: g.Grid, side: int = 16, stride: int = 1) -> DataFrame:
    """(bx, by, bz, sums, weights, problem): each block as its evidence alone determines it.

    frames: (seq, data) frame leaves; tiles: (bx, by, bz, seq, tile, data).  Which frames a block reads follows from their
    poses.  A pixel that a block reads and no tile holds, and a tile that it reads nothing of, is a problem.  The poses and
    tiles of a block come sorted by frame and are added as they come: a task holds a batch of them and one block's sums,
    however many frames there are.
    """
    across, many = tiles_across(cam, side), tile_count(cam, side)
    # a block that no frame reads still has a row; what is of no such block is not looked at
    asked, pose, tile = 0, 1, 2
    null = lambda kind: F.lit(None).cast(kind)
    row = lambda df, kind, *rest: df.select(*BLOCK, F.lit(kind).alias("kind"), *[F.expr(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in zip(("seq", "tile", "data"), rest)])
    pairs = reads(poses_of(frames.where(F.col("seq") % stride == 0)), blocks, cam, grid)
    rows = row(blocks.select(*BLOCK).distinct(), asked, null("long"), null("int"), null("binary"))
    rows = rows.unionByName(row(pairs, pose, "seq", null("int"), "pose")).unionByName(row(tiles.dropna(subset=BLOCK), tile, "seq", "tile", "data"))
    # width and height of each tile
    wide = np.minimum(side, cam.width - np.arange(many) % across * side)
    size = wide * np.minimum(side, cam.height - np.arange(many) // across * side)
    head = len(commit.TILE_TAG)

    def added(batch: pa.RecordBatch, number: np.ndarray, sums: np.ndarray, weights: np.ndarray) -> list[tuple[int, str]]:
        """Adds a batch of whole frames of blocks (number: each row's block) and tells what is wrong: (row, problem)."""
        b = np.column_stack([batch[c].to_numpy() for c in BLOCK])
        kind, seqs = batch["kind"].to_numpy(), batch["seq"]
        seq, none = seqs.fill_null(0).to_numpy(), seqs.is_null().to_numpy(zero_copy_only=False)
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]).any(1) | (seq[1:] != seq[:-1]) | (none[1:] != none[:-1])
        # the row that a tile's frame and block begin with: their pose, if the block reads the frame
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        number_of = batch["tile"].fill_null(-1).to_numpy()
        held = batch["data"]
        ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
        data = np.frombuffer(held.buffers()[2] or b"", np.uint8)
        of_tile = kind == tile
        known = of_tile & (number_of >= 0) & (number_of < many)
        fits = known & (np.diff(ends) == head + 2 * size[np.where(known, number_of, 0)])
        unread = of_tile & (kind[start] != pose)
        wrong = [(k, 0, "is not read, but a tile of it is held") for k in start[unread]]
        wrong += [(k, 0, "a tile has another size") for k in start[of_tile & ~unread & ~fits]]
        read = np.flatnonzero(kind == pose)
        for k in range(0, len(read), vector.CHUNK):
            some = read[k : k + vector.CHUNK]
            m = data[ends[some][:, None] + np.arange(96)].view("<f8")
            zc, u, v, seen = vector.projected(b[some].astype(np.float64), m, cam, grid)
            x, y, which = np.floor(u[seen] + 0.5).astype(np.int64), np.floor(v[seen] + 0.5).astype(np.int64), seen >> 9
            t = y // side * across + x // side
            # tiles of these frames lie between them and those after them
            mine = np.arange(some[0], read[k + len(some)] if k + len(some) < len(read) else len(b))
            mine = mine[(of_tile & ~unread & known)[mine]]
            place = np.searchsorted(some, start[mine])
            used = np.zeros((len(some), many), bool)
            used[which, t] = True
            wrong += [(some[j], 2, "a tile is held of which the block reads no pixel") for j in place[~used[place, number_of[mine]]]]
            at = np.full((len(some), many), -1, np.int64)
            mine, place = mine[fits[mine]], place[fits[mine]]
            at[place, number_of[mine]] = ends[mine] + head
            at = at[which, t]
            wrong += [(some[j], 1, "a pixel that the block reads is not held") for j in np.unique(which[at < 0])]
            at, seen = (at + 2 * (y % side * wide[t] + x % side))[at >= 0], seen[at >= 0]
            raw = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8
            seen, raw = seen[raw > 0], raw[raw > 0]
            sd = raw * cam.scale - zc[seen]
            hit = sd >= -grid.truncation
            where = number[some[seen[hit] >> 9]] * 512 + (seen[hit] & 511)
            np.add.at(sums, where, np.minimum(1.0, np.maximum(-1.0, sd[hit] / grid.truncation)))  # one after another, in order
            np.add.at(weights, where, 1)
        return [(k, f"frame {seqs[int(k)].as_py()}: {x}") for k, _, x in sorted(wrong)]

    def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # of the block that a batch ends with: place, sums, weights, problem, whether it is asked for

        def out(b: np.ndarray, sums: np.ndarray, weights: np.ndarray, problems: list, known: np.ndarray) -> pa.RecordBatch:
            k = np.flatnonzero(known)
            packed = lambda x, kind: pa.array([x[512 * j : 512 * j + 512].astype(kind).tobytes() for j in k], pa.binary())
            return pa.RecordBatch.from_arrays(
                [*[pa.array(b[k, i], pa.int32()) for i in range(3)], packed(sums, "<f8"), packed(weights, "<u4"), pa.array([problems[j] for j in k], pa.string())], [*BLOCK, "sums", "weights", "problem"]
            )

        for batch in whole_runs(batches, [*BLOCK, "seq"]):
            b = np.column_stack([batch[c].to_numpy() for c in BLOCK])
            new = np.ones(len(b), bool)
            new[1:] = (b[1:] != b[:-1]).any(1)
            first, number = b[new], np.cumsum(new) - 1
            n = len(first)
            sums, weights, problems, known = np.zeros(n * 512), np.zeros(n * 512, np.int64), [None] * n, np.zeros(n, bool)
            if state is not None:
                if (state[0][0] == first[0]).all():
                    sums[:512], weights[:512], problems[0], known[0] = state[1], state[2], state[3][0], state[4][0]
                else:
                    yield out(*state)
            known[number[batch["kind"].to_numpy() == asked]] = True
            for k, problem in added(batch, number, sums, weights):
                problems[number[k]] = problems[number[k]] or problem
            keep = n - 1
            if keep:
                yield out(first[:keep], sums, weights, problems, known[:keep])
            state = first[keep:], sums[512 * keep :].copy(), weights[512 * keep :].copy(), problems[keep:], known[keep:]
        if state is not None:
            yield out(*state)

    ordered = rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "seq", "kind")
    return ordered.mapInArrow(fused, "bx int, by int, bz int, sums binary, weights binary, problem string")


# --- proofs


@dataclass
class Proof:
    """frames (idx, seq, data); blocks (idx, bx, by, bz, data); paths (idx, level, hash); tiles (bx, by, bz, seq, tile, data);
    tile_paths (seq, tile, path: hashes from the bottom)."""

    shape: dict
    frames: DataFrame
    blocks: DataFrame
    paths: DataFrame
    tiles: DataFrame
    tile_paths: DataFrame


def shape_of(stated: dict) -> dict:
    return {"blocks": stated["blocks"], "frames": stated["frames"], "height": stated["camera"]["height"], "statement": digest_of(stated), "tile_pixels": stated["tile_pixels"], "width": stated["camera"]["width"]}


def prove(stated: dict, scan: DataFrame, volume_leaves: DataFrame, wanted: DataFrame, cam: g.Camera, grid: g.Grid) -> Proof:
    """The proof of the wanted blocks (bx, by, bz) of a map (idx, bx, by, bz, data)."""
    side, stride = stated["tile_pixels"], stated["frame_stride"]
    trees = kept(depth_trees(image_tiles(scan, cam, side)), "depth-trees")
    leaves = kept(frame_leaves(scan, trees), "frame-leaves")
    blocks = volume_leaves.join(wanted.select(*BLOCK).distinct(), BLOCK, "left_semi")
    paths = commit.paths(commit.tree(volume_leaves.select("idx", "data")), blocks.select("idx"))
    read = kept(evidence_tiles(scan.where(F.col("seq") % stride == 0), blocks, cam, grid, side, True), "evidence")
    n = tile_count(cam, side)

    def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tile, nodes in zip(pdf.tile, pdf.nodes):
                at, width, i, path = 0, n, int(tile), []
                while width > 1:
                    if i ^ 1 < width:
                        path.append(bytes(nodes[32 * (at + (i ^ 1)) : 32 * (at + (i ^ 1)) + 32]))
                    at, width, i = at + width, (width + 1) // 2, i // 2
                out.append(path)
            yield pd.DataFrame({"seq": pdf.seq, "tile": pdf.tile, "path": out})

    tile_paths = read.select("seq", "tile").distinct().join(trees.select("seq", "nodes"), "seq").mapInPandas(climb, "seq long, tile int, path array<binary>")
    return Proof(shape_of(stated), leaves, blocks.select("idx", *BLOCK, "data"), paths, read, tile_paths)


def _wrong_tiles(p: Proof, stated: dict) -> DataFrame:
    """(bx, by, bz) of blocks with a tile that does not lead to its frame's depth root."""
    n = -(-stated["camera"]["width"] // stated["tile_pixels"]) * -(-stated["camera"]["height"] // stated["tile_pixels"])
    # what many blocks hold alike is judged once
    own = ["seq", "tile", "data"]
    each = p.tiles.select(*own).distinct().join(p.tile_paths, ["seq", "tile"], "left").join(p.frames.select("seq", F.col("data").alias("frame")), "seq", "left")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = []
            for tile, data, path, frame in zip(pdf.tile, pdf.data, pdf.path, pdf.frame):
                try:
                    root = read_frame(bytes(frame))[2] if frame is not None else None
                    good.append(root is not None and path is not None and commit.root_from_path(hashlib.sha256(b"\x00" + bytes(data)).digest(), int(tile), n, [bytes(x) for x in path]) == root)
                except ValueError:
                    good.append(False)
            yield pdf[own][~np.array(good, bool)]

    bad = kept(each.mapInPandas(judge, "seq long, tile int, data binary"), "wrong-tiles")
    return p.tiles.join(bad, own, "left_semi").select(*BLOCK).distinct()


def check_blocks(stated: dict, p: Proof) -> DataFrame:
    """(bx, by, bz, verdict, failed, differing) of each block of a proof: verified, refuted or invalid, with the
    first check that fails.  Only the statement and the proof are read."""
    spark = p.blocks.sparkSession
    cam = g.Camera(**stated["camera"], scale=stated["depth_scale"])
    grid = g.Grid(stated["voxel"], stated["truncation"])
    want = shape_of(stated)
    failed = None
    if stated["rule"] != RULE or p.shape["statement"] != want["statement"]:
        failed = "statement"
    elif any(p.shape[k] != want[k] for k in want) or p.frames.count() != stated["frames"]:
        failed = "shape"
    elif commit.root(p.frames.select("idx", "data")).hex() != stated["scan_root"]:
        failed = "scan root"
    if failed:
        return p.blocks.select(*BLOCK, F.lit("invalid").alias("verdict"), F.lit(failed).alias("failed"), F.lit(0).alias("differing"))
    at_root = commit.check_path_proofs(p.blocks.select("idx", "data"), p.paths, stated["blocks"], bytes.fromhex(stated["map_root"]))
    # a leaf's data begins with the place that it is about
    n = len(commit.BLOCK_TAG)
    own = F.substring("data", 1, n + 12) == F.concat(F.lit(commit.BLOCK_TAG), *[F.unhex(F.concat(*[F.substring(F.lpad(F.hex(F.col(c).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"), k, 2) for k in (7, 5, 3, 1)])) for c in BLOCK])
    mapped = p.blocks.withColumn("own", own).join(at_root, "idx").select(*BLOCK, F.col("data").alias("block"), (F.col("own") & (F.col("verdict") == "verified")).alias("mapped"))
    frames = p.frames.where(F.col("seq") % stated["frame_stride"] == 0)
    posed = poses_of(frames).where("has_pose").where(~g.is_rigid(g.pose())).isEmpty()
    again = fused_from_evidence(frames, p.blocks, p.tiles, cam, grid, stated["tile_pixels"])
    bad = _wrong_tiles(p, stated).withColumn("torn", F.lit(True))
    d = mapped.join(bad, BLOCK, "left").join(again, BLOCK)

    def differing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for block, sums, weights in zip(pdf.block, pdf.sums, pdf.weights):
                held = bytes(block)[n + 12 :]
                s = np.frombuffer(held[:4096], "<u8") != np.frombuffer(sums, "<u8") if len(held) == 6144 else np.ones(512, bool)
                w = np.frombuffer(held[4096:], "<u4") != np.frombuffer(weights, "<u4") if len(held) == 6144 else np.ones(512, bool)
                out.append(int((s | w).sum()))
            yield pdf[[*BLOCK, "mapped", "torn", "problem"]].assign(differing=out)

    d = d.mapInPandas(differing, "bx int, by int, bz int, mapped boolean, torn boolean, problem string, differing int")
    reason = F.when(~F.col("mapped"), "map root").when(F.col("torn"), "depth roots").when(F.lit(not posed), "poses").when(F.col("problem").isNotNull(), "pixels").when(F.col("differing") > 0, "fusion")
    verdict = F.when(reason.isNull(), "verified").when(reason == "fusion", "refuted").otherwise("invalid")
    return d.select(*BLOCK, verdict.alias("verdict"), reason.alias("failed"), F.when(reason == "fusion", F.col("differing")).otherwise(0).alias("differing"))


def held_verdict(checked: DataFrame) -> DataFrame:
    """One row: the verdict of all blocks together, the first check in order that fails anywhere, and the first block, in
    canonical order, at which it does."""
    place = F.array_position(F.array(*map(F.lit, CHECKS)), F.col("failed"))
    worst = checked.agg(F.min(F.when(F.col("failed").isNotNull(), F.struct(place.alias("k"), "bz", "by", "bx", "verdict", "failed"))).alias("w"), F.count("*").alias("blocks"))
    return worst.select(F.coalesce("w.verdict", F.lit("verified")).alias("verdict"), F.col("w.failed").alias("failed"), "blocks", *[F.col(f"w.{c}").alias(c) for c in BLOCK])


def check_route(stated: dict, p: Proof, columns: DataFrame, first: int, last: int, min_weight: int = 3) -> DataFrame:
    """One row: clear or not-clear by the proof's blocks, or invalid or refuted as they are; blocks that a route touches
    and the proof does not hold count as unobserved (J20)."""
    from scanengine.operators import freespace

    held = held_verdict(check_blocks(stated, p))
    touched = freespace.touched_blocks(columns, first, last)
    volume = unpacked_blocks(p.blocks.join(touched, BLOCK, "left_semi"))
    part = {"x": F.col("l") % 8, "y": F.floor(F.col("l") / 8) % 8, "z": F.floor(F.col("l") / 64)}
    flat = volume.select(*[(F.col(f"b{a}").cast("long") * 8 + part[a]).alias(f"g{a}") for a in "xyz"], "tsdf_sum", "weight")
    return commit.route_verdict(held, freespace.clearance(columns, flat, first, last, min_weight))


def unpacked_blocks(blocks: DataFrame) -> DataFrame:
    """(bx, by, bz, l, tsdf_sum, weight) of blocks' leaf data."""
    n = len(commit.BLOCK_TAG) + 12

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, y, z, data in zip(pdf.bx, pdf.by, pdf.bz, pdf.data):
                s, w = np.frombuffer(bytes(data)[n : n + 4096], "<f8"), np.frombuffer(bytes(data)[n + 4096 :], "<u4")
                k = np.flatnonzero(w)
                yield pd.DataFrame({"bx": x, "by": y, "bz": z, "l": k.astype(np.int32), "tsdf_sum": s[k], "weight": w[k].astype(np.int64)})

    return blocks.select(*BLOCK, "data").mapInPandas(rows, "bx int, by int, bz int, l int, tsdf_sum double, weight long")


def audit_blocks(spark: SparkSession, stated: dict, seed: bytes, count: int, volume_leaves: DataFrame) -> DataFrame:
    """(bx, by, bz) of the blocks that an audit of a statement draws."""
    drawn = commit.audit_rows(spark, bytes.fromhex(digest_of(stated)), seed, stated["blocks"], count)
    return volume_leaves.join(drawn.select(F.col("row").alias("idx")), "idx", "left_semi").select(*BLOCK)


def check_audit(stated: dict, p: Proof, seed: bytes, count: int) -> DataFrame:
    """One row: a proof that holds other blocks than those drawn is invalid; else what its blocks say."""
    drawn = commit.audit_rows(p.blocks.sparkSession, bytes.fromhex(digest_of(stated)), seed, stated["blocks"], count)
    return commit.audit_verdict(drawn, p.blocks.select(F.col("idx").alias("row")), held_verdict(check_blocks(stated, p)))


# --- files

_TABLES = ("frames", "blocks", "paths", "tiles", "tile_paths")


def write_statement(stated: dict, path: str) -> str:
    return artifacts.publish(path, [artifacts.canonical(stated)])


def load_statement(path: str) -> dict:
    """A statement; fields that are missing or unknown, and text that is not canonical, are refused."""
    data = artifacts.content(path)
    stated = artifacts.strict_json(data)
    fields = {"blocks", "camera", "depth_scale", "frame_stride", "frames", "map_root", "rule", "scan_root", "session", "tile_pixels", "truncation", "voxel"}
    if not isinstance(stated, dict) or set(stated) != fields or artifacts.canonical(stated) != data:
        raise artifacts.ArtifactError("not a canonical statement")
    return stated


def write_proof(p: Proof, path: str, packed: bool = False) -> str:
    """A proof as one file: magic, header with the length and digest of each table, then the tables, sorted, as Arrow
    streams.  A proof is of a bounded number of blocks; packed, the whole is compressed."""
    parts = []
    for name in _TABLES:
        table = getattr(p, name)
        table = table.orderBy(*[c for c in table.columns if c not in ("data", "path", "hash")]).toArrow()
        out = io.BytesIO()
        with pa.ipc.new_stream(out, table.schema) as w:
            w.write_table(table)
        parts.append(out.getvalue())
    header = p.shape | {"tables": [{"bytes": len(x), "name": n, "sha256": hashlib.sha256(x).hexdigest()} for n, x in zip(_TABLES, parts)]}
    data = artifacts.contained(artifacts.PROOF_MAGIC, header) + b"".join(parts)
    return artifacts.publish(path, [b"SFTPACK1" + commit.pack(data)] if packed else [data])


def load_proof(spark: SparkSession, path: str, most: int = 1 << 30) -> Proof:
    """A proof from its file; other lengths, digests and bytes after the end are refused."""
    data = artifacts.content(path)
    if data[:8] == b"SFTPACK1":
        data = commit.unpack(data[8:], most)
    header, at = artifacts.opened(data, artifacts.PROOF_MAGIC)
    tables = header.pop("tables")
    if [t["name"] for t in tables] != list(_TABLES) or len(data) != at + sum(t["bytes"] for t in tables):
        raise artifacts.ArtifactError("the proof's length does not fit its header")
    out = {}
    for t in tables:
        part = data[at : at + t["bytes"]]
        if hashlib.sha256(part).hexdigest() != t["sha256"]:
            raise artifacts.ArtifactError(f"{t['name']} does not fit its digest")
        out[t["name"]] = spark.createDataFrame(pa.ipc.open_stream(part).read_all())
        at += t["bytes"]
    return Proof(header, **out)
