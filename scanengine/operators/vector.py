"""Voxel evaluation a frame at a time in NumPy, for results that need no row for each voxel and frame.

The arithmetic is that of scanengine.operators.fuse.evaluated(), term by term, so both give the same bits.  Along a block's
side a coordinate takes eight values, so its products with the pose are made once an axis and only added up for each voxel.

The blocks go to every task: a slice of at most MOST_SENT of them, some 16 bytes each with the cubes above them, at a time.  A frame's image goes to one
task and stays there; what leaves it is a row for each block that it reaches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import views

BLOCK = ["bx", "by", "bz"]
#: Blocks sent to all tasks at once (some 64 MB); more are evaluated in slices of about this many.
MOST_SENT = 4_000_000
#: Blocks evaluated at once: their voxels' arrays stay within a core's cache.
CHUNK = 64

Frame = tuple[int, np.ndarray, np.ndarray]


def frames_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Frame]:
    """(seq, depth image, pose) of each row of (seq, depth, m0..m11)."""
    for batch in batches:
        seq = batch.column(0).to_numpy(zero_copy_only=False)
        images = batch.column(1)
        pose = np.column_stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(12)])
        for k in range(batch.num_rows):
            yield int(seq[k]), images[k].values.to_numpy(zero_copy_only=False), pose[k]


def projected(b: np.ndarray, m: np.ndarray, cam: g.Camera, grid: g.Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(zc, u, v, seen) of every voxel of some blocks, in the order of l; seen: the places of those inside the image.  m: the
    pose, of all blocks or a row for each."""
    if m.ndim == 2:
        m = m.T[:, :, None]  # a column for each number, which blocks' places are multiplied with
    centres = (b[:, :, None] * g.SIDE + np.arange(8) + 0.5) * grid.voxel  # block, axis, place
    dx, dy, dz = centres[:, 0] - m[3], centres[:, 1] - m[7], centres[:, 2] - m[11]
    many = len(b) * 512
    xc, yc, zc = (((m[i] * dx)[:, None, None, :] + (m[i + 4] * dy)[:, None, :, None] + (m[i + 8] * dz)[:, :, None, None]).reshape(many) for i in range(3))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        ahead = zc > 0
        u = np.where(ahead, cam.fx * xc / zc + cam.cx, np.nan)
        v = np.where(ahead, cam.fy * yc / zc + cam.cy, np.nan)
        seen = np.flatnonzero((u >= -0.5) & (u < cam.width - 0.5) & (v >= -0.5) & (v < cam.height - 0.5))
    return zc, u, v, seen


def voxels_of(b: np.ndarray, frame: Frame, cam: g.Camera, grid: g.Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(zc, u, v, raw, sd) of every voxel of some blocks, in the order of l; raw -1 outside the image, sd NaN without depth."""
    _, depth, m = frame
    zc, u, v, seen = projected(b, m, cam, grid)
    raw = np.full(len(zc), -1, np.int64)
    pixel = np.floor(v[seen] + 0.5).astype(np.int64) * cam.width + np.floor(u[seen] + 0.5).astype(np.int64)
    raw[seen] = depth[pixel]
    sd = np.full(len(zc), np.nan)
    read = seen[raw[seen] > 0]
    sd[read] = raw[read] * cam.scale - zc[read]
    return zc, u, v, raw, sd


def dealt_frames(scan: DataFrame) -> DataFrame:
    """(seq, depth, m0..m11) of frames that have depth and a pose, dealt out by number: a frame is a few kilobytes and millions
    of evaluations, so partitions sized by bytes would leave most cores idle."""
    spark = scan.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = scan.where("has_depth and has_pose").select("seq", "depth", *[f"m{i}" for i in range(12)])
    # by a hash of the number: by the number itself, a scan that a join has left so is taken as dealt out, in its few partitions
    return whole if scan.isStreaming else whole.repartition(parts, F.xxhash64("seq"))


def over_frames(
    scan: DataFrame,
    blocks: DataFrame,
    cam: g.Camera,
    grid: g.Grid,
    work: Callable[[Iterator[tuple[Frame, np.ndarray, np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]],
    schema: str,
    hide: bool = False,
    named: bool = False,
) -> DataFrame:
    """work over each task's frames that have depth and a pose: (frame, the blocks to evaluate, verdicts of all blocks, all
    blocks).  hide: blocks behind all that their frame measured are not evaluated; named: and each is
    told from those outside of the image."""
    spark = scan.sparkSession
    whole = dealt_frames(scan)
    plan = blocks.select(*[F.col(c).cast("int").alias(c) for c in BLOCK])
    # one slice's rows and one more, so that a plan within the bound is made once
    first = plan.limit(MOST_SENT + 1).toArrow()
    slices = 1 if first.num_rows <= MOST_SENT else -(-plan.count() // MOST_SENT)
    out = None
    for k in range(slices):
        rows = first if slices == 1 else plan.where(F.pmod(F.xxhash64(*BLOCK), F.lit(slices)) == k).toArrow()
        sent = spark.sparkContext.broadcast(views.Cubes(np.column_stack([rows[c].to_numpy() for c in BLOCK]).astype(np.int32)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            cubes = sent.value

            def each() -> Iterator[tuple[Frame, np.ndarray, np.ndarray, np.ndarray]]:
                for frame in frames_in(batches):
                    verdicts = cubes.verdicts(frame[2], cam, grid, views.Depths(frame[1], cam) if hide else None, named)
                    yield frame, cubes.blocks[verdicts == views.SEEN].astype(np.float64), verdicts, cubes.blocks

            return work(each())

        found = whole.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def packed_contributions(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """(seq, bx, by, bz, l, delta): of each frame and block that it adds to, its voxels and what they get, packed."""

    def work(frames: Iterator) -> Iterator[pa.RecordBatch]:
        for frame, b, _, _ in frames:
            for k in range(0, len(b), CHUNK):
                some = b[k : k + CHUNK]
                sd = voxels_of(some, frame, cam, grid)[4]
                hit = np.flatnonzero(sd >= -grid.truncation)
                if not len(hit):
                    continue
                delta = np.minimum(1.0, np.maximum(-1.0, sd[hit] / grid.truncation))
                which = hit >> 9
                ends = np.searchsorted(which, np.arange(len(some) + 1))
                held = np.flatnonzero(np.diff(ends))
                l, at = (hit & 511).astype("<i2"), some[held].astype(np.int32)
                binary = lambda x: pa.array([x[ends[j] : ends[j + 1]].tobytes() for j in held], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(held), frame[0])), *[pa.array(at[:, i]) for i in range(3)], binary(l), binary(delta.astype("<f8"))], ["seq", *BLOCK, "l", "delta"]
                )

    return over_frames(scan, blocks, cam, grid, work, "seq long, bx int, by int, bz int, l binary, delta binary")


def folded(packed: DataFrame) -> DataFrame:
    """(bx, by, bz, l, tsdf_sum, weight) of packed contributions: each voxel's are added in the order of frames.

    Rows of a block meet sorted by frame and are added as they come, so a task holds one batch and a block's sums.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, weight = None, np.zeros(512), np.zeros(512, np.int64)

        def rows(b: np.ndarray, sums: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
            k = np.flatnonzero(weights.ravel())
            which = k >> 9
            cols = [pa.array(b[which, i]) for i in range(3)]
            return pa.RecordBatch.from_arrays([*cols, pa.array((k & 511).astype(np.int32)), pa.array(sums.ravel()[k]), pa.array(weights.ravel()[k])], [*BLOCK, "l", "tsdf_sum", "weight"])

        for batch in (whole.slice(at, 4096) for whole in batches for at in range(0, whole.num_rows, 4096)):
            b = np.column_stack([batch.column(1 + i).to_numpy() for i in range(3)])
            new = np.ones(len(b), bool)
            new[1:] = (b[1:] != b[:-1]).any(1)
            first = np.flatnonzero(new)
            number = np.cumsum(new) - 1
            voxels = [np.frombuffer(x.as_py(), "<i2") for x in batch.column(4)]
            delta = np.concatenate([np.frombuffer(x.as_py(), "<f8") for x in batch.column(5)])
            at = np.repeat(number, [len(x) for x in voxels]) * 512 + np.concatenate(voxels)
            sums, weights = np.zeros(len(first) * 512), np.zeros(len(first) * 512, np.int64)
            if held is not None:
                if (b[0] == held).all():
                    sums[:512], weights[:512] = total, weight
                else:
                    yield rows(held[None], total, weight)
            np.add.at(sums, at, delta)  # one after another, in order
            np.add.at(weights, at, 1)
            keep = len(first) - 1
            if keep:
                yield rows(b[first[:keep]], sums[: keep * 512], weights[: keep * 512])
            held, total, weight = b[first[keep]], sums[keep * 512 :].copy(), weights[keep * 512 :].copy()
        if held is not None:
            yield rows(held[None], total, weight)

    ordered = packed.select("seq", *BLOCK, "l", "delta").repartition(*BLOCK).sortWithinPartitions(*BLOCK, "seq")
    return ordered.mapInArrow(add, "bx int, by int, bz int, l int, tsdf_sum double, weight long")


def status_counts(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """(seq, code, n): how often each outcome, by its place in fuse.STATUSES, came in each frame."""

    def work(frames: Iterator) -> Iterator[pa.RecordBatch]:
        for frame, b, verdicts, _ in frames:
            n = np.zeros(11, np.int64)
            n[4], n[6] = 512 * (verdicts == 1).sum(), 512 * (verdicts == 2).sum()
            for k in range(0, len(b), CHUNK):
                zc, u, v, raw, sd = voxels_of(b[k : k + CHUNK], frame, cam, grid)
                code = np.where(sd < -grid.truncation, 9, 10)
                code[raw <= 0] = 7
                code[raw < 0] = 6
                code[np.isnan(u) | np.isnan(v)] = 5
                code[~(zc > 0)] = 4
                code[np.isnan(zc) | (np.abs(zc) > 1e300)] = 3
                code[(raw > 0) & np.isnan(sd)] = 8
                n += np.bincount(code, minlength=11)
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), frame[0])), pa.array(k.astype(np.int32)), pa.array(n[k])], ["seq", "code", "n"])

    return over_frames(scan, blocks, cam, grid, work, "seq long, code int, n long")


def best_kinds(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid, flush: int = 16_384) -> DataFrame:
    """(bx, by, bz, kinds): of each seen block and task, its voxels' best sample: 3 surface, 2 free, 1 occluded, 0 none.

    A task keeps at most `flush` blocks (8 MB) and passes them on when more come.
    """

    def work(frames: Iterator) -> Iterator[pa.RecordBatch]:
        best, held, slot = np.zeros((flush, 512), np.uint8), np.zeros((flush, 3), np.int32), None
        n = 0

        def rows() -> pa.RecordBatch:
            cols = [pa.array(held[:n, i].copy()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([x.tobytes() for x in best[:n]], pa.binary())], [*BLOCK, "kinds"])

        for frame, b, verdicts, _ in frames:
            slot = np.full(len(verdicts), -1, np.int32) if slot is None else slot
            number = np.flatnonzero(verdicts == 0)
            for k in range(0, len(b), CHUNK):
                sd = voxels_of(b[k : k + CHUNK], frame, cam, grid)[4]
                with np.errstate(invalid="ignore"):
                    kind = np.where(sd < -grid.truncation, 1, np.where(sd <= grid.truncation, 3, np.where(sd > grid.truncation, 2, 0))).astype(np.uint8).reshape(-1, 512)
                seen = np.flatnonzero(kind.any(1))
                at = number[k + seen]
                new = at[slot[at] < 0]
                if n + len(new) > flush:
                    yield rows()
                    best[:n], slot[:], n = 0, -1, 0
                    new = at
                slot[new] = np.arange(n, n + len(new))
                held[n : n + len(new)] = b[np.searchsorted(number, new)]
                n += len(new)
                best[slot[at]] = np.maximum(best[slot[at]], kind[seen])
        if n:
            yield rows()

    return over_frames(scan, blocks, cam, grid, work, "bx int, by int, bz int, kinds binary")


def best_of_voxels(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """(bx, by, bz, l, kind): the best sample of every voxel of the blocks, 0 where no frame saw it."""
    kinds = best_kinds(scan, blocks, cam, grid).groupBy(*BLOCK).agg(F.collect_list("kinds").alias("kinds"))
    every = blocks.select(*BLOCK).join(kinds, BLOCK, "left")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        l = np.tile(np.arange(512, dtype=np.int32), 256)
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            best = np.zeros((batch.num_rows, 512), np.int32)
            for k, found in enumerate(batch.column(3).to_pylist()):
                for x in found or ():
                    best[k] = np.maximum(best[k], np.frombuffer(x, np.uint8))
            cols = [pa.array(np.repeat(batch.column(i).to_numpy(), 512).astype(np.int32)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(l[: best.size]), pa.array(best.ravel())], [*BLOCK, "l", "kind"])

    return every.mapInArrow(spread, "bx int, by int, bz int, l int, kind int")


def block_verdicts(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid, hide: bool = False, only: tuple[int, ...] | None = None) -> DataFrame:
    """(seq, bx, by, bz, code) of every integrated frame and block, by the codes of views; only: some codes alone."""

    def work(frames: Iterator) -> Iterator[pa.RecordBatch]:
        for frame, _, verdicts, b in frames:
            at = np.arange(len(b)) if only is None else np.flatnonzero(np.isin(verdicts, only))
            for k in range(0, len(at), 65_536):
                some = at[k : k + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), frame[0])), *[pa.array(b[some, i]) for i in range(3)], pa.array(verdicts[some].astype(np.int32))], ["seq", *BLOCK, "code"])

    return over_frames(scan, blocks, cam, grid, work, "seq long, bx int, by int, bz int, code int", hide, True)


def contributing(scan: DataFrame, blocks: DataFrame, cam: g.Camera, grid: g.Grid, hide: bool = True) -> DataFrame:
    """(bx, by, bz) of blocks in which some voxel contributes, once a task.  A block that a task has settled is not
    evaluated again, nor one that its frame hides (F2): no voxel of it could contribute."""

    def work(frames: Iterator) -> Iterator[pa.RecordBatch]:
        settled = None
        for frame, b, verdicts, _ in frames:
            settled = np.zeros(len(verdicts), bool) if settled is None else settled
            number = np.flatnonzero(verdicts == 0)
            left = ~settled[number]
            b, number = b[left], number[left]
            for k in range(0, len(b), CHUNK):
                some = b[k : k + CHUNK]
                hit = (voxels_of(some, frame, cam, grid)[4] >= -grid.truncation).reshape(-1, 512).any(1)
                settled[number[k : k + CHUNK][hit]] = True
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(some[hit, i].astype(np.int32)) for i in range(3)], BLOCK)

    return over_frames(scan, blocks, cam, grid, work, "bx int, by int, bz int", hide)


def contributing_in_box(scan: DataFrame, box: views.Box, cam: g.Camera, grid: g.Grid, hide: bool = True, settled_most: int = 1_000_000) -> DataFrame:
    """(bx, by, bz), once a task, of the blocks of a box in which some voxel contributes.  The box is never listed: each frame
    halves it where it sees something.  A task remembers at most settled_most blocks that need no more evaluation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled = np.zeros(0, np.int64)
        wide = box[1] - box[0] + 1
        for frame in frames_in(batches):
            b, _ = views.blocks_in_view(box, frame[2], cam, grid, views.Depths(frame[1], cam) if hide else None)
            number = ((b[:, 2] - box[0][2]) * wide[1] + b[:, 1] - box[0][1]) * wide[0] + b[:, 0] - box[0][0]
            left = ~np.isin(number, settled)
            b, number, found = b[left], number[left], []
            for k in range(0, len(b), CHUNK):
                some = b[k : k + CHUNK]
                hit = (voxels_of(some.astype(np.float64), frame, cam, grid)[4] >= -grid.truncation).reshape(-1, 512).any(1)
                found.append(np.flatnonzero(hit) + k)
            found = np.concatenate(found) if found else np.zeros(0, np.int64)
            if len(found):
                settled = np.union1d(settled if len(settled) < settled_most else settled[:0], number[found])
                yield pa.RecordBatch.from_arrays([pa.array(b[found, i].astype(np.int32)) for i in range(3)], BLOCK)

    return dealt_frames(scan).mapInArrow(run, "bx int, by int, bz int")


def pruning(scan: DataFrame, box: views.Box, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """(seq, candidates, judged, in_view, evaluated): for each frame the blocks of a box, the cubes that it judged, and the
    blocks that it would evaluate without and with the largest depths."""
    most = int(np.prod(np.maximum(box[1] - box[0] + 1, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames_in(batches):
            seen, _ = views.blocks_in_view(box, frame[2], cam, grid, None)
            left, cubes = views.blocks_in_view(box, frame[2], cam, grid, views.Depths(frame[1], cam))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (frame[0], most, cubes, len(seen), len(left))], ["seq", "candidates", "judged", "in_view", "evaluated"])

    return dealt_frames(scan).mapInArrow(run, "seq long, candidates long, judged long, in_view long, evaluated long")
