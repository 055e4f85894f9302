"""Work that must not grow with the pairs of rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scanengine.functions.batches import whole_runs
from scanengine.functions.geometry import Grid
from scanengine.operators import commit, evaluate, proof, replay, vector
from scanengine.sources.derived import CAMERA, with_poses
from scanengine.streaming import fusion
from tests.test_boxtree import rows_written


def test_association_lists_no_candidates(spark):
    """Streams in which every row has dozens of rows of the other within the limit, some at the very same time."""
    r = random.Random(5)
    a, b = ([(base + k, r.randrange(20_000)) for k in range(600)] + [(base + 600 + k, 7000) for k in range(9)] for base in (0, 5000))
    left, right, want = set(), set(), set()
    for _, t, u, i, j in sorted((abs(t - u), t, u, i, j) for i, t in a for j, u in b if abs(t - u) < 900):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            want.add((i, t, j, u))
    frame = lambda x: spark.createDataFrame(x, "id long, ts long")
    n, got = rows_written(spark, lambda: replay.associate(frame(a), frame(b), 900))
    assert {tuple(x) for x in got} == want
    assert n < 6 * (len(a) + len(b))
    assert {tuple(x) for x in replay.associate(frame(a), frame(b), 900, rows_a_range=100).collect()} == want


def test_a_block_of_a_stream_is_added_to_row_by_row(spark):
    """No task gathers all that a batch adds to a block; sums are made in the order of frames, after the state before."""
    r = random.Random(3)
    rows = [(k, k % 2, 0, 0, np.array([5, 7 + k % 3], "<i2").tobytes(), np.array([r.uniform(-1, 1), 0.1], "<f8").tobytes()) for k in range(40)]
    old = (np.arange(512, dtype="<f8") / 7, np.ones(512, "<i8"))
    state = spark.createDataFrame([(0, 0, 0, old[0].tobytes(), old[1].tobytes()), (9, 9, 9, old[0].tobytes(), old[1].tobytes())], fusion.STATE)
    packed = spark.createDataFrame(rows[::-1], "seq long, bx int, by int, bz int, l binary, delta binary").repartition(5)
    added = fusion._added(state, packed)
    assert "CoGroup" not in added._jdf.queryExecution().executedPlan().toString()
    want = {0: [old[0].copy(), old[1].copy()], 1: [np.zeros(512), np.zeros(512, np.int64)]}
    for _, bx, _, _, l, delta in rows:
        l = np.frombuffer(l, "<i2")
        want[bx][0][l] += np.frombuffer(delta, "<f8")
        want[bx][1][l] += 1
    assert {(x.bx, x.by, x.bz): (bytes(x.sums), bytes(x.weights)) for x in added.collect()} == {(k, 0, 0): (t.tobytes(), w.tobytes()) for k, (t, w) in want.items()}


def test_a_pixel_is_sent_once_to_be_compared_with_its_neighbours(spark):
    """Frames with a hole, with readings of 0, and too narrow for a neighbourhood."""
    r = random.Random(9)
    px = [(s, u, v, r.choice([0] + [100, 110, 120] * 9)) for s in (0, 1) for u in range(7) for v in range(6) if (s, u, v) != (1, 3, 3)] + [(2, 0, v, 1) for v in range(5)]
    at = {(s, u, v): x for s, u, v, x in px}
    around = lambda s, u, v: [at.get((s, u + i, v + j)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    want = {k for k in at if None not in (n := around(*k)) and max(n) - min(n) <= 20}
    n, got = rows_written(spark, lambda: evaluate.smooth(spark.createDataFrame(px, "seq long, u int, v int, raw long"), 20))
    assert {tuple(x) for x in got} == want and want
    assert n < 3 * len(px)


def test_runs_are_whole_however_batches_are_cut():
    """Rows of a block and frame, some without a frame, in batches of one row to all."""
    rows = [(b, s) for b in range(4) for s in (None, *range(3)) for _ in range(1 + (b + (s or 0)) % 4)]
    for n in range(1, len(rows) + 1):
        batches = [pa.RecordBatch.from_pylist([{"b": b, "s": s} for b, s in rows[k : k + n]], pa.schema({"b": pa.int32(), "s": pa.int64()})) for k in range(0, len(rows), n)]
        out = [[(r["b"], r["s"]) for r in x.to_pylist()] for x in whole_runs(iter(batches), ["b", "s"])]
        assert [r for x in out for r in x] == rows
        assert all(a[-1] != b[0] for a, b in zip(out, out[1:]))


def _recorded(spark, n: int):
    r = random.Random(4)
    images = [(k, [r.choice((0, 900, 1500, 2600, 4000)) for _ in range(CAMERA.width * CAMERA.height)]) for k in range(n)]
    return with_poses(spark.createDataFrame([(k,) for k, _ in images], "seq long")).join(spark.createDataFrame(images, "seq long, depth array<int>"), "seq")


def test_a_block_is_fused_from_its_evidence_as_it_comes(spark):
    """No task gathers the evidence of a block or of a scan; what is missing, spare or broken is told of its block alone."""
    grid, side = Grid(0.2, 0.4), 10
    scan = _recorded(spark, 20).cache()
    plan = [(x, y, z) for x in (-1, 0) for y in (-1, 0) for z in (0, 1, 2)] + [(0, 0, -9)]
    blocks = spark.createDataFrame(plan, "bx int, by int, bz int")
    frames = proof.frame_leaves(scan, proof.depth_trees(proof.image_tiles(scan, CAMERA, side))).cache()
    tiles = proof.evidence_tiles(scan, blocks, CAMERA, grid, side, True)
    want = {b: (np.zeros(512), np.zeros(512, np.int64)) for b in plan}
    for f in scan.where("has_depth and has_pose").orderBy("seq").collect():
        pose = np.array([f[f"m{k}"] for k in range(12)])
        for b, (total, weight) in want.items():
            sd = vector.voxels_of(np.array([b], float), (f.seq, np.array(f.depth), pose), CAMERA, grid)[4]
            hit = sd >= -grid.truncation
            total[hit] += np.minimum(1.0, np.maximum(-1.0, sd[hit] / grid.truncation))
            weight[hit] += 1
    want = {b: (t.astype("<f8").tobytes(), w.astype("<u4").tobytes()) for b, (t, w) in want.items()}
    held = [tuple(r) for r in tiles.collect()]
    assert len({x for x, _ in want.values()}) > 10 and {r[3:5] for r in held} and all(r[5].startswith(commit.TILE_TAG) for r in held)
    of = lambda b: next(k for k, r in enumerate(held) if r[:3] == b)
    a, b, c, d, e = (-1, -1, 1), (0, 0, 1), (0, -1, 1), (-1, 0, 1), (0, 0, -9)
    bad = list(held)
    bad[of(b)] = bad[of(b)][:5] + (bad[of(b)][5][:-2],)  # another size
    bad += [c + (10, 0, held[0][5]), c + (None, 0, held[0][5])]  # frames that are not read
    bad += [d + (held[of(d)][3], k, held[0][5]) for k in (None, -1, 99)] + [e + (0, 0, held[0][5]), (50, 0, 0, 0, 0, held[0][5])]
    del bad[of(a)]
    told = {a: "is not held", b: "another size", c: "is not read", d: "another size", e: "is not read"}
    for batch in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        for rows, wrong in ((held, {}), (bad, told)):
            found = proof.fused_from_evidence(frames, blocks, spark.createDataFrame(rows[::-1], tiles.schema).repartition(3), CAMERA, grid, side)
            text = found._jdf.queryExecution().executedPlan().toString()
            assert "CoGroup" not in text and "FlatMapGroups" not in text
            got = {(r.bx, r.by, r.bz): r for r in found.collect()}
            assert set(got) == set(plan)
            assert {k for k, r in got.items() if r.problem} == set(wrong) and all(x in got[k].problem for k, x in wrong.items())
            assert all((bytes(r.sums), bytes(r.weights)) == want[k] for k, r in got.items() if k not in (a, b))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_frames_of_a_joined_scan_are_dealt_out(spark):
    """A join leaves few, small partitions by the frames' numbers; evaluating them needs all cores."""
    parts = 4 * spark.sparkContext.defaultParallelism
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        dealt = vector.dealt_frames(_recorded(spark, 40))
        where = dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, x in kept.items():
            spark.conf.set(k, x)
    assert sum(r["count"] for r in where) > 20 and len(where) > 4
