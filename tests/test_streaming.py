"""Streams of frames that come late, early, twice or changed."""

import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import fuse
from scanengine.plans.fusion_queries import COARSE, blocks
from scanengine.sources import derived
from scanengine.sources.derived import CAMERA
from scanengine.streaming import fusion

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def bits(df):
    return {(r.bx, r.by, r.bz, r.l): (struct.pack("<d", r.tsdf_sum), r.weight) for r in df.collect()}


@pytest.fixture(scope="module")
def scene(spark):
    """Ten frames: those of the derived scan with depth and pose, numbered again, and one without either."""
    s = derived.scan(spark, SF)
    many = s.select("*", F.explode(F.array(*[F.lit(k) for k in range(6)])).alias("k")).withColumn("seq", F.col("seq") * 6 + F.col("k")).where("seq < 10")
    moved = many.withColumn("m3", F.col("m3") + F.col("k") * 0.05).withColumn("has_pose", F.col("has_pose") & (F.col("seq") != 4)).drop("k").cache()
    assert moved.count() == 10
    return moved, blocks(spark, SF).cache()


def given(scene, folder, groups):
    for k, group in enumerate(groups):
        scene.where(F.col("seq").isin(group)).coalesce(1).write.mode("append").parquet(f"{folder}/frames/{k}")


def test_frames_out_of_order_end_with_the_same_bits(spark, scene, tmp_path):
    scan, plan = scene
    want = bits(fuse.fuse(scan, plan, CAMERA, COARSE))
    folder = str(tmp_path)
    at = None
    for k, group in enumerate([[5, 3], [0], [1, 2, 9], [0, 5], [4, 6, 8], [7], []]):
        scan.where(F.col("seq").isin(group)).coalesce(1).write.mode("append").parquet(f"{folder}/frames")
        at = fusion.advance(spark, f"{folder}/frames", scan.schema, plan, CAMERA, COARSE, folder)
        assert at["next_seq"] == [0, 1, 4, 4, 7, 10, 10][k]
        if at["next_seq"]:
            assert bits(fusion.state_of(spark, folder)) == bits(fuse.fuse(scan.where(F.col("seq") < at["next_seq"]), plan, CAMERA, COARSE))
        if k < 5:
            with pytest.raises(ValueError, match="of 10 frames"):
                fusion.finish(spark, folder, 10)
    assert bits(fusion.finish(spark, folder, 10)) == want
    with pytest.raises(fusion.ForeignState, match="grid"):
        fusion.advance(spark, f"{folder}/frames", scan.schema, plan, CAMERA, g.Grid(0.2, 0.5), folder)
    with pytest.raises(fusion.ForeignState, match="blocks"):
        fusion.advance(spark, f"{folder}/frames", scan.schema, plan.where("bx <> 0"), CAMERA, COARSE, folder)


def test_steps_limits_and_repeats_of_a_batch(spark, scene, tmp_path):
    scan, plan = scene
    folder = str(tmp_path)
    one = fusion.absorb(spark, scan, 0, plan, CAMERA, COARSE, folder, most=3)
    assert one["next_seq"] == 3 and fusion.absorb(spark, scan, 0, plan, CAMERA, COARSE, folder, most=9) == one
    state = bits(fusion.state_of(spark, folder))
    two = fusion.absorb(spark, scan.where("1 = 0"), 1, plan, CAMERA, COARSE, folder, most=4)
    assert two["next_seq"] == 7 and state == bits(fuse.fuse(scan.where("seq < 3"), plan, CAMERA, COARSE))
    # a batch that was cut off before its progress was written is done again
    (tmp_path / "progress" / "1.json").unlink()
    assert fusion.absorb(spark, scan.where("1 = 0"), 1, plan, CAMERA, COARSE, folder)["next_seq"] == 10
    assert bits(fusion.state_of(spark, folder)) == bits(fuse.fuse(scan, plan, CAMERA, COARSE))
    with pytest.raises(fusion.ForeignState, match="frame 2 came again"):
        fusion.absorb(spark, scan.where("seq = 2").withColumn("m3", F.lit(9.0)), 2, plan, CAMERA, COARSE, folder)


def test_digests_of_the_frames_that_came_are_all_that_is_read(spark, scene, tmp_path, monkeypatch):
    scan, plan = scene
    folder = str(tmp_path)
    monkeypatch.setattr(fusion, "SPAN", 4)
    for k in range(10):
        fusion.absorb(spark, scan.where(F.col("seq") == k), k, plan, CAMERA, COARSE, folder)
    for spans in ([], [0], [1, 2], [7]):
        files = [f for f in fusion.recorded_digests(spark, folder, spans, 99).inputFiles()]
        assert {int(f.split("span=")[1].split("/")[0]) for f in files} == set(spans) - {7}
    assert fusion.recorded_digests(spark, folder, [0, 1, 2], 99).count() == 10
    assert fusion.recorded_digests(spark, folder, [0, 1, 2], 5).count() == 5
    # a repeat is recorded once; a change is refused after many batches, in whatever field it is
    assert fusion.absorb(spark, scan.where("seq in (1, 6)"), 10, plan, CAMERA, COARSE, folder)["next_seq"] == 10
    assert fusion.recorded_digests(spark, folder, [0, 1, 2], 99).count() == 10
    for column, value in (("m3", F.lit(9.0)), ("has_pose", F.lit(False)), ("depth", F.transform("depth", lambda x: x + 1))):
        with pytest.raises(fusion.ForeignState, match="frame 1 came again"):
            fusion.absorb(spark, scan.where("seq = 1").withColumn(column, value), 11, plan, CAMERA, COARSE, folder)


def test_blocks_in_steps_and_expansion_stops_early(spark, scene, tmp_path):
    scan, plan = scene
    left, n = [], plan.count()
    while not left or left[-1]:
        left.append(fusion.advance_blocks(spark, scan, plan, CAMERA, COARSE, str(tmp_path), n // 3 + 1))
    assert len(left) == 3 and bits(spark.read.parquet(f"{tmp_path}/volume")) == bits(fuse.fuse(scan, plan, CAMERA, COARSE))
    empty = plan.select("bx", "by", "bz").where("1 = 0")
    first = fusion.approved_so_far(scan.where("seq < 5"), plan, empty, CAMERA, COARSE).cache()
    both = fusion.approved_so_far(scan.where("seq >= 5"), plan, first, CAMERA, COARSE)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(both) == key(fuse.observed_blocks(scan, plan, CAMERA, COARSE))
    with pytest.raises(ValueError, match="more than 100"):
        fusion.context(scan, 100)
    assert fusion.context(scan).count() == 10


def test_samples_meet_frames_as_both_arrive(spark, tmp_path):
    """Frames late, samples late, both in between; what comes after the watermark is counted and left out; state is dropped."""
    from scanengine.streaming import windows

    second = 1_000_000
    r = __import__("random").Random(5)
    frames = [(k, 10 * second * (k + 1), 10 * second * k if k else None) for k in range(60)]
    samples = [(k, r.randrange(-5 * second, 605 * second)) for k in range(2000)] + [(9000, 10 * second), (9001, 10 * second + 1), (9002, 20 * second)]
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    go = lambda: windows.run(spark, f"{tmp_path}/frames", f"{tmp_path}/samples", f"{tmp_path}/out", 7 * second, "30 seconds", "20 seconds")
    got = lambda: {(x.seq, x.id) for x in windows.windows(spark, f"{tmp_path}/out").collect()}

    def want(some):
        return {(seq, i) for seq, hi, lo in frames for i, ts in some if (hi - 30 * second if lo is None else lo) < ts <= hi}

    held = []
    for upto in range(100, 700, 100):
        now = [x for x in samples if (upto - 100) * second < x[1] <= upto * second or upto == 100 and x[1] <= 0]
        part = [f for f in frames if (upto - 100) * second < f[1] <= upto * second]
        held += now
        # samples before their frames, then frames before their samples
        for name, rows, schema in (("samples", now, windows.SAMPLES), ("frames", part, windows.FRAMES))[:: 1 if upto % 200 else -1]:
            write(name, rows or [], schema)
            if (upto // 100) % 3 == 0 and (tmp_path / "frames").exists() and (tmp_path / "samples").exists():
                go()
        state = go()
        assert got() == want(held) and state["late"] == 0
    assert state["kept"] < len(samples) / 2
    count = len(got())
    write("samples", [(5000, 15 * second)], windows.SAMPLES)  # ten minutes late
    assert go()["late"] >= 1 and len(got()) == count
    assert go()["late"] == 0
