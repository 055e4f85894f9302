"""Frame-at-a-time fusion as a stream.

Frames arrive as files, in any order and perhaps more than once.  Sums must be made in the order of frames, so what has been
taken in is always a prefix of the sequence: frames that come early wait, frames that come again are dropped, and one that
comes again with other contents is an error.  Each batch of a stream writes, in this order, the frames that wait, the blocks
that it changed and its progress; a batch without progress is done again from the state before it, so a stream that is
stopped anywhere, or advanced in steps, ends with the bytes of one that runs through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import fuse, vector
from scanengine.sources import artifacts
from scanengine.sources.scratch import kept

BLOCK = ["bx", "by", "bz"]
STATE = "bx int, by int, bz int, sums binary, weights binary"
#: Every so many batches all blocks' state is written, so that a batch reads few files.
WHOLE_EVERY = 8
#: Frames whose digests lie in one folder: a batch reads the folders of the frames that it brings and no others.
SPAN = 4096


class ForeignState(ValueError):
    """A folder that holds the state of another fusion, or a frame that is not what it was."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _listed(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(p)] if files.exists(p) else []


def identity_of(blocks: DataFrame, cam: g.Camera, grid: g.Grid, more: dict | None = None) -> dict:
    """What a fusion's state belongs to: the plan's blocks, the camera, the grid, and what the caller adds."""
    rows = blocks.select(*BLOCK).distinct().orderBy("bz", "by", "bx").limit(artifacts.MOST_BLOCKS + 1).collect()
    if len(rows) > artifacts.MOST_BLOCKS:
        raise ValueError(f"a plan has at most {artifacts.MOST_BLOCKS} blocks")
    digest = hashlib.sha256(repr([tuple(r) for r in rows]).encode()).hexdigest()
    return {"blocks": digest, "camera": repr(cam), "grid": repr(grid), "digests": "sha-256"} | (more or {})


def progress(spark: SparkSession, folder: str, before: int | None = None) -> dict:
    """The last batch's progress (batch, next_seq, absorbed, whole), of those below `before`; of none, the beginning."""
    done = sorted(int(m[1]) for x in _listed(spark, f"{folder}/progress") if (m := re.fullmatch(r"(\d+)\.json", x)))
    done = [k for k in done if before is None or k < before]
    return artifacts.strict_json(artifacts.content(f"{folder}/progress/{done[-1]}.json")) if done else {"batch": -1, "next_seq": 0, "absorbed": 0, "whole": -1}


def _state(spark: SparkSession, folder: str, at: dict) -> DataFrame:
    """Each block's state (bx, by, bz, sums, weights) after a batch: the last whole one and what changed since."""
    if at["batch"] < 0:
        return spark.createDataFrame([], STATE)
    changes = spark.read.schema(STATE + ", batch int").option("basePath", f"{folder}/changes").parquet(f"{folder}/changes")
    changes = changes.where((F.col("batch") >= max(0, at["whole"])) & (F.col("batch") <= at["batch"]))
    return changes.groupBy(*BLOCK).agg(F.max_by(F.struct("sums", "weights"), "batch").alias("s")).select(*BLOCK, "s.sums", "s.weights")


def _added(state: DataFrame, packed: DataFrame) -> DataFrame:
    """Blocks' states with packed contributions added, frame by frame; only blocks that get any.

    A block's state and then its contributions come one by one, so a task holds one batch of rows and one block's sums,
    however many frames a batch of the stream brings.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, weight, any_ = None, np.zeros(512), np.zeros(512, np.int64), False

        def row() -> pa.RecordBatch:
            at = [pa.array([int(x)], pa.int32()) for x in held]
            return pa.RecordBatch.from_arrays([*at, pa.array([total.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary())], [*BLOCK, "sums", "weights"])

        for batch in batches:
            b, seq = list(zip(*(batch.column(i).to_numpy().tolist() for i in range(3)))), batch.column(3).to_numpy()
            for k, at in enumerate(b):
                if at != held:
                    if any_:
                        yield row()
                    held, total, weight, any_ = at, np.zeros(512), np.zeros(512, np.int64), False
                if seq[k] < 0:
                    total = np.frombuffer(batch.column(6)[k].as_py(), "<f8").copy()
                    weight = np.frombuffer(batch.column(7)[k].as_py(), "<i8").copy()
                else:
                    l = np.frombuffer(batch.column(4)[k].as_py(), "<i2")
                    total[l] += np.frombuffer(batch.column(5)[k].as_py(), "<f8")  # a voxel comes once a frame
                    weight[l] += 1
                    any_ = True
        if any_:
            yield row()

    first = state.select(*BLOCK, F.lit(-1).cast("long").alias("seq"), "sums", "weights")
    both = packed.select(*BLOCK, "seq", "l", "delta").unionByName(first, allowMissingColumns=True)
    return both.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "seq").mapInArrow(add, STATE)


def content_digest() -> Column:
    """SHA-256 of all that a frame brings to a fusion; fields that are null are not in the text that is hashed."""
    return F.sha2(F.to_json(F.struct("has_depth", "has_pose", "depth", *[f"m{i}" for i in range(12)])), 256)


def recorded_digests(spark: SparkSession, folder: str, spans: list[int], before: int) -> DataFrame:
    """(seq, digest) of the frames of some spans that batches below `before` brought."""
    held = set(_listed(spark, f"{folder}/digests")) if spans else set()
    paths = [f"{folder}/digests/span={k}" for k in spans if f"span={k}" in held]
    if not paths:
        return spark.createDataFrame([], "seq long, digest string")
    rows = spark.read.schema("seq long, digest string, span long, batch long").option("basePath", f"{folder}/digests").parquet(*paths)
    return rows.where(F.col("batch") < before).select("seq", "digest")


def absorb(spark: SparkSession, batch: DataFrame, number: int, blocks: DataFrame, cam: g.Camera, grid: g.Grid, folder: str, most: int | None = None) -> dict:
    """Takes in a batch of frames (at most `most` of them now) and returns the progress after it."""
    if _exists(spark, f"{folder}/progress/{number}.json"):
        return progress(spark, folder, number + 1)
    at = progress(spark, folder, number)
    span = F.floor(F.col("seq") / SPAN)
    came = kept(batch.withColumn("digest", content_digest()), "frames")
    # what a frame was when it first came; those that wait were compared when they came
    spans = [r["span"] for r in came.select(span.alias("span")).distinct().collect()]
    known = recorded_digests(spark, folder, spans, number)
    changed = came.select("seq", "digest").unionByName(known).groupBy("seq").agg(F.countDistinct("digest").alias("n")).where("n > 1").orderBy("seq").limit(1).collect()
    if changed:
        raise ForeignState(f"frame {changed[0]['seq']} came again with other contents")
    new = came.drop("digest")
    if at["batch"] >= 0:
        new = new.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/waiting/batch={at['batch']}"))
    left = new.where(F.col("seq") >= at["next_seq"]).dropDuplicates(["seq"])
    # numbers alone, of the frames of one batch and of those that wait
    ahead, upto = sorted(r["seq"] for r in left.select("seq").collect()), at["next_seq"]
    for s in ahead:
        if s != upto or most is not None and upto - at["next_seq"] >= most:
            break
        upto += 1
    ready = left.where(F.col("seq") < upto)
    left.where(F.col("seq") >= upto).write.mode("overwrite").parquet(f"{folder}/waiting/batch={number}")
    fresh = came.select("seq", "digest").distinct().join(known.select("seq"), "seq", "left_anti")
    fresh = fresh.select("*", span.alias("span"), F.lit(number).cast("long").alias("batch"))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("span", "batch").parquet(f"{folder}/digests")
    state = _state(spark, folder, at)
    changes = _added(state, vector.packed_contributions(ready, blocks, cam, grid))
    whole = number - at["whole"] >= WHOLE_EVERY or at["batch"] < 0
    if whole:
        changes = kept(changes, "changes")
        changes = changes.unionByName(state.join(changes.select(*BLOCK), BLOCK, "left_anti"))
    changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
    now = {"batch": number, "next_seq": upto, "absorbed": at["absorbed"] + upto - at["next_seq"], "whole": number if whole else at["whole"]}
    artifacts.publish(f"{folder}/progress/{number}.json", [artifacts.canonical(now)])
    return now


def advance(
    spark: SparkSession, source: str, schema, blocks: DataFrame, cam: g.Camera, grid: g.Grid, folder: str, frames_a_batch: int | None = None, more: dict | None = None, most: int | None = None
) -> dict:
    """Takes in every frame file that the stream has not seen, and stops; the progress after it.

    folder holds the stream's checkpoint, its state and what it belongs to; the state of another plan, camera, grid or of
    other fields `more` is refused (T3).  most: how many frames a batch takes in; the rest waits.
    """
    own = identity_of(blocks, cam, grid, more)
    place = f"{folder}/identity.json"
    if _exists(spark, place):
        held = artifacts.strict_json(artifacts.content(place))
        if wrong := sorted(k for k in held.keys() | own.keys() if held.get(k) != own.get(k)):
            raise ForeignState(f"the folder holds another fusion: {', '.join(wrong)}")
    else:
        artifacts.publish(place, [artifacts.canonical(own)])
    reader = spark.readStream.schema(schema)
    if frames_a_batch:
        reader = reader.option("maxFilesPerTrigger", frames_a_batch)
    query = (
        reader.parquet(source)
        .writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(lambda batch, number: absorb(spark, batch, number, blocks, cam, grid, folder, most) and None)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return progress(spark, folder)


def state_of(spark: SparkSession, folder: str) -> DataFrame:
    """The volume after all batches, as (bx, by, bz, l, tsdf_sum, weight)."""

    def unpacked(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                total, weight = np.frombuffer(batch.column(3)[k].as_py(), "<f8"), np.frombuffer(batch.column(4)[k].as_py(), "<i8")
                l = np.flatnonzero(weight)
                at = [pa.array(np.full(len(l), batch.column(i)[k].as_py(), np.int32)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*at, pa.array(l.astype(np.int32)), pa.array(total[l]), pa.array(weight[l])], [*BLOCK, "l", "tsdf_sum", "weight"])

    return _state(spark, folder, progress(spark, folder)).mapInArrow(unpacked, "bx int, by int, bz int, l int, tsdf_sum double, weight long")


def finish(spark: SparkSession, folder: str, frames: int) -> DataFrame:
    """The volume of a stream that has taken in all of its frames; refused while any is missing."""
    at = progress(spark, folder)
    if at["next_seq"] != frames:
        raise ValueError(f"{at['next_seq']} of {frames} frames have been taken in")
    return state_of(spark, folder)


def advance_blocks(spark: SparkSession, scan: DataFrame, plan: DataFrame, cam: g.Camera, grid: g.Grid, folder: str, blocks_a_step: int) -> int:
    """T5: fuses the next blocks of a plan, in canonical order, and lists them in a ledger; how many are left.  A step that is
    done again writes the same files."""
    ledger = f"{folder}/ledger"
    done = spark.read.schema("bx int, by int, bz int, step int").option("basePath", ledger).parquet(ledger) if _listed(spark, ledger) else spark.createDataFrame([], "bx int, by int, bz int, step int")
    step = (done.agg(F.max("step").alias("k")).first()["k"] or 0) + 1
    left = pending(plan, done)
    now = kept(left.orderBy("bz", "by", "bx").limit(blocks_a_step), "step")
    fuse.fuse(scan, now, cam, grid).write.mode("overwrite").parquet(f"{folder}/volume/step={step}")
    now.write.mode("overwrite").parquet(f"{ledger}/step={step}")
    return left.count() - now.count()


def approved_so_far(frames: DataFrame, candidates: DataFrame, approved: DataFrame, cam: g.Camera, grid: g.Grid) -> DataFrame:
    """the candidate blocks that these frames approve, beside those that earlier ones have; a block that is approved is
    not evaluated again."""
    left = candidates.select(*BLOCK).join(approved.select(*BLOCK), BLOCK, "left_anti")
    return approved.select(*BLOCK).unionByName(fuse.observed_blocks(frames, left, cam, grid))


def context(scan: DataFrame, most_bytes: int = 512 << 20) -> DataFrame:
    """A snapshot of a scan's frames with their images, which later steps read; refused above a limit of bytes."""
    size = scan.agg(F.coalesce(F.sum(F.size(F.coalesce("depth", F.array().cast("array<int>"))).cast("long") * 2), F.lit(0)).alias("b")).first()["b"]
    if size > most_bytes:
        raise ValueError(f"the scan's images take {size} bytes, more than {most_bytes}")
    return kept(scan, "context")


def pending(plan: DataFrame, done: DataFrame) -> DataFrame:
    """U4, T5: blocks of a plan that a ledger does not list yet."""
    return plan.select("bx", "by", "bz").join(done.select("bx", "by", "bz"), ["bx", "by", "bz"], "left_anti")
