"""Samples of a fast sensor given to frames as both arrive (T10, J2): a join of two streams with watermarks.

A frame's window reaches from after the frame before it to its own time.  Frames come with that earlier time, as a recorder's
index has it; samples come on their own.  Both streams are joined on buckets of time and the window itself, so each sample
meets one frame, however many there are.  Each stream's state is dropped once no partner can come any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "seq long, ts long, previous long"
SAMPLES = "id long, ts long"
#: Microseconds added to event times: a stream's first watermark is 1970, and ticks may count from a recording's start or before.
LATER = 3_000_000_000_000_000


def joined(frames: DataFrame, samples: DataFrame, width: int, reach: str, delay: str, a_micro: int = 1) -> DataFrame:
    """(seq, id, ts) of streams of frames (seq, ts, previous; null for the first) and samples (id, ts).

    width: ticks of a bucket; a_micro: ticks in a microsecond; reach: how long a window may be: samples that lie farther
    before their frame get none.  delay: how much later than the newest one a row may come; what comes later still is late:
    it is not joined, and counted (see `run`).  A sample at a frame's very time is that frame's.  Samples after the last frame
    wait for one.  Rows that repeat are joined each.
    """
    at = lambda c: F.timestamp_micros(F.floor(F.col(c) / a_micro).cast("long") + LATER)
    far = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00 UTC' + interval {reach})") * a_micro
    f = frames.select("seq", F.col("ts").alias("hi"), F.coalesce("previous", F.col("ts") - far).alias("lo")).withColumn("frame_time", at("hi")).withWatermark("frame_time", delay)
    low = F.greatest(F.col("lo"), F.col("hi") - far)
    f = f.withColumn("bucket", F.explode(F.sequence(F.floor(low / width), F.floor(F.col("hi") / width))))
    s = samples.select("id", "ts", F.floor(F.col("ts") / width).alias("bucket")).withColumn("sample_time", at("ts")).withWatermark("sample_time", delay)
    inside = (F.col("ts") > F.col("lo")) & (F.col("ts") <= F.col("hi"))
    bounded = F.expr(f"sample_time <= frame_time AND sample_time >= frame_time - interval {reach}")
    return s.join(f, (s["bucket"] == f["bucket"]) & inside & bounded).select("seq", "id", "ts")


def run(spark: SparkSession, frames: str, samples: str, out: str, width: int, reach: str = "1 minute", delay: str = "10 seconds", a_micro: int = 1, files: int = 100) -> dict:
    """Joins what has come to the folders `frames` and `samples` since the last run, and stops: (rows given to frames, rows that
    were late).  out holds the rows and the streams' checkpoint."""
    read = lambda path, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    rows = joined(read(frames, FRAMES), read(samples, SAMPLES), width, reach, delay, a_micro)
    query = rows.writeStream.format("parquet").option("path", f"{out}/windows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    steps = [p for p in query.recentProgress]
    late = sum(op["numRowsDroppedByWatermark"] for p in steps for op in p["stateOperators"])
    return {"batches": len(steps), "late": late, "kept": max([op["numRowsTotal"] for op in steps[-1]["stateOperators"]], default=0) if steps else 0}


def windows(spark: SparkSession, out: str) -> DataFrame:
    """(seq, id, ts): every sample that a frame has got so far."""
    return spark.read.schema("seq long, id long, ts long").parquet(f"{out}/windows")
