"""Scan sessions: manifest, calibrations and streams."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanengine.functions import geometry as g
from scanengine.operators import replay
from scanengine.sources import artifacts
from scanengine.sources.scratch import kept

CALIBRATION = T.StructType(
    [T.StructField(n, t) for n, t in (("id", T.StringType()), ("model", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()))]
    + [T.StructField(n, T.DoubleType()) for n in ("fx", "fy", "cx", "cy")]
    + [T.StructField("distortion_model", T.StringType()), T.StructField("distortion_coefficients", T.ArrayType(T.DoubleType())), T.StructField("t_rig_camera", T.ArrayType(T.DoubleType()))]
)
SAMPLE = "id string, timestamp_ns long, path string, T_world_camera array<double>, accelerometer_m_s2 array<double>, gyroscope_rad_s array<double>, _corrupt_record string"


class SessionError(ValueError):
    """Every problem of a session, together."""


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """S3: a stream's JSON lines; a line that is no record is kept in _corrupt_record for problems()."""
    return spark.read.schema(SAMPLE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """The cameras of a calibration file."""
    numbers = T.StructType([T.StructField(n, T.DoubleType()) for n in ("fx", "fy", "cx", "cy")])
    bent = T.StructType([T.StructField("model", T.StringType()), T.StructField("coefficients", T.ArrayType(T.DoubleType()))])
    nested = T.StructType([T.StructField("intrinsics", numbers), T.StructField("distortion", bent), T.StructField("T_rig_camera", T.ArrayType(T.DoubleType()))])
    whole = lambda one: T.StructType([T.StructField("cameras", T.ArrayType(one))])
    # two readings of one text, as a column cannot have the names of both forms, which differ by case alone
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", whole(CALIBRATION)).alias("a"), F.from_json("value", whole(nested)).alias("b"))
    c = text.select(F.explode(F.arrays_zip(F.col("a.cameras").alias("a"), F.col("b.cameras").alias("b"))).alias("c"))
    either = {n: F.coalesce(F.col(f"c.b.intrinsics.{n}"), F.col(f"c.a.{n}")) for n in ("fx", "fy", "cx", "cy")}
    either |= {"distortion_model": F.coalesce("c.b.distortion.model", "c.a.distortion_model"), "distortion_coefficients": F.coalesce("c.b.distortion.coefficients", "c.a.distortion_coefficients")}
    either["t_rig_camera"] = F.coalesce("c.b.T_rig_camera", "c.a.t_rig_camera")
    return c.select(*[either.get(f.name, F.col(f"c.a.{f.name}")).alias(f.name) for f in CALIBRATION.fields])


def calibration_problems(cameras: DataFrame) -> DataFrame:
    """(where, problem): other models than the pinhole, distortion, bad sizes, repeated ids, transforms that are not rigid."""
    m = [F.col("t_rig_camera")[k] for k in range(12)]
    rules = [
        (F.col("model") != "pinhole", "unsupported camera model"),
        (F.coalesce(F.col("distortion_model"), F.lit("none")) != "none", "unsupported distortion"),
        (~((F.col("fx") > 0) & (F.col("fy") > 0)), "focal lengths must be positive"),
        (~((F.col("cx") >= 0) & (F.col("cx") < F.col("width")) & (F.col("cy") >= 0) & (F.col("cy") < F.col("height"))), "the centre is outside the image"),
        (F.when(F.size("t_rig_camera") == 16, ~g.is_rigid(m)).otherwise(F.lit(True)), "the rig transform is not rigid"),
    ]
    found = [cameras.where(rule).select(F.col("id").alias("where"), F.lit(text).alias("problem")) for rule, text in rules]
    found.append(cameras.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("where"), F.lit("repeated camera id").alias("problem")))
    return reduce(DataFrame.unionByName, found)


def unsafe_path(path: Column) -> Column:
    """Whether a path leaves the session: absolute, not POSIX, empty, or through a parent folder."""
    return path.isNull() | (path == "") | path.startswith("/") | path.contains("\\") | path.rlike(r"(^|/)\.\.(/|$)") | path.rlike(r"^[A-Za-z]:")


def stream_problems(samples: DataFrame, kind: str, files: DataFrame | None = None) -> DataFrame:
    """(where, problem) of a stream's samples: broken lines, missing fields, repeated ids, timestamps that do not
    rise, paths that leave the session or name no file, poses that are not rigid.  files: (path) of the session."""
    s = samples
    good = s.where("_corrupt_record is null") if "_corrupt_record" in s.columns else s
    name = lambda d, text: d.select(F.coalesce(F.col("id"), F.lit(kind)).alias("where"), F.lit(text).alias("problem"))
    out = [name(good.where("id is null or timestamp_ns is null"), "missing field")]
    if "_corrupt_record" in s.columns:
        out.append(name(s.where("_corrupt_record is not null"), "not a record"))
    out.append(name(good.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 and id is not null"), "repeated id"))
    out.append(name(good.groupBy("timestamp_ns").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1 and timestamp_ns is not null"), "timestamps do not rise"))
    if kind in ("rgb", "depth"):
        out.append(name(good.where(unsafe_path(F.col("path"))), "unsafe path"))
        if files is not None:
            out.append(name(good.where(~unsafe_path(F.col("path"))).join(files.select("path"), "path", "left_anti"), "no such file"))
    if kind == "pose":
        m = [F.col("T_world_camera")[k] for k in range(12)]
        out.append(name(good.where(F.when(F.size("T_world_camera") == 16, ~g.is_rigid(m)).otherwise(F.lit(True))), "pose is not rigid"))
    return reduce(DataFrame.unionByName, out)


def refuse(problems: DataFrame) -> None:
    """Raises one error with all problems, in order; nothing if there are none.  Problems are for people: the first
    hundred are named."""
    rows = problems.distinct().orderBy("where", "problem").limit(101).collect()
    if rows:
        raise SessionError("; ".join(f"{r['where']}: {r['problem']}" for r in rows[:100]) + ("; and more" if len(rows) > 100 else ""))


#: What a manifest says of its clock and its axes.
TIMEBASE = {"clock": "monotonic", "unit": "nanoseconds", "epoch": "session_start"}
AXES = {
    "handedness": "right", "world_axes": {"x": "forward", "y": "left", "z": "up"}, "camera_axes": {"x": "right", "y": "down", "z": "forward"},
    "distance_unit": "metres", "pose": "T_world_camera",
}
KINDS = ("rgb", "depth", "pose", "imu")


@dataclass
class Session:
    """A session whose every part has been checked: its manifest, its cameras, and its streams (line, id, timestamp_ns, ...)."""

    manifest: dict
    cameras: DataFrame
    streams: dict[str, DataFrame]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """S3: a stream's records with their line, in the order of the file; what is no record is in _corrupt_record."""
    fields = T.StructType.fromDDL(SAMPLE)
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where("trim(value) <> ''")
    d = lines.select("line", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return d.select("line", "r.*")


def manifest_problems(manifest: object) -> list[str]:
    """What a manifest lacks or says otherwise."""
    if not isinstance(manifest, dict):
        return ["manifest: not an object"]
    out = []
    if not re.fullmatch(r"[a-z]+\.scan-session", str(manifest.get("schema"))):
        out.append("manifest.schema: not a scan session")
    if manifest.get("schema_version") != "0.1.0":
        out.append("manifest.schema_version: unknown")
    if not re.fullmatch(r"[a-z0-9][a-z0-9._-]*", str(manifest.get("session_id") or "")):
        out.append("manifest.session_id: not an identifier")
    try:
        stamp = str(manifest.get("created_at_utc"))
        if not stamp.endswith("Z") or datetime.fromisoformat(stamp).utcoffset() != timedelta(0):
            raise ValueError
    except ValueError:
        out.append("manifest.created_at_utc: not a UTC time")
    for key, want in (("timebase", TIMEBASE), ("coordinate_system", AXES)):
        if manifest.get(key) != want:
            out.append(f"manifest.{key}: not as expected")
    streams = manifest.get("streams")
    if not isinstance(streams, dict) or not streams:
        return [*out, "manifest.streams: none"]
    for name, s in sorted(streams.items()):
        kind = s.get("kind") if isinstance(s, dict) else None
        if kind not in KINDS:
            out.append(f"manifest.streams.{name}: unknown kind")
            continue
        if kind in ("rgb", "depth") and not s.get("calibration_id"):
            out.append(f"manifest.streams.{name}: no calibration")
        if kind == "depth" and not (isinstance(s.get("depth_scale_m"), (int, float)) and s["depth_scale_m"] > 0):
            out.append(f"manifest.streams.{name}: no depth scale")
    return out


def load_session(spark: SparkSession, root: str) -> Session:
    """A session folder with its manifest, cameras and streams; one error names every problem of all of them."""
    problems: list[str] = []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", r"^(?:file:)?/*(.*)$", 1).alias("p"))
    base = re.sub(r"^(?:file:)?/*", "", root.rstrip("/")) + "/"
    files = files.where(F.col("p").startswith(base)).select(F.substring("p", len(base) + 1, 10_000).alias("path"))

    def named(reference: object, what: str) -> str | None:
        path = str(reference or "")
        if not path or path.startswith("/") or "\\" in path or ".." in path.split("/"):
            problems.append(f"{what}: unsafe path")
        elif files.where(F.col("path") == path).isEmpty():
            problems.append(f"{what}: no such file")
        else:
            return f"{root}/{path}"
        return None

    place = named("manifest.json", "manifest")
    if place is None:
        raise SessionError("; ".join(problems))
    manifest = artifacts.strict_json(artifacts.content(place))
    problems += manifest_problems(manifest)
    manifest = manifest if isinstance(manifest, dict) else {}
    cameras, streams, found, ids = None, {}, [], set()
    if path := named(manifest.get("calibration"), "manifest.calibration"):
        cameras = read_calibrations(spark, path)
        ids = {r["id"] for r in cameras.select("id").collect()}
        found.append(calibration_problems(cameras))
    for name, s in sorted((manifest.get("streams") or {}).items()):
        if not isinstance(s, dict) or s.get("kind") not in KINDS:
            continue
        if s["kind"] in ("rgb", "depth") and ids and s.get("calibration_id") not in ids:
            problems.append(f"manifest.streams.{name}: no camera {s.get('calibration_id')}")
        if path := named(s.get("index"), f"manifest.streams.{name}.index"):
            rows = kept(read_lines(spark, path), "stream")
            streams[name] = rows
            found.append(stream_problems(rows, s["kind"], files))
            late = replay.increasing(rows.where("timestamp_ns is not null").select("line", F.col("timestamp_ns").alias("ts")))
            found.append(late.join(rows.select("line", "id"), "line").select(F.coalesce("id", F.lit(name)).alias("where"), F.lit("timestamps do not rise").alias("problem")))
    if found:
        rows = reduce(DataFrame.unionByName, found).distinct().orderBy("where", "problem").limit(101).collect()
        problems += [f"{r['where']}: {r['problem']}" for r in rows[:100]] + (["and more"] if len(rows) > 100 else [])
    if problems:
        raise SessionError("; ".join(problems))
    return Session(manifest, cameras, streams)
