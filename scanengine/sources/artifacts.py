"""Artifacts that are one file each: dense volumes, block plans, block volumes, checkpoints, meshes, manifests and pictures
(S7, S12, S13, S15, S18, K2-K8, K10, K11, K13, V1, V2, V17).

A file is written in pieces as they come from the executors, beside its place, and appears there whole or not at all; an
existing file is refused.  JSON is canonical: sorted keys, ASCII, no blanks, a line feed at the end.  What a file says about
its contents (counts, digests) is derived again when it is read.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import commit
from scanengine.sources.scratch import kept

#: How files begin, and their limits.
CHECKPOINT_MAGIC, PROOF_MAGIC = b"SFTCKP01", b"SFTPRF01"
MOST_DENSE, MOST_BLOCKS, MOST_HEADER = 1_000_000, 250_000, 16 * 1024
BLOCK = ["bx", "by", "bz"]


class ArtifactError(ValueError):
    """A file that is not what it says."""


def canonical(value: object) -> bytes:
    return (json.dumps(value, sort_keys=True, ensure_ascii=True, separators=(",", ":"), allow_nan=False) + "\n").encode()


def strict_json(data: bytes) -> object:
    """JSON without repeated keys, NaN or infinities."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ArtifactError("an object holds a key twice")
        return out

    def refused(name: str) -> None:
        raise ArtifactError(f"{name} is no number")

    try:
        return json.loads(data.decode("utf-8"), object_pairs_hook=once, parse_constant=refused)
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as e:
        raise ArtifactError(f"not JSON: {e}") from e


def publish(path: str, pieces: Iterable[bytes], replace: bool = False) -> str:
    """Writes pieces to a file that appears at once; its SHA-256.  An existing file is refused unless `replace`."""
    from pyarrow import fs

    files, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))
    there = files.get_file_info(place).type != fs.FileType.NotFound
    if there and not replace:
        raise FileExistsError(f"{path} exists")
    files.create_dir(os.path.dirname(place), recursive=True)
    draft, digest = f"{place}.{uuid.uuid4().hex}.tmp", hashlib.sha256()
    try:
        with files.open_output_stream(draft, compression=None) as out:
            for piece in pieces:
                out.write(piece)
                digest.update(piece)
        if isinstance(files, fs.LocalFileSystem) and not replace:
            os.link(draft, place)  # fails if the file has appeared meanwhile
            files.delete_file(draft)
        else:
            files.move(draft, place)
    except BaseException:
        if files.get_file_info(draft).type != fs.FileType.NotFound:
            files.delete_file(draft)
        raise
    return digest.hexdigest()


def content(path: str) -> bytes:
    from pyarrow import fs

    files, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))
    with files.open_input_file(place) as f:
        return f.read()


def contained(magic: bytes, header: dict) -> bytes:
    head = canonical(header)
    return magic + struct.pack("<Q", len(head)) + head


def opened(data: bytes, magic: bytes) -> tuple[dict, int]:
    """(header, where the payload begins)."""
    if data[:8] != magic or len(data) < 16:
        raise ArtifactError("the file begins otherwise")
    (n,) = struct.unpack("<Q", data[8:16])
    if n > MOST_HEADER or len(data) < 16 + n:
        raise ArtifactError("the header is too long or cut short")
    header = strict_json(data[16 : 16 + n])
    if not isinstance(header, dict) or canonical(header) != data[16 : 16 + n]:
        raise ArtifactError("the header is not canonical")
    return header, 16 + n


def nine(x: float) -> float:
    """A number with nine decimals; minus zero is zero."""
    return float(f"{0.0 if abs(x) < 0.5e-9 else x:.9f}")


# --- dense volumes


def write_dense(volume: DataFrame, grid: g.Grid, origin: tuple[int, int, int], size: tuple[int, int, int], path: str, more: dict | None = None) -> str:
    """K2: the known voxels (gx, gy, gz, tsdf_sum, weight) of a box as JSON, x fastest, then y, then z; the file's SHA-256."""
    total = math.prod(size)
    if total > MOST_DENSE:
        raise ArtifactError(f"a dense volume has at most {MOST_DENSE} voxels")
    inside = volume.where(" and ".join(f"g{a} between {o} and {o + n - 1}" for a, o, n in zip("xyz", origin, size)))
    v = kept(inside.select(*[(F.col(f"g{a}") - o).cast("int").alias(f"g{a}") for a, o in zip("xyz", origin)], (F.col("tsdf_sum") / F.col("weight")).alias("tsdf"), "weight"), "dense")
    n = v.agg(F.count("*").alias("n"), F.count_if(F.expr("weight > 1")).alias("fused"), F.coalesce(F.sum("weight"), F.lit(0)).alias("updates"), F.coalesce(F.max("weight"), F.lit(0)).alias("most")).first()
    head = {
        "integration": {"fused_voxels": n["fused"], "max_weight": n["most"], "observed_voxels": n["n"], "total_voxels": total, "unknown_voxels": total - n["n"], "voxel_updates": n["updates"]},
        "schema": "scanengine.dense-volume",
        "source": more or {},
        "volume": {"dimensions_xyz": list(size), "origin_world_m": [nine(o * grid.voxel) for o in origin], "truncation_m": nine(grid.truncation), "voxel_size_m": nine(grid.voxel)},
    }

    def pieces() -> Iterator[bytes]:
        yield canonical(head)[:-2] + b',"voxels":['
        for k, r in enumerate(v.orderBy("gz", "gy", "gx").toLocalIterator()):
            one = canonical({"index": [r["gx"], r["gy"], r["gz"]], "tsdf": nine(r["tsdf"]), "weight": r["weight"]})[:-1]
            yield (b"," if k else b"") + one
        yield b"]}\n"

    return publish(path, pieces())


def load_dense(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(header, voxels (gx, gy, gz, value, weight)); voxels out of order, out of the box or beyond their bounds, and
    counts that do not follow from the voxels, are refused."""
    doc = strict_json(content(path))
    if not isinstance(doc, dict) or doc.get("schema") != "scanengine.dense-volume":
        raise ArtifactError("not a dense volume")
    voxels, said, size = doc.pop("voxels"), doc["integration"], doc["volume"]["dimensions_xyz"]
    if math.prod(size) > MOST_DENSE:
        raise ArtifactError(f"a dense volume has at most {MOST_DENSE} voxels")
    last = -1
    for x in voxels:
        i, value, weight = x["index"], x["tsdf"], x["weight"]
        if len(i) != 3 or not all(0 <= a < n for a, n in zip(i, size)) or not -1 <= value <= 1 or not isinstance(weight, int) or weight < 1:
            raise ArtifactError(f"voxel {i} is out of bounds")
        at = i[0] + size[0] * (i[1] + size[1] * i[2])
        if at <= last:
            raise ArtifactError("voxels are not in order")
        last = at
    weights = [x["weight"] for x in voxels]
    counted = {"fused_voxels": sum(w > 1 for w in weights), "max_weight": max(weights, default=0), "observed_voxels": len(weights), "total_voxels": math.prod(size), "unknown_voxels": math.prod(size) - len(weights), "voxel_updates": sum(weights)}
    if counted != said:
        raise ArtifactError("the counts do not follow from the voxels")
    rows = pd.DataFrame([(*x["index"], float(x["tsdf"]), x["weight"]) for x in voxels], columns=["gx", "gy", "gz", "value", "weight"])
    schema = "gx long, gy long, gz long, value double, weight long"
    return doc, spark.createDataFrame(rows, schema) if len(rows) else spark.createDataFrame([], schema)


# --- block plans


def write_plan(plan: DataFrame, grid: g.Grid, counters: dict, path: str, expanded: DataFrame | None = None) -> str:
    """K3, K4: a plan (bx, by, bz, is_surface) as JSON, blocks in canonical order (z, y, x).  expanded: the blocks that a
    free-space expansion has approved beside it; surface blocks stay, active ones are the union."""
    active = plan.select(*BLOCK)
    if expanded is not None:
        active = active.unionByName(expanded.select(*BLOCK)).distinct()
    lists = {}
    for name, blocks in (("surface_blocks", plan.where("is_surface").select(*BLOCK)), ("active_blocks", active)):
        rows = blocks.orderBy("bz", "by", "bx").limit(MOST_BLOCKS + 1).collect()
        if len(rows) > MOST_BLOCKS:
            raise ArtifactError(f"a plan has at most {MOST_BLOCKS} blocks")
        lists[name] = [list(r) for r in rows]
    both = lists["active_blocks"]
    doc = {
        "activation": {"free_space": "not-planned" if expanded is None else "approved", "truncation_m": grid.truncation},
        "grid": {"block_extent_m": grid.extent, "block_resolution": g.SIDE, "voxel_size_m": grid.voxel},
        "planning": counters | {
            "active_blocks": len(both), "halo_blocks": len(both) - len(lists["surface_blocks"]), "planned_voxel_slots": 512 * len(both), "surface_blocks": len(lists["surface_blocks"]),
            "max_block_index": [max((b[k] for b in both), default=0) for k in range(3)], "min_block_index": [min((b[k] for b in both), default=0) for k in range(3)],
        },
        "schema": "scanengine.block-plan",
        "schema_version": "0.1.0" if expanded is None else "0.2.0",
        **lists,
    }
    return publish(path, [canonical(doc)])


def load_plan(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(document without its lists, plan (bx, by, bz, is_surface)); blocks out of order, surface blocks that are not
    active, and counts that do not follow, are refused."""
    doc = strict_json(content(path))
    if not isinstance(doc, dict) or doc.get("schema") != "scanengine.block-plan":
        raise ArtifactError("not a block plan")
    surface, active = doc.pop("surface_blocks"), doc.pop("active_blocks")
    for blocks in (surface, active):
        keys = [tuple(reversed(b)) for b in blocks]
        if len(blocks) > MOST_BLOCKS or any(len(b) != 3 or not all(isinstance(i, int) for i in b) for b in blocks) or any(x >= y for x, y in zip(keys, keys[1:])):
            raise ArtifactError("blocks are too many, no indices, or not in order")
    is_surface = set(map(tuple, surface))
    if not is_surface <= set(map(tuple, active)):
        raise ArtifactError("a surface block is not active")
    p = doc["planning"]
    counted = {
        "active_blocks": len(active), "surface_blocks": len(surface), "halo_blocks": len(active) - len(surface), "planned_voxel_slots": 512 * len(active),
        "max_block_index": [max((b[k] for b in active), default=0) for k in range(3)], "min_block_index": [min((b[k] for b in active), default=0) for k in range(3)],
    }
    if {k: p.get(k) for k in counted} != counted or not math.isclose(doc["grid"]["block_extent_m"], 8 * doc["grid"]["voxel_size_m"]):
        raise ArtifactError("the counts do not follow from the blocks")
    rows = [(*b, tuple(b) in is_surface) for b in active]
    return doc, spark.createDataFrame(rows, "bx int, by int, bz int, is_surface boolean")


def plan_differences(document: dict, loaded: DataFrame, planned: DataFrame, counters: dict) -> DataFrame:
    """V2: (field, left, right) where a loaded plan differs from one made again from the scan: counters and sets of blocks."""
    spark = loaded.sparkSession
    digest = lambda d: d.agg(F.sum(F.xxhash64(*BLOCK, "is_surface").cast("decimal(38,0)")).cast("string").alias("blocks"), F.count("*").alias("n"))
    said = {k: str(document["planning"].get(k)) for k in counters}
    row = lambda c, d: spark.createDataFrame([tuple(map(str, c.values()))], ", ".join(f"`{k}` string" for k in c)).crossJoin(digest(d))  # noqa: E731  a row each
    return commit.differences(row(said, loaded), row({k: str(v) for k, v in counters.items()}, planned))


# --- block volumes and checkpoints


def _packed_blocks(volume: DataFrame) -> DataFrame:
    """(bx, by, bz, sums, weights) of each block, in canonical order when sorted by (bz, by, bx)."""
    leaf = commit.block_leaves(volume)
    tag = len(commit.BLOCK_TAG) + 12
    return leaf.select(*BLOCK, F.substring("data", tag + 1, 4096).alias("sums"), F.substring("data", tag + 4097, 2048).alias("weights"))


def write_volume(volume: DataFrame, header: dict, path: str, replace: bool = False, magic: bytes | None = None, blocks: DataFrame | None = None) -> str:
    """A fused volume (bx, by, bz, l, tsdf_sum, weight) as magic, header, indices, sums and weights.  Blocks of
    the plan `blocks` without a voxel are held as zeros.  With CHECKPOINT_MAGIC the indices are left out, only their digest
    stays, and the file may replace its predecessor.  Three passes over a kept table, a block at a time."""
    from scanengine.sources.files import VOLUME_MAGIC

    packed = _packed_blocks(volume)
    if blocks is not None:
        packed = blocks.select(*BLOCK).join(packed, BLOCK, "left").select(*BLOCK, F.coalesce("sums", F.unhex(F.lit("00" * 4096))).alias("sums"), F.coalesce("weights", F.unhex(F.lit("00" * 2048))).alias("weights"))
    packed = kept(packed, "volume")
    rows = lambda c: packed.orderBy("bz", "by", "bx").select(*c).toLocalIterator()
    count, digests = 0, {}
    index = lambda r: struct.pack("<3i", r["bx"], r["by"], r["bz"])
    for name, c, of in (("indices", BLOCK, index), ("sums", ["sums"], lambda r: bytes(r["sums"])), ("weights", ["weights"], lambda r: bytes(r["weights"]))):
        h, count = hashlib.sha256(), 0
        for r in rows(c):
            h.update(of(r))
            count += 1
        digests[f"{name}_sha256"] = h.hexdigest()
    seen = volume.where("weight > 0").agg(F.count("*").alias("observed"), F.coalesce(F.max("weight"), F.lit(0)).alias("most")).first()
    head = header | {"blocks": count, "observed_voxels": seen["observed"], "maximum_weight": seen["most"]} | digests
    kind = magic or VOLUME_MAGIC

    def pieces() -> Iterator[bytes]:
        yield contained(kind, head)
        if kind == VOLUME_MAGIC:
            yield from map(index, rows(BLOCK))
        yield from (bytes(r["sums"]) for r in rows(["sums"]))
        yield from (bytes(r["weights"]) for r in rows(["weights"]))

    return publish(path, pieces(), replace)


def load_checkpoint(spark: SparkSession, path: str, plan: DataFrame, expected: dict) -> tuple[dict, DataFrame]:
    """(progress, volume) of a checkpoint of this plan.  Another plan, other fields than `expected`, and arrays that
    do not fit the digests and counts, are refused."""
    data = content(path)
    header, at = opened(data, CHECKPOINT_MAGIC)
    index = [tuple(r) for r in plan.select(*BLOCK).orderBy("bz", "by", "bx").limit(MOST_BLOCKS + 1).collect()]
    n = len(index)
    if header["blocks"] != n or hashlib.sha256(b"".join(struct.pack("<3i", *b) for b in index)).hexdigest() != header["indices_sha256"]:
        raise ArtifactError("the checkpoint belongs to another plan")
    if wrong := [k for k, v in expected.items() if header.get(k) != v]:
        raise ArtifactError(f"the checkpoint belongs to another fusion: {', '.join(wrong)}")
    if len(data) != at + n * 6144:
        raise ArtifactError("the checkpoint's length does not fit its header")
    sums, weights = data[at : at + 4096 * n], data[at + 4096 * n :]
    if hashlib.sha256(sums).hexdigest() != header["sums_sha256"] or hashlib.sha256(weights).hexdigest() != header["weights_sha256"]:
        raise ArtifactError("the arrays do not fit their digests")
    s, w = np.frombuffer(sums, "<f8").reshape(n, 512), np.frombuffer(weights, "<u4").reshape(n, 512)
    if not np.isfinite(s).all() or (np.abs(s) > w).any() or s[w == 0].any() or header["observed_voxels"] != int((w > 0).sum()) or header["maximum_weight"] != int(w.max(initial=0)):
        raise ArtifactError("the sums, weights and counts do not fit each other")
    b, l = np.nonzero(w)
    at_block = np.array(index, np.int32).reshape(n, 3)[b]
    rows = pd.DataFrame({"bx": at_block[:, 0], "by": at_block[:, 1], "bz": at_block[:, 2], "l": l.astype(np.int32), "tsdf_sum": s[b, l], "weight": w[b, l].astype(np.int64)})
    return header, spark.createDataFrame(rows, "bx int, by int, bz int, l int, tsdf_sum double, weight long")


def volume_problems(volume: DataFrame) -> DataFrame:
    """V1: (bx, by, bz, problem) of voxels whose sum is not finite, larger than its weight, or there without any weight."""
    bad = F.when(F.isnan("tsdf_sum") | (F.abs("tsdf_sum") > 1e300), "sum is not finite").when((F.col("weight") <= 0) & (F.col("tsdf_sum") != 0), "a sum without weight").when(F.abs("tsdf_sum") > F.col("weight"), "sum above weight")
    return volume.select(*BLOCK, bad.alias("problem")).where("problem is not null").distinct()


# --- meshes


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str, comments: tuple[str, ...] = (), rows_a_piece: int = 16_384) -> str:
    """K7: vertices (id, x, y, z) and faces (face, v0, v1, v2), numbered without gaps, as a binary PLY; the file's SHA-256.
    Executors pack pieces of rows; the file is put together in their order."""

    def packed(df: DataFrame, key: str, columns: list[str], kind: list) -> DataFrame:
        def pack(table):
            import pyarrow as pa

            t = table.sort_by(key)
            out = np.empty(t.num_rows, dtype=kind)
            for (name, _), c in zip(kind[-len(columns) :], columns):
                out[name] = t[c].to_numpy()
            if len(kind) > len(columns):
                out[kind[0][0]] = 3
            return pa.table({"piece": t["piece"][:1], "data": pa.array([out.tobytes()], pa.binary())})

        return df.withColumn("piece", F.floor(F.col(key) / rows_a_piece)).groupBy("piece").applyInArrow(pack, "piece long, data binary")

    v = kept(packed(vertices, "id", ["x", "y", "z"], [(a, "<f8") for a in "xyz"]), "mesh-vertices")
    f = kept(packed(faces, "face", ["v0", "v1", "v2"], [("n", "u1"), ("a", "<i4"), ("b", "<i4"), ("c", "<i4")]), "mesh-faces")
    head = ["ply", "format binary_little_endian 1.0", *[f"comment {c}" for c in comments], f"element vertex {vertices.count()}", *[f"property double {a}" for a in "xyz"]]
    head += [f"element face {faces.count()}", "property list uchar int vertex_indices", "end_header", ""]

    def pieces() -> Iterator[bytes]:
        yield "\n".join(head).encode("ascii")
        for part in (v, f):
            yield from (bytes(r["data"]) for r in part.orderBy("piece").toLocalIterator())

    return publish(path, pieces())


def ply_header(data: bytes) -> tuple[str, dict[str, int], dict[str, list[str]], list[str], int]:
    """(format, elements, their properties, comments, where the data begins) of a PLY file."""
    end = data.find(b"end_header\n")
    if not data.startswith(b"ply\n") or end < 0:
        raise ArtifactError("not a PLY file")
    kind, elements, properties, comments, now = "", {}, {}, [], ""
    for line in data[:end].decode("ascii", "replace").splitlines()[1:]:
        word, _, rest = line.partition(" ")
        if word == "format":
            kind = rest.split()[0]
        elif word == "comment":
            comments.append(rest)
        elif word == "element":
            now, n = rest.split()
            elements[now], properties[now] = int(n), []
        elif word == "property":
            properties[now].append(rest)
    return kind, elements, properties, comments, end + len(b"end_header\n")


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(vertices (id and the file's properties), faces (face, v0, v1, v2), comments) of a PLY of triangles or of
    points, as text or little-endian binary."""
    data = content(path)
    kind, elements, properties, comments, at = ply_header(data)
    names = [p.split()[-1] for p in properties.get("vertex", [])]
    sizes = {"double": "<f8", "float64": "<f8", "float": "<f4", "float32": "<f4", "uchar": "u1", "uint8": "u1", "int": "<i4", "int32": "<i4"}
    n, m = elements.get("vertex", 0), elements.get("face", 0)
    if kind == "binary_little_endian":
        record = np.dtype([(a, sizes[p.split()[0]]) for a, p in zip(names, properties["vertex"])])
        triangle = np.dtype([("n", "u1"), ("v", "<i4", (3,))])
        if len(data) != at + n * record.itemsize + m * triangle.itemsize:
            raise ArtifactError("the file's length does not fit its header")
        v = np.frombuffer(data, record, n, at)
        f = np.frombuffer(data, triangle, m, at + n * record.itemsize)
        if (f["n"] != 3).any():
            raise ArtifactError("a face is no triangle")
        points, faces = np.column_stack([v[a].astype(np.float64) for a in names]) if n else np.zeros((0, len(names))), f["v"]
    else:
        lines = data[at:].decode("ascii").split("\n")
        points = np.array([x.split() for x in lines[:n]], np.float64).reshape(n, -1)[:, : len(names)]
        faces = np.array([x.split() for x in lines[n : n + m]], np.int64).reshape(m, -1)[:, 1:4] if m else np.zeros((0, 3), np.int64)
    if m and (faces.min() < 0 or faces.max() >= n):
        raise ArtifactError("a face names a vertex that is not there")
    rows = pd.DataFrame(points, columns=names)
    rows.insert(0, "id", np.arange(n))
    tri = pd.DataFrame({"face": np.arange(m), **{f"v{k}": faces[:, k].astype(np.int64) for k in range(3)}})
    vertices = spark.createDataFrame(rows, ", ".join(["id long", *[f"{a} double" for a in names]]))
    return vertices, spark.createDataFrame(tri, "face long, v0 long, v1 long, v2 long"), comments


def check_mesh_source(path: str, volume_digest: str, key: str = "source_volume_sha256") -> dict:
    """A mesh's counts and digest; a mesh that names another volume, or none, is refused."""
    data = content(path)
    _, elements, _, comments, _ = ply_header(data)
    said = [c.split(" ", 1)[1] for c in comments if c.startswith(f"{key} ")]
    if said != [volume_digest]:
        raise ArtifactError(f"the mesh records the volume {said[0] if said else 'none'}, not {volume_digest}")
    return {"sha256": hashlib.sha256(data).hexdigest(), "vertices": elements["vertex"], "triangles": elements["face"]}


# --- manifests and pictures


def write_manifest(measurement: str, metrics: DataFrame, inputs: list[str], path: str, code: dict | None = None) -> str:
    """A result's row of metrics, the digests of the files it came from, and the state of the code."""
    row = metrics.limit(2).collect()
    if len(row) != 1:
        raise ArtifactError("a manifest is of one row of metrics")
    digests = {os.path.basename(p): hashlib.sha256(content(p)).hexdigest() for p in inputs}
    return publish(path, [canonical({"code": code or {}, "inputs": digests, "measurement": measurement, "metrics": row[0].asDict()})])


def encode_png(width: int, height: int, raster: bytes) -> bytes:
    """A picture of 8-bit red, green and blue."""
    if len(raster) != 3 * width * height:
        raise ArtifactError("the raster does not fit the picture")
    lines = b"".join(b"\0" + raster[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 9)) + chunk(b"IEND", b"")


def write_picture(raster: DataFrame, width: int, height: int, path: str, background: tuple[int, int, int] = (255, 255, 255)) -> str:
    """Pixels (px, py, r, g, b, 0 to 255) as a PNG; pixels without a row have the background's colour.  A picture is a
    few million pixels at the most, put together on the driver."""
    out = np.empty((height, width, 3), np.uint8)
    out[:] = background
    t = raster.where(f"px between 0 and {width - 1} and py between 0 and {height - 1}").select("px", "py", *[F.col(c).cast("int").alias(c) for c in "rgb"]).toArrow()
    out[t["py"].to_numpy(), t["px"].to_numpy()] = np.column_stack([t[c].to_numpy() for c in "rgb"])
    return publish(path, [encode_png(width, height, out.tobytes())])


def read_rgb_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, rgb) of 8-bit colour images, three bytes a pixel, an image a row."""
    from scanengine.sources.files import decode_pgm, decode_png

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{ppm,png}").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, data in zip(pdf.path, pdf.content):
                w, h, raw, size = decode_png(data, colours=3) if data[:4] == b"\x89PNG" else decode_pgm(data)
                if size != 1 or len(raw) < 3 * w * h or data[:2] not in (b"P6", b"\x89P"):
                    raise ValueError(f"{name} is no colour image of 8 bits")
                out.append({"path": name, "width": w, "height": h, "rgb": raw[: 3 * w * h]})
            yield pd.DataFrame(out)

    return files.mapInPandas(decode, "path string, width int, height int, rgb binary")


def pixels_of_rgb(images: DataFrame, key: str = "path") -> DataFrame:
    """(key, u, v, r, g, b) of colour images."""
    at = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i")
    p = images.select(key, "width", "rgb", at)
    byte = lambda k: F.conv(F.hex(F.substring("rgb", 3 * F.col("i") + k + 1, F.lit(1))), 16, 10).cast("int")
    return p.select(key, (F.col("i") % F.col("width")).alias("u"), F.floor(F.col("i") / F.col("width")).cast("int").alias("v"), *[byte(k).alias(c) for k, c in enumerate("rgb")])
