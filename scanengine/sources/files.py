"""File formats: text sequences, images, meshes, volumes and packed proofs."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanengine.operators.replay import nanoseconds

#: How a volume file begins.
VOLUME_MAGIC = b"SFTVOL01"


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """(ts, path, line) of a sequence's image list: decimal seconds and a path; comments and blank lines are skipped."""
    t = spark.read.text(path).where("value not like '#%' and trim(value) <> ''")
    p = F.split(F.trim("value"), r"\s+")
    return t.select(nanoseconds(p[0]).alias("ts"), p[1].alias("path"), F.size(p).alias("fields"))


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """(ts, tx, ty, tz, qx, qy, qz, qw)."""
    t = spark.read.text(path).where("value not like '#%' and trim(value) <> ''")
    p = F.split(F.trim("value"), r"\s+")
    return t.select(nanoseconds(p[0]).alias("ts"), *[p[k + 1].cast("double").alias(n) for k, n in enumerate(("tx", "ty", "tz", "qx", "qy", "qz", "qw"))])


def other_hand(poses: DataFrame) -> DataFrame:
    """Poses given with the other handedness, as text and without rounding: (qx, qy, qz, qw) becomes (qw, qz, qy, qx)
    and tz changes sign."""
    flip = F.when(F.col("tz").startswith("-"), F.substring("tz", 2, 1000)).otherwise(F.concat(F.lit("-"), "tz"))
    return poses.select("ts", "tx", "ty", flip.alias("tz"), F.col("qw").alias("qx"), F.col("qz").alias("qy"), F.col("qy").alias("qz"), F.col("qx").alias("qw"))


def decode_pgm(data: bytes) -> tuple[int, int, bytes, int]:
    """(width, height, raster, bytes a sample) of a binary PGM or PPM without comments in the raster."""
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    return width, height, data[at + 1 :], 2 if most > 255 else 1


def decode_png(data: bytes, colours: int = 1) -> tuple[int, int, bytes, int]:
    """(width, height, raster, bytes a sample) of a PNG of 8 or 16 bits, not interlaced: grey, or of 3 colours."""
    import numpy as np

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, head = 8, b"", None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    width, height, depth, colour, _, _, interlace = head
    if colour != {1: 0, 3: 2}[colours] or depth not in (8, 16) or interlace:
        raise ValueError("only whole images of 8 or 16 bits are read, grey or of three colours")
    sample = depth // 8
    size, across = colours * sample, width * colours * sample
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + across)
    out = np.zeros((height, across), np.uint8)
    above = np.zeros(across, np.int64)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if kind == 2:
            line = (line + above) & 255
        elif kind:
            for x in range(len(line)):
                left = line[x - size] if x >= size else 0
                up, corner = above[x], above[x - size] if x >= size else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = left if a <= b and a <= c else up if b <= c else corner
                line[x] = (line[x] + guess) & 255
        out[y] = above = line
    return width, height, out.tobytes(), sample


def read_depth_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, depth) of 16-bit images, a row-major array each, an image a row."""
    import numpy as np

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pgm,png}").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, data in zip(pdf.path, pdf.content):
                w, h, raw, size = decode_png(data) if data[:4] == b"\x89PNG" else decode_pgm(data)
                if size != 2 or len(raw) < 2 * w * h:
                    raise ValueError(f"{name} is no 16-bit image")
                out.append({"path": name, "width": w, "height": h, "depth": np.frombuffer(raw, ">u2", w * h).astype(np.int32)})
            yield pd.DataFrame(out)

    return files.mapInPandas(decode, "path string, width int, height int, depth array<int>")


def pixels_of(images: DataFrame) -> DataFrame:
    """(path, u, v, raw) of depth images."""
    p = images.select("path", "width", F.posexplode("depth").alias("i", "raw"))
    return p.select("path", (F.col("i") % F.col("width")).alias("u"), F.floor(F.col("i") / F.col("width")).cast("int").alias("v"), "raw")


def number(c: Column) -> Column:
    """A coordinate with nine decimals; what would print as minus zero prints as zero."""
    return F.format_string("%.9f", F.when(F.abs(c) < 0.5e-9, F.lit(0.0)).otherwise(c))


def write_points_ply(points: DataFrame, path: str, columns: tuple[str, ...] = ("x", "y", "z"), comments: tuple[str, ...] = (), order: list[str] | None = None) -> None:
    """Points as text PLY in parts: part 0 is the header, the others follow in order; an existing path is
    refused, and nothing appears under it unless all is written."""
    n = points.count()
    head = ["ply", "format ascii 1.0", *[f"comment {c}" for c in comments], f"element vertex {n}", *[f"property double {c}" for c in columns], "end_header"]
    spark = points.sparkSession
    body = (points.orderBy(*order) if order else points).select(F.concat_ws(" ", *[number(F.col(c)) for c in columns]).alias("value"))
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).union(body).write.mode("errorifexists").text(path)


def read_points_ply(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z, ...) of a text PLY: the columns its header names."""
    lines = spark.read.text(path)
    head = [r["value"] for r in lines.where("value rlike '^(ply|format|comment|element|property|end_header)'").collect()]
    names = [h.split()[-1] for h in head if h.startswith("property") and "list" not in h]
    rows = lines.where("value rlike '^-?[0-9]'").select(F.split(F.trim("value"), r"\s+").alias("p"))
    return rows.where(F.size("p") >= len(names)).select(*[F.col("p")[k].cast("double").alias(n) for k, n in enumerate(names)])


def encode_volume(header: dict, blocks: list[tuple[int, int, int]], sums: bytes, weights: bytes) -> bytes:
    """K5: magic, length of the header, canonical header, then block indices, sums and weights, little-endian."""
    head = (json.dumps(header, sort_keys=True, ensure_ascii=True, separators=(",", ":")) + "\n").encode()
    index = b"".join(struct.pack("<3i", *b) for b in blocks)
    return VOLUME_MAGIC + struct.pack("<Q", len(head)) + head + index + sums + weights


def decode_volume(data: bytes) -> tuple[dict, object, object, object]:
    """(header, indices, sums, weights); a file that is cut short, too long or holds impossible voxels is refused."""
    import numpy as np

    if data[:8] != VOLUME_MAGIC:
        raise ValueError("not a volume")
    (n,) = struct.unpack("<Q", data[8:16])
    header = json.loads(data[16 : 16 + n])
    count, at = header["blocks"], 16 + n
    if len(data) != at + count * (12 + 512 * 12):
        raise ValueError("a volume's length does not fit its header")
    index = np.frombuffer(data, "<i4", 3 * count, at).reshape(count, 3)
    sums = np.frombuffer(data, "<f8", 512 * count, at + 12 * count).reshape(count, 512)
    weights = np.frombuffer(data, "<u4", 512 * count, at + count * (12 + 4096)).reshape(count, 512)
    if not np.isfinite(sums).all() or (np.abs(sums) > weights).any() or sums[weights == 0].any():
        raise ValueError("a volume's sums do not fit its weights")
    return header, index, sums, weights


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bx, by, bz, l, tsdf_sum, weight) of observed voxels of volume files."""
    import numpy as np

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf.path, pdf.content):
                _, index, sums, weights = decode_volume(data)
                for b, s, w in zip(index, sums, weights):
                    k = np.flatnonzero(w)
                    yield pd.DataFrame({"path": name, "bx": b[0], "by": b[1], "bz": b[2], "l": k.astype(np.int32), "tsdf_sum": s[k], "weight": w[k].astype(np.int64)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "path string, bx int, by int, bz int, l int, tsdf_sum double, weight long")
