"""What SQL users of the engine can call: functions, table functions and data sources of a session.

    register(spark)
    spark.sql("SELECT * FROM cell_line(0, 0, 5, 9)")
    spark.read.format("block-volume").load("map.vol")
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def packed_doubles(values: pd.Series) -> pd.Series:
    """The little-endian bytes of an array of doubles."""
    return values.map(lambda v: None if v is None else struct.pack(f"<{len(v)}d", *v))


def merkle_roots(leaves: pd.Series) -> pd.Series:
    """The root over an array of leaf data: zero byte before leaves, one before nodes, a lone last node carried up."""

    def root(data) -> bytes | None:
        if data is None:
            return None
        level = [hashlib.sha256(b"\x00" + bytes(x)).digest() for x in data]
        while len(level) > 1:
            level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else hashlib.sha256(b"").digest()

    return leaves.map(root)


class CellLine:
    """The cells of the line between two cells, ends included (G8): along the longer axis cell by cell, along the other to the
    cell that the line's error asks for."""

    def eval(self, a0: int, b0: int, a1: int, b1: int) -> Iterator[tuple[int, int, int]]:
        da, db = abs(a1 - a0), abs(b1 - b0)
        a, b, error = a0, b0, da - db
        for step in range(max(da, db) + 1):
            yield step, a, b
            twice = 2 * error
            if twice > -db:
                error, a = error - db, a + (a1 > a0) - (a1 < a0)
            if twice < da:
                error, b = error + da, b + (b1 > b0) - (b1 < b0)


class RayBlocks:
    """The blocks that a closed segment passes, in order (G5): a block for each distinct fraction of the way at which planes
    between blocks are crossed."""

    def eval(self, x0: float, y0: float, z0: float, x1: float, y1: float, z1: float, extent: float) -> Iterator[tuple[int, int, int, int]]:
        def block(c: float) -> int:
            i = math.floor(c / extent)
            return i - 1 if i * extent > c else i + 1 if (i + 1) * extent <= c else i

        first, crossed = [], []
        for c, e in ((x0, x1), (y0, y1), (z0, z1)):
            b, last = block(c), block(e)
            planes = range(b + 1, last + 1) if last > b else range(b, last, -1)
            first.append((b, 1 if last > b else -1))
            crossed.append([(p * extent - c) / (e - c) for p in planes])
        for step, t in enumerate([-math.inf, *sorted({t for ts in crossed for t in ts})]):
            yield (step, *(b + s * sum(x <= t for x in ts) for (b, s), ts in zip(first, crossed)))


class _Blocks(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _VolumeReader(DataSourceReader):
    """Reads a volume file's blocks in ranges, each from its own places in the file."""

    def __init__(self, options):
        self.path, self.each = options["path"], int(options.get("blocksapartition", 4096))

    def _open(self):
        from scanengine.sources import artifacts
        from scanengine.sources.files import VOLUME_MAGIC

        f = open(self.path.removeprefix("file://"), "rb")
        head = f.read(16)
        header, _ = artifacts.opened(head + f.read(struct.unpack("<Q", head[8:16])[0]) if head[:8] == VOLUME_MAGIC else head, VOLUME_MAGIC)
        return f, header, f.tell()

    def partitions(self):
        f, header, _ = self._open()
        f.close()
        return [_Blocks(k, min(k + self.each, header["blocks"])) for k in range(0, header["blocks"], self.each)]

    def read(self, part):
        import numpy as np

        f, header, at = self._open()
        with f:
            n, count = header["blocks"], part.last - part.first

            def array(start: int, size: int, kind: str):
                f.seek(at + start + part.first * size)
                return np.frombuffer(f.read(count * size), kind).reshape(count, -1)

            index, sums, weights = array(0, 12, "<i4"), array(12 * n, 4096, "<f8"), array((12 + 4096) * n, 2048, "<u4")
            for b, s, w in zip(index.tolist(), sums, weights):
                for k in np.flatnonzero(w).tolist():
                    yield (*b, k, float(s[k]), int(w[k]))


class VolumeSource(DataSource):
    """Format block-volume: (bx, by, bz, l, tsdf_sum, weight) of a volume file, in ranges of blocks."""

    @classmethod
    def name(cls) -> str:
        return "block-volume"

    def schema(self) -> str:
        return "bx int, by int, bz int, l int, tsdf_sum double, weight long"

    def reader(self, schema):
        return _VolumeReader(self.options)


def register(spark: SparkSession) -> None:
    """Registers pack_f64_le, merkle_root, cell_line, ray_blocks and the format block-volume in a session."""
    spark.udf.register("pack_f64_le", F.pandas_udf(packed_doubles, "binary"))
    spark.udf.register("merkle_root", F.pandas_udf(merkle_roots, "binary"))
    spark.udtf.register("cell_line", F.udtf(CellLine, returnType="step int, a long, b long"))
    spark.udtf.register("ray_blocks", F.udtf(RayBlocks, returnType="step int, bx int, by int, bz int"))
    spark.dataSource.register(VolumeSource)
