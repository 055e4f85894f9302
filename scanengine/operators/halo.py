"""Blocks of voxels with what they need of their neighbours.

A cell reaches one voxel beyond its lowest corner, so a block's cells need, beside its 8 by 8 by 8 voxels, the nearest face,
edge or corner voxels of seven neighbours.  Those alone are sent, 217 for a full block, so that everything that asks for
neighbouring voxels is one shuffle of 1.4 rows a voxel and work on whole arrays inside of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanengine.functions import geometry as g

BLOCK = ["bx", "by", "bz"]
#: Blocks whose voxels are laid out at once: some ten megabytes.
LAID = 512
#: Voxels along a side of a block with its halo.
REACH = 9


def padded(v: DataFrame) -> DataFrame:
    """(bx, by, bz, s): each block that holds, or lies before, voxels of v (gx, gy, gz, value), with those that its cells
    can touch: s has their places in 9 by 9 by 9, x fastest, and values, in no order.

    A voxel with a local coordinate of 0 goes to the blocks before it too; the rest stays within its block.
    """
    part = {a: g.local_part(F.col(f"g{a}")) for a in "xyz"}
    first: Column = F.lit(0)
    for k, a in enumerate("xyz"):
        first = first + F.when(part[a] == 0, 1 << k).otherwise(0)
    sent = v.select("gx", "gy", "gz", "value", first.alias("first"), F.explode(F.array(*[F.lit(k) for k in range(8)])).alias("to"))
    sent = sent.where(F.col("first").bitwiseAND(F.col("to")) == F.col("to"))
    bit = {a: F.shiftright("to", k).bitwiseAND(F.lit(1)) for k, a in enumerate("xyz")}
    at = sum(((part[a] + 8 * bit[a]) * REACH**k for k, a in enumerate("xyz")), F.lit(0)).cast("short")
    block = [(g.block_part(F.col(f"g{a}")) - bit[a]).cast("long").alias(f"b{a}") for a in "xyz"]
    return sent.select(*block, F.struct(at.alias("at"), F.col("value").cast("double").alias("value")).alias("s")).groupBy(*BLOCK).agg(F.collect_list("s").alias("s"))


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(blocks, value, known) of a few padded blocks at a time; the last two by block, z, y, x."""
    for batch in batches:
        for k in range(0, batch.num_rows, LAID):
            some = batch.slice(k, LAID)
            lists, n = some.column(3), some.num_rows
            each = lists.flatten()
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = each.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
            value, known = np.zeros((n, REACH**3)), np.zeros((n, REACH**3), bool)
            value[row, at] = each.field("value").to_numpy(zero_copy_only=False)
            known[row, at] = True
            b = np.stack([some.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1).astype(np.int64)
            yield b, value.reshape(n, REACH, REACH, REACH), known.reshape(n, REACH, REACH, REACH)


def _corner(a: np.ndarray, k: int) -> np.ndarray:
    """The voxels at corner k of every cell of the blocks."""
    x, y, z = k & 1, k >> 1 & 1, k >> 2
    return a[:, z : z + 8, y : y + 8, x : x + 8]


def _places(b: np.ndarray, where: tuple[np.ndarray, ...]) -> list[pa.Array]:
    n, z, y, x = where
    return [pa.array(b[n, i] * g.SIDE + c) for i, c in enumerate((x, y, z))]


def cells(v: DataFrame, active: bool = False) -> DataFrame:
    """(gx, gy, gz, known, values) of cells, by their lowest corner, of which a corner is known: how many are, and the values
    of the eight, null where unknown.  active: only cells whose corners are all known and not zero and differ in sign."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, value, known in _laid(batches):
            count = sum(_corner(known, k).astype(np.int8) for k in range(8))
            if active:
                low = sum((_corner(value, k) < 0).astype(np.int8) for k in range(8))
                zero = sum((_corner(value, k) == 0).astype(np.int8) for k in range(8))
                where = np.nonzero((count == 8) & (zero == 0) & (low > 0) & (low < 8))
            else:
                where = np.nonzero(count > 0)
            of = lambda a: np.stack([_corner(a, k)[where] for k in range(8)], 1).ravel()  # noqa: B023, E731
            flat = pa.array(of(value), mask=None if active else ~of(known))
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 8, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*_places(b, where), pa.array(count[where].astype(np.int64)), values], ["gx", "gy", "gz", "known", "values"])

    return padded(v).mapInArrow(work, "gx long, gy long, gz long, known long, values array<double>")


def crossings(v: DataFrame) -> DataFrame:
    """(kind, gx, gy, gz, value, next): voxels that are exactly zero (kind 0, next null), and those whose next one along x, y or
    z (kind 1 to 3) is known and of strictly other sign."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, value, known in _laid(batches):
            own, mine = _corner(value, 0), _corner(known, 0)
            for kind in range(4):
                if kind:
                    after = _corner(value, 1 << (kind - 1))
                    with np.errstate(invalid="ignore", over="ignore"):
                        hit = mine & _corner(known, 1 << (kind - 1)) & (own * after < 0)
                else:
                    hit = mine & (own == 0)
                where = np.nonzero(hit)
                n = len(where[0])
                following = pa.array(after[where]) if kind else pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *_places(b, where), pa.array(own[where]), following], ["kind", "gx", "gy", "gz", "value", "next"])

    return padded(v).mapInArrow(work, "kind int, gx long, gy long, gz long, value double, next double")
