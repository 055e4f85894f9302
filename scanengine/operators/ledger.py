"""A Merkle tree that grows by appending (A24, T9): a range of perfect trees, their peaks, and the root that they give.

A node (level, idx) is complete when all 2^level leaves below it are there, and never changes after.  So what a batch of
leaves adds are the nodes that it completes; of all earlier nodes it needs the peaks alone, one for each bit of their
number.  The peaks, folded from the right, give the same root as commit.tree over all leaves.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanengine.sources.scratch import kept

NODES = "level int, idx long, hash binary"
Peaks = dict[int, bytes]


def record(*fields: Column) -> Column:
    """Fields as one string that no other fields give: each with its length in bytes, `-` for null."""
    each = [F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.concat(*[F.concat(x, F.lit(";")) for x in each])


def peak_indices(n: int) -> list[tuple[int, int]]:
    """(level, idx) of the peaks of n leaves, the largest first."""
    return [(k, (n >> k) - 1) for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def root_of_peaks(peaks: Peaks) -> bytes:
    """The root of all leaves under some peaks; of none, the hash of nothing."""
    out = None
    for k in sorted(peaks):
        out = peaks[k] if out is None else hashlib.sha256(b"\x01" + peaks[k] + out).digest()
    return hashlib.sha256(b"").digest() if out is None else out


def append(leaves: DataFrame, before: int, peaks: Peaks, height: int = 10) -> tuple[DataFrame, int, Peaks]:
    """(nodes, n, peaks): what leaves (idx from `before` without gaps, hash) complete in a tree of `before` leaves that has
    these peaks; how many leaves there are now, and their peaks.

    nodes has the leaves as level 0.  Runs of 2^height nodes grow as many levels in one task; peaks, at most 64, reach the
    driver.  Peaks that are not those of `before` leaves are refused.
    """
    if sorted(peaks) != sorted(k for k, _ in peak_indices(before)):
        raise ValueError(f"these are not the peaks of {before} leaves")
    out = level = kept(leaves.select(F.lit(0).alias("level"), F.col("idx").cast("long").alias("idx"), F.col("hash").cast("binary").alias("hash")), "ledger")
    span = level.agg(F.count("*").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi")).first()
    n = before + span["n"]
    if span["n"] and (span["lo"], span["hi"]) != (before, n - 1):
        raise ValueError(f"leaves must be numbered from {before} without gaps")
    base = 0
    while span["n"] and (n >> base) > (before >> base) and n >> (base + 1):

        def grow(table: pa.Table, base: int = base) -> pa.Table:
            table = table.sort_by("idx")
            first, nodes = table["idx"][0].as_py(), [x.as_py() for x in table["hash"]]
            rows = []
            for k in range(base, base + height):
                # the node before the first new one is an earlier peak if it is a left child
                if nodes and first % 2:
                    nodes, first = [peaks[k], *nodes], first - 1
                nodes = [hashlib.sha256(b"\x01" + nodes[i] + nodes[i + 1]).digest() for i in range(0, len(nodes) - 1, 2)]
                first //= 2
                rows += [(k + 1, first + i, h) for i, h in enumerate(nodes)]
            return pa.table({"level": pa.array([r[0] for r in rows], pa.int32()), "idx": pa.array([r[1] for r in rows], pa.int64()), "hash": pa.array([r[2] for r in rows], pa.binary())})

        grown = kept(level.groupBy(F.shiftright("idx", height)).applyInArrow(_alone(grow), NODES), "ledger")
        out = out.unionByName(grown)
        base += height
        level = grown.where(F.col("level") == base)
    wanted = [(k, i) for k, i in peak_indices(n) if not (before >> k and i == (before >> k) - 1 and k in peaks)]
    now = {k: h for k, h in peaks.items() if (k, (before >> k) - 1) in peak_indices(n)}
    if wanted:
        is_peak = F.lit(False)
        for k, i in wanted:
            is_peak |= (F.col("level") == k) & (F.col("idx") == i)
        now |= {r["level"]: bytes(r["hash"]) for r in out.where(is_peak).collect()}
    return out, n, now


def _alone(grow):
    """grow as a function of a group's rows alone."""
    return lambda table: grow(table)


def inclusion(nodes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(idx, level, hash): for each wanted leaf (idx), its siblings up to its peak, from the bottom; one join over all levels.
    nodes: those of all batches."""
    at = wanted.where(F.col("idx") < n).select(F.col("idx").alias("leaf"), F.explode(F.sequence(F.lit(0), F.lit(max(0, n.bit_length() - 1)))).alias("level"))
    # a leaf lies below the peak of the highest bit in which n and it differ
    at = at.withColumn("idx", F.expr("shiftright(leaf, level)").bitwiseXOR(F.lit(1))).where(F.expr(f"shiftright(leaf, level + 1) < shiftright({n}L, level + 1)"))
    return at.join(nodes, ["level", "idx"]).select(F.col("leaf").alias("idx"), "level", "hash")


def check_inclusion(leaf: bytes, idx: int, n: int, siblings: list[bytes], peaks: Peaks, root: bytes) -> bool:
    """Whether a leaf lies at idx among the n leaves of a root; siblings or peaks too few or too many are refused."""
    if not 0 <= idx < n or sorted(peaks) != sorted(k for k, _ in peak_indices(n)) or root_of_peaks(peaks) != root:
        return False
    level = next(k for k, i in peak_indices(n) if idx >> k == i)
    if len(siblings) != level:
        return False
    h = leaf
    for k, other in enumerate(siblings):
        h = hashlib.sha256(b"\x01" + (other + h if idx >> k & 1 else h + other)).digest()
    return h == peaks[level]
