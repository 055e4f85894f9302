"""Commitments, proofs and audits.

Hashes are SHA-256 in built-in functions; trees are tables (level, idx, hash).  What a checker needs of a tree is a join
for each level, never the tree itself.
"""

from __future__ import annotations

import bisect
import math
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanengine.sources.scratch import kept

#: Tags that open the data of a leaf, by kind.
TILE_TAG, FRAME_TAG, BLOCK_TAG, AUDIT_TAG = b"SFTILE01", b"SFFRAME1", b"SFBLOCK1", b"SFAUDIT1"


def sha(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def leaf_hash(data: Column) -> Column:
    """V3: a leaf's hash: a zero byte before its data."""
    return sha(F.concat(F.unhex(F.lit("00")), data.cast("binary")))


def tree(leaves: DataFrame, height: int = 10) -> DataFrame:
    """(level, idx, hash) of all levels over leaves (idx from 0 without gaps, data); an unpaired last node is carried
    up as it is.

    Runs of 2^height nodes grow as many levels in one task, so a tree takes a shuffle for every `height` levels.
    """
    import hashlib

    import pyarrow as pa

    level = kept(leaves.select(F.lit(0).alias("level"), F.col("idx").cast("long").alias("idx"), leaf_hash(F.col("data")).alias("hash")), "leaves")
    n, out, base = level.count(), level, 0
    top = max(0, n - 1).bit_length()
    while base < top:
        step = min(height, top - base)

        def grow(table: pa.Table, base: int = base, step: int = step) -> pa.Table:
            table = table.sort_by("idx")
            first, nodes = table["idx"][0].as_py(), [x.as_py() for x in table["hash"]]
            rows = []
            for k in range(1, step + 1):
                nodes = [hashlib.sha256(b"\x01" + nodes[i] + nodes[i + 1]).digest() if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
                rows += [(base + k, (first >> k) + i, h) for i, h in enumerate(nodes)]
            return pa.table({"level": pa.array([r[0] for r in rows], pa.int32()), "idx": pa.array([r[1] for r in rows], pa.int64()), "hash": pa.array([r[2] for r in rows], pa.binary())})

        run = F.shiftright("idx", step)
        grown = kept(level.groupBy(run.alias("run")).applyInArrow(_one(grow), "level int, idx long, hash binary"), "tree")
        out = out.unionByName(grown)
        base += step
        level = grown.where(F.col("level") == base)
    return out


def _one(grow):
    """grow as a function of a group's rows alone."""
    return lambda table: grow(table)


def root(leaves: DataFrame) -> bytes:
    """The root of leaves (idx, data); of none, the hash of nothing."""
    import hashlib

    t = tree(leaves)
    top = t.orderBy(F.col("level").desc()).limit(1).collect()
    return bytes(top[0]["hash"]) if top else hashlib.sha256(b"").digest()


def paths(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(idx, level, hash): the siblings that prove each wanted leaf (idx), from the bottom; one join over all levels."""
    levels = nodes.agg(F.max("level").alias("top")).first()["top"] or 0
    if levels == 0:
        return nodes.where(F.lit(False)).select("idx", "level", "hash")
    at = wanted.select(F.col("idx").alias("leaf"), F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    at = at.withColumn("idx", F.expr("shiftright(leaf, level)").bitwiseXOR(F.lit(1)))
    return at.join(nodes, ["level", "idx"]).select(F.col("leaf").alias("idx"), "level", "hash")


def root_from_path(leaf: bytes, index: int, count: int, siblings: list[bytes]) -> bytes:
    """V3: the root that a leaf's hash and its siblings lead to; the wrong number of siblings is refused."""
    import hashlib

    h, n, left = leaf, count, list(siblings)
    if not 0 <= index < count:
        raise ValueError("the index is outside the tree")
    while n > 1:
        if index % 2 or index + 1 < n:
            if not left:
                raise ValueError("the path is too short")
            other = left.pop(0)
            h = hashlib.sha256(b"\x01" + (other + h if index % 2 else h + other)).digest()
        index, n = index // 2, (n + 1) // 2
    if left:
        raise ValueError("the path is too long")
    return h


def shared_proof(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """V3: (level, idx, hash): the least nodes from which, with the wanted leaves, the root follows: siblings of what is
    known at each level that are not known themselves."""
    levels = nodes.agg(F.max("level").alias("top")).first()["top"] or 0
    at = wanted.select(F.col("idx").alias("leaf"), F.explode(F.sequence(F.lit(0), F.lit(max(0, levels)))).alias("level"))
    known = at.select("level", F.expr("shiftright(leaf, level)").alias("idx")).distinct()
    need = known.where(F.col("level") < levels).select("level", F.col("idx").bitwiseXOR(F.lit(1)).alias("idx")).join(known, ["level", "idx"], "left_anti")
    return need.join(nodes, ["level", "idx"])


def tiles(px: DataFrame, width: int, height: int, side: int = 16) -> DataFrame:
    """(seq, tile, data): each depth image cut into tiles, row by row; data is the tag and little-endian 16-bit
    readings, 0 where there is none.  Tiles at the right and bottom edge are smaller."""
    across = -(-width // side)
    t = px.select("seq", (F.floor(F.col("v") / side) * across + F.floor(F.col("u") / side)).alias("tile"), "u", "v", F.col("raw").cast("int").alias("raw"))
    packed = t.groupBy("seq", "tile").agg(F.map_from_entries(F.collect_list(F.struct((F.col("v") * width + F.col("u")).alias("i"), "raw"))).alias("m"))
    v0, u0 = F.floor(F.col("tile") / across) * side, F.col("tile") % across * side
    vs = F.sequence(v0, F.least(v0 + side, F.lit(height)) - 1)
    us = F.sequence(u0, F.least(u0 + side, F.lit(width)) - 1)
    order = F.flatten(F.transform(vs, lambda v: F.transform(us, lambda u: (v * width + u).cast("int"))))
    word = lambda x: F.lpad(F.hex(x), 4, "0")
    swap = lambda s: F.concat(F.substring(s, 3, 2), F.substring(s, 1, 2))
    hexed = F.array_join(F.transform(order, lambda i: swap(word(F.coalesce(F.try_element_at("m", i), F.lit(0))))), "")
    return packed.select("seq", F.col("tile").cast("long").alias("tile"), F.concat(F.lit(TILE_TAG), F.unhex(hexed)).alias("data"))


def block_leaf(block: tuple[int, int, int], sums: bytes, weights: bytes) -> bytes:
    """V4: a block's leaf: tag, index, 512 sums and 512 weights in storage order (z, y, x), little-endian."""
    return BLOCK_TAG + struct.pack("<3i", *block) + sums + weights


def block_leaves(volume: DataFrame) -> DataFrame:
    """V4: (bx, by, bz, data): the packed bytes of each block of a volume; voxels not observed are zeros.

    IEEE bytes have no built-in function, so each block is packed in NumPy; a block is 6 KB whatever the scan.
    """
    import numpy as np
    import pyarrow as pa

    def packed(table: pa.Table) -> pa.Table:
        total, weight = np.zeros(512, "<f8"), np.zeros(512, "<u4")
        l = table["l"].to_numpy()
        total[l], weight[l] = table["tsdf_sum"].to_numpy(), table["weight"].to_numpy()
        at = tuple(table[c][0].as_py() for c in ("bx", "by", "bz"))
        data = block_leaf(at, total.tobytes(), weight.tobytes())
        return pa.table([pa.array([x], pa.int32()) for x in at] + [pa.array([data], pa.binary())], names=["bx", "by", "bz", "data"])

    return volume.groupBy("bx", "by", "bz").applyInArrow(packed, "bx int, by int, bz int, data binary")


def frame_leaf(seq: int, pose: list[float] | None, depth_root: bytes | None) -> bytes:
    """V4: a frame's leaf: sequence, flags (1 depth, 2 pose), pose and depth root, zeros for what is missing."""
    flags = (depth_root is not None) + 2 * (pose is not None)
    return FRAME_TAG + struct.pack("<QB", seq, flags) + struct.pack("<16d", *(pose or [0.0] * 16)) + (depth_root or bytes(32))


def numbered(blocks: DataFrame) -> DataFrame:
    """O1: blocks with idx, their place in canonical order (z, y, x): counted by layers, then within them."""
    from pyspark.sql import Window

    layers = blocks.groupBy("bz").agg(F.count("*").alias("n"))
    start = layers.select("bz", F.coalesce(F.sum("n").over(Window.orderBy("bz").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("bz").orderBy("by", "bx")) - 1
    return blocks.withColumn("_k", inside).join(start, "bz").withColumn("idx", F.col("start") + F.col("_k")).drop("_k", "start")


def volume_root(volume: DataFrame) -> bytes:
    """V5: the root over a volume's blocks in canonical order."""
    leaves = block_leaves(volume)
    return root(numbered(leaves).select("idx", "data"))


def statement(fields: dict[str, str]) -> str:
    """A statement's canonical text."""
    import json

    return json.dumps(fields, sort_keys=True, ensure_ascii=True, separators=(",", ":")) + "\n"


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(field, left, right) of two one-row tables where they differ; columns that one lacks count as null there."""
    names = sorted(set(a.columns) | set(b.columns))
    row = lambda d: d.select(*[(F.col(n) if n in d.columns else F.lit(None)).cast("string").alias(n) for n in names])
    long = lambda d, out: row(d).select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias(out)) for n in names])).alias("s")).select("s.*")
    return long(a, "left").join(long(b, "right"), "field").where(~F.col("left").eqNullSafe(F.col("right")))


def sample_blocks(blocks: DataFrame, seed: str, count: int, domain: str = "scanengine.block-sample") -> DataFrame:
    """O3: the `count` blocks with the smallest keyed hashes."""
    key = F.sha2(F.concat(F.lit(f"{domain}/{seed}/"), F.concat_ws(",", "bx", "by", "bz")).cast("binary"), 256)
    return blocks.select("bx", "by", "bz", key.alias("key")).orderBy("key").limit(count)


def little_endian(i: Column) -> Column:
    """Eight bytes of a whole number, the lowest first."""
    h = F.lpad(F.hex(i), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)]))


def draws(statement_digest: bytes, seed: bytes, rows: int, tries: DataFrame) -> DataFrame:
    """(i, row) for draws i: the first eight bytes, lowest first, of a hash of tag, digest, seed and i, modulo rows;
    numbers in the last, incomplete run of rows are rejected, so no row is likelier."""
    stem = AUDIT_TAG + statement_digest + struct.pack("<H", len(seed)) + seed
    h = F.sha2(F.concat(F.lit(stem), little_endian(F.col("id"))), 256)
    number = F.conv(F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)]), 16, 10).cast("decimal(20,0)")
    limit = (1 << 64) // rows * rows
    d = tries.select(F.col("id").alias("i"), number.alias("number")).where(F.col("number") < F.lit(str(limit)).cast("decimal(20,0)"))
    return d.select("i", (F.col("number") % F.lit(rows).cast("decimal(20,0)")).cast("long").alias("row"))


def audit_rows(spark, statement_digest: bytes, seed: bytes, rows: int, count: int) -> DataFrame:
    """The first `count` distinct rows drawn, in ascending order of draw: (row, i)."""
    if not 0 <= count <= rows:
        raise ValueError("an audit draws at most every row")
    n = max(16, 2 * count)
    while True:
        got = draws(statement_digest, seed, rows, spark.range(n)).groupBy("row").agg(F.min("i").alias("i"))
        if count == 0 or got.count() >= count:
            return got.orderBy("i").limit(count)
        n *= 2


def wrong_blocks_caught(blocks: int, drawn: int, one_in: int = 100) -> int:
    """The least number of wrong blocks that a draw misses at most one time in `one_in`; exact, in whole numbers.

    A draw of d of n blocks misses w wrong ones with probability (n-d)(n-d-1).../(n(n-1)...), w factors on each side; as w
    and d may change places there, the shorter product will do.
    """
    if min(drawn, one_in) < 1 or drawn > blocks:
        raise ValueError("an audit draws at least one block and at most all")

    def caught(wrong: int) -> bool:
        few, many = sorted((wrong, drawn))
        return one_in * math.perm(blocks - many, few) <= math.perm(blocks, few)

    return 1 + bisect.bisect_left(range(1, blocks - drawn + 1), True, key=caught)


def evidence(e: DataFrame) -> DataFrame:
    """How many pixels each block of an evaluation reads in each frame, and of how many voxels."""
    return e.where("status not in ('camera-z-nonpositive', 'projection-outside-image')").groupBy("bx", "by", "bz", "seq").agg(F.count("*").alias("voxels"))


def check_path_proofs(leaves: DataFrame, proof: DataFrame, count: int, expected: bytes) -> DataFrame:
    """(idx, verdict): each leaf (idx, data) against a root by its path (idx, level, hash).

    verified, refuted (the root differs) or invalid (the path does not fit the tree).  A path is at most 64 hashes, so
    each leaf is checked on its own.
    """
    import hashlib

    p = proof.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("level", "hash"))).alias("path"))
    both = leaves.select("idx", F.col("data").cast("binary").alias("data")).join(p, "idx", "left")

    def verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, data, path in zip(pdf.idx, pdf.data, pdf.path):
                steps = [] if path is None else [bytes(s["hash"]) for s in path]
                try:
                    got = root_from_path(hashlib.sha256(b"\x00" + bytes(data)).digest(), int(i), count, steps)
                    out.append("verified" if got == expected else "refuted")
                except ValueError:
                    out.append("invalid")
            yield pd.DataFrame({"idx": pdf.idx, "verdict": out})

    return both.mapInPandas(verdicts, "idx long, verdict string")


def pack(data: bytes) -> bytes:
    """V16, S17."""
    return zlib.compress(data, 9)


def unpack(data: bytes, most: int) -> bytes:
    """Exactly one stream, of at most `most` bytes, and nothing after it."""
    d = zlib.decompressobj()
    out = d.decompress(data, most + 1)
    if len(out) > most or not d.eof or d.unused_data or d.unconsumed_tail:
        raise ValueError("a packed proof is too large, cut short or followed by other bytes")
    return out


def held_blocks_verdict(blocks: DataFrame, proof: DataFrame, count: int, map_root: bytes, refused: DataFrame) -> DataFrame:
    """One row: verified, refuted (with a block that differs) or invalid, over all held blocks.

    blocks: idx, data; proof: paths into the map's root; refused: (bx, by, bz, verdict) of the blocks fused again from the
    pixels they read, as compare_volumes gives it.  A wrong root or path makes a proof invalid; only a block whose fusion
    differs refutes the map.
    """
    checked = check_path_proofs(blocks, proof, count, map_root)
    bad = checked.agg(F.count_if(F.col("verdict") != "verified").alias("broken"))
    wrong = refused.agg(F.count_if(F.col("verdict") != "identical").alias("different"), F.min(F.when(F.col("verdict") != "identical", F.struct("bz", "by", "bx"))).alias("first"))
    both = bad.crossJoin(wrong)  # a row each
    verdict = F.when(F.col("broken") > 0, "invalid").when(F.col("different") > 0, "refuted").otherwise("verified")
    return both.select(verdict.alias("verdict"), "broken", "different", F.col("first.bx").alias("bx"), F.col("first.by").alias("by"), F.col("first.bz").alias("bz"))


def route_verdict(held: DataFrame, clearance: DataFrame) -> DataFrame:
    """Clear or not-clear for a route whose blocks are verified, else what the blocks say."""
    h = held.select(F.col("verdict").alias("held"))
    c = clearance.select(F.col("verdict").alias("clear"), "unobserved", "occupied")
    return h.crossJoin(c).select(F.when(F.col("held") == "verified", F.col("clear")).otherwise(F.col("held")).alias("verdict"), "unobserved", "occupied")


def audit_verdict(drawn: DataFrame, answered: DataFrame, held: DataFrame) -> DataFrame:
    """An audit's answer must hold exactly the rows drawn; then the held blocks decide."""
    odd = drawn.select("row").join(answered.select("row"), "row", "full_outer").count()
    both = drawn.select("row").intersect(answered.select("row")).count()
    return held.select(F.when(F.lit(odd != both), "invalid").otherwise(F.col("verdict")).alias("verdict"))
