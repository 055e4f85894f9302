"""Appended trees against trees made at once."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from scanengine.operators import commit, ledger


def plain_root(leaves):
    """By the definition: the largest power of two to the left."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << ((len(leaves) - 1).bit_length() - 1)
    return hashlib.sha256(b"\x01" + plain_root(leaves[:k]) + plain_root(leaves[k:])).digest()


def leaf(i):
    return hashlib.sha256(b"\x00" + str(i).encode()).digest()


def rows(spark, lo, hi):
    d = spark.range(lo, hi).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("data"))
    return d.select("idx", commit.leaf_hash(F.col("data")).alias("hash")).repartition(3)


@pytest.mark.parametrize("steps", [[0, 1, 2, 3], [5, 5, 8, 9], [7, 64], [33, 34, 35, 96]])
def test_batches_give_the_tree_of_all(spark, steps):
    n, peaks, nodes = 0, {}, None
    for upto in steps:
        new, n, peaks = ledger.append(rows(spark, n, upto), n, peaks, height=3)
        nodes = new if nodes is None else nodes.unionByName(new)
        assert n == upto
        assert ledger.root_of_peaks(peaks) == plain_root([leaf(i) for i in range(n)])
    found = {(r.level, r.idx): bytes(r.hash) for r in nodes.collect()}
    # every complete node once
    assert len(found) == nodes.count() and set(found) == {(k, i) for k in range(8) for i in range(n >> k)}
    root = ledger.root_of_peaks(peaks)
    if n:
        assert root == commit.root(spark.range(n).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("data")))
    wanted = sorted(random.Random(1).sample(range(n), min(n, 6)))
    paths = {}
    for r in ledger.inclusion(nodes, spark.createDataFrame([(i,) for i in wanted], "idx long"), n).orderBy("idx", "level").collect():
        paths.setdefault(r.idx, []).append(bytes(r.hash))
    for i in wanted:
        path = paths.get(i, [])
        assert ledger.check_inclusion(leaf(i), i, n, path, peaks, root)
        assert not ledger.check_inclusion(leaf(i + 1), i, n, path, peaks, root)
        assert not ledger.check_inclusion(leaf(i), i, n, [*path, root], peaks, root)
        assert not path or not ledger.check_inclusion(leaf(i), i, n, path[:-1], peaks, root)
        assert not ledger.check_inclusion(leaf(i), i, n, path, peaks, leaf(0) if n > 1 else leaf(9))


def test_foreign_peaks_and_gaps_are_refused(spark):
    with pytest.raises(ValueError):
        ledger.append(rows(spark, 3, 4), 3, {0: leaf(0)})
    with pytest.raises(ValueError):
        ledger.append(rows(spark, 1, 3), 0, {})


def test_records_differ_where_fields_do(spark):
    d = spark.createDataFrame([("a", "b"), ("a;1:b", None), (None, "a"), ("", ""), ("-", None), (None, None), ("é", "b")], "x string, y string")
    got = [r[0] for r in d.select(ledger.record(F.col("x"), F.col("y"))).collect()]
    assert len(set(got)) == len(got) and got[0] == "1:a;1:b;" and got[-1] == "2:é;1:b;"
