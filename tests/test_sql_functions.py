"""Functions, table functions and formats that SQL can call, against the operators they stand for."""

import random
import struct

from pyspark.sql import functions as F

from scanengine.functions import sql
from scanengine.operators import commit, freespace, rays
from scanengine.sources import artifacts, files


def test_functions_and_table_functions(spark):
    sql.register(spark)
    got = spark.sql("SELECT pack_f64_le(array(1.5D, -0.25D)) AS p, merkle_root(array(binary('a'), binary('b'), binary('c'))) AS r, merkle_root(array()) AS e").first()
    leaves = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx long, data string")
    assert bytes(got.p) == struct.pack("<2d", 1.5, -0.25) and bytes(got.r) == commit.root(leaves) and bytes(got.e) == commit.root(leaves.where("1 = 0"))
    r = random.Random(1)
    ends = [tuple(r.randrange(-6, 7) for _ in range(4)) for _ in range(12)]
    w = spark.createDataFrame([(k, *e) for k, e in enumerate(ends)], "leg int, a0 long, b0 long, a1 long, b1 long")
    w.createOrReplaceTempView("legs")
    got = spark.sql("SELECT leg, step, a, b FROM legs, LATERAL cell_line(a0, b0, a1, b1)").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, freespace.chain(w).collect()))
    s = spark.createDataFrame([(k, *[r.uniform(-2, 2) for _ in range(6)]) for k in range(30)], "k long, ax double, ay double, az double, zx double, zy double, zz double")
    s.createOrReplaceTempView("segments")
    want = rays.with_path(s, ("ax", "ay", "az"), ("zx", "zy", "zz"), 0.7).select("k", F.posexplode("path").alias("step", "p")).select("k", "step", "p.*")
    got = spark.sql("SELECT k, step, bx, by, bz FROM segments, LATERAL ray_blocks(ax, ay, az, zx, zy, zz, 0.7D)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_volumes_are_read_in_ranges_of_blocks(spark, tmp_path):
    sql.register(spark)
    r = random.Random(7)
    rows = [(x, 0, z, l, r.choice([-0.5, 0.25]), 1) for x in range(5) for z in range(2) for l in r.sample(range(512), 9)]
    v = spark.createDataFrame(rows, "bx int, by int, bz int, l int, tsdf_sum double, weight long")
    path = str(tmp_path / "v.vol")
    artifacts.write_volume(v, {"session": "s"}, path)
    got = spark.read.format("block-volume").option("blocksAPartition", 3).load(path)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == sorted(rows) == sorted(map(tuple, files.read_volumes(spark, path).drop("path").collect()))
