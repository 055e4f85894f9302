"""Every query with an SQL twin against it, on the smallest tables; and the invariants of fusion."""

import math
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from scanengine.operators import fuse, vector
from scanengine.plans import registry
from scanengine.plans.fusion_queries import COARSE, blocks
from scanengine.sources import derived
from scanengine.sources.derived import CAMERA

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows_of(df):
    out = []
    for r in df[sorted(df.columns)].astype(object).itertuples(index=False):
        row = []
        for x in r:
            if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("<NA>", "NaT"):
                row.append("None")
            elif isinstance(x, (int, float)) and not isinstance(x, bool):
                row.append(repr(round(float(x), 9) + 0.0))
            else:
                row.append(str(x))
        out.append(tuple(row))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def bits(df):
    import struct

    return {(r.bx, r.by, r.bz, r.l): (struct.pack("<d", r.tsdf_sum), r.weight) for r in df.collect()}


def test_fusion_has_the_same_bits_however_it_is_cut(spark):
    scan, plan = derived.scan(spark, SF).cache(), blocks(spark, SF).cache()
    want = bits(fuse.fuse(scan, plan, CAMERA, COARSE))
    assert want
    for n in (1, 7):
        assert bits(fuse.fuse(scan.repartition(n), plan, CAMERA, COARSE)) == want
    assert bits(fuse.fuse(scan, plan, CAMERA, COARSE, culled=False)) == want
    rows = fuse.contributions(scan, plan, CAMERA, COARSE)
    assert bits(rows.groupBy(*fuse.VOXEL).agg(fuse.ordered_sum("seq", "delta").alias("tsdf_sum"), F.count("*").alias("weight"))) == want
    vector.MOST_SENT, whole = 40, vector.MOST_SENT
    try:
        assert bits(fuse.fuse(scan, plan, CAMERA, COARSE)) == want
    finally:
        vector.MOST_SENT = whole


def test_evaluation_in_numpy_agrees_with_columns(spark):
    scan, plan = derived.scan(spark, SF).cache(), blocks(spark, SF).cache()
    e = fuse.evaluated(scan, plan, CAMERA, COARSE, culled=False).cache()
    code = {n: k for k, n in enumerate(fuse.STATUSES)}
    want = {(r.seq, code[r.status]): r["count"] for r in e.groupBy("seq", "status").count().collect()}
    assert {(r.seq, r.code): r.n for r in vector.status_counts(scan, plan, CAMERA, COARSE).collect()} == want
    t = F.lit(float(COARSE.truncation))
    kind = F.when(F.col("sd") < -t, 1).when(F.col("sd") <= t, 3).when(F.col("sd") > t, 2).otherwise(0)
    want = {tuple(r) for r in e.groupBy(*fuse.VOXEL).agg(F.max(kind)).collect()}
    assert {tuple(r) for r in vector.best_of_voxels(scan, plan, CAMERA, COARSE).collect()} == want
    few = vector.best_kinds(scan, plan, CAMERA, COARSE, flush=70).groupBy(*fuse.BLOCK).count().collect()
    assert any(r["count"] > 1 for r in few)
    want = {tuple(r) for r in e.where("status = 'contributes'").select(*fuse.BLOCK).distinct().collect()}
    assert {tuple(r) for r in fuse.observed_blocks(scan, plan, CAMERA, COARSE).collect()} == want


def test_whole_volumes_and_trees_are_checked(spark):
    leaves = registry.queries()["v3_leaf_hashes"](spark, SF).count()
    assert registry.queries()["v3_merkle_paths"](spark, SF).count() == leaves
    checked = {(r.bx, r.by, r.bz) for r in registry.queries()["j19_all_blocks_check"](spark, SF).collect()}
    seen = {(r.bx, r.by, r.bz) for r in registry.queries()["a1_fuse_blocks_arrow"](spark, SF).select("bx", "by", "bz").distinct().collect()}
    assert checked == seen and len({x for x, _, _ in seen}) > 1


def test_automatic_dense_box_holds_all_surface(spark):
    dense = bits(registry.queries()["m4_auto_dense_tsdf"](spark, SF))
    planned = bits(registry.queries()["a1_fuse_blocks_arrow"](spark, SF))
    assert planned and planned.items() <= dense.items()


def test_empty_scans_give_empty_results(spark):
    scan, plan = derived.scan(spark, SF), blocks(spark, SF)
    assert fuse.fuse(scan.where("1 = 0"), plan, CAMERA, COARSE).count() == 0
    assert fuse.fuse(scan, plan.where("1 = 0"), CAMERA, COARSE).count() == 0


def test_tables_that_change_under_a_path_are_fused_anew(spark, tmp_path):
    from scanengine.plans import registry

    report = registry.queries()["a4_volume_report"]
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    path = f"{tmp_path}/lineitem.parquet"
    items.where("l_orderkey < 800").write.parquet(path)
    first = report(spark, str(tmp_path)).first()
    assert report(spark, str(tmp_path)).first() == first
    items.write.mode("overwrite").parquet(path)
    second = report(spark, str(tmp_path)).first()
    assert second != first and second == report(spark, "/root/testdata/sf0.001").first()


def test_held_out_frames_are_not_in_the_volume_that_they_judge(spark, tmp_path):
    """Other readings in odd frames leave the volume of even ones as it is."""
    from pyspark.sql import functions as F

    from scanengine.plans import fusion_queries

    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    odd = F.floor(F.col("l_orderkey") / 625) % 2 == 1
    items.withColumn("l_quantity", F.when(odd, F.col("l_quantity") + 7).otherwise(F.col("l_quantity"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = lambda sf: sorted(map(tuple, fusion_queries.even_volume(spark, sf).collect()))
    assert rows(str(tmp_path)) == rows("/root/testdata/sf0.001")
