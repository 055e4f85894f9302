"""The jobs over growing copies of the given tables: two runs, reruns, broken runs, refused rows, and their SQL twins."""

import hashlib
import json
import logging
import math

import pytest
from pyspark.sql import functions as F

from jobs import evidence_ledger, map_release
from scanengine.operators import ledger

SF = "/root/testdata/sf0.001"


def rows_of(df):
    out = []
    for r in df[sorted(df.columns)].astype(object).itertuples(index=False):
        out.append(tuple("None" if x is None or isinstance(x, float) and math.isnan(x) or str(x) == "<NA>" else repr(round(float(x), 9)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r))
    return sorted(out)


def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["job1_evidence_ledger", "job2_map_release"])
def test_jobs_equal_sql(spark, name):
    import __spark_entry__

    settings = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    found = __spark_entry__.queries()[name](spark, SF).toPandas()
    assert len(found) and rows_of(found) == rows_of(duck().execute(__spark_entry__.oracle_sql()[name]).df())
    assert settings == {k: spark.conf.get(k) for k in settings}


def leaf(key, *fields):
    part = lambda x: "-;" if x is None else f"{len(str(x).encode())}:{x};"
    return hashlib.sha256(b"\x00" + "".join(map(part, (key, *fields))).encode()).digest()


def root_of(leaves):
    nodes = list(leaves)
    while len(nodes) > 1:
        nodes = [hashlib.sha256(b"\x01" + nodes[i] + nodes[i + 1]).digest() if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0].hex()


def whole(spark, out):
    return sorted(map(tuple, evidence_ledger.read_ledger(spark, out).collect()), key=str)


CONFIG = evidence_ledger.Config(keys_a_range=20)


def test_ledger_takes_only_what_is_new(spark, tmp_path, caplog):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    by = {r.doc_id: r for r in docs.collect()}
    ids = sorted(by)
    half = ids[len(ids) // 2]
    docs.where(F.col("doc_id") < half).coalesce(1).write.parquet(source)
    with caplog.at_level(logging.INFO):
        first = evidence_ledger.run(spark, source, out, CONFIG)
    hashes = [leaf(i, by[i].lang, by[i].source, by[i].text) for i in ids]
    n = ids.index(half)
    assert (first["n_leaves"], first["root"], first["batch"]) == (n, root_of(hashes[:n]), 0)
    assert f"read {n} rows, recorded {n}" in caplog.text
    # nothing new: nothing is done, nothing changes
    before = whole(spark, out)
    assert evidence_ledger.run(spark, source, out, CONFIG) == first and whole(spark, out) == before
    # the rest, with repeats, changed rows and a row without a key
    more = docs.where(F.col("doc_id") >= half).unionByName(docs.where(F.col("doc_id") < half).limit(5))
    odd = spark.createDataFrame([(ids[0], "changed", "en", "web"), (None, "no key", "en", None)], "doc_id long, text string, lang string, source string")
    more.unionByName(odd).coalesce(1).write.mode("append").parquet(source)
    with caplog.at_level(logging.INFO):
        second = evidence_ledger.run(spark, source, out, CONFIG)
    assert (second["n_leaves"], second["root"], second["batch"]) == (len(ids), root_of(hashes), 1)
    assert (second["taken"], second["added"], second["repeated"], second["refused"]) == (len(ids) - n + 7, len(ids) - n, 5, 2)
    # what was recorded stays as it was
    after = whole(spark, out)
    assert {r for r in before if r[0] in ("leaf", "node")} <= set(after)
    assert [r for r in after if r[0] == "refused"] == sorted([("refused", None, None, ids[0], leaf(ids[0], "en", "web", "changed").hex()), ("refused", None, None, None, leaf(None, "en", None, "no key").hex())], key=str)
    # a row of the first batch is proved under the root of the second
    nodes = spark.read.parquet(f"{out}/nodes")
    path = [bytes(r.hash) for r in ledger.inclusion(nodes, spark.createDataFrame([(3,)], "idx long"), len(ids)).orderBy("level").collect()]
    peaks = {int(k): bytes.fromhex(h) for k, h in second["peaks"].items()}
    assert ledger.check_inclusion(hashes[3], 3, len(ids), path, peaks, bytes.fromhex(second["root"]))


def test_a_batch_done_again_replaces_its_own(spark, tmp_path):
    out = str(tmp_path)
    rows = spark.createDataFrame([(k, "en", "s", f"text {k}") for k in range(50)], "doc_id long, lang string, source string, text string")
    evidence_ledger.record_batch(spark, rows.where("doc_id < 20"), 0, out, CONFIG)
    once = evidence_ledger.record_batch(spark, rows.where("doc_id >= 20"), 1, out, CONFIG)
    before = whole(spark, out)
    # as after a stop between its writes and the stream's own mark, or before its statement
    assert evidence_ledger.record_batch(spark, rows.where("doc_id >= 20"), 1, out, CONFIG) == once
    assert whole(spark, out) == before and once["n_leaves"] == 50
    # a batch of repeats alone, and an empty one
    again = evidence_ledger.record_batch(spark, rows.where("doc_id < 9"), 2, out, CONFIG)
    assert (again["added"], again["repeated"], again["root"]) == (0, 9, once["root"])
    empty = evidence_ledger.record_batch(spark, rows.where("1 = 0"), 3, out, CONFIG)
    assert (empty["taken"], empty["root"]) == (0, once["root"])


def test_ledger_command(spark, tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"key": "doc_id", "fields": ["text"], "keys_a_range": 10}))
    assert evidence_ledger.Config.read(str(config)) == evidence_ledger.Config("doc_id", ("text",), 10)
    config.write_text(json.dumps({"colour": 1}))
    with pytest.raises(ValueError, match="colour"):
        evidence_ledger.Config.read(str(config))


def voxels(spark, out):
    return sorted(map(tuple, map_release.read_map(spark, out).collect()), key=str)


def test_map_writes_only_tiles_that_changed(spark, tmp_path, caplog):
    tables, out = f"{tmp_path}/in", f"{tmp_path}/out"
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    items.where("l_orderkey < 900").write.parquet(f"{tables}/lineitem.parquet")
    with caplog.at_level(logging.INFO):
        first = map_release.run(spark, tables, out)
    assert first["release"] == 1 and first["added"] > 1 and first["changed"] == first["removed"] == 0
    assert f"release 1 of {out}: {first['added']} tiles added" in caplog.text
    before, files = voxels(spark, out), set(spark.read.parquet(f"{out}/volume").inputFiles())
    # the same input: no release, no file
    assert map_release.run(spark, tables, out) == {"release": 1, "added": 0, "changed": 0, "removed": 0}
    assert voxels(spark, out) == before and set(spark.read.parquet(f"{out}/volume").inputFiles()) == files
    # more frames: what they reach is written anew, and the map is that of a run over all
    items.where("l_orderkey >= 900").write.mode("append").parquet(f"{tables}/lineitem.parquet")
    second = map_release.run(spark, tables, out)
    assert second["release"] == 2 and second["changed"] + second["added"] > 0
    map_release.run(spark, tables, f"{tmp_path}/other")
    assert voxels(spark, out) == voxels(spark, f"{tmp_path}/other")
    changes = {(r.tile_x, r.tile_z) for r in spark.read.parquet(f"{out}/changes/release=2").collect()}
    kept = files & set(spark.read.parquet(f"{out}/volume").inputFiles())
    assert kept == {f for f in files if tuple(int(x.split("=")[1]) for x in f.split("/")[-3:-1]) not in changes}


def test_a_release_without_its_list_is_done_again(spark, tmp_path):
    """As after a stop between the tiles and the list: the tiles of fewer frames lie there, unlisted."""
    out = str(tmp_path)
    map_release.run(spark, SF, out, map_release.Config(last_frame=0))
    one = voxels(spark, out)
    volume, columns = map_release.make_map(spark, SF, map_release.Config())
    for name, table in (("volume", volume), ("columns", columns)):
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile_x", "tile_z").parquet(f"{out}/{name}")
    map_release.run(spark, SF, out, map_release.Config())
    again = voxels(spark, out)
    map_release.run(spark, SF, f"{out}/other", map_release.Config())
    assert again == voxels(spark, f"{out}/other") and again != one
    # fewer frames again: tiles that only later ones reach are no longer listed
    back = map_release.run(spark, SF, out, map_release.Config(last_frame=0))
    assert voxels(spark, out) == one and back["release"] == 3


def test_map_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"band": [0.0, 1.0]}))
    assert map_release.Config.read(str(path)).band == (0.0, 1.0)
    path.write_text(json.dumps({"bands": 1}))
    with pytest.raises(ValueError, match="bands"):
        map_release.Config.read(str(path))
