"""Keeps an append-only ledger of a growing table, so that any row can later be shown to be what was recorded.

    python -m jobs.evidence_ledger INPUT OUTPUT [--config FILE]

Each run takes the Parquet files of INPUT that no run before it has taken (a file stream's checkpoint knows them), records
their rows as leaves of a Merkle tree that grows by appending, and states the new root.  A row whose key is recorded with
the same contents is a repeat and adds nothing; one with other contents, or without a key, is refused and listed.

OUTPUT holds, a folder a batch: leaves (by range of keys), nodes that the batch completed, refused rows, and a statement
(counts, peaks, root), written last.  A batch that is done again reads what came before it alone and replaces its own
folders, so a run that is stopped anywhere leaves the same ledger once it is run again.
"""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanengine.operators import commit, ledger
from scanengine.operators.order import dense_numbers

log = logging.getLogger("jobs.evidence_ledger")

LEAVES = "idx long, key long, hash binary, key_range long"
REFUSED = "key long, hash binary, reason string"
STATEMENT = "batch long, taken long, added long, repeated long, refused long, n_leaves long, root string, peaks map<int,string>"
#: Keys of more ranges than this are looked up without naming the ranges to the scan.
MOST_NAMED = 1000


@dataclass(frozen=True)
class Config:
    """key: an integer column; fields: what a leaf binds beside it; max_files: how many new files a batch takes."""

    key: str = "doc_id"
    fields: tuple[str, ...] = ("lang", "source", "text")
    keys_a_range: int = 65_536
    max_files: int = 1000

    @staticmethod
    def read(path: str) -> Config:
        given = json.loads(Path(path).read_text())
        if unknown := given.keys() - {f.name for f in fields(Config)}:
            raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
        return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The batches under a folder, or None before the first one."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def statement(spark: SparkSession, out: str, before: int | None = None) -> dict:
    """The last statement, of the batches below `before`; of none, an empty ledger."""
    found = _table(spark, f"{out}/statements", STATEMENT)
    last = None
    if found is not None:
        if before is not None:
            found = found.where(F.col("batch") < before)
        last = found.orderBy(F.col("batch").desc()).first()
    return last.asDict() if last else {"batch": -1, "n_leaves": 0, "root": ledger.root_of_peaks({}).hex(), "peaks": {}}


def leaves_of(rows: DataFrame, config: Config) -> DataFrame:
    """(key, key_range, hash): each row's leaf."""
    key = F.col(config.key).cast("long")
    data = ledger.record(key, *[F.col(f) for f in config.fields])
    return rows.select(key.alias("key"), F.floor(key / config.keys_a_range).cast("long").alias("key_range"), commit.leaf_hash(data).alias("hash"))


def record_batch(spark: SparkSession, rows: DataFrame, number: int, out: str, config: Config) -> dict:
    """Records one batch and returns its statement."""
    before = statement(spark, out, number)
    came = leaves_of(rows, config).persist()
    try:
        # of rows that share a new key within a batch, the one with the smallest leaf counts
        ranked = came.where("key is not null").distinct().withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("hash")))
        earlier = _table(spark, f"{out}/leaves", LEAVES + ", batch long")
        if earlier is None:
            known = spark.createDataFrame([], "known_key long, known_hash binary, key_range long")
        else:
            known = earlier.where(F.col("batch") < number).select(F.col("key").alias("known_key"), F.col("hash").alias("known_hash"), "key_range")
            ranges = [r["key_range"] for r in ranked.select("key_range").distinct().limit(MOST_NAMED + 1).collect()]
            if len(ranges) <= MOST_NAMED:
                known = known.where(F.col("key_range").isin(ranges))
        met = ranked.join(known, (ranked["key"] == known["known_key"]) & (ranked["key_range"] == known["key_range"]), "left").select(ranked["*"], "known_hash")
        new = dense_numbers(met.where("known_hash is null and place = 1").drop("known_hash", "place"), [F.col("key")], F.col("key_range"), "place")
        new = new.select((F.col("place") + before["n_leaves"]).alias("idx"), "key", "hash", "key_range")
        new.write.mode("overwrite").partitionBy("key_range").parquet(f"{out}/leaves/batch={number}")
        refused = (
            came.where("key is null").select("key", "hash", F.lit("no key").alias("reason"))
            .unionByName(met.where("known_hash is null and place > 1").select("key", "hash", F.lit("other contents in its batch").alias("reason")))
            .unionByName(met.where("known_hash <> hash").select("key", "hash", F.lit("other contents than recorded").alias("reason")))
        )
        refused.write.mode("overwrite").parquet(f"{out}/refused/batch={number}")
        written = spark.read.schema(LEAVES).parquet(f"{out}/leaves/batch={number}")
        nodes, n, peaks = ledger.append(written, before["n_leaves"], {int(k): bytes.fromhex(h) for k, h in before["peaks"].items()})
        nodes.write.mode("overwrite").parquet(f"{out}/nodes/batch={number}")
        taken, added = came.count(), n - before["n_leaves"]
        bad = spark.read.schema(REFUSED).parquet(f"{out}/refused/batch={number}").count()
    finally:
        came.unpersist()
    root = ledger.root_of_peaks(peaks).hex()
    said = (number, taken, added, taken - added - bad, bad, n, root, {k: h.hex() for k, h in peaks.items()})
    spark.createDataFrame([said], STATEMENT).drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{out}/statements/batch={number}")
    log.info("batch %d: read %d rows, recorded %d, repeated %d, refused %d; %d leaves, root %s", *said[:7])
    return statement(spark, out)


def _pattern(source: str) -> str:
    """A path as a pattern that only it matches: file streams take a pattern's folders and files alike, a path's only as a
    folder."""
    path = source.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, source: str, out: str, config: Config = Config()) -> dict:
    """Takes what is new under `source` and returns the ledger's last statement."""
    schema = spark.read.parquet(source).select(config.key, *config.fields).schema
    log.info("reading new files of %s into %s, after batch %d", source, out, statement(spark, out)["batch"])
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", config.max_files)
        .parquet(_pattern(source))
        .writeStream.option("checkpointLocation", f"{out}/checkpoint")
        .foreachBatch(lambda rows, number: record_batch(rows.sparkSession, rows, number, out, config) and None)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    now = statement(spark, out)
    log.info("wrote %s: %d leaves, root %s", out, now["n_leaves"], now["root"])
    return now


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """(kind, level, idx, key, hash): the leaves, the nodes above them, the refused rows and the root of the ledger."""
    done = spark.read.schema(STATEMENT).option("basePath", f"{out}/statements").parquet(f"{out}/statements")
    batches = done.select("batch")
    hexed = F.lower(F.hex("hash")).alias("hash")
    none = lambda kind: F.lit(None).cast(kind)
    part = lambda name, schema: spark.read.schema(f"{schema}, batch long").option("basePath", f"{out}/{name}").parquet(f"{out}/{name}").join(F.broadcast(batches), "batch", "left_semi")
    leaves = part("leaves", LEAVES).select(F.lit("leaf").alias("kind"), F.lit(0).alias("level"), "idx", "key", hexed)
    nodes = part("nodes", ledger.NODES).where("level > 0").select(F.lit("node").alias("kind"), "level", "idx", none("long").alias("key"), hexed)
    refused = part("refused", REFUSED).select(F.lit("refused").alias("kind"), none("int").alias("level"), none("long").alias("idx"), "key", hexed)
    last = done.orderBy(F.col("batch").desc()).limit(1)
    root = last.select(F.lit("root").alias("kind"), none("int").alias("level"), F.col("n_leaves").alias("idx"), none("long").alias("key"), F.col("root").alias("hash"))
    return leaves.unionByName(nodes).unionByName(refused).unionByName(root)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m jobs.evidence_ledger", description=__doc__.splitlines()[0])
    parser.add_argument("input", help="folder of Parquet files that grows, or a pattern")
    parser.add_argument("output", help="folder of the ledger")
    parser.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("evidence_ledger").getOrCreate()
    try:
        print(json.dumps({k: v for k, v in run(spark, given.input, given.output, Config.read(given.config)).items() if k != "peaks"}))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
