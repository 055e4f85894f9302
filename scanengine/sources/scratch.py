"""Folders for intermediate tables: where the session's checkpoints go, which a cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of our own in local mode, and an error on a cluster,
    whose machines would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="scanengine-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a scratch folder, for results that several later steps read."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_MADE: dict[tuple, tuple[str, object]] = {}


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells a table's files from those of another time: their number, bytes and a hash of their names, lengths and
    times of change.  Only a listing; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    told = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    return tuple(files.agg(F.count("*"), F.sum("length"), F.bit_xor(told), F.sum(F.shiftright(told, 20))).first())


def forget() -> None:
    """From now on once() makes everything anew."""
    _MADE.clear()


def once(spark: SparkSession, name: str, sources: list[str], key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() gives, written the first time that an application asks for it and read from then on: a fused
    volume is one file to all that is derived from it.  sources: the tables that it is made from; where their files are no
    longer the same, it is made anew.  key: what else it depends on."""
    own = (spark.sparkContext.applicationId, name, *key, *[(p, stamp(spark, p)) for p in sources])
    if own in _MADE:
        path, schema = _MADE[own]
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.read.schema(schema).parquet(path)
    df, path = make(), scratch(spark, name)
    df.write.parquet(path)
    _MADE[own] = path, df.schema
    return spark.read.schema(df.schema).parquet(path)
