"""What the operators share: tables in the cluster's shared folder and running totals without one big window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every word contract: blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, a temporary folder of our
    own in local mode, as in tests, and an error on a cluster, whose machines would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scanengine-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, and its size is known to the optimizer."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that scratch() named."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key() -> Column:
    """What tells rows of one doc_id, or of none, apart: a hash of doc_id and text.  Rows that agree in both agree in it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and row_key() are not in drop (doc_id, key)."""
    gone = drop.select(F.col("doc_id").alias("_drop_id"), F.col("key").alias("_drop_key"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_drop_id")) & (row_key() == F.col("_drop_key")), "left_anti")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare != "", F.split(bare, BLANKS)).otherwise(F.array().cast("array<string>"))


def running_start(
    df: DataFrame, group: str, bucket: str, order: list[Column], value: str, out: str, within: list[str] | None = None
) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of `group` that come before, in the order of (bucket, order).

    Two levels: totals of each (group, bucket) are summed in a window over the small table of totals, and rows in a
    window of their own bucket alone, so that a group holding a third of all rows never meets in one task.
    """
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col(group).alias("_g"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col(bucket) == F.col("_b")))
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop("_inside", "_start", "_g", "_b")
    )
