"""Fuses a recorded depth scan into a map and publishes it tile by tile.

    python -m jobs.map_release TABLES OUTPUT [--config FILE]

TABLES is a folder with the scan's tables.  OUTPUT holds volume and columns (free, occupied or unknown within a band of
heights), partitioned by tile, and for each release the list of its tiles with counts and a fingerprint, and what changed.
A run writes only the tiles whose fingerprint differs from the last release's, by overwriting their partitions, then lists
the release; where nothing differs it writes nothing.  A run that is stopped before its list is done again as a whole.
Readers take the tiles of the last release (`read_map`); a tile that is no longer there stays on disk but is not listed.
"""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import freespace, fuse, plan, surface
from scanengine.sources import derived
from scanengine.sources.scratch import kept

log = logging.getLogger("jobs.map_release")

TILE = ["tile_x", "tile_z"]
VOLUME = "bx int, by int, bz int, l int, tsdf_sum double, weight long, tile_x long, tile_z long"
COLUMNS = "a long, b long, verdict string, tile_x long, tile_z long"
TILES = "tile_x long, tile_z long, blocks long, voxels long, fused long, free long, fingerprint long, release long"


@dataclass(frozen=True)
class Config:
    """voxel, truncation: metres; tile_blocks: blocks along a tile's side; band: heights in metres of what must be free;
    first_frame, last_frame: which frames are fused, ends included."""

    voxel: float = 0.2
    truncation: float = 0.4
    min_weight: int = 1
    tile_blocks: int = 4
    band: tuple[float, float] = (0.0, 0.8)
    files_a_tile: int = 1
    first_frame: int = 0
    last_frame: int | None = None

    @staticmethod
    def read(path: str) -> Config:
        given = json.loads(Path(path).read_text())
        if unknown := given.keys() - {f.name for f in fields(Config)}:
            raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
        return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def releases(spark: SparkSession, out: str) -> DataFrame | None:
    """The tiles of all releases, or None before the first one."""
    try:
        return spark.read.schema(TILES).option("basePath", f"{out}/tiles").parquet(f"{out}/tiles")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def last_release(spark: SparkSession, out: str) -> int:
    found = releases(spark, out)
    return (found.agg(F.max("release").alias("n")).first()["n"] or 0) if found is not None else 0


def tile_of(x: Column, z: Column, side: int) -> list[Column]:
    return [F.floor(c / side).cast("long").alias(n) for c, n in zip((x, z), TILE)]


def make_map(spark: SparkSession, tables: str, config: Config) -> tuple[DataFrame, DataFrame]:
    """(volume, columns) with the tile of each row."""
    grid = g.Grid(config.voxel, config.truncation)
    within = F.col("seq") >= config.first_frame
    if config.last_frame is not None:
        within &= F.col("seq") <= config.last_frame
    scan = derived.scan(spark, tables).where(within)
    pts = plan.points(derived.pixels(spark, tables).where(within), derived.frames(spark, tables).where(within), derived.CAMERA)
    fused = fuse.fuse(scan, plan.plan(pts, grid), derived.CAMERA, grid)
    volume = kept(fused.select("bx", "by", "bz", F.col("l").cast("int").alias("l"), "tsdf_sum", F.col("weight").cast("long").alias("weight"), *tile_of(F.col("bx"), F.col("bz"), config.tile_blocks)), "map-volume")
    first, last = freespace.band(*config.band, config.voxel)
    free = freespace.columns(surface.samples(volume, config.min_weight), first, last)
    voxels = 8 * config.tile_blocks
    columns = free.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "verdict", *tile_of(F.col("a"), F.col("b"), voxels))
    return volume, kept(columns, "map-columns")


def tiles_of(volume: DataFrame, columns: DataFrame) -> DataFrame:
    """A row a tile: counts, and a fingerprint that does not depend on the order of rows."""
    blocks = volume.groupBy(*TILE, "bx", "by", "bz").agg(F.count("*").alias("n"), F.count_if(F.col("weight") > 1).alias("m"), F.bit_xor(F.xxhash64("bx", "by", "bz", "l", "tsdf_sum", "weight")).alias("h"))
    v = blocks.groupBy(*TILE).agg(F.count("*").alias("blocks"), F.sum("n").alias("voxels"), F.sum("m").alias("fused"), F.bit_xor("h").alias("h"))
    c = columns.groupBy(*TILE).agg(F.count_if(F.col("verdict") == "free").alias("free"), F.bit_xor(F.xxhash64("a", "b", "verdict")).alias("k"))
    both = v.join(c, TILE, "full")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n)
    return both.select(*TILE, *map(zero, ("blocks", "voxels", "fused", "free")), F.xxhash64("h", "k").alias("fingerprint"))


def run(spark: SparkSession, tables: str, out: str, config: Config = Config()) -> dict:
    """Publishes the map of `tables` and returns the release with the numbers of added, changed and removed tiles."""
    at = last_release(spark, out)
    log.info("reading the scan in %s; last release of %s is %d", tables, out, at)
    volume, columns = make_map(spark, tables, config)
    now = kept(tiles_of(volume, columns), "map-tiles")
    held = releases(spark, out)
    held = spark.createDataFrame([], TILES) if held is None else held.where(F.col("release") == at)
    was = held.select(*TILE, F.col("fingerprint").alias("was"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("fingerprint").isNull(), "removed").when(F.col("was") != F.col("fingerprint"), "changed")
    changes = kept(now.join(was, TILE, "full").select(*TILE, change.alias("change")).where("change is not null"), "map-changes")
    count = {k: 0 for k in ("added", "changed", "removed")} | {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
    if not any(count.values()):
        log.info("nothing changed; %s keeps release %d", out, at)
        return {"release": at} | count
    fresh = changes.where("change <> 'removed'").select(*TILE)
    for name, table, spread in (("volume", volume, ["bx", "by", "bz"]), ("columns", columns, ["a", "b"])):
        part = F.pmod(F.xxhash64(*spread), F.lit(config.files_a_tile))
        rows = table.join(fresh, TILE, "left_semi").repartition(*TILE, part)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*TILE).parquet(f"{out}/{name}")
    changes.coalesce(1).write.mode("overwrite").parquet(f"{out}/changes/release={at + 1}")
    now.coalesce(1).write.mode("overwrite").parquet(f"{out}/tiles/release={at + 1}")
    log.info("wrote release %d of %s: %d tiles added, %d changed, %d removed", at + 1, out, *count.values())
    return {"release": at + 1} | count


def read_map(spark: SparkSession, out: str) -> DataFrame:
    """(kind, tile_x, tile_z, x, y, z, l, value, n, verdict): the tiles, voxels and columns of the last release."""
    tiles = releases(spark, out).where(F.col("release") == last_release(spark, out))
    none = lambda kind: F.lit(None).cast(kind)
    listed = lambda name, schema: spark.read.schema(schema).parquet(f"{out}/{name}").join(tiles.select(*TILE), TILE, "left_semi")
    big = lambda c: F.col(c).cast("long")
    shape = lambda df, kind, x, y, z, l, value, n, verdict: df.select(F.lit(kind).alias("kind"), *TILE, x.alias("x"), y.alias("y"), z.alias("z"), l.alias("l"), value.alias("value"), n.alias("n"), verdict.alias("verdict"))
    v = shape(listed("volume", VOLUME), "voxel", big("bx"), big("by"), big("bz"), F.col("l"), F.col("tsdf_sum"), F.col("weight"), none("string"))
    c = shape(listed("columns", COLUMNS), "column", F.col("a"), none("long"), F.col("b"), none("int"), none("double"), none("long"), F.col("verdict"))
    t = shape(tiles, "tile", F.col("blocks"), F.col("fused"), F.col("free"), none("int"), none("double"), F.col("voxels"), none("string"))
    return v.unionByName(c).unionByName(t)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m jobs.map_release", description=__doc__.splitlines()[0])
    parser.add_argument("tables", help="folder of the scan's tables")
    parser.add_argument("output", help="folder of the map")
    parser.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("map_release").getOrCreate()
    try:
        print(json.dumps(run(spark, given.tables, given.output, Config.read(given.config))))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
