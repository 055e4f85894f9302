"""The jobs as queries: each runs twice into one new folder and returns the whole output, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import evidence_ledger, map_release
from scanengine.plans.common import registrar
from scanengine.plans.scan_sql import d
from scanengine.plans.surface_queries import base
from scanengine.sources.scratch import scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}) || ':' || {x} END || ';'"


def _ledger_sql(top: int = 40) -> str:
    """The tree level by level: complete nodes alone, then the peaks from the right."""
    node = lambda x, y: f"sha256('\\x01'::BLOB || unhex({x}) || unhex({y}))"
    data = " || ".join(_field(x) for x in ("CAST(doc_id AS VARCHAR)", "lang", "source", "text"))
    out = [
        f"ca AS (SELECT doc_id AS key, sha256('\\x00'::BLOB || encode({data})) AS h FROM documents)",
        "ra AS (SELECT key, h, row_number() OVER (PARTITION BY key ORDER BY h) AS place FROM (SELECT DISTINCT key, h FROM ca WHERE key IS NOT NULL) q)",
        "nd0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key) - 1 AS idx, key, h FROM ra WHERE place = 1)",
    ]
    for k in range(top):
        out.append(f"nd{k + 1} AS MATERIALIZED (SELECT idx // 2 AS idx, {node('max(CASE WHEN idx % 2 = 0 THEN h END)', 'max(CASE WHEN idx % 2 = 1 THEN h END)')} AS h FROM nd{k} GROUP BY 1 HAVING count(*) = 2)")
    out.append("rt0 AS (SELECT (SELECT count(*) FROM nd0) AS n, CAST(NULL AS VARCHAR) AS h)")
    for k in range(top):
        peak = f"(SELECT h FROM nd{k} WHERE idx = (n >> {k}) - 1)"
        out.append(f"rt{k + 1} AS MATERIALIZED (SELECT n, CASE WHEN (n >> {k}) % 2 = 0 THEN h WHEN h IS NULL THEN {peak} ELSE {node(peak, 'h')} END AS h FROM rt{k})")
    parts = ["SELECT 'leaf' AS kind, CAST(0 AS INTEGER) AS level, CAST(idx AS BIGINT) AS idx, key, lower(h) AS hash FROM nd0"]
    parts += [f"SELECT 'node', {k}, CAST(idx AS BIGINT), NULL, lower(h) FROM nd{k}" for k in range(1, top + 1)]
    parts.append("SELECT 'refused', NULL, NULL, key, lower(h) FROM (SELECT key, h FROM ca WHERE key IS NULL UNION ALL SELECT key, h FROM ra WHERE place > 1) q")
    parts.append(f"SELECT 'root', NULL, CAST(n AS BIGINT), NULL, lower(coalesce(h, sha256(''))) FROM rt{top}")
    return "WITH " + ",\n".join(out) + "\n" + "\nUNION ALL ".join(parts)


@query("job1_evidence_ledger", _ledger_sql())
def job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "evidence-ledger")
    for _ in range(2):
        evidence_ledger.run(spark, f"{sf_dir}/documents.parquet", out)
    return evidence_ledger.read_ledger(spark, out)


_MAP = map_release.Config()
_SIDE = _MAP.tile_blocks


def _map_sql() -> str:
    from scanengine.operators.freespace import band

    first, last = band(*_MAP.band, _MAP.voxel)
    tile = lambda x, z, side: f"CAST(floor({x} / {d(float(side))}) AS BIGINT) AS tile_x, CAST(floor({z} / {d(float(side))}) AS BIGINT) AS tile_z"
    return base(
        f"mv AS (SELECT *, {tile('bx', 'bz', _SIDE)} FROM vo)",
        f"""mc AS (SELECT gx AS a, gz AS b, CASE WHEN bool_or(value <= 0) THEN 'occupied' WHEN count(*) = {last - first + 1} THEN 'free' ELSE 'unknown' END AS verdict
  FROM sm WHERE gy BETWEEN {first} AND {last} GROUP BY 1, 2)""",
        f"mt AS (SELECT *, {tile('a', 'b', 8 * _SIDE)} FROM mc)",
        "tv AS (SELECT tile_x, tile_z, count(DISTINCT (bx, by, bz)) AS blocks, count(*) AS voxels, count(*) FILTER (weight > 1) AS fused FROM mv GROUP BY 1, 2)",
        "tc AS (SELECT tile_x, tile_z, count(*) FILTER (verdict = 'free') AS free FROM mt GROUP BY 1, 2)",
    ) + """SELECT 'voxel' AS kind, tile_x, tile_z, CAST(bx AS BIGINT) AS x, CAST(by AS BIGINT) AS y, CAST(bz AS BIGINT) AS z, l, tsdf_sum AS value, CAST(weight AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS verdict FROM mv
    UNION ALL SELECT 'column', tile_x, tile_z, CAST(a AS BIGINT), NULL, CAST(b AS BIGINT), NULL, NULL, NULL, verdict FROM mt
    UNION ALL SELECT 'tile', tile_x, tile_z, coalesce(blocks, 0), coalesce(fused, 0), coalesce(free, 0), NULL, NULL, coalesce(voxels, 0), NULL FROM tv FULL JOIN tc USING (tile_x, tile_z)"""


@query("job2_map_release", _map_sql())
def job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "map-release")
    for _ in range(2):
        map_release.run(spark, sf_dir, out, _MAP)
    return map_release.read_map(spark, out)
