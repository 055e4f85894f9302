"""Queries of rays and footprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanengine.operators import fuse, rays
from scanengine.plans.common import registrar
from scanengine.plans.fusion_queries import COARSE, blocks, points
from scanengine.plans.scan_sql import block_sql, d, eval_sql, plan_sql, scan_with
from scanengine.sources import derived
from scanengine.sources.derived import CAMERA

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


def _rays_sql() -> str:
    e = d(COARSE.extent)
    ends = ", ".join(f"m{k} AS o{a}, {block_sql(f'm{k}', COARSE.extent)} AS f{a}, {block_sql(f'w{a}', COARSE.extent)} AS l{a}" for a, k in zip("xyz", (3, 7, 11)))
    cross = ", ".join(
        f"CASE WHEN l{a} <> f{a} THEN list_transform(range(abs(l{a} - f{a})::BIGINT), lambda j: ((f{a} + (l{a} > f{a})::INT + sign(l{a} - f{a}) * j) * {e} - o{a}) / (w{a} - o{a})) ELSE []::DOUBLE[] END AS t{a}"
        for a in "xyz"
    )
    at = ", ".join(f"CAST(f{a} + sign(l{a} - f{a}) * len(list_filter(t{a}, lambda x: x <= t)) AS INTEGER) AS b{a}" for a in "xyz")
    return f"""
ry AS (SELECT pt.seq, wx, wy, wz, {ends} FROM pt JOIN fr USING (seq)),
rt AS (SELECT *, {cross} FROM ry),
ru AS (SELECT *, unnest(list_distinct(list_concat(tx, ty, tz) || ['-inf'::DOUBLE])) AS t FROM rt),
rb AS (SELECT DISTINCT seq, {at} FROM ru)"""


@query("g5_g7_ray_blocks", scan_with(_rays_sql()) + "SELECT seq, bx, by, bz FROM rb")
def g5(s, sf):
    """Blocks between camera and surface, by frame; tests hold the rays against sampling."""
    return rays.traced(points(s, sf), derived.frames(s, sf), COARSE.extent)


@query(
    "g7_rays_in_plan",
    scan_with(plan_sql(COARSE.voxel, COARSE.truncation), _rays_sql())
    + "SELECT rb.seq, count(*) AS blocks, count(pl.bx) AS planned, count(*) - count(pl.bx) AS outside FROM rb LEFT JOIN pl ON pl.bx = rb.bx AND pl.by = rb.by AND pl.bz = rb.bz GROUP BY 1",
)
def g7(s, sf):
    """Of each frame's ray blocks, how many the plan holds."""
    found = rays.by_plan(rays.traced(points(s, sf), derived.frames(s, sf), COARSE.extent), blocks(s, sf))
    n = found.groupBy("seq").agg(F.count("*").alias("blocks"), F.count_if("planned").alias("planned"))
    return n.withColumn("outside", F.col("blocks") - F.col("planned"))


def feet(s, sf):
    return rays.footprints(derived.pixels(s, sf), derived.frames(s, sf), CAMERA, COARSE)


def _feet_sql() -> str:
    """ft(seq, bx, by, bz): blocks that no plane of a pixel's pyramid leaves wholly outside."""
    less = lambda q, r: [f"({i} - {j})" for i, j in zip(q, r)]
    cross = lambda q, r: [f"({q[1]} * {r[2]} - {q[2]} * {r[1]})", f"({q[2]} * {r[0]} - {q[0]} * {r[2]})", f"({q[0]} * {r[1]} - {q[1]} * {r[0]})"]
    dot = lambda q, r: f"({q[0]} * {r[0]} + {q[1]} * {r[1]} + {q[2]} * {r[2]})"
    point = lambda name: [f"{name}{a}" for a in "xyz"]
    apex, corners, inner, middle = ["m3", "m7", "m11"], [point(f"c{k}") for k in range(4)], point("i"), point("j")
    local, placed = [], []
    for k, (du, dv) in enumerate(((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))):
        local.append(f"(u + {d(du)} - {d(CAMERA.cx)}) * z / {d(CAMERA.fx)} AS u{k}, (v + {d(dv)} - {d(CAMERA.cy)}) * z / {d(CAMERA.fy)} AS v{k}")
        placed += [f"m{r} * u{k} + m{r + 1} * v{k} + m{r + 2} * z + m{r + 3} AS c{k}{a}" for a, r in zip("xyz", (0, 4, 8))]
    ends = [[apex[i], *[c[i] for c in corners]] for i in range(3)]
    box = ", ".join(f"least({', '.join(x)}) AS n{a}, greatest({', '.join(x)}) AS x{a}, ({' + '.join(x)}) / {d(5.0)} AS i{a}, ({' + '.join(x[1:])}) / {d(4.0)} AS j{a}" for a, x in zip("xyz", ends))
    planes = [(apex, cross(less(corners[k], apex), less(corners[(k + 1) % 4], apex))) for k in range(4)]
    planes += [(corners[0], cross(less(corners[1], corners[0]), less(corners[2], corners[0]))), (apex, less(apex, middle))]
    normals = ", ".join(f"{x} AS p{k}{a}" for k, (_, n) in enumerate(planes) for a, x in zip("xyz", n))
    turns = ", ".join(f"-sign({dot(point(f'p{k}'), less(inner, at))})::DOUBLE AS t{k}" for k, (at, _) in enumerate(planes))
    spans = [f"unnest(range({block_sql(f'n{a}', COARSE.extent)}, {block_sql(f'x{a}', COARSE.extent)} + 1)) AS b{a}" for a in "xyz"]
    e = d(COARSE.extent)

    def ahead(k: int) -> str:
        n = [f"(p{k}{a} * t{k})" for a in "xyz"]
        near = [f"(CASE WHEN {x} >= 0 THEN b{a} * {e} ELSE b{a} * {e} + {e} END - {at})" for a, x, at in zip("xyz", n, planes[k][0])]
        return f"{dot(n, near)} <= 0"

    return f"""
f1 AS (SELECT px.seq, u, v, raw * {d(CAMERA.scale)} + {d(COARSE.truncation)} AS z, {", ".join(f"m{k}" for k in range(12))} FROM px JOIN fr ON fr.seq = px.seq WHERE raw > 0 AND has_pose),
f2 AS (SELECT *, {", ".join(local)} FROM f1), f3 AS (SELECT *, {", ".join(placed)} FROM f2), f4 AS (SELECT *, {box} FROM f3),
f5 AS (SELECT *, {turns}, {spans[0]} FROM (SELECT *, {normals} FROM f4) q), f6 AS (SELECT *, {spans[1]} FROM f5), f7 AS (SELECT *, {spans[2]} FROM f6),
ft AS (SELECT DISTINCT seq, CAST(bx AS INTEGER) AS bx, CAST(by AS INTEGER) AS by, CAST(bz AS INTEGER) AS bz FROM f7 WHERE {" AND ".join(ahead(k) for k in range(6))})"""


@query("g6_g7_footprint_blocks", scan_with(_feet_sql()) + "SELECT seq, bx, by, bz FROM ft")
def g6(s, sf):
    return feet(s, sf).select("seq", "bx", "by", "bz").distinct()


@query(
    "f3_footprint_expansion",
    scan_with(_feet_sql(), "cv AS (SELECT DISTINCT bx, by, bz FROM ft)", eval_sql(COARSE.voxel, COARSE.truncation, "cv"))
    + f"SELECT DISTINCT bx, by, bz FROM ev WHERE sd >= {d(-COARSE.truncation)}",
)
def f3(s, sf):
    covered = feet(s, sf).select("bx", "by", "bz").distinct()
    return fuse.observed_blocks(derived.scan(s, sf), covered, CAMERA, COARSE)
