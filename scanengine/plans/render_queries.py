"""Queries of rasters, colours, noise, and whole verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanengine.operators import commit, freespace, fuse, noise, render
from scanengine.plans import fusion_queries
from scanengine.plans.common import registrar
from scanengine.plans.fusion_queries import COARSE, blocks, points
from scanengine.plans.scan_sql import d, scan_with
from scanengine.plans.surface_queries import MESH, base, mesh_corners, route_columns
from scanengine.sources import derived
from scanengine.sources.derived import CAMERA
from scanengine.sources.scratch import kept

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)

STOPS = [(0.0, 0.0, 128.0), (0.0, 255.0, 255.0), (255.0, 255.0, 0.0), (128.0, 0.0, 0.0)]


def _ramp_sql(k: int) -> str:
    s = f"(least({d(1.0)}, greatest({d(0.0)}, wz / {d(5.0)})) * {d(3.0)})"
    lower = f"least(2, CAST(floor({s}) AS INTEGER))"
    pick = lambda o: f"(CASE {lower} + {o} " + " ".join(f"WHEN {i} THEN {d(STOPS[i][k])}" for i in range(4)) + " END)"
    return f"{pick(0)} * ({d(1.0)} - ({s} - {lower})) + {pick(1)} * ({s} - {lower})"


@query("p22_height_ramp", scan_with() + f"SELECT seq, u, v, {_ramp_sql(0)} AS r, {_ramp_sql(1)} AS g, {_ramp_sql(2)} AS b FROM pt")
def p22(s, sf):
    c = render.ramp(F.col("wz") / F.lit(5.0), STOPS)
    return points(s, sf).select("seq", "u", "v", *[x.alias(n) for x, n in zip(c, "rgb")])


_TRI = """
tr AS (SELECT gx || ',' || gy || ',' || gz || ',' || tetra || ',' || tri AS face,
  max(CASE corner WHEN 0 THEN x END) AS ax, max(CASE corner WHEN 0 THEN z END) AS ay, max(CASE corner WHEN 0 THEN y END) AS az,
  max(CASE corner WHEN 1 THEN x END) AS bx, max(CASE corner WHEN 1 THEN z END) AS yb, max(CASE corner WHEN 1 THEN y END) AS bz,
  max(CASE corner WHEN 2 THEN x END) AS cx, max(CASE corner WHEN 2 THEN z END) AS cy, max(CASE corner WHEN 2 THEN y END) AS cz FROM kc GROUP BY 1),
ra AS (SELECT *, (bx - ax) * (cy - ay) - (cx - ax) * (yb - ay) AS area FROM tr)"""
_S = d(0.1)


def _range(lo: str, hi: str) -> str:
    return f"range(CAST(ceil(least({lo}) / {_S} - {d(0.5)}) AS BIGINT), CAST(floor(greatest({hi}) / {_S} - {d(0.5)}) AS BIGINT) + 1)"


_RASTER = f"""
r1 AS (SELECT *, unnest({_range("ax, bx, cx", "ax, bx, cx")}) AS px FROM ra WHERE area <> 0),
r2 AS (SELECT *, unnest({_range("ay, yb, cy", "ay, yb, cy")}) AS py FROM r1),
r3 AS (SELECT *, (px + {d(0.5)}) * {_S} AS uu, (py + {d(0.5)}) * {_S} AS vv FROM r2),
r4 AS (SELECT *, ((cx - bx) * (vv - yb) - (uu - bx) * (cy - yb)) / area AS w0, ((ax - cx) * (vv - cy) - (uu - cx) * (ay - cy)) / area AS w1,
  ((bx - ax) * (vv - ay) - (uu - ax) * (yb - ay)) / area AS w2 FROM r3),
r5 AS (SELECT px, py, face, w0 * az + w1 * bz + w2 * cz AS depth FROM r4 WHERE w0 >= 0 AND w1 >= 0 AND w2 >= 0),
r6 AS (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY depth, face) AS k FROM r5)"""


@query("g14_m15_raster", base(*MESH, _TRI, _RASTER) + "SELECT px, py, depth, face FROM r6 WHERE k = 1")
def g14(s, sf):
    """The mesh from above."""
    k = mesh_corners(s, sf).withColumn("face", F.concat_ws(",", "gx", "gy", "gz", "tetra", "tri"))
    at = lambda i, c: F.max(F.when(F.col("corner") == i, F.col(c)))
    cols = [at(i, src).alias(f"{v}{a}") for i, v in enumerate("abc") for a, src in (("x", "x"), ("y", "z"), ("z", "y"))]
    return render.rasterise(k.groupBy("face").agg(*cols), 0.1)


@query("p20_p21_sensor_noise")
def p20(s, sf):
    """Drawn noise on every depth image; tests compare with NumPy."""
    images = derived.depth_images(derived.pixels(s, sf))
    return noise.noisy(images.join(noise.drawn(images, 7, CAMERA.height, CAMERA.width, 0.5, 1.0 / 6.0), "seq"), CAMERA, 35130.0)


@query("v11_v14_verdicts")
def verdicts(s, sf):
    """A map's blocks proved, an audit of them and a route through them, each to its verdict."""
    plan, scan = kept(blocks(s, sf), "plan"), fusion_queries.scan(s, sf)
    vol = kept(fuse.fuse(scan, plan, CAMERA, COARSE), "volume")
    leaves = kept(commit.numbered(commit.block_leaves(vol)).select("idx", "bx", "by", "bz", "data"), "leaves")
    nodes, n = kept(commit.tree(leaves), "nodes"), leaves.count()
    root = bytes(nodes.orderBy(F.col("level").desc()).first()["hash"])
    rows = kept(commit.audit_rows(s, root, b"7", n, min(n, 12)).select("row"), "audit")
    held = kept(leaves.join(rows, F.col("idx") == F.col("row")), "held")
    some = held.select("bx", "by", "bz")
    again = fuse.fuse(scan, plan.join(some, ["bx", "by", "bz"], "left_semi"), CAMERA, COARSE)
    same = kept(fuse.compare_volumes(vol.join(some, ["bx", "by", "bz"], "left_semi"), again), "compared")
    proof = commit.paths(nodes, held)
    good = commit.held_blocks_verdict(held, proof, n, root, same)
    forged = commit.held_blocks_verdict(held, proof, n, bytes(32), same)
    part = {"x": F.col("l") % 8, "y": F.floor(F.col("l") / 8) % 8, "z": F.floor(F.col("l") / 64)}
    flat = vol.select(*[(F.col(f"b{a}").cast("long") * 8 + part[a]).alias(f"g{a}") for a in "xyz"], "tsdf_sum", "weight")
    route = commit.route_verdict(good, freespace.clearance(route_columns(s), flat, -1, 1, 3))
    out = good.select(F.lit("blocks").alias("what"), "verdict").unionByName(forged.select(F.lit("forged-root").alias("what"), "verdict"))
    out = out.unionByName(commit.audit_verdict(rows, held.select("row"), good).select(F.lit("audit").alias("what"), "verdict"))
    out = out.unionByName(commit.audit_verdict(rows, held.select("row").where("row % 2 = 0"), good).select(F.lit("short-audit").alias("what"), "verdict"))
    return out.unionByName(route.select(F.lit("route").alias("what"), "verdict"))
