"""Queries of planning and fusion over the derived scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import expansion, fuse, plan, vector
from scanengine.plans.common import registrar
from scanengine.plans.scan_sql import block_sql, d, eval_sql, fused_with, plan_sql, scan_with, volume_sql
from scanengine.sources import derived, scratch
from scanengine.sources.derived import CAMERA

FINE, COARSE = g.Grid(0.1, 0.3), g.Grid(0.2, 0.4)
QUERIES: dict = {}
SQL: dict[str, str] = {}


query = registrar(QUERIES, SQL)


def points(s: SparkSession, sf: str) -> DataFrame:
    return plan.points(derived.pixels(s, sf), derived.frames(s, sf), CAMERA)


def blocks(s: SparkSession, sf: str, grid: g.Grid = COARSE) -> DataFrame:
    return plan.plan(points(s, sf), grid)


def scan_tables(sf: str) -> list[str]:
    """The tables that the derived scan is made from."""
    return [f"{sf}/lineitem.parquet"]


def scan(s: SparkSession, sf: str) -> DataFrame:
    """The derived scan, written once an application: what reads it more than once reads the table."""
    return scratch.once(s, "scan", scan_tables(sf), (), lambda: derived.scan(s, sf))


def volume(s: SparkSession, sf: str, grid: g.Grid = COARSE) -> DataFrame:
    """The fused volume, written once an application: what is derived from it reads the table."""
    return scratch.once(s, "volume", scan_tables(sf), (repr(grid),), lambda: fuse.fuse(scan(s, sf), blocks(s, sf, grid), CAMERA, grid))


def even_volume(s: SparkSession, sf: str, grid: g.Grid = COARSE) -> DataFrame:
    """Planned and fused from even frames alone, so that odd ones can judge it."""
    even = F.col("seq") % 2 == 0
    plan_of = lambda: plan.plan(points(s, sf).where(even), grid)
    return scratch.once(s, "even-volume", scan_tables(sf), (repr(grid),), lambda: fuse.fuse(derived.scan(s, sf).where(even), plan_of(), CAMERA, grid))


C = (COARSE.voxel, COARSE.truncation)


@query("a1_fuse_voxels", fused_with(FINE.voxel, FINE.truncation) + "SELECT bx, by, bz, l, tsdf_sum, weight FROM vo")
def a1(s, sf):
    return fuse.fuse(derived.scan(s, sf), blocks(s, sf, FINE), CAMERA, FINE)


@query("a1_fuse_blocks_arrow", fused_with(*C) + "SELECT bx, by, bz, l, tsdf_sum, weight FROM vo")
def a1_blocks(s, sf):
    """Packed contributions, a row for each frame and block, folded in Arrow batches."""
    return vector.folded(vector.packed_contributions(derived.scan(s, sf), blocks(s, sf), CAMERA, COARSE))


@query("m1_point_cloud", scan_with() + "SELECT seq, u, v, wx, wy, wz FROM pt")
def m1(s, sf):
    return points(s, sf).select("seq", "u", "v", "wx", "wy", "wz")


@query("p1_p2_strided_points", scan_with() + "SELECT seq, u, v, wx, wy, wz FROM pt WHERE seq % 2 = 0 AND u % 4 = 0 AND v % 4 = 0")
def p1(s, sf):
    return plan.points(derived.pixels(s, sf), derived.frames(s, sf), CAMERA, 2, 4).select("seq", "u", "v", "wx", "wy", "wz")


@query("g1_plan_blocks", scan_with(plan_sql(FINE.voxel, FINE.truncation)) + "SELECT * FROM pl")
def g1(s, sf):
    return blocks(s, sf, FINE)


@query(
    "a6_plan_report",
    scan_with(plan_sql(FINE.voxel, FINE.truncation))
    + """SELECT count(*) AS active_blocks, count(*) FILTER (is_surface) AS surface_blocks, count(*) FILTER (NOT is_surface) AS halo_blocks,
    min(bx)::BIGINT AS min_x, max(bx)::BIGINT AS max_x, min(by)::BIGINT AS min_y, max(by)::BIGINT AS max_y, min(bz)::BIGINT AS min_z, max(bz)::BIGINT AS max_z FROM pl""",
)
def a6(s, sf):
    return plan.plan_report(blocks(s, sf, FINE))


@query("u3_halo_blocks", scan_with(plan_sql(FINE.voxel, FINE.truncation)) + "SELECT bx, by, bz FROM pl EXCEPT SELECT bx, by, bz FROM pl WHERE is_surface")
def u3(s, sf):
    b = blocks(s, sf, FINE)
    return b.select("bx", "by", "bz").exceptAll(b.where("is_surface").select("bx", "by", "bz"))


def _bounds_sql() -> str:
    out = []
    for a in "xyz":
        lo, hi = f"floor((min(w{a}) - {d(0.5)}) / {d(0.1)})", f"ceil((max(w{a}) + {d(0.5)}) / {d(0.1)})"
        lo = f"(CASE WHEN {lo} * {d(0.1)} > min(w{a}) - {d(0.5)} THEN {lo} - 1 ELSE {lo} END)"
        hi = f"(CASE WHEN {hi} * {d(0.1)} < max(w{a}) + {d(0.5)} THEN {hi} + 1 ELSE {hi} END)"
        out += [f"{lo} * {d(0.1)} AS origin_{a}", f"CAST({hi} - {lo} AS BIGINT) AS voxels_{a}"]
    return scan_with() + "SELECT " + ", ".join(out) + " FROM pt"


@query("a5_world_bounds", _bounds_sql())
def a5(s, sf):
    return plan.bounds(points(s, sf), FINE, 0.5)


@query(
    "a3_counters",
    scan_with()
    + """, us AS (SELECT p.raw FROM px p JOIN fr f ON f.seq = p.seq WHERE f.seq % 2 = 0 AND has_depth AND has_pose)
    SELECT count(*) AS frames, count(*) FILTER (seq % 2 = 0) AS selected, count(*) FILTER (seq % 2 = 0 AND has_depth AND has_pose) AS integrated,
    count(*) FILTER (seq % 2 = 0 AND NOT has_depth) AS missing_depth, count(*) FILTER (seq % 2 = 0 AND NOT has_pose) AS missing_pose,
    (SELECT count(*) FROM us WHERE raw > 0) AS valid_pixels, (SELECT count(*) FROM us WHERE raw <= 0) AS invalid_pixels FROM fr""",
)
def a3(s, sf):
    return plan.counters(derived.frames(s, sf), derived.pixels(s, sf), 2)


_LACK = """, ha AS (
  SELECT status, count(*) AS n FROM ev GROUP BY 1
  UNION ALL SELECT CASE WHEN NOT has_depth AND NOT has_pose THEN 'missing-depth-and-pose' WHEN NOT has_depth THEN 'missing-depth' ELSE 'missing-pose' END,
         (SELECT count(*) * 512 FROM pl) FROM fr WHERE NOT (has_depth AND has_pose))"""


@query("a2_status_histogram", fused_with(*C) + _LACK + "SELECT status, sum(n)::BIGINT AS n FROM ha GROUP BY 1")
def a2(s, sf):
    return fuse.status_histogram(derived.scan(s, sf), blocks(s, sf), CAMERA, COARSE)


@query(
    "a4_volume_report",
    fused_with(*C)
    + """SELECT (SELECT count(*) * 512 FROM pl) AS voxels, count(*) AS observed, count(*) FILTER (weight > 1) AS fused, max(weight) AS max_weight,
    (SELECT count(*) * 512 FROM pl) - count(*) AS unknown FROM vo""",
)
def a4(s, sf):
    return fuse.volume_report(volume(s, sf), blocks(s, sf))


@query("p8_contribution_status", fused_with(*C) + "SELECT seq, status, count(*) AS n FROM ev GROUP BY 1, 2")
def p8(s, sf):
    return fuse.evaluated(derived.scan(s, sf), blocks(s, sf), CAMERA, COARSE, culled=False).groupBy("seq", "status").agg(F.count("*").alias("n"))


@query(
    "p9_sampling_status",
    fused_with(*C)
    + f"""SELECT CASE WHEN sd > {d(0.4)} THEN 'free-space' WHEN sd >= {d(-0.4)} THEN 'surface-band' WHEN sd < {d(-0.4)} THEN 'occluded' ELSE status END AS sample,
    count(*) AS n FROM ev GROUP BY 1""",
)
def p9(s, sf):
    return fuse.sampling(derived.scan(s, sf), blocks(s, sf), CAMERA, COARSE)


@query("p14_p15_mean_tsdf", fused_with(*C) + "SELECT bx, by, bz, l, tsdf_sum / weight AS tsdf FROM vo WHERE weight >= 2")
def p14(s, sf):
    return volume(s, sf).where("weight >= 2").select("bx", "by", "bz", "l", g.normalised(F.col("tsdf_sum"), F.col("weight")).alias("tsdf"))


@query(
    "p10_p13_voxel_address",
    scan_with()
    + f""", gg AS (SELECT seq, u, v, CAST(floor(wx / {d(0.1)}) AS BIGINT) AS gx, {block_sql("wx", 0.8)} AS block_x FROM pt)
    SELECT seq, u, v, block_x, CAST(floor(gx / 8.0) AS BIGINT) AS voxel_block, gx - 8 * CAST(floor(gx / 8.0) AS BIGINT) AS local, (gx + {d(0.5)}) * {d(0.1)} AS centre FROM gg""",
)
def p10(s, sf):
    gx = F.floor(F.col("wx") / F.lit(0.1))
    p = points(s, sf).select("seq", "u", "v", gx.alias("gx"), g.block_of(F.col("wx"), 0.8).cast("int").alias("block_x"))
    return p.select("seq", "u", "v", "block_x", g.block_part(F.col("gx")).alias("voxel_block"), g.local_part(F.col("gx")).alias("local"), g.centre(F.col("gx"), 0.1).alias("centre"))


def _corner_sql(plan_name: str = "pl") -> str:
    """Camera coordinates of each block's eight extreme voxel centres."""
    return f"""
kc AS (SELECT f.seq, b.bx, b.by, b.bz, k,
         (b.bx * 8 + 7 * (k % 2) + {d(0.5)}) * {d(0.2)} AS x, (b.by * 8 + 7 * ((k // 2) % 2) + {d(0.5)}) * {d(0.2)} AS y, (b.bz * 8 + 7 * (k // 4) + {d(0.5)}) * {d(0.2)} AS z, f.*
       FROM {plan_name} b, fr f, range(8) r(k) WHERE has_depth AND has_pose),
kk AS (SELECT seq, bx, by, bz, m0 * (x - m3) + m4 * (y - m7) + m8 * (z - m11) AS xc, m1 * (x - m3) + m5 * (y - m7) + m9 * (z - m11) AS yc,
         m2 * (x - m3) + m6 * (y - m7) + m10 * (z - m11) AS zc, greatest(abs(x - m3), abs(y - m7), abs(z - m11)) AS reach FROM kc),
kv AS (SELECT seq, bx, by, bz, min(zc) AS zmin, max(zc) AS zmax, {d(1e-09)} * ({d(1.0)} + max(reach)) AS slack,
         max({d(24.0)} * xc + {d(16.5)} * zc) AS lft, min({d(24.0)} * xc + {d(15.5 - 31.5 - 0.5)} * zc) AS rgt,
         max({d(24.0)} * yc + {d(12.5)} * zc) AS top, min({d(24.0)} * yc + {d(11.5 - 23.5 - 0.5)} * zc) AS bot,
         min(CASE WHEN zc > 0 THEN {d(24.0)} * xc / zc + {d(15.5)} END) AS u0, max(CASE WHEN zc > 0 THEN {d(24.0)} * xc / zc + {d(15.5)} END) AS u1,
         min(CASE WHEN zc > 0 THEN {d(24.0)} * yc / zc + {d(11.5)} END) AS v0, max(CASE WHEN zc > 0 THEN {d(24.0)} * yc / zc + {d(11.5)} END) AS v1
       FROM kk GROUP BY 1, 2, 3, 4),
cu AS (SELECT *, CASE WHEN zmax < -slack THEN 'behind' WHEN zmin > slack AND (lft < 0 OR rgt > 0 OR top < 0 OR bot > 0) THEN 'outside' ELSE 'evaluate' END AS verdict FROM kv)"""


@query("f1_cull_verdicts", scan_with(plan_sql(*C), _corner_sql()) + "SELECT seq, bx, by, bz, verdict FROM cu")
def f1(s, sf):
    return fuse.verdicts(derived.scan(s, sf), blocks(s, sf), CAMERA, COARSE)


_TILES = f"ti AS (SELECT seq, u // 8 AS tu, v // 8 AS tv, max(CASE WHEN raw > 0 THEN raw * {d(0.001)} ELSE {d(0.0)} END) AS depth FROM px GROUP BY 1, 2, 3)"


@query("a28_depth_tiles", scan_with(_TILES) + "SELECT seq, CAST(tu AS BIGINT) AS tu, CAST(tv AS BIGINT) AS tv, depth FROM ti")
def a28(s, sf):
    return fuse.depth_tiles(derived.pixels(s, sf), CAMERA)


_HIDDEN = f"""
hr AS (SELECT seq, bx, by, bz, zmin - slack AS near,
         CAST(least(31, greatest(0, floor(u0 + {d(0.5)}) - 1)) AS INTEGER) // 8 AS a, CAST(least(31, greatest(0, floor(u1 + {d(0.5)}) + 1)) AS INTEGER) // 8 AS b,
         CAST(least(23, greatest(0, floor(v0 + {d(0.5)}) - 1)) AS INTEGER) // 8 AS c, CAST(least(23, greatest(0, floor(v1 + {d(0.5)}) + 1)) AS INTEGER) // 8 AS e
       FROM cu WHERE verdict = 'evaluate' AND zmin > slack),
hi AS (SELECT h.seq, h.bx, h.by, h.bz, h.near, coalesce(max(t.depth), {d(0.0)}) AS depth
       FROM hr h LEFT JOIN ti t ON t.seq = h.seq AND t.tu BETWEEN h.a AND h.b AND t.tv BETWEEN h.c AND h.e GROUP BY 1, 2, 3, 4, 5)"""


@query("f2_hidden_blocks", scan_with(plan_sql(*C), _corner_sql(), _TILES, _HIDDEN) + f"SELECT seq, bx, by, bz FROM hi WHERE near - {d(0.4)} > depth OR near > depth + {d(0.4)}")
def f2(s, sf):
    return fuse.hidden(derived.scan(s, sf), blocks(s, sf), CAMERA, COARSE)


_VERDICT = f"""
xv AS (SELECT bx, by, bz, l, max(CASE WHEN sd < {d(-0.4)} THEN 1 WHEN sd <= {d(0.4)} THEN 3 WHEN sd > {d(0.4)} THEN 2 ELSE 0 END) AS k FROM ev GROUP BY 1, 2, 3, 4)"""
_NAME = "CASE k WHEN 3 THEN 'surface' WHEN 2 THEN 'free-space' WHEN 1 THEN 'occluded' ELSE 'unseen' END"


@query("a7_cross_view_voxels", fused_with(*C, _VERDICT) + f"SELECT bx, by, bz, l, {_NAME} AS verdict FROM xv")
def a7(s, sf):
    return fuse.cross_view(derived.scan(s, sf), blocks(s, sf), CAMERA, COARSE)


@query("a7_cross_view_blocks", fused_with(*C, _VERDICT) + f"SELECT bx, by, bz, {_NAME} AS verdict, count(*) AS n FROM xv GROUP BY 1, 2, 3, 4")
def a7_blocks(s, sf):
    return a7(s, sf).groupBy("bx", "by", "bz", "verdict").agg(F.count("*").alias("n"))


_BOX = """
bd AS (SELECT min(bx) AS x0, max(bx) AS x1, min(by) AS y0, max(by) AS y1, min(bz) AS z0, max(bz) AS z1 FROM pl),
bo AS (SELECT CAST(x AS INTEGER) AS bx, CAST(y AS INTEGER) AS by, CAST(z AS INTEGER) AS bz
       FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM bd) a, LATERAL (SELECT unnest(range(a.y0, a.y1 + 1)) AS y) b, LATERAL (SELECT unnest(range(a.z0, a.z1 + 1)) AS z) c)"""


def candidate_box(b: DataFrame) -> DataFrame:
    """Every block of the plan's bounding box."""
    ends = b.agg(*[f(f"b{a}").alias(f"{a}{i}") for a in "xyz" for i, f in ((0, F.min), (1, F.max))])
    for a in "xyz":
        ends = ends.withColumn(f"b{a}", F.explode(F.sequence(f"{a}0", f"{a}1")))
    return ends.select("bx", "by", "bz")


@query("g4_candidate_box", scan_with(plan_sql(*C), _BOX) + "SELECT * FROM bo")
def g4(s, sf):
    return candidate_box(blocks(s, sf))


@query(
    "f4_observed_expansion",
    scan_with(plan_sql(*C), _BOX, eval_sql(*C, plan="bo"))
    + """, ap AS (SELECT DISTINCT bx, by, bz FROM ev WHERE status = 'contributes')
    SELECT bx, by, bz, max(planned) AS planned, max(approved) AS approved FROM (
      SELECT bx, by, bz, true AS planned, false AS approved FROM pl UNION ALL SELECT bx, by, bz, false, true FROM ap) GROUP BY 1, 2, 3""",
)
def f4(s, sf):
    b = blocks(s, sf)
    approved = fuse.observed_blocks(derived.scan(s, sf), candidate_box(b), CAMERA, COARSE)
    both = b.select("bx", "by", "bz", F.lit(True).alias("planned"), F.lit(False).alias("approved")).unionByName(
        approved.select("bx", "by", "bz", F.lit(False).alias("planned"), F.lit(True).alias("approved"))
    )
    return both.groupBy("bx", "by", "bz").agg(F.max("planned").alias("planned"), F.max("approved").alias("approved"))


def _ends(name: str, of: str = "") -> str:
    return ", ".join(f"CAST(floor({f}({of}{a}{k}) / {d(COARSE.extent)}) AS BIGINT) AS {name}{a}{k}" for a in "xyz" for k, f in ((0, "min"), (1, "max")))


def _pyramid_sql() -> str:
    """fb: the bounds of each frame's pyramid; fo: every block of the box of all."""
    deep = f"(dm.raw * {d(0.001)} + {d(0.4)})"
    z = deep
    axes = {a: [m] for a, m in zip("xyz", ("m3", "m7", "m11"))}
    for u in (-0.5, 31.5):
        for v in (-0.5, 23.5):
            x, y = f"(({d(u)} - {d(15.5)}) * {z} / {d(24.0)})", f"(({d(v)} - {d(11.5)}) * {z} / {d(24.0)})"
            for k, a in enumerate("xyz"):
                axes[a].append(f"m{4 * k} * {x} + m{4 * k + 1} * {y} + m{4 * k + 2} * {z} + m{4 * k + 3}")
    cols = ", ".join(f"least({', '.join(e)}) - {d(1e-06)} AS {a}0, greatest({', '.join(e)}) + {d(1e-06)} AS {a}1" for a, e in axes.items())
    return f"""
dm AS (SELECT seq, max(raw) AS raw FROM px GROUP BY 1 HAVING max(raw) > 0),
fb AS (SELECT fr.seq, {cols} FROM fr JOIN dm ON dm.seq = fr.seq WHERE has_depth AND has_pose),
fx AS (SELECT {_ends("")} FROM fb),
fo AS (SELECT CAST(x AS INTEGER) AS bx, CAST(y AS INTEGER) AS by, CAST(z AS INTEGER) AS bz
       FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM fx) a, LATERAL (SELECT unnest(range(a.y0, a.y1 + 1)) AS y) b, LATERAL (SELECT unnest(range(a.z0, a.z1 + 1)) AS z) c)"""


@query("g4_frame_bounds", scan_with(_pyramid_sql()) + "SELECT seq, x0, x1, y0, y1, z0, z1 FROM fb")
def g4_frames(s, sf):
    return expansion.frame_bounds(derived.scan(s, sf), CAMERA, COARSE)


@query("g4_frame_box", scan_with(_pyramid_sql()) + "SELECT * FROM fx")
def g4_box(s, sf):
    """The box of blocks that some frame may observe, from poses and depths."""
    return expansion.box_of(expansion.frame_bounds(derived.scan(s, sf), CAMERA, COARSE), COARSE)


@query(
    "f4_free_space_expansion",
    scan_with(plan_sql(*C), _pyramid_sql(), eval_sql(*C, plan="fo"))
    + """, ap AS (SELECT DISTINCT bx, by, bz FROM ev WHERE status = 'contributes')
    SELECT bx, by, bz, max(planned) AS planned, max(approved) AS approved FROM (
      SELECT bx, by, bz, true AS planned, false AS approved FROM pl UNION ALL SELECT bx, by, bz, false, true FROM ap) GROUP BY 1, 2, 3""",
)
def f4_free(s, sf):
    """Every block that some frame observes, inside of the plan's box or not."""
    return expansion.expanded(derived.scan(s, sf), blocks(s, sf), CAMERA, COARSE)


@query(
    "f2_pruned_pairs",
    scan_with(_pyramid_sql(), _corner_sql("fo"), _TILES, _HIDDEN)
    + f"""SELECT cu.seq, count(*) AS candidates, count(*) FILTER (verdict = 'evaluate') AS in_view,
    count(*) FILTER (verdict = 'evaluate' AND NOT coalesce(near > depth + {d(0.4)}, false)) AS evaluated
    FROM cu LEFT JOIN hi ON hi.seq = cu.seq AND hi.bx = cu.bx AND hi.by = cu.by AND hi.bz = cu.bz GROUP BY 1""",
)
def f2_pruned(s, sf):
    """How many pairs of a frame and a candidate block are evaluated without and with the largest depths."""
    return expansion.pruned(derived.scan(s, sf), CAMERA, COARSE).drop("judged")


_ASIDE, _FAR = "sqrt(0.25 / 576.0 + 0.25 / 576.0)", "sqrt(1.0 + (15.5 / 24.0) * (15.5 / 24.0) + (11.5 / 24.0) * (11.5 / 24.0))"


@query(
    "p24_candidate_margin",
    scan_with(plan_sql(*C))
    + f""", hb AS (
      SELECT {", ".join(f"least(min(b{a}) * {d(1.6)}, (SELECT min(m{k}) FROM fr WHERE has_depth AND has_pose)) AS {a}0, greatest((max(b{a}) + 1) * {d(1.6)}, (SELECT max(m{k}) FROM fr WHERE has_depth AND has_pose)) AS {a}1" for a, k in (("x", 3), ("y", 7), ("z", 11)))} FROM pl),
    hm AS (SELECT *, {d(0.4)} * {_FAR} + (sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + (z1 - z0) * (z1 - z0)) + {d(0.4)}) * {_ASIDE} AS margin FROM hb)
    SELECT round(margin, 9) AS margin, {", ".join(f"CAST(floor(({a}0 - margin) / {d(1.6)}) AS BIGINT) AS {a}0, CAST(floor(({a}1 + margin) / {d(1.6)}) AS BIGINT) AS {a}1" for a in "xyz")} FROM hm""",
)
def p24(s, sf):
    """The margin within which observed voxels lie of the plan and the cameras, and the box that it makes."""
    return expansion.hull_box(blocks(s, sf), derived.frames(s, sf), CAMERA, COARSE).withColumn("margin", F.round("margin", 9))


@query(
    "u2_expansion_parts",
    scan_with(plan_sql(*C), _BOX, eval_sql(*C, plan="bo"))
    + """, ap AS (SELECT DISTINCT bx, by, bz FROM ev WHERE status = 'contributes')
    SELECT bo.bx, bo.by, bo.bz, CASE WHEN pl.is_surface THEN 'surface' WHEN pl.bx IS NOT NULL THEN 'halo' WHEN ap.bx IS NOT NULL THEN 'approved' ELSE 'rejected' END AS part
    FROM bo LEFT JOIN pl ON pl.bx = bo.bx AND pl.by = bo.by AND pl.bz = bo.bz LEFT JOIN ap ON ap.bx = bo.bx AND ap.by = bo.by AND ap.bz = bo.bz""",
)
def u2(s, sf):
    """Every candidate block: of the plan, approved beside it, or rejected."""
    b = blocks(s, sf)
    return fuse.expansion_parts(b, candidate_box(b), fuse.observed_blocks(derived.scan(s, sf), candidate_box(b), CAMERA, COARSE))


@query("v7_lone_blocks", fused_with(*C) + "SELECT bx, by, bz, l, tsdf_sum, weight FROM vo WHERE bx = 0 AND by = 0")
def v7(s, sf):
    """Blocks fused on their own, without fusing the rest of the volume."""
    return fuse.fuse(derived.scan(s, sf), blocks(s, sf).where("bx = 0 and by = 0"), CAMERA, COARSE)


@query("j19_block_check", fused_with(*C) + "SELECT DISTINCT bx, by, bz, CASE WHEN bz = 1 THEN 'absent' ELSE 'identical' END AS verdict FROM vo WHERE bx = 0")
def j19(s, sf):
    """A volume's blocks against the same blocks fused alone; one layer is left out of the second volume."""
    b = blocks(s, sf).where("bx = 0")
    return fuse.compare_volumes(volume(s, sf).where("bx = 0"), fuse.fuse(derived.scan(s, sf), b.where("bz <> 1"), CAMERA, COARSE, culled=False))


@query("j19_all_blocks_check", fused_with(*C) + "SELECT DISTINCT bx, by, bz, CASE WHEN bz = 1 THEN 'absent' ELSE 'identical' END AS verdict FROM vo")
def j19_all(s, sf):
    """All blocks of a volume against the same blocks fused alone; one layer is left out of the second volume."""
    b = blocks(s, sf)
    return fuse.compare_volumes(volume(s, sf), fuse.fuse(derived.scan(s, sf), b.where("bz <> 1"), CAMERA, COARSE, culled=False))


@query(
    "m2_dense_tsdf",
    scan_with(
        "pl AS (SELECT CAST(i % 4 - 2 AS INTEGER) AS bx, CAST((i // 4) % 4 - 2 AS INTEGER) AS by, CAST(i // 16 AS INTEGER) AS bz FROM range(64) q(i))",
        eval_sql(*C),
        volume_sql(0.4),
    )
    + "SELECT bx, by, bz, l, tsdf_sum, weight FROM vo",
)
def m2(s, sf):
    """A dense box of voxels (M2, M3): the same fusion over every block of the box; voxels never seen are absent."""
    box = s.range(64).select(*[(F.floor(F.col("id") / k) % 4 - o).cast("int").alias(n) for n, k, o in (("bx", 1, 2), ("by", 4, 2), ("bz", 16, 0))])
    return fuse.fuse(derived.scan(s, sf), box, CAMERA, COARSE)


@query("m4_auto_dense_tsdf", scan_with(plan_sql(*C), _BOX, eval_sql(*C, plan="bo"), volume_sql(0.4)) + "SELECT bx, by, bz, l, tsdf_sum, weight FROM vo")
def m4(s, sf):
    """A dense box of voxels with the bounds of the scan's own plan (M4)."""
    return fuse.fuse(derived.scan(s, sf), candidate_box(blocks(s, sf)), CAMERA, COARSE)


@query(
    "a27_traversal_receipts",
    fused_with(*C)
    + """SELECT seq, count(*) FILTER (status = 'contributes') AS updated, count(DISTINCT CASE WHEN status = 'contributes' THEN (bx, by, bz) END) AS blocks FROM ev GROUP BY 1""",
)
def a27(s, sf):
    e = fuse.evaluated(derived.scan(s, sf), blocks(s, sf), CAMERA, COARSE, culled=False)
    hit = F.col("status") == "contributes"
    each = e.groupBy("seq", "bx", "by", "bz").agg(F.count_if(hit).alias("n"))
    return each.groupBy("seq").agg(F.sum("n").alias("updated"), F.count_if(F.expr("n > 0")).alias("blocks"))
