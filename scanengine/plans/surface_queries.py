"""Queries of surfaces, meshes, free space and routes over the fused derived scan."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from scanengine.operators import freespace, mesh, surface
from scanengine.plans.common import registrar
from scanengine.plans.fusion_queries import COARSE, points, scan_tables, volume
from scanengine.plans.scan_sql import d, fused_with
from scanengine.sources import derived, scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)

V = COARSE.voxel
#: sm(gx, gy, gz, value): known voxels by global index.
SAMPLES = "sm AS (SELECT bx * 8 + l % 8 AS gx, by * 8 + (l // 8) % 8 AS gy, bz * 8 + l // 64 AS gz, tsdf_sum / weight AS value, tsdf_sum, weight FROM vo)"


def base(*more: str) -> str:
    return fused_with(V, COARSE.truncation, SAMPLES, *more)


def samples(s, sf):
    return surface.samples(volume(s, sf))


def _c(expr: str) -> str:
    return f"({expr} + {d(0.5)}) * {d(V)}"


@query("j6_voxel_locate", base() + "SELECT gx, gy, gz, value FROM sm")
def j6(s, sf):
    return samples(s, sf)


@query(
    "j6_located_points",
    base(
        f"""lp AS (SELECT seq, u, v, CAST(floor(wx / {d(V)}) AS BIGINT) AS gx, CAST(floor(wy / {d(V)}) AS BIGINT) AS gy, CAST(floor(wz / {d(V)}) AS BIGINT) AS gz FROM pt),
lb AS (SELECT *, CAST(floor(gx / 8.0) AS INTEGER) AS bx, CAST(floor(gy / 8.0) AS INTEGER) AS by, CAST(floor(gz / 8.0) AS INTEGER) AS bz FROM lp),
lh AS (SELECT DISTINCT bx, by, bz FROM vo WHERE (bx + by + bz) % 3 <> 0)"""
    )
    + """SELECT lb.seq, lb.u, lb.v, CAST(lb.gx - 8 * lb.bx + 8 * (lb.gy - 8 * lb.by) + 64 * (lb.gz - 8 * lb.bz) AS INTEGER) AS l,
    CASE WHEN lh.bx IS NULL THEN 'no-block' WHEN vo.l IS NULL THEN 'unobserved' ELSE 'observed' END AS status, vo.weight
    FROM lb LEFT JOIN lh ON lh.bx = lb.bx AND lh.by = lb.by AND lh.bz = lb.bz
    LEFT JOIN vo ON lh.bx IS NOT NULL AND vo.bx = lb.bx AND vo.by = lb.by AND vo.bz = lb.bz AND vo.l = lb.gx - 8 * lb.bx + 8 * (lb.gy - 8 * lb.by) + 64 * (lb.gz - 8 * lb.bz)""",
)
def j6_points(s, sf):
    """The voxel of every point of the scan, looked up in a volume that lacks a third of its blocks."""
    held = volume(s, sf).where("(bx + by + bz) % 3 <> 0")
    return surface.locate(points(s, sf).select("seq", "u", "v", "wx", "wy", "wz"), held, V).select("seq", "u", "v", "l", "status", "weight")


@query(
    "m5_surface_points",
    base(
        """nx AS (SELECT a.gx, a.gy, a.gz, a.value, k, b.value AS nv FROM sm a, range(1, 4) r(k)
             JOIN sm b ON b.gx = a.gx + (k = 1)::INT AND b.gy = a.gy + (k = 2)::INT AND b.gz = a.gz + (k = 3)::INT)"""
    )
    + f"""SELECT 0 AS kind, gx, gy, gz, {_c("gx")} AS x, {_c("gy")} AS y, {_c("gz")} AS z FROM sm WHERE value = 0
    UNION ALL SELECT k::INT, gx, gy, gz,
      CASE WHEN k = 1 THEN {_c("gx")} + value / (value - nv) * ({_c("(gx + 1)")} - {_c("gx")}) ELSE {_c("gx")} END,
      CASE WHEN k = 2 THEN {_c("gy")} + value / (value - nv) * ({_c("(gy + 1)")} - {_c("gy")}) ELSE {_c("gy")} END,
      CASE WHEN k = 3 THEN {_c("gz")} + value / (value - nv) * ({_c("(gz + 1)")} - {_c("gz")}) ELSE {_c("gz")} END
    FROM nx WHERE value * nv < 0""",
)
def m5(s, sf):
    return surface.surface_points(samples(s, sf), V)


CELLS = """
cs AS (SELECT gx - k % 2 AS gx, gy - (k // 2) % 2 AS gy, gz - k // 4 AS gz, k, value FROM sm, range(8) r(k)),
ce AS (SELECT gx, gy, gz, count(*) AS known, min(value) AS lo, max(value) AS hi, bool_or(value = 0) AS zero, list(value ORDER BY k) AS vs FROM cs GROUP BY 1, 2, 3)"""


@query(
    "j7_m6_cell_report",
    base(CELLS)
    + """SELECT count(*) AS considered, count(*) FILTER (known < 8) AS "unknown", count(*) FILTER (known = 8 AND zero) AS exact_zero,
    count(*) FILTER (known = 8 AND NOT zero) AS eligible, count(*) FILTER (known = 8 AND NOT zero AND lo < 0 AND hi > 0) AS active FROM ce""",
)
def m6(s, sf):
    return surface.cell_report(surface.cells(samples(s, sf)))


def _case_values() -> str:
    return "cv(tetra, pattern, tri, n0, p0, n1, p1, n2, p2) AS (VALUES " + ", ".join(
        "(" + ", ".join(map(str, [t, p, k, *[c for e in tri for c in e]])) + ")" for t, p, k, tri in surface.cases()
    ) + ")"


def _tetra_values() -> str:
    return "tv(tetra, a, b, c, e) AS (VALUES " + ", ".join(str((t, *sorted(q))) for t, q in enumerate(surface.TETRAHEDRA)) + ")"


def _corner(n: str, p: str, a: int, g: str) -> str:
    bit = lambda c: f"(({c} >> {a}) & 1)"
    return f"{_c(f'({g} + {bit(n)})')} + vn / (vn - vp) * ({_c(f'({g} + {bit(p)})')} - {_c(f'({g} + {bit(n)})')})"


MESH = (
    CELLS,
    _tetra_values(),
    _case_values(),
    """
tp AS (SELECT gx, gy, gz, vs, t.tetra, (vs[a + 1] < 0)::INT + 2 * (vs[b + 1] < 0)::INT + 4 * (vs[c + 1] < 0)::INT + 8 * (vs[e + 1] < 0)::INT AS pattern
       FROM ce, tv t WHERE known = 8 AND NOT zero),
tt AS (SELECT tp.*, tri, k, CASE k WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END AS n, CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p
       FROM tp JOIN cv USING (tetra, pattern), range(3) r(k)),
tc AS (SELECT gx, gy, gz, tetra, tri, k, n, p, vs[n + 1] AS vn, vs[p + 1] AS vp FROM tt),"""
    + f"""
kc AS (SELECT gx, gy, gz, tetra, tri, k AS corner, gx + least(n & 1, p & 1) AS ex, gy + least((n >> 1) & 1, (p >> 1) & 1) AS ey,
              gz + least((n >> 2) & 1, (p >> 2) & 1) AS ez, xor(n, p) AS code,
              {_corner("n", "p", 0, "gx")} AS x, {_corner("n", "p", 1, "gy")} AS y, {_corner("n", "p", 2, "gz")} AS z, n, p FROM tc),
hk AS (SELECT gx, gy, gz, tetra, tri, corner, ex || ',' || ey || ',' || ez || ',' || code AS k FROM kc),
fk AS (SELECT gx, gy, gz, tetra, tri, max(CASE corner WHEN 0 THEN k END) AS k0, max(CASE corner WHEN 1 THEN k END) AS k1, max(CASE corner WHEN 2 THEN k END) AS k2 FROM hk GROUP BY 1, 2, 3, 4, 5),
he AS (SELECT least(k0, k1) AS a, greatest(k0, k1) AS b FROM fk UNION ALL SELECT least(k1, k2), greatest(k1, k2) FROM fk UNION ALL SELECT least(k2, k0), greatest(k2, k0) FROM fk),
hn AS (SELECT a, b, count(*) AS n FROM he GROUP BY 1, 2)""",
)


def mesh_corners(s, sf):
    return surface.corners(surface.triangles(surface.active_cells(samples(s, sf))), V)


@query("m9_mesh_triangles", base(*MESH) + "SELECT gx, gy, gz, tetra, tri, corner, ex, ey, ez, code, x, y, z FROM kc")
def m9(s, sf):
    return mesh_corners(s, sf)


@query("m7_mesh_vertices", base(*MESH) + "SELECT ex, ey, ez, code, min(x) AS x, min(y) AS y, min(z) AS z FROM kc GROUP BY 1, 2, 3, 4")
def m7(s, sf):
    return surface.vertices(mesh_corners(s, sf))


@query(
    "w3_vertex_numbers",
    base(*MESH)
    + """, vf AS (SELECT *, row_number() OVER (PARTITION BY ex, ey, ez, code ORDER BY gz, gy, gx, tetra, n, p) AS r FROM kc)
    SELECT ex, ey, ez, code, row_number() OVER (ORDER BY gz, gy, gx, tetra, n, p) - 1 AS id FROM vf WHERE r = 1""",
)
def w3(s, sf):
    t = surface.triangles(surface.active_cells(samples(s, sf)))
    return surface.vertex_numbers(surface.corners(t, V, ("n", "p")))


@query("a17_half_edges", base(*MESH) + "SELECT count(*) FILTER (n = 1) AS boundary, count(*) FILTER (n = 2) AS manifold, count(*) FILTER (n > 2) AS non_manifold FROM hn")
def a17(s, sf):
    return surface.edge_report(mesh_corners(s, sf))


def rec(sql: str) -> str:
    return "WITH RECURSIVE" + sql[len("WITH") :]


def _reached(name: str, links: str) -> str:
    """name(n, r): the smallest node r that each node n of links (a, b), given both ways, reaches."""
    return f"""{name}(n, r) USING KEY (n) AS (SELECT DISTINCT a, a FROM {links} UNION SELECT x.n, x.r
FROM (SELECT l.b AS n, min(c.r) AS r FROM {name} c JOIN {links} l ON l.a = c.n GROUP BY 1) x JOIN recurring.{name} q ON q.n = x.n WHERE x.r < q.r)"""


@query(
    "a18_a19_face_components",
    rec(base(*MESH)) + ", hl AS MATERIALIZED (SELECT a, b FROM he UNION SELECT b, a FROM he), " + _reached("hc", "hl")
    + " SELECT gx, gy, gz, tetra, tri, r AS component, count(*) OVER (PARTITION BY r) AS triangles FROM fk JOIN hc ON hc.n = least(k0, k1, k2) QUALIFY triangles >= 2",
)
def a18(s, sf):
    """Components of two triangles or more."""
    return surface.face_components(mesh_corners(s, sf)).where("triangles >= 2")


_FACES = """,
vf AS (SELECT *, row_number() OVER (PARTITION BY ex, ey, ez, code ORDER BY gz, gy, gx, tetra, n, p) AS r FROM kc),
vn AS (SELECT ex, ey, ez, code, row_number() OVER (ORDER BY gz, gy, gx, tetra, n, p) - 1 AS id FROM vf WHERE r = 1),
ff AS (SELECT row_number() OVER (ORDER BY gz, gy, gx, tetra, tri) - 1 AS face, max(CASE corner WHEN 0 THEN id END) AS v0, max(CASE corner WHEN 1 THEN id END) AS v1, max(CASE corner WHEN 2 THEN id END) AS v2
       FROM kc JOIN vn USING (ex, ey, ez, code) GROUP BY gz, gy, gx, tetra, tri)"""


def indexed(s, sf):
    """The indexed mesh, written once an application."""
    corners = lambda: surface.corners(surface.triangles(surface.active_cells(samples(s, sf))), V, ("n", "p"))
    made = functools.cache(lambda: mesh.indexed(corners()))
    return scratch.once(s, "faces", scan_tables(sf), (), lambda: made()[0]), scratch.once(s, "vertices", scan_tables(sf), (), lambda: made()[1])


@query("w4_face_order", base(*MESH) + _FACES + " SELECT face, v0, v1, v2 FROM ff")
def w4(s, sf):
    """Faces by their vertices' numbers, in the order of cells."""
    return indexed(s, sf)[0]


def _face_points() -> str:
    pick = ", ".join(f"max(CASE k WHEN {i} THEN {c} END) AS {c}{i}" for i in range(3) for c in "xyz")
    return f""", t3 AS (SELECT face, list_sort([v0, v1, v2]) AS t FROM ff),
r3 AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY face) AS r FROM t3),
vp AS (SELECT id, x, y, z FROM vn JOIN (SELECT ex, ey, ez, code, min(x) AS x, min(y) AS y, min(z) AS z FROM kc GROUP BY 1, 2, 3, 4) q USING (ex, ey, ez, code)),
fp AS (SELECT face, {pick} FROM (SELECT face, unnest([0, 1, 2]) AS k, unnest([v0, v1, v2]) AS id FROM ff) u JOIN vp USING (id) GROUP BY face)"""


_PROBLEMS = """SELECT face, 'repeated' AS problem FROM r3 WHERE r > 1 UNION ALL SELECT face, 'degenerate' FROM fp
    WHERE (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) = 0 AND (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) = 0 AND (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) = 0"""


def _sides(faces: str) -> str:
    return " UNION ALL ".join(f"SELECT face, least({p}, {q}) AS a, greatest({p}, {q}) AS b FROM {faces}" for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0")))


def _fans(cf: str) -> str:
    """fn(v, face, fan): the fan, named by its first face, that each face of cf belongs to at each of its vertices."""
    return f""", sd AS MATERIALIZED ({_sides(cf)}), sv AS (SELECT a, b, face, unnest([a, b]) AS v FROM sd),
s1 AS (SELECT a, b, v, min(face) AS f0 FROM sv GROUP BY 1, 2, 3),
s2 AS (SELECT DISTINCT v * 1000000000 + f0 AS a, v * 1000000000 + face AS b FROM sv JOIN s1 USING (a, b, v)),
fl AS MATERIALIZED (SELECT a, b FROM s2 UNION SELECT b, a FROM s2), {_reached("fc", "fl")},
fn AS MATERIALIZED (SELECT n // 1000000000 AS v, n % 1000000000 AS face, r % 1000000000 AS fan FROM fc)"""


def _clean() -> str:
    """cf(face, v0, v1, v2): the faces without problems, numbered again; and their fans."""
    return (
        rec(base(*MESH)) + _FACES + _face_points()
        + f", bf AS ({_PROBLEMS}), cf AS MATERIALIZED (SELECT row_number() OVER (ORDER BY face) - 1 AS face, v0, v1, v2 FROM ff WHERE face NOT IN (SELECT face FROM bf))"
        + _fans("cf")
    )


@query("m10_face_problems", base(*MESH) + _FACES + _face_points() + " " + _PROBLEMS)
def m10(s, sf):
    return mesh.face_problems(*indexed(s, sf))


@query(
    "m11_split_pinches",
    _clean() + """, kp AS (SELECT v, min(fan) AS keeps FROM fn GROUP BY 1),
    nw AS (SELECT v, fan, row_number() OVER (ORDER BY v, fan) - 1 + (SELECT count(*) FROM vn) AS id FROM (SELECT DISTINCT v, fan FROM fn JOIN kp USING (v) WHERE fan > keeps) q),
    mv AS (SELECT v, face, id FROM fn JOIN nw USING (v, fan))
    SELECT cf.face, coalesce(a.id, v0) AS v0, coalesce(b.id, v1) AS v1, coalesce(c.id, v2) AS v2 FROM cf LEFT JOIN mv a ON a.face = cf.face AND a.v = v0
    LEFT JOIN mv b ON b.face = cf.face AND b.v = v1 LEFT JOIN mv c ON c.face = cf.face AND c.v = v2""",
)
def m11_split(s, sf):
    """The mesh without bad faces, a vertex for each fan."""
    faces, vertices = indexed(s, sf)
    return mesh.split_pinches(mesh.clean(faces, vertices), vertices)[0]


@query(
    "m12_manifold_verdict",
    _clean() + """, en AS (SELECT count(*) FILTER (n = 1) AS boundary, count(*) FILTER (n = 2) AS inner_, count(*) FILTER (n > 2) AS crowded FROM (SELECT a, b, count(*) AS n FROM sd GROUP BY 1, 2) q),
    pn AS (SELECT count(*) AS vertices, count(*) FILTER (n > 1) AS pinched FROM (SELECT v, count(DISTINCT fan) AS n FROM fn GROUP BY 1) q)
    SELECT (SELECT count(*) FROM cf) AS faces, vertices, boundary, inner_ AS "inner", crowded, pinched,
    CASE WHEN crowded > 0 OR pinched > 0 THEN 'non-manifold' WHEN boundary > 0 THEN 'manifold-with-boundary' ELSE 'closed' END AS verdict FROM en, pn""",
)
def m12(s, sf):
    faces, vertices = indexed(s, sf)
    return mesh.verdict(mesh.clean(faces, vertices))


@query(
    "a19_large_components",
    rec(base(*MESH)) + _FACES + f""", sd AS ({_sides("ff")}), fl AS MATERIALIZED (SELECT a, b FROM sd UNION SELECT b, a FROM sd), {_reached("fc", "fl")},
    lf AS MATERIALIZED (SELECT face, v0, v1, v2 FROM ff JOIN fc ON fc.n = v0 QUALIFY count(*) OVER (PARTITION BY r) >= 4),
    lv AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT DISTINCT unnest([v0, v1, v2]) AS id FROM lf) q)
    SELECT row_number() OVER (ORDER BY face) - 1 AS face, a.k AS v0, b.k AS v1, c.k AS v2 FROM lf JOIN lv a ON a.id = v0 JOIN lv b ON b.id = v1 JOIN lv c ON c.id = v2""",
)
def a19(s, sf):
    """Components of four triangles or more, renumbered."""
    return mesh.keep_components(*indexed(s, sf), 4)[0]


_DENSE = "sm AS (SELECT * FROM sm0 WHERE gx BETWEEN -16 AND 15 AND gy BETWEEN -16 AND 15 AND gz BETWEEN 0 AND 31)"


@query("m6_dense_mesh", base(*MESH).replace("sm AS (", "sm0 AS (", 1).replace(CELLS, _DENSE + "," + CELLS, 1) + "SELECT gx, gy, gz, tetra, tri, corner, ex, ey, ez, code, x, y, z FROM kc")
def m6_dense(s, sf):
    """The mesh of a dense box of voxels."""
    v = mesh.dense_samples(volume(s, sf), (-16, -16, 0), (32, 32, 32))
    return surface.corners(surface.triangles(surface.active_cells(v)), V)


@query(
    "m11_m12_vertex_fans",
    rec(base(*MESH)) + """, fs AS (SELECT gx || ',' || gy || ',' || gz || ',' || tetra || ',' || tri AS face, k0, k1, k2 FROM fk),
    hs AS MATERIALIZED (SELECT face, least(k0, k1) AS a, greatest(k0, k1) AS b FROM fs UNION ALL SELECT face, least(k1, k2), greatest(k1, k2) FROM fs UNION ALL SELECT face, least(k2, k0), greatest(k2, k0) FROM fs),
    hv AS (SELECT a, b, face, unnest([a, b]) AS v FROM hs), h1 AS (SELECT a, b, v, min(face) AS f0 FROM hv GROUP BY 1, 2, 3),
    h2 AS (SELECT DISTINCT v || '|' || f0 AS a, v || '|' || face AS b FROM hv JOIN h1 USING (a, b, v)), hl AS MATERIALIZED (SELECT a, b FROM h2 UNION SELECT b, a FROM h2), """
    + _reached("hc", "hl") + " SELECT split_part(n, '|', 1) AS v, split_part(r, '|', 2) AS fan, count(*) AS triangles FROM hc GROUP BY 1, 2",
)
def m11(s, sf):
    return surface.fans(mesh_corners(s, sf))


@query(
    "a9_free_space_columns",
    base()
    + """SELECT gx AS a, gz AS b, CASE WHEN bool_or(value <= 0) THEN 'occupied' WHEN count(*) = 3 THEN 'free' ELSE 'unknown' END AS verdict
    FROM sm WHERE gy BETWEEN -1 AND 1 GROUP BY 1, 2""",
)
def a9(s, sf):
    return freespace.columns(samples(s, sf), -1, 1)


@query(
    "j18_camera_verdicts",
    base(f"ca AS (SELECT seq AS id, CAST(floor(m3 / {d(V)}) AS BIGINT) AS gx, CAST(floor(m7 / {d(V)}) AS BIGINT) AS gy, CAST(floor(m11 / {d(V)}) AS BIGINT) AS gz FROM fr WHERE has_pose)")
    + """SELECT id, ca.gx, ca.gy, ca.gz, CASE WHEN value IS NULL THEN 'unobserved' WHEN value <= 0 THEN 'occupied' ELSE 'free' END AS verdict
    FROM ca LEFT JOIN sm ON sm.gx = ca.gx AND sm.gy = ca.gy AND sm.gz = ca.gz""",
)
def j18(s, sf):
    cams = derived.frames(s, sf).where("has_pose").select(F.col("seq").alias("id"), F.col("m3").alias("x"), F.col("m7").alias("y"), F.col("m11").alias("z"))
    return freespace.voxel_verdicts(cams, samples(s, sf), V)


ROUTE = [(0, 2), (5, 9), (-3, 14), (-3, 4)]
CHAIN = "wp(leg, a0, b0, a1, b1) AS (VALUES " + ", ".join(str((k, *p, *q)) for k, (p, q) in enumerate(zip(ROUTE, ROUTE[1:]))) + """),
ch(leg, step, a, b, e, da, db, sa, sb, n) AS (
  SELECT leg, 0, a0, b0, abs(a1 - a0) - abs(b1 - b0), abs(a1 - a0), abs(b1 - b0), sign(a1 - a0)::INT, sign(b1 - b0)::INT, greatest(abs(a1 - a0), abs(b1 - b0)) FROM wp
  UNION ALL SELECT leg, step + 1, a + CASE WHEN 2 * e > -db THEN sa ELSE 0 END, b + CASE WHEN 2 * e < da THEN sb ELSE 0 END,
    e - CASE WHEN 2 * e > -db THEN db ELSE 0 END + CASE WHEN 2 * e < da THEN da ELSE 0 END, da, db, sa, sb, n FROM ch WHERE step < n),
sw AS (SELECT DISTINCT a + i AS a, b + j AS b FROM ch, range(-2, 3) r(i), range(-2, 3) q(j) WHERE i * i + j * j <= 4)"""


def route_columns(s):
    return freespace.swept(freespace.chain(freespace.waypoints(s, ROUTE)), 2)


#: A leg for each supplier.
_LEGS = CHAIN.replace(CHAIN[: CHAIN.index("),\nch(") + 1], """wp AS (SELECT CAST(s_suppkey AS INTEGER) AS leg, CAST(s_suppkey * 7 % 41 - 20 AS INTEGER) AS a0, CAST(s_nationkey AS INTEGER) AS b0,
  CAST(s_suppkey * 11 % 53 - 26 AS INTEGER) AS a1, CAST(s_suppkey % 17 AS INTEGER) AS b1 FROM supplier)""", 1)


def legs(s, sf):
    k = F.col("s_suppkey")
    return derived.table(s, sf, "supplier").select(k.cast("int").alias("leg"), (k * 7 % 41 - 20).alias("a0"), F.col("s_nationkey").cast("long").alias("b0"), (k * 11 % 53 - 26).alias("a1"), (k % 17).alias("b1"))


def leg_columns(s, sf):
    return freespace.swept(freespace.chain(legs(s, sf)), 2)


@query("g8_route_chain", "WITH RECURSIVE " + _LEGS + " SELECT leg, step, a::BIGINT AS a, b::BIGINT AS b FROM ch")
def g8(s, sf):
    return freespace.chain(legs(s, sf))


@query("g9_route_sweep", "WITH RECURSIVE " + _LEGS + " SELECT a::BIGINT AS a, b::BIGINT AS b FROM sw")
def g9(s, sf):
    return leg_columns(s, sf)


@query("g10_touched_blocks", "WITH RECURSIVE " + _LEGS + " SELECT DISTINCT CAST(floor(a / 8.0) AS INT) AS bx, CAST(y AS INT) AS by, CAST(floor(b / 8.0) AS INT) AS bz FROM sw, range(-1, 1) r(y)")
def g10(s, sf):
    return freespace.touched_blocks(leg_columns(s, sf), -1, 1)


@query(
    "a10_route_clearance",
    rec(base(CHAIN))
    + """, nd AS (SELECT sw.a AS gx, y AS gy, sw.b AS gz, weight, tsdf_sum FROM sw JOIN range(-1, 2) r(y) ON true LEFT JOIN sm ON sm.gx = sw.a AND sm.gy = y AND sm.gz = sw.b),
    nv AS (SELECT *, coalesce(weight < 3, true) AS weak, NOT coalesce(weight < 3, true) AND tsdf_sum <= 0 AS hit FROM nd),
    f1 AS (SELECT gx, gy, gz FROM nv WHERE weak OR hit ORDER BY gz, gy, gx LIMIT 1)
    SELECT count(*) AS voxels, count(*) FILTER (weak) AS unobserved, count(*) FILTER (hit) AS occupied,
    CASE WHEN count(*) FILTER (weak OR hit) = 0 THEN 'clear' ELSE 'not-clear' END AS verdict,
    (SELECT gx FROM f1)::BIGINT AS first_x, (SELECT gy FROM f1)::BIGINT AS first_y, (SELECT gz FROM f1)::BIGINT AS first_z FROM nv""",
)
def a10(s, sf):
    v = volume(s, sf)
    part = {"x": F.col("l") % 8, "y": F.floor(F.col("l") / 8) % 8, "z": F.floor(F.col("l") / 64)}
    flat = v.select(*[(F.col(f"b{a}").cast("long") * 8 + part[a]).alias(f"g{a}") for a in "xyz"], "tsdf_sum", "weight")
    return freespace.clearance(route_columns(s), flat, -1, 1, 3)


@query(
    "j20_absent_blocks",
    rec(base(CHAIN)) + """, tb AS (SELECT DISTINCT CAST(floor(a / 8.0) AS INT) AS bx, CAST(y AS INT) AS by, CAST(floor(b / 8.0) AS INT) AS bz FROM sw, range(-1, 1) r(y))
    SELECT bx, by, bz FROM tb EXCEPT SELECT bx, by, bz FROM vo""",
)
def j20(s, sf):
    return freespace.touched_blocks(route_columns(s), -1, 1).join(volume(s, sf).select("bx", "by", "bz").distinct(), ["bx", "by", "bz"], "left_anti")


@query(
    "j20_absent_high_blocks",
    rec(base(CHAIN)) + """, tb AS (SELECT DISTINCT CAST(floor(a / 8.0) AS INT) AS bx, CAST(y AS INT) AS by, CAST(floor(b / 8.0) AS INT) AS bz FROM sw, range(-2, 3) r(y))
    SELECT bx, by, bz FROM tb EXCEPT SELECT bx, by, bz FROM vo""",
)
def j20_high(s, sf):
    """The same route for a taller traveller, above what the scan saw."""
    return freespace.touched_blocks(route_columns(s), -10, 20).join(volume(s, sf).select("bx", "by", "bz").distinct(), ["bx", "by", "bz"], "left_anti")


@query(
    "f6_band_window",
    base()
    + f"""SELECT gx AS a, gz AS b, CASE WHEN bool_or(value <= 0) THEN 'occupied' WHEN count(*) = 3 THEN 'free' ELSE 'unknown' END AS verdict
    FROM sm WHERE gy BETWEEN -1 AND 1 AND (gx + {d(0.5)}) * {d(V)} BETWEEN {d(-1.0)} AND {d(1.0)} AND (gz + {d(0.5)}) * {d(V)} BETWEEN {d(0.0)} AND {d(2.5)} GROUP BY 1, 2""",
)
def f6(s, sf):
    """The free-space map of a window of the world, two metres wide."""
    return freespace.columns(freespace.window(samples(s, sf), V, a=(-1.0, 1.0), b=(0.0, 2.5)), -1, 1)
