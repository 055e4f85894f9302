"""Queries of accuracy, completeness and noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import evaluate, mesh, order, placement, replay, surface
from scanengine.plans import surface_queries
from scanengine.plans.common import registrar
from scanengine.plans.fusion_queries import COARSE, even_volume
from scanengine.plans.fusion_queries import points as all_points
from scanengine.plans.scan_sql import d, eval_sql, plan_sql, scan_with, volume_sql
from scanengine.plans.surface_queries import V, base, indexed, samples
from scanengine.sources import derived, scratch
from scanengine.sources.derived import CAMERA, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)

LIMIT = 0.25


def even_base(*more: str) -> str:
    """base() with the plan and the volume of even frames alone."""
    even = lambda t: f"(SELECT * FROM {t} WHERE seq % 2 = 0)"
    return scan_with(plan_sql(V, COARSE.truncation, even("pt")), eval_sql(V, COARSE.truncation), volume_sql(COARSE.truncation, even("ev")), surface_queries.SAMPLES, *more)


_PTS = """
ea AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings WHERE vec_id % 2 = 1),
eb AS (SELECT vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings WHERE vec_id % 2 = 0)"""
_D2 = "((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) + (q.z - r.z) * (q.z - r.z))"


def cloud(s, sf, odd: int, name: str):
    e = table(s, sf, "embeddings").where(F.col("vec_id") % 2 == odd)
    return e.select(F.col("vec_id").alias(name), *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")])


def near(s, sf):
    return evaluate.nearest(cloud(s, sf, 1, "id"), cloud(s, sf, 0, "idx"), LIMIT)


_NEAR = f"""
nn AS (SELECT q.id, r.idx, {_D2} AS d2, row_number() OVER (PARTITION BY q.id ORDER BY {_D2}, r.idx) AS k FROM ea q JOIN eb r ON {_D2} <= {d(LIMIT)} * {d(LIMIT)}),
nr AS (SELECT ea.id, nn.idx, nn.d2 FROM ea LEFT JOIN nn ON nn.id = ea.id AND nn.k = 1)"""


@query("j10_nearest_points", f"WITH {_PTS}, {_NEAR} SELECT id, idx, d2 FROM nr")
def j10(s, sf):
    return near(s, sf)


@query(
    "a12_ranked_percentiles",
    f"""WITH {_PTS}, {_NEAR}, rk AS (SELECT d2, row_number() OVER (ORDER BY d2 NULLS LAST) AS k, count(*) OVER () AS total FROM nr)
    SELECT p AS "percent", (SELECT d2 FROM rk WHERE k = greatest(1, ceil(total * p / 100)::BIGINT)) AS value FROM (VALUES (50), (90), (95)) t(p)""",
)
def a12(s, sf):
    return evaluate.ranked_percentiles(near(s, sf), "d2")


@query(
    "a13_within_thresholds",
    f"""WITH {_PTS}, {_NEAR} SELECT t AS threshold, count(*) FILTER (d2 <= t * t)::DOUBLE / count(*) AS share FROM nr, (VALUES ({d(0.05)}), ({d(0.1)}), ({d(0.2)})) v(t) GROUP BY 1""",
)
def a13(s, sf):
    t = F.explode(F.array(F.lit(0.05), F.lit(0.1), F.lit(0.2))).alias("threshold")
    return near(s, sf).select("d2", t).groupBy("threshold").agg((F.count_if(F.col("d2") <= F.col("threshold") * F.col("threshold")) / F.count("*")).alias("share"))


@query(
    "j14_j15_volume_sampling",
    even_base(
        f"""hp AS (SELECT seq * 1000 + v * 32 + u AS id, wx, wy, wz, floor(wx / {d(V)} - {d(0.5)}) AS b0, floor(wy / {d(V)} - {d(0.5)}) AS b1, floor(wz / {d(V)} - {d(0.5)}) AS b2 FROM pt WHERE seq % 2 = 1),
hc AS (SELECT id, k, b0 + k % 2 AS gx, b1 + (k // 2) % 2 AS gy, b2 + k // 4 AS gz,
  CASE WHEN k % 2 = 1 THEN wx / {d(V)} - {d(0.5)} - b0 ELSE {d(1.0)} - (wx / {d(V)} - {d(0.5)} - b0) END
  * CASE WHEN (k // 2) % 2 = 1 THEN wy / {d(V)} - {d(0.5)} - b1 ELSE {d(1.0)} - (wy / {d(V)} - {d(0.5)} - b1) END
  * CASE WHEN k // 4 = 1 THEN wz / {d(V)} - {d(0.5)} - b2 ELSE {d(1.0)} - (wz / {d(V)} - {d(0.5)} - b2) END AS w FROM hp, range(8) r(k)),
hv AS (SELECT id, sum(w * value ORDER BY k) AS value, count(*) AS n FROM hc JOIN sm ON sm.gx = hc.gx AND sm.gy = hc.gy AND sm.gz = hc.gz GROUP BY 1),
ho AS (SELECT id, sm.value AS nearest FROM hp LEFT JOIN sm ON sm.gx = floor(wx / {d(V)}) AND sm.gy = floor(wy / {d(V)}) AND sm.gz = floor(wz / {d(V)}))"""
    )
    + "SELECT ho.id, CASE WHEN hv.n = 8 THEN hv.value END AS value, nearest FROM ho LEFT JOIN hv ON hv.id = ho.id",
)
def j14(s, sf):
    return held_out(s, sf)


def held_out(s, sf):
    """Points of odd frames in the volume of even ones."""
    p = all_points(s, sf).where("seq % 2 = 1").select((F.col("seq") * 1000 + F.col("v") * 32 + F.col("u")).alias("id"), F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"))
    return evaluate.trilinear(p, surface.samples(even_volume(s, sf)), V)


@query(
    "a11_w5_residual_summary",
    SQL["j14_j15_volume_sampling"].rsplit("SELECT ho.id", 1)[0]
    + f""", re AS (SELECT hv.value * {d(COARSE.truncation)} AS r FROM hv WHERE n = 8)
    SELECT count(*) AS n, round(1000 * avg(r), 6) AS mean_mm, round(1000 * sqrt(avg(r * r)), 6) AS rms_mm, quantile_cont(abs(r), 0.5) AS median, quantile_cont(abs(r), 0.95) AS p95, count(*) FILTER (abs(r) <= {d(V)})::DOUBLE / count(*) AS within FROM re""",
)
def a11(s, sf):
    """Residuals of held-out frames: the interpolated value in metres."""
    r = held_out(s, sf).select((F.col("value") * F.lit(COARSE.truncation)).alias("r"))
    return evaluate.residual_summary(r, "r", V)


_MODEL = f"""
mo AS (SELECT CAST(i AS BIGINT) AS idx, (i % 12 - 6) * {d(0.15)} AS x, (i // 12 % 12 - 6) * {d(0.1)} AS y, (i // 144 + 1) * {d(0.5)} AS z,
       {d(0.0)} AS nx, CASE WHEN i % 3 = 0 THEN {d(0.6)} ELSE {d(0.0)} END AS ny, CASE WHEN i % 3 = 0 THEN {d(-0.8)} ELSE {d(-1.0)} END AS nz FROM range(1440) r(i))"""


def model(s):
    i = F.col("id")
    slant = i % 3 == 0
    return s.range(1440).select(
        i.alias("idx"), ((i % 12 - 6) * F.lit(0.15)).alias("x"), ((F.floor(i / 12) % 12 - 6) * F.lit(0.1)).alias("y"), ((F.floor(i / 144) + 1) * F.lit(0.5)).alias("z"),
        F.lit(0.0).alias("nx"), F.when(slant, F.lit(0.6)).otherwise(F.lit(0.0)).alias("ny"), F.when(slant, F.lit(-0.8)).otherwise(F.lit(-1.0)).alias("nz"),
    )


_VIEWS = f"""
v1 AS (SELECT f.seq, idx, m0 * (x - m3) + m4 * (y - m7) + m8 * (z - m11) AS xc, m1 * (x - m3) + m5 * (y - m7) + m9 * (z - m11) AS yc,
  m2 * (x - m3) + m6 * (y - m7) + m10 * (z - m11) AS zc, -(nx * (x - m3) + ny * (y - m7) + nz * (z - m11)) AS facing,
  sqrt((x - m3) * (x - m3) + (y - m7) * (y - m7) + (z - m11) * (z - m11)) AS len FROM mo, fr f WHERE has_depth AND has_pose),
v2 AS (SELECT *, {d(24.0)} * xc / zc + {d(15.5)} AS pu, {d(24.0)} * yc / zc + {d(11.5)} AS pv FROM v1 WHERE zc > {d(0.05)} AND facing > 0),
v3 AS (SELECT v2.idx, facing / len AS cosine FROM v2 JOIN px p ON p.seq = v2.seq AND p.u = CAST(floor(pu + {d(0.5)}) AS INT) AND p.v = CAST(floor(pv + {d(0.5)}) AS INT)
  WHERE pu >= {d(-0.5)} AND pu < {d(31.5)} AND pv >= {d(-0.5)} AND pv < {d(23.5)} AND p.raw > 0 AND abs(p.raw * {d(0.001)} - zc) <= {d(0.25)}),
v4 AS (SELECT mo.idx, count(v3.cosine) AS views, max(v3.cosine) AS best FROM mo LEFT JOIN v3 ON v3.idx = mo.idx GROUP BY 1)"""


@query("j16_a15_view_survey", scan_with(_MODEL, _VIEWS) + "SELECT idx, views, best FROM v4")
def j16(s, sf):
    return evaluate.view_survey(model(s), derived.scan(s, sf), CAMERA, 0.25)


@query(
    "a14_completeness_by_angle",
    scan_with(_MODEL, _VIEWS)
    + """, an AS (SELECT views, degrees(acos(least(1.0::DOUBLE, best))) AS a FROM v4 WHERE views > 0)
    SELECT CAST(CASE WHEN a < 60 THEN 0 WHEN a < 70 THEN 60 WHEN a < 75 THEN 70 WHEN a < 80 THEN 75 WHEN a < 85 THEN 80 ELSE 85 END AS INT) AS band,
    count(*) AS points, sum(views)::BIGINT AS views FROM an GROUP BY 1""",
)
def a14(s, sf):
    return evaluate.by_angle(evaluate.view_survey(model(s), derived.scan(s, sf), CAMERA, 0.25))


@query(
    "p19_smooth_mask",
    scan_with()
    + """, sn AS (SELECT seq, u + o % 3 - 1 AS u, v + o // 3 - 1 AS v, raw FROM px, range(9) r(o))
    SELECT seq, u::INT AS u, v::INT AS v FROM sn GROUP BY seq, sn.u, sn.v HAVING count(*) = 9 AND max(raw) - min(raw) <= 3000""",
)
def p19(s, sf):
    return evaluate.smooth(derived.pixels(s, sf), 3000)


@query(
    "a16_noise_bands",
    scan_with()
    + f""", nb AS (SELECT a.raw // 500 AS band, abs({d(1000.0)} / b.raw - {d(1000.0)} / a.raw) AS e FROM px a JOIN (SELECT seq - 1 AS seq, u, v, raw FROM px) b ON b.seq = a.seq AND b.u = a.u AND b.v = a.v WHERE a.raw > 0 AND b.raw > 0)
    SELECT band, count(*) AS n, quantile_cont(e, 0.5) AS median FROM nb GROUP BY 1 HAVING count(*) >= 100""",
)
def a16(s, sf):
    px = derived.pixels(s, sf)
    return evaluate.noise_bands(px, px.withColumn("seq", F.col("seq") - 1), 500, 1000.0, 100)


@query(
    "p20_quantised_depth",
    scan_with()
    + f""", nz AS (SELECT seq, u, v, floor(u + ((u * 7 + v) % 3 - 1) * {d(0.6)} + {d(0.5)}) AS su, floor(v + ((u + v * 5) % 3 - 1) * {d(0.6)} + {d(0.5)}) AS sv, ((u * 3 + v * 11) % 7) * {d(0.1)} AS nd FROM px),
    nw AS (SELECT n.seq, n.u, n.v, floor({d(35000.0)} / p.raw + nd + {d(0.5)}) AS w FROM nz n JOIN px p ON p.seq = n.seq AND p.u = n.su AND p.v = n.sv WHERE p.raw > 0)
    SELECT seq, u, v, CASE WHEN w > 0 THEN {d(35000.0)} / w END AS depth FROM nw""",
)
def p20(s, sf):
    u, v = F.col("u"), F.col("v")
    noisy = derived.pixels(s, sf).select("seq", "u", "v", "raw", (((u * 7 + v) % 3 - 1) * F.lit(0.6)).alias("nu"), (((u + v * 5) % 3 - 1) * F.lit(0.6)).alias("nv"), (((u * 3 + v * 11) % 7) * F.lit(0.1)).alias("nd"))
    return evaluate.quantised(noisy, 35000.0)


@query(
    "a22_plane_histogram",
    scan_with() + f"SELECT axis, CAST(floor(c / {d(0.2)}) AS BIGINT) AS bin, count(*) AS n FROM (SELECT 'x' AS axis, wx AS c FROM pt UNION ALL SELECT 'y', wy FROM pt UNION ALL SELECT 'z', wz FROM pt) GROUP BY 1, 2",
)
def a22(s, sf):
    return evaluate.plane_histogram(all_points(s, sf), 0.2)


_COLOURS = f"""
vs AS (SELECT v2.idx, v2.seq, facing / len / (zc * zc) AS w, p.u, p.v FROM v2 JOIN px p ON p.seq = v2.seq AND p.u = CAST(floor(pu + {d(0.5)}) AS INT) AND p.v = CAST(floor(pv + {d(0.5)}) AS INT)
  WHERE pu >= {d(-0.5)} AND pu < {d(31.5)} AND pv >= {d(-0.5)} AND pv < {d(23.5)} AND p.raw > 0 AND abs(p.raw * {d(0.001)} - zc) <= {d(0.25)} AND facing / len > {d(0.15)})"""


@query(
    "j17_vertex_colours",
    scan_with(_MODEL, _VIEWS.replace(f"zc > {d(0.05)}", f"zc > {d(1e-6)}"), _COLOURS)
    + """SELECT mo.idx, round(sum(w * ((u * 7 + v * 3) % 256)) / sum(w), 6) AS r, round(sum(w * ((u * 5 + vs.seq) % 256)) / sum(w), 6) AS g, round(sum(w * ((v * 11) % 256)) / sum(w), 6) AS b, count(w) AS views
    FROM mo LEFT JOIN vs ON vs.idx = mo.idx GROUP BY 1""",
)
def j17(s, sf):
    """Colours of the model's points from a made-up colour for each pixel of the scan."""
    px = derived.pixels(s, sf)
    u, v = F.col("u"), F.col("v")
    colours = px.select("seq", "u", "v", ((u * 7 + v * 3) % 256).alias("r"), ((u * 5 + F.col("seq")) % 256).alias("g"), ((v * 11) % 256).alias("b"))
    c = evaluate.vertex_colours(model(s), derived.scan(s, sf), colours, CAMERA, 0.25)
    return c.select("idx", *[F.round(x, 6).alias(x) for x in "rgb"], F.col("views").cast("long").alias("views"))


@query("j11_nearest_by_all", f"WITH {_PTS}, {_NEAR} SELECT id, idx, d2 FROM nr")
def j11(s, sf):
    """Nearest points by comparing all with all, as the plain form of j10_nearest_points."""
    return evaluate.nearest_by_all(cloud(s, sf, 1, "id"), cloud(s, sf, 0, "idx"), LIMIT)


def _triangle_sql() -> str:
    """tb(face, ax..cz) and td(id, face, d2): triangles of every three points, and all points' squared distances to them."""
    less = lambda q, r: [f"({i} - {j})" for i, j in zip(q, r)]
    dot = lambda q, r: f"({q[0]} * {r[0]} + {q[1]} * {r[1]} + {q[2]} * {r[2]})"
    cross = lambda q, r: [f"({q[1]} * {r[2]} - {q[2]} * {r[1]})", f"({q[2]} * {r[0]} - {q[0]} * {r[2]})", f"({q[0]} * {r[1]} - {q[1]} * {r[0]})"]
    a, b, c, n, p = ([f"{v}{x}" for x in "xyz"] for v in ("a", "b", "c", "n", ""))
    edges = list(enumerate(((a, b), (b, c), (c, a))))
    normal = ", ".join(f"{x} AS {name}" for x, name in zip(cross(less(b, a), less(c, a)), n))
    along = ", ".join(
        f"CASE WHEN {dot(less(r, q), less(r, q))} > 0 THEN least({d(1.0)}, greatest({d(0.0)}, {dot(less(p, q), less(r, q))} / {dot(less(r, q), less(r, q))})) ELSE {d(0.0)} END AS t{k}" for k, (q, r) in edges
    )
    sides = " AND ".join(f"{dot(cross(less(r, q), less(p, q)), n)} >= 0" for _, (q, r) in edges)
    off = [[f"({w} - t{k} * {e})" for w, e in zip(less(p, q), less(r, q))] for k, (q, r) in edges]
    corners = ", ".join(f"max(CASE k WHEN {i} THEN {x} END) AS {v}{x}" for i, v in enumerate("abc") for x in "xyz")
    return f"""tb AS (SELECT face, {corners} FROM (SELECT idx // 6 * 6 AS face, idx % 6 // 2 AS k, x, y, z FROM eb) q GROUP BY face HAVING count(*) = 3),
tn AS (SELECT *, {dot(n, n)} AS nn FROM (SELECT *, {normal} FROM tb) q),
te AS (SELECT *, {along}, {dot(less(p, a), n)} AS h FROM ea, tn),
td AS (SELECT id, face, CASE WHEN nn > 0 AND {sides} THEN h * h / nn ELSE least({", ".join(dot(o, o) for o in off)}) END AS d2 FROM te)"""


@query(
    "j12_triangle_distance",
    f"WITH {_PTS}, {_triangle_sql()} SELECT id, min(d2) FILTER (d2 <= {d(0.1)} * {d(0.1)}) AS d2 FROM ea LEFT JOIN td USING (id) GROUP BY id",
)
def j12(s, sf):
    """Points of one half of the embeddings to triangles of the other half's."""
    p = cloud(s, sf, 0, "idx")
    tri = p.select((F.floor(F.col("idx") / 6) * 6).alias("face"), ((F.col("idx") % 6) / 2).cast("int").alias("k"), "x", "y", "z")
    corner = [F.max(F.when(F.col("k") == i, F.col(a))).alias(f"{n}{a}") for i, n in enumerate("abc") for a in "xyz"]
    whole = tri.groupBy("face").agg(F.count("*").alias("n"), *corner).where("n = 3").drop("n")
    return evaluate.triangle_distance(cloud(s, sf, 1, "id"), whole, 0.1)


@query(
    "p16_p17_pose_algebra",
    scan_with()
    + """SELECT seq, m0 * m0 + m4 * m4 + m8 * m8 AS i0, m0 * m1 + m4 * m5 + m8 * m9 AS i1, m0 * m2 + m4 * m6 + m8 * m10 AS i2,
    m0 * m3 + m4 * m7 + m8 * m11 + -(m0 * m3 + m4 * m7 + m8 * m11) AS i3 FROM fr WHERE has_pose""",
)
def p16(s, sf):
    """The first row of each pose's inverse times the pose."""
    f = derived.frames(s, sf).where("has_pose")
    m = g.pose()
    unit = g.compose(g.inverse(m), m)
    return f.select("seq", *[unit[k].alias(f"i{k}") for k in range(4)])


@query("s5_rigid_poses", scan_with() + "SELECT seq, true AS rigid FROM fr WHERE has_pose")
def s5(s, sf):
    return derived.frames(s, sf).where("has_pose").select("seq", g.is_rigid(g.pose()).alias("rigid"))


def _rigid_sql() -> str:
    rows = [("m0", "m1", "m2"), ("m4", "m5", "m6"), ("m8", "m9", "m10")]
    near = lambda x, y: f"abs({x} - {y}) <= {d(1e-5)}"
    dots = [near(" + ".join(f"{a} * {b}" for a, b in zip(rows[i], rows[j])), int(i == j)) for i in range(3) for j in range(i, 3)]
    det = "m0 * (m5 * m10 - m6 * m9) + m1 * (m6 * m8 - m4 * m10) + m2 * (m4 * m9 - m5 * m8)"
    return " AND ".join([*dots, near(det, 1)])


@query(
    "s5_rigid_verdicts",
    scan_with("sh AS (SELECT seq, CASE WHEN seq % 5 = 0 THEN m0 * CAST('1.1' AS DOUBLE) ELSE m0 END AS m0, m1, m2, m4, CASE WHEN seq % 5 = 1 THEN -m5 ELSE m5 END AS m5, m6, m8, m9, m10 FROM fr WHERE has_pose)")
    + f"SELECT seq, {_rigid_sql()} AS rigid FROM sh",
)
def s5_verdicts(s, sf):
    """Poses of which some are stretched and some mirrored."""
    f = derived.frames(s, sf).where("has_pose")
    f = f.withColumn("m0", F.when(F.col("seq") % 5 == 0, F.col("m0") * F.lit(1.1)).otherwise(F.col("m0")))
    f = f.withColumn("m5", F.when(F.col("seq") % 5 == 1, -F.col("m5")).otherwise(F.col("m5")))
    return f.select("seq", g.is_rigid(g.pose()).alias("rigid"))


@query(
    "p16_quaternions",
    scan_with("qn AS (SELECT seq, CAST(seq % 5 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS b, CAST(2 AS DOUBLE) AS c, CAST(seq % 3 + 1 AS DOUBLE) AS e FROM fr)", "ql AS (SELECT *, sqrt(a * a + b * b + c * c + e * e) AS n FROM qn)", "qu AS (SELECT seq, a / n AS x, b / n AS y, c / n AS z, e / n AS w FROM ql)")
    + f"""SELECT seq, {d(1.0)} - {d(2.0)} * (y * y + z * z) AS r0, {d(2.0)} * (x * y - z * w) AS r1, {d(2.0)} * (x * z + y * w) AS r2, {d(2.0)} * (x * y + z * w) AS r3, {d(1.0)} - {d(2.0)} * (x * x + z * z) AS r4,
    {d(2.0)} * (y * z - x * w) AS r5, {d(2.0)} * (x * z - y * w) AS r6, {d(2.0)} * (y * z + x * w) AS r7, {d(1.0)} - {d(2.0)} * (x * x + y * y) AS r8 FROM qu""",
)
def p16_quaternions(s, sf):
    q = (F.col("seq") % 5).cast("double"), F.lit(1.0), F.lit(2.0), (F.col("seq") % 3 + 1).cast("double")
    m = g.quaternion_matrix(*q)
    return derived.frames(s, sf).select("seq", *[x.alias(f"r{k}") for k, x in enumerate(m)])


@query(
    "p17_pose_products",
    scan_with()
    + "SELECT seq, " + ", ".join(
        f"m{i} * {a} + m{i + 1} * {b} + m{i + 2} * {c}" + (f" + m{i + 3}" if j == 3 else "") + f" AS p{i + j}"
        for i in (0, 4, 8) for j, (a, b, c) in enumerate((("m0", "m4", "m8"), ("m1", "m5", "m9"), ("m2", "m6", "m10"), ("m3", "m7", "m11")))
    ) + " FROM fr WHERE has_pose",
)
def p17(s, sf):
    """Every pose after itself: all twelve numbers."""
    m = g.pose()
    return derived.frames(s, sf).where("has_pose").select("seq", *[x.alias(f"p{k}") for k, x in enumerate(g.compose(m, m))])


def _oriented_sql() -> str:
    at = lambda r, a, b: f"JOIN po {r} ON {r}.seq = c.seq AND {r}.u = c.u + {a} AND {r}.v = c.v + {b}"
    n = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    cross = ", ".join(f"(r.{i} - l.{i}) * (b.{j} - a.{j}) - (r.{j} - l.{j}) * (b.{i} - a.{i}) AS n{k}" for k, (i, j) in n.items())
    flat = " AND ".join(f"abs({d(0.5)} * ({d(1.0)} / {p}.z + {d(1.0)} / {q}.z) - {d(1.0)} / c.z) < {d(0.03)} * ({d(1.0)} / c.z)" for p, q in (("r", "l"), ("b", "a")))
    return f"""
po AS (SELECT seq, u, v, x, y, z FROM cp),
on1 AS (SELECT c.*, {cross} FROM po c {at("r", 1, 0)} {at("l", -1, 0)} {at("b", 0, 1)} {at("a", 0, -1)} WHERE {flat}),
on2 AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM on1),
on3 AS (SELECT seq, u, v, x, y, z, nx / len AS nx, ny / len AS ny, nz / len AS nz FROM on2 WHERE len > 0)"""


@query(
    "m14_oriented_depth",
    scan_with(_oriented_sql())
    + "SELECT seq, u, v, x, y, z, CASE WHEN nx * x + ny * y + nz * z > 0 THEN -nx ELSE nx END AS nx, CASE WHEN nx * x + ny * y + nz * z > 0 THEN -ny ELSE ny END AS ny, CASE WHEN nx * x + ny * y + nz * z > 0 THEN -nz ELSE nz END AS nz FROM on3",
)
def m14(s, sf):
    return placement.oriented(derived.pixels(s, sf), CAMERA, 1)


_MOMENTS = [f"q{i}{j}{k}" for i, j, k in placement.QUARTICS]
_POWERS = [" * ".join(["nx"] * i + ["ny"] * j + ["nz"] * k) for i, j, k in placement.QUARTICS]


@query("a22_normal_moments", f"SELECT {', '.join(f'round(avg({p}), 9) AS {q}' for p, q in zip(_POWERS, _MOMENTS))}, count(*) AS n FROM ({SQL['m14_oriented_depth']}) o")
def a22_moments(s, sf):
    """The fourth moments of the scan's normals, from which its dominant axes follow."""
    return placement.moment_sums(placement.oriented(derived.pixels(s, sf), CAMERA, 1)).select(*[F.round(q, 9).alias(q) for q in _MOMENTS], "n")


@query(
    "v18_trajectory_difference",
    scan_with()
    + f"""SELECT (SELECT count(*) FROM fr WHERE has_pose AND seq % 4 = 3) AS unpaired, max(sqrt(x * x + y * y + z * z)) AS metres, round(max(acos(greatest({d(-1.0)}, least({d(1.0)}, (t - 1.0) / 2.0)))), 9) AS radians
    FROM (SELECT m3 - (m3 + seq * {d(0.001)}) AS x, m7 - m7 AS y, m11 - m11 AS z,
          m0 * CASE WHEN seq % 3 = 0 THEN m8 ELSE m0 END + m1 * CASE WHEN seq % 3 = 0 THEN m9 ELSE m1 END + m2 * CASE WHEN seq % 3 = 0 THEN m10 ELSE m2 END + m4 * m4 + m5 * m5 + m6 * m6
          + m8 * CASE WHEN seq % 3 = 0 THEN -m0 ELSE m8 END + m9 * CASE WHEN seq % 3 = 0 THEN -m1 ELSE m9 END + m10 * CASE WHEN seq % 3 = 0 THEN -m2 ELSE m10 END AS t FROM fr WHERE has_pose AND seq % 4 <> 3)""",
)
def v18(s, sf):
    """The scan's trajectory against one with drift, with quarter turns, and without some frames."""
    f = derived.frames(s, sf).where("has_pose").select("seq", *[f"m{k}" for k in range(12)])
    turn = F.col("seq") % 3 == 0
    moved = f.where("seq % 4 <> 3").withColumn("m3", F.col("m3") + F.col("seq") * F.lit(0.001))
    rows = {**{f"m{k}": F.when(turn, F.col(f"m{k + 8}")).otherwise(F.col(f"m{k}")) for k in range(3)}, **{f"m{k + 8}": F.when(turn, -F.col(f"m{k}")).otherwise(F.col(f"m{k + 8}")) for k in range(3)}}
    return placement.trajectory_difference(f, moved.withColumns(rows)).withColumn("radians", F.round("radians", 9))


@query(
    "a24_scan_digest",
    scan_with(
        "rd AS (SELECT row_number() OVER (ORDER BY seq, v, u) - 1 AS i, sha256(seq || '|' || u || '|' || v || '|' || raw) AS digest FROM px)",
        "rr AS (SELECT i // 65536 AS run, sha256(unhex(string_agg(digest, '' ORDER BY i))) AS digest FROM rd GROUP BY 1)",
    )
    + "SELECT sha256(unhex(string_agg(digest, '' ORDER BY run))) AS digest FROM rr",
)
def a24(s, sf):
    """One digest of all readings in the order of frames, rows and columns."""
    px = order.dense_numbers(derived.pixels(s, sf), [F.col("v"), F.col("u")], F.col("seq"), "i")
    return replay.ordered_digest(px, ["seq", "u", "v", "raw"], "i")


@query("p23_band_limit", f"SELECT DISTINCT p_size AS centimetres, round(degrees(acos(least({d(1.0)}, p_size * {d(0.01)} / {d(0.4)}))), 9) AS degrees FROM part")
def p23(s, sf):
    """For voxels of the sizes of parts."""
    size = table(s, sf, "part").select(F.col("p_size").alias("centimetres")).distinct()
    return size.select("centimetres", F.round(evaluate.band_limit_of(F.col("centimetres") * F.lit(0.01), 0.4), 9).alias("degrees"))


def _normals() -> str:
    """no(v, nx, ny, nz): each face's cross product at its three vertices, added in the order of faces."""
    u, w = ([f"({a}{k} - {a}0)" for a in "xyz"] for k in (1, 2))
    normal = [f"{u[1]} * {w[2]} - {u[2]} * {w[1]}", f"{u[2]} * {w[0]} - {u[0]} * {w[2]}", f"{u[0]} * {w[1]} - {u[1]} * {w[0]}"]
    folded = ", ".join(f"list_reduce(list_prepend({d(0.0)}, list(n{a} ORDER BY face)), lambda p, q: p + q) AS n{a}" for a in "xyz")
    return f""", fx AS (SELECT face, {", ".join(f"{n} AS n{a}" for n, a in zip(normal, "xyz"))} FROM fp),
no AS (SELECT v, {folded} FROM (SELECT face, unnest([v0, v1, v2]) AS v FROM ff) q JOIN fx USING (face) GROUP BY v)"""


@query(
    "a20_vertex_normals",
    base(*surface_queries.MESH) + surface_queries._FACES + surface_queries._face_points() + _normals()
    + " SELECT v, " + ", ".join(f"CASE WHEN len > 0 THEN n{a} / len END AS n{a}" for a in "xyz") + " FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM no) q",
)
def a20(s, sf):
    """Area-weighted normals of the mesh's vertices."""
    faces, vertices = indexed(s, sf)
    p = mesh.with_points(faces, vertices).select("face", F.col("v0").alias("va"), F.col("v1").alias("vb"), F.col("v2").alias("vc"), *[f"{c}{a}" for c in "abc" for a in "xyz"])
    return evaluate.vertex_normals(p)


_M5, _POINTS = surface_queries.SQL["m5_surface_points"].split("SELECT 0 AS kind", 1)


@query(
    "j16_surface_survey",
    _M5
    + f""", sp5 AS (SELECT 0 AS kind{_POINTS}),
    mo AS (SELECT row_number() OVER (ORDER BY kind, gz, gy, gx) - 1 AS idx, x, y, z, {d(0.0)} AS nx, {d(0.6)} AS ny, {d(-0.8)} AS nz FROM sp5), {_VIEWS} SELECT idx, views, best FROM v4""",
)
def j16_surface(s, sf):
    """Which frames see each point of the fused surface from above and before."""
    p = surface.surface_points(samples(s, sf), V)
    p = order.dense_numbers(p, [F.col(c) for c in ("gz", "gy", "gx")], F.struct("kind", F.shiftright("gz", 3)), "idx")
    p = p.select("idx", "x", "y", "z", F.lit(0.0).alias("nx"), F.lit(0.6).alias("ny"), F.lit(-0.8).alias("nz"))
    return evaluate.view_survey(scratch.kept(p, "surface"), derived.scan(s, sf), CAMERA, 0.25)
