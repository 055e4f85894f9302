"""The SQL twins' shared parts: plan, volume and statuses of the derived scan, in the order of DuckDB's WITH clause."""

from __future__ import annotations

from scanengine.sources.derived import SCAN_SQL


def d(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def block_sql(c: str, e: float) -> str:
    i = f"floor({c} / {d(e)})"
    return f"CAST(CASE WHEN {i} * {d(e)} > {c} THEN {i} - 1 WHEN ({i} + 1) * {d(e)} <= {c} THEN {i} + 1 ELSE {i} END AS INTEGER)"


def plan_sql(voxel: float, trunc: float, points: str = "pt") -> str:
    """pl(bx, by, bz, is_surface)."""
    e = voxel * 8
    cols = []
    for a in "xyz":
        c = f"w{a}"
        lo, hi = f"floor(({c} - {d(trunc)}) / {d(e)})", f"ceil(({c} + {d(trunc)}) / {d(e)})"
        cols.append(f"CAST(CASE WHEN {lo} * {d(e)} > {c} - {d(trunc)} THEN {lo} - 1 ELSE {lo} END AS INTEGER) AS lo{a}")
        cols.append(f"CAST(CASE WHEN {hi} * {d(e)} < {c} + {d(trunc)} THEN {hi} + 1 ELSE {hi} END - 1 AS INTEGER) AS hi{a}")
        cols.append(f"{block_sql(c, e)} AS s{a}")
    return f"""
sp AS (SELECT DISTINCT {", ".join(cols)} FROM {points}),
e1 AS (SELECT *, unnest(range(lox, hix + 1)) AS ix FROM sp),
e2 AS (SELECT *, unnest(range(loy, hiy + 1)) AS iy FROM e1),
e3 AS (SELECT *, unnest(range(loz, hiz + 1)) AS iz FROM e2),
pl AS (SELECT CAST(ix AS INTEGER) AS bx, CAST(iy AS INTEGER) AS by, CAST(iz AS INTEGER) AS bz,
              bool_or(ix = sx AND iy = sy AND iz = sz) AS is_surface FROM e3 GROUP BY 1, 2, 3)"""


def eval_sql(voxel: float, trunc: float, plan: str = "pl") -> str:
    """ev(seq, bx, by, bz, l, status, sd): every voxel of the plan in every frame with depth and pose, without any cull."""
    return f"""
vx AS (SELECT bx, by, bz, CAST(l AS INTEGER) AS l,
              (bx * 8 + l % 8 + {d(0.5)}) * {d(voxel)} AS vx, (by * 8 + (l // 8) % 8 + {d(0.5)}) * {d(voxel)} AS vy,
              (bz * 8 + l // 64 + {d(0.5)}) * {d(voxel)} AS vz
       FROM {plan}, range(512) r(l)),
c1 AS (SELECT f.seq, v.bx, v.by, v.bz, v.l,
              m0 * (vx - m3) + m4 * (vy - m7) + m8 * (vz - m11) AS xc,
              m1 * (vx - m3) + m5 * (vy - m7) + m9 * (vz - m11) AS yc,
              m2 * (vx - m3) + m6 * (vy - m7) + m10 * (vz - m11) AS zc
       FROM vx v, fr f WHERE f.has_depth AND f.has_pose),
c2 AS (SELECT *, CASE WHEN zc > 0 THEN {d(24.0)} * xc / zc + {d(15.5)} END AS pu, CASE WHEN zc > 0 THEN {d(24.0)} * yc / zc + {d(11.5)} END AS pv FROM c1),
c3 AS (SELECT *, coalesce(pu >= {d(-0.5)} AND pu < {d(31.5)} AND pv >= {d(-0.5)} AND pv < {d(23.5)}, false) AS seen FROM c2),
c4 AS (SELECT c3.*, CASE WHEN seen THEN coalesce(p.raw, 0) END AS raw
       FROM c3 LEFT JOIN px p ON c3.seen AND p.seq = c3.seq AND p.u = CAST(floor(pu + {d(0.5)}) AS INTEGER) AND p.v = CAST(floor(pv + {d(0.5)}) AS INTEGER)),
c5 AS (SELECT *, CASE WHEN raw > 0 THEN raw * {d(0.001)} - zc END AS sd FROM c4),
ev AS (SELECT seq, bx, by, bz, l, sd, zc,
              CASE WHEN zc <= 0 THEN 'camera-z-nonpositive' WHEN NOT seen THEN 'projection-outside-image' WHEN raw <= 0 THEN 'depth-invalid'
                   WHEN sd < {d(-trunc)} THEN 'behind-truncation' ELSE 'contributes' END AS status FROM c5)"""


def volume_sql(trunc: float, events: str = "ev") -> str:
    """vo(bx, by, bz, l, tsdf_sum, weight): sums in the order of frames."""
    return f"""
vo AS (SELECT bx, by, bz, l, sum(least({d(1.0)}, greatest({d(-1.0)}, sd / {d(trunc)})) ORDER BY seq) AS tsdf_sum, count(*) AS weight
       FROM {events} WHERE status = 'contributes' GROUP BY 1, 2, 3, 4)"""


def scan_with(*parts: str) -> str:
    return "WITH " + ",".join([SCAN_SQL, *parts])


def fused_with(voxel: float, trunc: float, *more: str) -> str:
    return scan_with(plan_sql(voxel, trunc), eval_sql(voxel, trunc), volume_sql(trunc), *more)
