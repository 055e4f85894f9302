"""Queries of commitments, samples and audits."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from scanengine.operators import commit, fuse, multiproof, proof
from scanengine.plans.common import registrar
from scanengine.plans.fusion_queries import COARSE, blocks, volume
from scanengine.plans.fusion_queries import scan as recorded
from scanengine.plans.scan_sql import d, fused_with, plan_sql, scan_with
from scanengine.sources import derived
from scanengine.sources.derived import CAMERA, table
from scanengine.sources.scratch import kept

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)

C = (COARSE.voxel, COARSE.truncation)


def levels(n: int, first: str = "lv0") -> str:
    """The levels of a tree, unrolled."""
    out = []
    for k in range(n):
        src = first if k == 0 else f"lv{k}"
        out.append(
            f"lv{k + 1} AS (SELECT idx // 2 AS idx, CASE WHEN count(*) = 2 THEN sha256('\\x01'::BLOB || unhex(max(CASE WHEN idx % 2 = 0 THEN h END)) || unhex(max(CASE WHEN idx % 2 = 1 THEN h END))) ELSE max(h) END AS h FROM {src} GROUP BY 1)"
        )
    return ",\n".join(out)


def _leaf(data: str) -> str:
    return f"sha256('\\x00'::BLOB || encode({data}))"


_CUST = f"lv0 AS (SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS idx, {_leaf('c_custkey || chr(58) || c_name')} AS h FROM customer)"


def leaves(s, sf):
    c = table(s, sf, "customer")
    low = c.agg(F.min("c_custkey").alias("low"))
    return c.crossJoin(low).select((F.col("c_custkey") - F.col("low")).alias("idx"), F.concat_ws(":", F.col("c_custkey").cast("string"), F.col("c_name")).alias("data"))


@query("v3_leaf_hashes", f"WITH {_CUST} SELECT idx, lower(h) AS hash FROM lv0")
def v3_leaves(s, sf):
    return leaves(s, sf).select("idx", F.lower(F.hex(commit.leaf_hash(F.col("data")))).alias("hash"))


@query("a23_merkle_root", f"WITH {_CUST}, {levels(20)} SELECT lower(h) AS root FROM lv20")
def a23(s, sf):
    t = commit.tree(leaves(s, sf))
    top = t.agg(F.max("level").alias("top"))
    return t.join(top, F.col("level") == F.col("top")).select(F.lower(F.hex("hash")).alias("root"))


_LEVELS = " UNION ALL ".join(f"SELECT {k} AS level, idx, h FROM lv{k}" for k in range(20))
_NODES = f"nd AS (SELECT level, idx, h FROM ({_LEVELS}) q WHERE level = 0 OR level <= (SELECT ceil(log2(count(*))) FROM lv0)), tp AS (SELECT CAST(ceil(log2(count(*))) AS INTEGER) AS top FROM lv0)"


def climb(n: int) -> str:
    """up{n}: what each leaf's path gives, step by step."""
    node = lambda x, y: f"sha256('\\x01'::BLOB || unhex({x}) || unhex({y}))"
    step = lambda k: f"CASE WHEN nd.h IS NULL THEN u.h WHEN (u.idx >> {k}) % 2 = 0 THEN {node('u.h', 'nd.h')} ELSE {node('nd.h', 'u.h')} END"
    return ", ".join(
        f"up{k + 1} AS MATERIALIZED (SELECT u.idx, {step(k)} AS h FROM {f'up{k}' if k else 'lv0'} u LEFT JOIN nd ON nd.level = {k} AND nd.idx = xor(u.idx >> {k}, 1))" for k in range(n)
    )


@query(
    "v3_merkle_paths",
    f"WITH {_CUST}, {levels(20)}, {_NODES.replace('nd AS (', 'nd AS MATERIALIZED (', 1)}, {climb(20)} SELECT idx, CASE WHEN h = (SELECT h FROM lv20) THEN 'verified' ELSE 'refuted' END AS verdict FROM up20",
)
def v3_paths(s, sf):
    """The path of every leaf, checked against the root."""
    every = leaves(s, sf)
    return commit.check_path_proofs(every, commit.paths(commit.tree(every), every), every.count(), commit.root(every))


@query(
    "v3_path_hashes",
    f"WITH {_CUST}, {levels(20)}, {_NODES} SELECT l.idx, nd.level, lower(nd.h) AS hash FROM lv0 l, tp, range(20) r(k) JOIN nd ON nd.level = k AND nd.idx = xor(l.idx >> k, 1) WHERE k < tp.top",
)
def v3_hashes(s, sf):
    """The hashes of every leaf's path."""
    every = leaves(s, sf)
    return commit.paths(commit.tree(every), every).select("idx", "level", F.lower(F.hex("hash")).alias("hash"))


@query(
    "v3_shared_proof",
    f"""WITH {_CUST}, {levels(20)}, {_NODES}, kn AS (SELECT DISTINCT k AS level, l.idx >> k AS idx FROM lv0 l, tp, range(20) r(k) WHERE l.idx % 16 < 3 AND k <= tp.top),
    nn AS (SELECT DISTINCT level, xor(idx, 1) AS idx FROM kn, tp WHERE level < tp.top)
    SELECT nd.level, nd.idx, lower(nd.h) AS hash FROM nn JOIN nd ON nd.level = nn.level AND nd.idx = nn.idx WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.level = nn.level AND kn.idx = nn.idx)""",
)
def v3_shared(s, sf):
    some = leaves(s, sf)
    return commit.shared_proof(commit.tree(some), some.where("idx % 16 < 3").select("idx")).select("level", "idx", F.lower(F.hex("hash")).alias("hash"))


def _forest_sql(top: int = 10) -> str:
    """Trees of a thousand customers each: lv0 to lv10 by tree; sz: their sizes and heights; kn: what follows from the wanted."""
    out = [
        "lo AS (SELECT min(c_custkey) AS low FROM customer)",
        f"lv0 AS (SELECT (c_custkey - low) // 1000 AS tree, (c_custkey - low) % 1000 AS idx, {_leaf('c_custkey || chr(58) || c_name')} AS h FROM customer, lo)",
    ]
    for k in range(top):
        out.append(
            f"lv{k + 1} AS (SELECT tree, idx // 2 AS idx, CASE WHEN count(*) = 2 THEN sha256('\\x01'::BLOB || unhex(max(CASE WHEN idx % 2 = 0 THEN h END)) || unhex(max(CASE WHEN idx % 2 = 1 THEN h END))) ELSE max(h) END AS h FROM lv{k} GROUP BY 1, 2)"
        )
    out += [
        "sz AS (SELECT tree, count(*) AS n, CAST(ceil(log2(count(*))) AS INTEGER) AS height FROM lv0 GROUP BY 1)",
        f"wt AS (SELECT l.tree, k AS level, l.idx >> k AS idx, (n + (1 << k) - 1) // (1 << k) AS size FROM lv0 l JOIN sz USING (tree), range({top}) r(k) WHERE l.idx % 16 < 3 AND k < height)",
        "kn AS (SELECT DISTINCT tree, level, idx, size FROM wt)",
        "pn AS (SELECT tree, count(*) AS nodes FROM kn WHERE xor(idx, 1) < size AND NOT EXISTS (SELECT 1 FROM kn o WHERE o.tree = kn.tree AND o.level = kn.level AND o.idx = xor(kn.idx, 1)) GROUP BY 1)",
        "pa AS (SELECT tree, count(*) AS nodes FROM wt WHERE xor(idx, 1) < size GROUP BY 1)",
    ]
    return "WITH " + ",\n".join(out)


@query(
    "v12_shared_proofs",
    _forest_sql()
    + """ SELECT tree, n, lower(h) AS root, coalesce(pn.nodes, 0) AS proof_nodes, coalesce(pa.nodes, 0) AS path_nodes
    FROM lv10 JOIN sz USING (tree) LEFT JOIN pn USING (tree) LEFT JOIN pa USING (tree)""",
)
def v12_shared(s, sf):
    """The roots that shared proofs of a fifth of the leaves of many trees lead to, and how large the proofs are beside paths."""
    every = leaves(s, sf).select(F.floor(F.col("idx") / 1000).cast("long").alias("tree"), (F.col("idx") % 1000).alias("idx"), "data")
    nodes, n = multiproof.forest(every), multiproof.sizes(every)
    wanted = every.where("idx % 16 < 3").select("tree", "idx")
    proof = kept(multiproof.prove(nodes, wanted, n), "proof")
    asked = nodes.where("level = 0").join(wanted, ["tree", "idx"]).select("tree", "idx", "hash")
    found = multiproof.check(asked, proof, n).where("problem is null").select("tree", F.lower(F.hex("root")).alias("root"))
    count = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    size = proof.groupBy("tree").agg(F.count("*").alias("proof_nodes"))
    paths = multiproof.path_nodes(wanted, n).withColumnRenamed("nodes", "path_nodes")
    return found.join(n, "tree").join(size, "tree", "left").join(paths, "tree", "left").select("tree", "n", "root", count("proof_nodes"), count("path_nodes"))


@query(
    "g13_depth_tiles",
    scan_with(
        "tg AS (SELECT DISTINCT seq, v // 16 * 2 + u // 16 AS tile FROM px)",
        "tq AS (SELECT seq, tile, tile // 2 * 16 + k // 16 AS v, tile % 2 * 16 + k % 16 AS u FROM tg, range(256) r(k) WHERE tile // 2 * 16 + k // 16 < 24)",
    )
    + f"""SELECT tq.seq, CAST(tq.tile AS BIGINT) AS tile, sha256(unhex('00{commit.TILE_TAG.hex()}' || string_agg(printf('%02x%02x', coalesce(raw, 0) % 256, coalesce(raw, 0) // 256), '' ORDER BY tq.v, tq.u))) AS leaf
    FROM tq LEFT JOIN px ON px.seq = tq.seq AND px.u = tq.u AND px.v = tq.v GROUP BY 1, 2""",
)
def g13(s, sf):
    return commit.tiles(derived.pixels(s, sf), CAMERA.width, CAMERA.height).select("seq", "tile", F.lower(F.hex(commit.leaf_hash(F.col("data")))).alias("leaf"))


def _packed(c: str, width: int = 8) -> str:
    """The hexadecimal digits of a number's bytes, the last byte first."""
    return " || ".join(f"substr(hex(CAST(CAST({c} AS BIT) AS BLOB)), {2 * k + 1}, 2)" for k in reversed(range(width)))


@query(
    "v5_volume_leaves",
    fused_with(
        *C,
        f"hx AS (SELECT bx, by, bz, l, {_packed('tsdf_sum')} AS s, {_packed('CAST(weight AS INTEGER)', 4)} AS w FROM vo)",
        "bl AS (SELECT DISTINCT bx, by, bz FROM vo)",
        f"""pk AS (SELECT bl.bx, bl.by, bl.bz, string_agg(coalesce(s, repeat('00', 8)), '' ORDER BY k) || string_agg(coalesce(w, repeat('00', 4)), '' ORDER BY k) AS voxels
        FROM bl JOIN range(512) r(k) ON true LEFT JOIN hx ON hx.bx = bl.bx AND hx.by = bl.by AND hx.bz = bl.bz AND hx.l = k GROUP BY 1, 2, 3)""",
    )
    + f"""SELECT row_number() OVER (ORDER BY bz, by, bx) - 1 AS idx, bx, by, bz,
    sha256(unhex('00{commit.BLOCK_TAG.hex()}' || {_packed("bx", 4)} || {_packed("by", 4)} || {_packed("bz", 4)} || voxels)) AS leaf FROM pk""",
)
def v5(s, sf):
    return commit.numbered(commit.block_leaves(volume(s, sf))).select("idx", "bx", "by", "bz", F.lower(F.hex(commit.leaf_hash(F.col("data")))).alias("leaf"))


@query(
    "o3_block_sample",
    scan_with(plan_sql(*C)) + """SELECT bx, by, bz, sha256('scanengine.block-sample/7/' || bx || ',' || by || ',' || bz) AS key FROM pl ORDER BY key LIMIT 10""",
)
def o3(s, sf):
    return commit.sample_blocks(blocks(s, sf), "7", 10)


_DIGEST, _SEED = hashlib.sha256(b"a statement").digest(), b"seed"
_STEM = "".join(f"\\x{b:02X}" for b in commit.AUDIT_TAG + _DIGEST + len(_SEED).to_bytes(2, "little") + _SEED)


def _le(h: str) -> str:
    return " || ".join(f"substr({h}, {15 - 2 * k}, 2)" for k in range(8))


@query(
    "o4_audit_draw",
    f"""WITH c AS (SELECT count(*) AS rows, count(*) // 50 + 2 AS many FROM customer),
    t AS (SELECT i, lpad(upper(hex(i)), 16, '0') AS hx FROM (SELECT unnest(range(64 + 4 * many)) AS i FROM c) r),
    h AS (SELECT i, sha256('{_STEM}'::BLOB || unhex({_le("hx")})) AS s FROM t),
    n AS (SELECT i, CAST('0x' || {_le("s")} AS UBIGINT) AS v FROM h),
    q AS (SELECT i, CAST(v % rows AS BIGINT) AS row FROM n, c WHERE v < {1 << 64}::HUGEINT // rows * rows),
    f AS (SELECT row, min(i) AS i FROM q GROUP BY 1)
    SELECT row, i FROM f ORDER BY i LIMIT (SELECT many FROM c)""",
)
def o4(s, sf):
    """An audit of one row in fifty of a table."""
    rows = table(s, sf, "customer").count()
    return commit.audit_rows(s, _DIGEST, _SEED, rows, rows // 50 + 2)


@query(
    "u6_statement_differences",
    """WITH a AS (SELECT count(*)::VARCHAR AS n, min(o_orderkey)::VARCHAR AS lo, max(o_orderkey)::VARCHAR AS hi FROM orders),
    b AS (SELECT count(*)::VARCHAR AS n, min(o_orderkey)::VARCHAR AS lo, max(o_orderkey)::VARCHAR AS hi FROM orders WHERE o_orderkey % 2 = 0),
    p AS (SELECT 'n' AS field, a.n AS l, b.n AS r FROM a, b UNION ALL SELECT 'lo', a.lo, b.lo FROM a, b UNION ALL SELECT 'hi', a.hi, b.hi FROM a, b)
    SELECT field, l AS "left", r AS "right" FROM p WHERE l IS DISTINCT FROM r""",
)
def u6(s, sf):
    o = table(s, sf, "orders")
    row = lambda x: x.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    return commit.differences(row(o), row(o.where("o_orderkey % 2 = 0")))


@query(
    "v9_block_evidence",
    fused_with(*C) + "SELECT bx, by, bz, seq, count(*) AS voxels FROM ev WHERE status NOT IN ('camera-z-nonpositive', 'projection-outside-image') GROUP BY 1, 2, 3, 4",
)
def v9(s, sf):
    return commit.evidence(fuse.evaluated(derived.scan(s, sf), blocks(s, sf), CAMERA, COARSE))


SIDE = 8


def world(s, sf):
    """(scan, leaves of a map in which some sums are wrong, its statement)."""
    scan = recorded(s, sf)
    v = volume(s, sf).withColumn("tsdf_sum", F.when((F.col("bx") + F.col("by") + F.col("bz")) % 4 == 0, F.when(F.col("l") % 64 == 0, F.col("tsdf_sum") / 2 + 0.25).otherwise(F.col("tsdf_sum"))).otherwise(F.col("tsdf_sum")))
    leaves = kept(commit.numbered(commit.block_leaves(v)), "leaves")
    frames = kept(proof.frame_leaves(scan, proof.depth_trees(proof.image_tiles(scan, CAMERA, SIDE))), "frame-leaves")
    return scan, leaves, proof.statement(frames, leaves, "derived", CAMERA, COARSE, SIDE)


_WRONG = """, wr AS (SELECT bx, by, bz, count(*) FILTER ((bx + by + bz) % 4 = 0 AND l % 64 = 0 AND tsdf_sum / 2 + 0.25 <> tsdf_sum) AS differing FROM vo GROUP BY 1, 2, 3)"""


@query(
    "v11_v12_block_verdicts",
    fused_with(*C) + _WRONG + " SELECT bx, by, bz, CASE WHEN differing > 0 THEN 'refuted' ELSE 'verified' END AS verdict, CASE WHEN differing > 0 THEN 'fusion' END AS failed, differing::INTEGER AS differing FROM wr",
)
def v11(s, sf):
    """Every block of a map with some wrong sums, proved and checked from its evidence alone."""
    scan, leaves, stated = world(s, sf)
    return proof.check_blocks(stated, proof.prove(stated, scan, leaves, leaves, CAMERA, COARSE))


@query(
    "v12_map_verdict",
    fused_with(*C) + _WRONG + """ SELECT CASE WHEN max(differing) > 0 THEN 'refuted' ELSE 'verified' END AS verdict, CASE WHEN max(differing) > 0 THEN 'fusion' END AS failed, count(*) AS blocks,
    (SELECT bx FROM wr WHERE differing > 0 ORDER BY bz, by, bx LIMIT 1) AS bx, (SELECT by FROM wr WHERE differing > 0 ORDER BY bz, by, bx LIMIT 1) AS by, (SELECT bz FROM wr WHERE differing > 0 ORDER BY bz, by, bx LIMIT 1) AS bz FROM wr""",
)
def v12(s, sf):
    return proof.held_verdict(v11(s, sf))


@query("v14_audit_verdict")
def v14(s, sf):
    """An audit of sixteen drawn blocks, answered with their proof."""
    scan, leaves, stated = world(s, sf)
    drawn = proof.audit_blocks(s, stated, b"audit", 16, leaves)
    return proof.check_audit(stated, proof.prove(stated, scan, leaves, drawn, CAMERA, COARSE), b"audit", 16)


_TILE = f"CAST(floor(pv + 0.5) AS INTEGER) // {SIDE} * 4 + CAST(floor(pu + 0.5) AS INTEGER) // {SIDE}"


@query("v9_evidence_tiles", fused_with(*C) + f"SELECT DISTINCT bx, by, bz, seq, {_TILE} AS tile FROM c5 WHERE seen")
def v9_tiles(s, sf):
    """The tiles of depth that each block reads."""
    return proof.evidence_tiles(derived.scan(s, sf), blocks(s, sf), CAMERA, COARSE, SIDE)


@query(
    "a26_evidence_sizes",
    fused_with(*C, f"et AS (SELECT DISTINCT bx, by, bz, seq, {_TILE} AS tile FROM c5 WHERE seen)")
    + "SELECT bx, by, bz, count(DISTINCT seq) AS frames, count(*) AS tiles, count(*) * 128 AS bytes, count(*) * 64 AS samples FROM et GROUP BY 1, 2, 3",
)
def a26(s, sf):
    return proof.evidence_counts(proof.evidence_tiles(derived.scan(s, sf), blocks(s, sf), CAMERA, COARSE, SIDE), CAMERA, SIDE)


def _frame_leaves() -> str:
    """Depth images cut into tiles, a tree for each, and the frames' leaves over the roots."""
    node = "sha256('\\x01'::BLOB || unhex(max(CASE WHEN idx % 2 = 0 THEN h END)) || unhex(max(CASE WHEN idx % 2 = 1 THEN h END)))"
    across, down = proof.tiles_across(CAMERA, SIDE), proof.tile_count(CAMERA, SIDE) // proof.tiles_across(CAMERA, SIDE)
    high = (across * down - 1).bit_length()
    parts = [
        f"tq AS (SELECT seq, t AS idx, k, t // {across} * {SIDE} + k // {SIDE} AS v, t % {across} * {SIDE} + k % {SIDE} AS u FROM fr, range({across * down}) r(t), range({SIDE * SIDE}) q(k) WHERE has_depth)",
        f"""dv0 AS (SELECT tq.seq, tq.idx, sha256(unhex('00{commit.TILE_TAG.hex()}' || string_agg(printf('%02x%02x', coalesce(raw, 0) % 256, coalesce(raw, 0) // 256), '' ORDER BY k))) AS h
        FROM tq LEFT JOIN px ON px.seq = tq.seq AND px.u = tq.u AND px.v = tq.v GROUP BY 1, 2)""",
    ]
    parts += [f"dv{k + 1} AS (SELECT seq, idx // 2 AS idx, CASE WHEN count(*) = 2 THEN {node} ELSE max(h) END AS h FROM dv{k} GROUP BY 1, 2)" for k in range(high)]
    pose = " || ".join(_packed(f"CAST(m{k} AS DOUBLE)") for k in range(12)) + " || repeat('00', 24) || " + _packed(d(1.0))
    return scan_with(*parts) + f"""SELECT row_number() OVER (ORDER BY fr.seq) - 1 AS idx, fr.seq, sha256(unhex('00{commit.FRAME_TAG.hex()}' || {_packed("CAST(fr.seq AS BIGINT)")} || printf('%02x', has_depth::INT + 2 * has_pose::INT)
    || CASE WHEN has_pose THEN {pose} ELSE repeat('00', 128) END || coalesce(h, repeat('00', 32)))) AS leaf FROM fr LEFT JOIN dv{high} ON dv{high}.seq = fr.seq"""


@query("v4_frame_leaves", _frame_leaves())
def v4(s, sf):
    """A leaf for every frame, with its pose and the root of its depth."""
    scan = derived.scan(s, sf)
    f = proof.frame_leaves(scan, proof.depth_trees(proof.image_tiles(scan, CAMERA, SIDE)))
    return f.select("idx", "seq", F.lower(F.hex(commit.leaf_hash(F.col("data")))).alias("leaf"))
