"""Surface points and meshes of a fused volume.

A volume is (bx, by, bz, l, tsdf_sum, weight); meshes are triangles (cell, k, and three edge keys) and vertices by edge.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import halo
from scanengine.sources import scratch

#: The corners of the six tetrahedra of a cell; a corner's bits are its x, y and z offsets.
TETRAHEDRA = ((0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7))


def cases() -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """(tetrahedron, pattern, triangle, its three crossed edges as (negative, positive) corners), wound so that the normal
    points to the positive side.  pattern has bit i set where the tetrahedron's i-th corner, in rising order, is negative.
    """
    at = lambda c: (c & 1, c >> 1 & 1, c >> 2 & 1)
    mean = lambda ps: tuple(sum(p[k] for p in ps) / len(ps) for k in range(3))
    out = []
    for t, tetra in enumerate(TETRAHEDRA):
        rising = sorted(tetra)
        for pattern in range(1, 15):
            low = [c for i, c in enumerate(rising) if pattern >> i & 1]
            high = [c for c in rising if c not in low]
            crossed = list(itertools.product(low, high))
            fans = [crossed] if len(crossed) == 3 else [[crossed[0], crossed[1], crossed[3]], [crossed[0], crossed[3], crossed[2]]]
            up = tuple(a - b for a, b in zip(mean([at(c) for c in high]), mean([at(c) for c in low])))
            for k, tri in enumerate(fans):
                p, q, r = (mean([at(a), at(b)]) for a, b in tri)
                e, f = tuple(x - y for x, y in zip(q, p)), tuple(x - y for x, y in zip(r, p))
                n = (e[1] * f[2] - e[2] * f[1], e[2] * f[0] - e[0] * f[2], e[0] * f[1] - e[1] * f[0])
                if sum(x * y for x, y in zip(n, up)) < 0:
                    tri = [tri[0], tri[2], tri[1]]
                out.append((t, pattern, k, tri))
    return out


def case_table(spark: SparkSession) -> DataFrame:
    """The case table: 6 tetrahedra of 14 patterns, one or two triangles each; small and of fixed size."""
    rows = [(t, p, k, *[c for e in tri for c in e]) for t, p, k, tri in cases()]
    return spark.createDataFrame(rows, "tetra int, pattern int, tri int, n0 int, p0 int, n1 int, p1 int, n2 int, p2 int")


def samples(volume: DataFrame, min_weight: int = 1) -> DataFrame:
    """(gx, gy, gz, value) of voxels seen often enough."""
    v = volume.where(F.col("weight") >= min_weight)
    part = {"x": F.col("l") % 8, "y": F.floor(F.col("l") / 8) % 8, "z": F.floor(F.col("l") / 64)}
    return v.select(*[(F.col(f"b{a}").cast("long") * 8 + part[a]).alias(f"g{a}") for a in "xyz"], (F.col("tsdf_sum") / F.col("weight")).alias("value"))


def locate(points: DataFrame, volume: DataFrame, voxel: float) -> DataFrame:
    """Points (wx, wy, wz and others) with the block and local voxel they lie in, and what the volume holds there: its
    sum and weight and a status: observed, unobserved (the block is held, the voxel was never seen) or no-block."""
    at = {a: F.floor(F.col(f"w{a}") / F.lit(voxel)) for a in "xyz"}
    p = points.select("*", *[g.block_part(at[a]).cast("int").alias(f"b{a}") for a in "xyz"], (g.local_part(at["x"]) + 8 * g.local_part(at["y"]) + 64 * g.local_part(at["z"])).cast("int").alias("l"))
    key = ["bx", "by", "bz"]
    held = volume.select(*key).distinct().withColumn("_held", F.lit(True))
    met = p.join(held, key, "left").join(volume.select(*key, "l", "tsdf_sum", "weight"), [*key, "l"], "left")
    status = F.when(F.col("weight").isNotNull(), "observed").when(F.col("_held"), "unobserved").otherwise("no-block")
    return met.withColumn("status", status).drop("_held")


def surface_points(v: DataFrame, voxel: float) -> DataFrame:
    """Exact zeros at voxel centres, then strict sign changes to the next voxel along x, y and z.

    (kind, gx, gy, gz, x, y, z): kind 0 for zeros, 1 to 3 for the axes.  Blocks meet the faces of the next ones in one
    shuffle; only what is on the surface leaves them.
    """
    c = [g.centre(F.col(f"g{a}"), voxel) for a in "xyz"]
    alpha = F.col("value") / (F.col("value") - F.col("next"))
    moved = [F.when(F.col("kind") == k + 1, c[k] + alpha * (g.centre(F.col(f"g{a}") + 1, voxel) - c[k])).otherwise(c[k]) for k, a in enumerate("xyz")]
    return halo.crossings(v).select("kind", "gx", "gy", "gz", *[x.alias(n) for x, n in zip(moved, "xyz")])


def cells(v: DataFrame) -> DataFrame:
    """(gx, gy, gz, known, values) of cells, by their lowest corner, of which a corner is known."""
    return halo.cells(v)


def active_cells(v: DataFrame) -> DataFrame:
    """Cells whose corners are all known, none of them zero, and differ in sign: those that hold triangles."""
    return halo.cells(v, True)


def cell_report(c: DataFrame) -> DataFrame:
    """Cells considered, skipped for an unknown corner, then for an exact zero, and eligible; active ones change sign."""
    zero = F.exists("values", lambda x: x == 0)
    low = F.exists("values", lambda x: x < 0) & F.exists("values", lambda x: x > 0)
    whole = F.col("known") == 8
    return c.agg(
        F.count("*").alias("considered"),
        F.count_if(~whole).alias("unknown"),
        F.count_if(whole & zero).alias("exact_zero"),
        F.count_if(whole & ~zero).alias("eligible"),
        F.count_if(whole & ~zero & low).alias("active"),
    )


def triangles(c: DataFrame) -> DataFrame:
    """(gx, gy, gz, tetra, tri, corner, n, p, vn, vp): three rows a triangle, each the edge it crosses."""
    spark = c.sparkSession
    good = c.where((F.col("known") == 8) & ~F.exists("values", lambda x: x == 0))
    t = good.select("gx", "gy", "gz", "values", F.posexplode(F.array(*[F.array(*[F.lit(x) for x in sorted(q)]) for q in TETRAHEDRA])).alias("tetra", "q"))
    pattern = sum((F.when(F.get("values", F.get("q", F.lit(i))) < 0, 1 << i).otherwise(0) for i in range(4)), F.lit(0))
    t = t.withColumn("pattern", pattern).where("pattern between 1 and 14")
    t = t.join(F.broadcast(case_table(spark)), ["tetra", "pattern"])  # at most 168 rows
    edge = F.posexplode(F.array(*[F.struct(F.col(f"n{k}").alias("n"), F.col(f"p{k}").alias("p")) for k in range(3)])).alias("corner", "e")
    t = t.select("gx", "gy", "gz", "values", "tetra", "tri", edge)
    return t.select("gx", "gy", "gz", "tetra", "tri", "corner", F.get("values", F.col("e.n")).alias("vn"), F.get("values", F.col("e.p")).alias("vp"), F.col("e.n").alias("n"), F.col("e.p").alias("p"))


def corners(t: DataFrame, voxel: float, more: tuple[str, ...] = ()) -> DataFrame:
    """Triangle corners with the edge they lie on (its lower voxel and direction code) and their point; more: other columns
    to keep."""
    bit = lambda c, a: F.shiftright(F.col(c), "xyz".index(a)) % 2
    low = [(F.col(f"g{a}") + F.least(bit("n", a), bit("p", a))).alias(f"e{a}") for a in "xyz"]
    code = F.col("n").bitwiseXOR(F.col("p")).alias("code")
    alpha = F.col("vn") / (F.col("vn") - F.col("vp"))
    point = []
    for a in "xyz":
        neg, pos = g.centre(F.col(f"g{a}") + bit("n", a), voxel), g.centre(F.col(f"g{a}") + bit("p", a), voxel)
        point.append((neg + alpha * (pos - neg)).alias(a))
    return t.select("gx", "gy", "gz", "tetra", "tri", "corner", *low, code, *point, *more)


EDGE = ["ex", "ey", "ez", "code"]
FACE = ["gx", "gy", "gz", "tetra", "tri"]


def vertices(k: DataFrame) -> DataFrame:
    """M7: one vertex an edge; every triangle that meets the edge computes the same point."""
    return k.groupBy(*EDGE).agg(*[F.min(a).alias(a) for a in "xyz"])


def vertex_numbers(k: DataFrame) -> DataFrame:
    """(ex, ey, ez, code, id): vertices numbered in the order of their first use, by cell (z, y, x), tetrahedron and
    crossed edge.  k: corners with n and p.

    Counts of rows of cells give each row its first number; numbers within a row need that row alone.
    """
    used = k.groupBy(*EDGE).agg(F.min(F.struct("gz", "gy", "gx", "tetra", "n", "p")).alias("f"))
    rows = used.groupBy(F.col("f.gz").alias("_z"), F.col("f.gy").alias("_y")).agg(F.count("*").alias("c"))
    before = Window.orderBy("_z", "_y").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.select("_z", "_y", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("f.gz", "f.gy").orderBy("f")) - 1
    met = used.withColumn("k", inside).join(start, (F.col("f.gz") == F.col("_z")) & (F.col("f.gy") == F.col("_y")))
    return met.select(*EDGE, (F.col("start") + F.col("k")).alias("id"))


def half_edges(k: DataFrame) -> DataFrame:
    """Undirected edges of the mesh: two vertex keys in order, for each side of each triangle."""
    key = F.concat_ws(",", *EDGE)
    f = k.groupBy(*FACE).agg(*[F.max(F.when(F.col("corner") == i, key)).alias(f"k{i}") for i in range(3)])
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    sides = F.explode(F.array(pair("k0", "k1"), pair("k1", "k2"), pair("k2", "k0"))).alias("s")
    return f.select(*FACE, sides).select(*FACE, "s.a", "s.b")


def edge_report(k: DataFrame) -> DataFrame:
    """Edges on the boundary (one triangle), inner ones (two) and others."""
    n = half_edges(k).groupBy("a", "b").agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.expr("n = 1")).alias("boundary"), F.count_if(F.expr("n = 2")).alias("manifold"), F.count_if(F.expr("n > 2")).alias("non_manifold"))


def fans(k: DataFrame) -> DataFrame:
    """(v, fan, triangles): the fans of triangles around each vertex; a manifold vertex has one.

    Two corners at a vertex belong to one fan if their triangles share an edge there.  The first fan keeps the vertex when
    pinches are split.
    """
    sides = half_edges(k).withColumn("face", F.concat_ws(",", *FACE))
    at = sides.select("a", "b", "face", F.explode(F.array("a", "b")).alias("v"))
    node = F.concat_ws("|", "v", "face")
    first = at.groupBy("a", "b", "v").agg(F.min("face").alias("f0"))
    links = at.join(first, ["a", "b", "v"]).select(F.concat_ws("|", "v", "f0").alias("a"), node.alias("b"))
    roots = components(links.distinct())
    return roots.groupBy(F.substring_index("node", "|", 1).alias("v"), F.substring_index("root", "|", -1).alias("fan")).agg(F.count("*").alias("triangles"))


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of links (a, b): the smallest node each reaches, by hooking and halving paths.

    Every round writes its table to the shared folder, so a lost executor costs a round's read and no more.
    """

    def kept(df: DataFrame) -> DataFrame:
        return scratch.kept(df, "components")

    both = kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(most):
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        hooked = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = hooked.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = kept(hooked.join(jump, F.col("root") == F.col("_n"), "left").select("node", F.least("root", F.coalesce("_r", "root")).alias("root")))
        if new.join(label.select("node", F.col("root").alias("was")), "node").where("root <> was").isEmpty():
            return new
        label = new
    raise RuntimeError("components did not settle")


def face_components(k: DataFrame) -> DataFrame:
    """Each triangle with its component (the smallest vertex key) and the component's number of triangles."""
    sides = half_edges(k)
    roots = components(sides.select("a", "b").distinct())
    f = sides.groupBy(*FACE).agg(F.min("a").alias("v")).join(roots, F.col("v") == F.col("node")).select(*FACE, F.col("root").alias("component"))
    size = f.groupBy("component").agg(F.count("*").alias("triangles"))
    return f.join(size, "component")
