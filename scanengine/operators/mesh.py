"""Indexed meshes: numbered vertices and faces, their checks, pinches and components.

Faces are (face, v0, v1, v2) and vertices (id, x, y, z); both are numbered from 0 without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanengine.functions import geometry as g
from scanengine.operators import surface
from scanengine.operators.order import dense_numbers
from scanengine.sources.scratch import kept

CORNERS = ("v0", "v1", "v2")
#: How many numbers make a bucket when rows are numbered in the order of numbers they have.
SPAN = 65_536


def indexed(k: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) of triangle corners with n and p: vertices by their first use, faces by cell (z, y, x), tetrahedron
    and triangle (W3, W4)."""
    k = kept(k, "corners")
    numbers = kept(surface.vertex_numbers(k), "vertex-numbers")
    at = k.join(numbers, surface.EDGE)
    each = [F.max(F.when(F.col("corner") == i, F.col("id"))).alias(c) for i, c in enumerate(CORNERS)]
    faces = at.groupBy(*surface.FACE).agg(*each)
    order = [F.col(c) for c in ("gx", "tetra", "tri")]
    faces = dense_numbers(faces, order, F.struct("gz", "gy"), "face").select("face", *CORNERS)
    vertices = surface.vertices(k).join(numbers, surface.EDGE).select("id", "x", "y", "z")
    return kept(faces, "faces"), kept(vertices, "vertices")


def with_points(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """faces with the coordinates of their corners: face, v0.., ax..az, bx.., cx..."""
    corner = faces.select("face", *CORNERS, F.posexplode(F.array(*CORNERS)).alias("i", "id")).join(vertices, "id")
    each = [F.max(F.when(F.col("i") == i, F.col(a))).alias(f"{n}{a}") for i, n in enumerate("abc") for a in "xyz"]
    return corner.groupBy("face", *CORNERS).agg(*each)


def face_problems(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(face, problem): corners that are one, no area, or the same three corners as an earlier face."""
    p = with_points(faces, vertices)
    a, b, c = (tuple(F.col(f"{v}{x}") for x in "xyz") for v in "abc")
    n = g.cross(tuple(q - r for q, r in zip(b, a)), tuple(q - r for q, r in zip(c, a)))
    flat = p.where((n[0] == 0) & (n[1] == 0) & (n[2] == 0)).select("face", F.lit("degenerate").alias("problem"))
    three = F.array_sort(F.array(*CORNERS))
    first = faces.groupBy(three.alias("t")).agg(F.min("face").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = faces.select("face", three.alias("t")).join(first, "t").where("face > first").select("face", F.lit("repeated").alias("problem"))
    return flat.unionByName(again)


def clean(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces without those that have problems, numbered again."""
    left = faces.join(face_problems(faces, vertices).select("face").distinct(), "face", "left_anti")
    return _renumbered(left, "face")


def _renumbered(df: DataFrame, column: str) -> DataFrame:
    """df with `column`'s numbers made dense, in their order."""
    d = dense_numbers(df, [F.col(column)], F.floor(F.col(column) / SPAN), "_new")
    return d.select(*[F.col("_new").alias(c) if c == column else F.col(c) for c in df.columns])


def sides(faces: DataFrame) -> DataFrame:
    """(face, a, b): the three undirected edges of each face."""
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    return faces.select("face", F.explode(F.array(pair("v0", "v1"), pair("v1", "v2"), pair("v2", "v0"))).alias("s")).select("face", "s.a", "s.b")


def corner_fans(faces: DataFrame) -> DataFrame:
    """(v, face, fan): the fan that each face belongs to at each of its vertices, named by its first face.

    Two faces at a vertex are of one fan if they share an edge there.  A vertex of one fan needs no search.
    """
    at = sides(faces).select("a", "b", "face", F.explode(F.array("a", "b")).alias("v"))
    first = at.groupBy("a", "b", "v").agg(F.min("face").alias("f0"))
    node = lambda f: F.struct("v", F.col(f).alias("f"))
    links = at.join(first, ["a", "b", "v"]).select(node("f0").alias("a"), node("face").alias("b")).distinct()
    roots = surface.components(links)
    return roots.select(F.col("node.v").alias("v"), F.col("node.f").alias("face"), F.col("root.f").alias("fan"))


def split_pinches(faces: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) with a vertex for each fan.  The fan with the first face keeps the vertex; the others get new
    ones at the same point, numbered on by (vertex, fan)."""
    fans = kept(corner_fans(faces), "fans")
    lead = fans.groupBy("v").agg(F.min("fan").alias("keeps"), F.countDistinct("fan").alias("n")).where("n > 1")
    more = fans.join(lead, "v").where("fan > keeps").select("v", "fan").distinct()
    total = vertices.count()
    more = kept(dense_numbers(more, [F.col("v"), F.col("fan")], F.floor(F.col("v") / SPAN), "k").select("v", "fan", (F.col("k") + total).alias("new")), "pinches")
    moved = fans.join(more, ["v", "fan"]).select("face", "v", "new")
    corner = faces.select("face", F.posexplode(F.array(*CORNERS)).alias("i", "v")).join(moved, ["face", "v"], "left")
    each = [F.max(F.when(F.col("i") == i, F.coalesce("new", "v"))).alias(c) for i, c in enumerate(CORNERS)]
    copies = more.join(vertices, F.col("v") == F.col("id")).select(F.col("new").alias("id"), *[c for c in vertices.columns if c != "id"])
    return corner.groupBy("face").agg(*each).select("face", *CORNERS), vertices.unionByName(copies)


def components_of(faces: DataFrame) -> DataFrame:
    """(face, component, triangles): the smallest vertex that a face's vertices reach, and its component's size."""
    roots = surface.components(sides(faces).select("a", "b").distinct())
    f = faces.join(roots, F.col("v0") == F.col("node")).select("face", F.col("root").alias("component"))
    return f.join(f.groupBy("component").agg(F.count("*").alias("triangles")), "component").select("face", "component", "triangles")


def keep_components(faces: DataFrame, vertices: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) of components of `least` triangles or more, both numbered again in their order."""
    large = components_of(faces).where(F.col("triangles") >= least).select("face")
    left = kept(faces.join(large, "face", "left_semi"), "kept-faces")
    used = left.select(F.explode(F.array(*CORNERS)).alias("id")).distinct()
    left_vertices = vertices.join(used, "id", "left_semi")
    numbered = kept(dense_numbers(left_vertices, [F.col("id")], F.floor(F.col("id") / SPAN), "new"), "kept-vertices")
    corner = left.select("face", F.posexplode(F.array(*CORNERS)).alias("i", "id")).join(numbered.select("id", "new"), "id")
    each = [F.max(F.when(F.col("i") == i, F.col("new"))).alias(c) for i, c in enumerate(CORNERS)]
    again = _renumbered(corner.groupBy("face").agg(*each).select("face", *CORNERS), "face")
    return again, numbered.select(F.col("new").alias("id"), *[c for c in vertices.columns if c != "id"])


def verdict(faces: DataFrame) -> DataFrame:
    """One row: faces, edges by how many faces meet there, vertices with more than one fan, and the verdict: closed
    (every edge has two faces), manifold with boundary, or non-manifold."""
    edges = sides(faces).groupBy("a", "b").agg(F.count("*").alias("n"))
    e = edges.agg(F.count_if(F.expr("n = 1")).alias("boundary"), F.count_if(F.expr("n = 2")).alias("inner"), F.count_if(F.expr("n > 2")).alias("crowded"))
    fans = corner_fans(faces).groupBy("v").agg(F.countDistinct("fan").alias("n"))
    p = fans.agg(F.count("*").alias("vertices"), F.count_if(F.expr("n > 1")).alias("pinched"))
    one = faces.agg(F.count("*").alias("faces")).crossJoin(e).crossJoin(p)  # a row each
    bad = (F.col("crowded") > 0) | (F.col("pinched") > 0)
    name = F.when(bad, "non-manifold").when(F.col("boundary") > 0, "manifold-with-boundary").otherwise("closed")
    return one.select("faces", "vertices", "boundary", "inner", "crowded", "pinched", name.alias("verdict"))


def dense_samples(volume: DataFrame, origin: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """M6: (gx, gy, gz, value) of the voxels of a dense box that a fused volume knows; cells reach no further than the box."""
    v = surface.samples(volume)
    inside: Column = F.lit(True)
    for a, o, n in zip("xyz", origin, size):
        inside = inside & F.col(f"g{a}").between(o, o + n - 1)
    return v.where(inside)
