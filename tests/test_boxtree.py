"""Nearest points and triangles where a third of all rows lies in one cell."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanengine.operators import boxtree, evaluate

POINT = "x double, y double, z double"
TRIANGLE = "face long, " + ", ".join(f"{v}{a} double" for v in "abc" for a in "xyz")


def clumped(seed, n, shift=0.0):
    """A third within a ten thousandth, a third on a grid that gives ties, and a third anywhere."""
    r = random.Random(seed)
    near = [[0.3 + shift + r.uniform(0, 1e-4) for _ in range(3)] for _ in range(n // 3)]
    grid = [[r.randrange(-8, 9) / 8 for _ in range(3)] for _ in range(n // 3)]
    return near + grid + [[r.uniform(-1, 1) for _ in range(3)] for _ in range(n - 2 * (n // 3))]


@pytest.fixture(scope="module")
def clouds(spark):
    ref = [(k, *p) for k, p in enumerate(clumped(1, 3000))]
    query = [(k, *p) for k, p in enumerate(clumped(2, 600) + clumped(3, 600, 0.01) + [[40.0, 0.0, 0.0]])]
    made = lambda rows, key: spark.createDataFrame(rows, f"{key} long, {POINT}").repartition(6).cache()
    return ref, query, made(ref, "idx"), made(query, "id")


@pytest.mark.parametrize(("limit", "sent"), [(0.02, 0), (0.5, boxtree.SENT)])
def test_nearest_of_clumped_points(clouds, limit, sent, monkeypatch):
    ref, query, r, q = clouds
    if not sent:
        monkeypatch.setattr(boxtree.leaves_near, "__defaults__", (0, 0.0))
    at = np.array([p[1:] for p in ref])
    want = {}
    for i, *p in query:
        d = np.array(p) - at
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        best = int(np.argmin(d2))  # the first of equals
        want[i] = (best, float(d2[best])) if d2[best] <= limit * limit else (None, None)
    assert {x.id: (x.idx, x.d2) for x in evaluate.nearest(q, r, limit).collect()} == want
    assert sum(v[0] is None for v in want.values()) > 0


def test_work_follows_the_leaves_and_not_the_clump(clouds):
    ref, query, r, q = clouds
    items = r.select("idx", *[F.col(a).alias(f"{e}{a}") for e in "lh" for a in "xyz"]).dropDuplicates(boxtree.BOX)
    nodes, placed = boxtree.tree(items, 0.5)
    assert placed.count() == items.count() and placed.groupBy(*boxtree.CELL).count().agg(F.max("count")).first()[0] <= boxtree.MOST
    assert nodes.agg(F.max("level")).first()[0] > 4
    pairs = boxtree.leaves_near(q, nodes, 0.5).join(placed, boxtree.CELL).count()
    assert pairs < 6 * boxtree.MOST * len(query) < len(query) * len(ref) / 5


def test_copies_rows_without_a_place_and_empty_tables(spark):
    nan = float("nan")
    ref = spark.createDataFrame([(k, 0.5, 0.5, 0.5) for k in range(200)] + [(900, nan, 0.0, 0.0), (901, None, 0.0, 0.0)], f"idx long, {POINT}")
    query = spark.createDataFrame([(1, 0.5, 0.5, 0.6), (2, nan, 0.0, 0.0), (3, None, 0.5, 0.5), (4, 9.0, 9.0, 9.0)], f"id long, {POINT}")
    got = {x.id: x.idx for x in evaluate.nearest(query, ref, 0.2).collect()}
    assert got == {1: 0, 2: None, 3: None, 4: None}
    assert [x.idx for x in evaluate.nearest(query, ref.where("1 = 0"), 0.2).collect()] == [None] * 4
    assert evaluate.nearest(query.where("1 = 0"), ref, 0.2).count() == 0


def test_triangles_of_every_size_in_one_place(spark):
    """Most triangles are tiny and in one cell; some are hundreds of times as large as the reach."""
    r = random.Random(7)
    tiny = [[0.3 + r.uniform(0, 1e-3) for _ in range(9)] for _ in range(300)]
    some = [[c + r.uniform(-0.2, 0.2) for _ in range(3) for c in mid] for mid in ([r.uniform(-1, 1) for _ in range(3)] for _ in range(100))]
    huge = [[r.uniform(-40, 40) for _ in range(9)] for _ in range(20)]
    flat = [[0.1, 0.1, 0.1] * 3, [0.2, 0.2, 0.2, 0.4, 0.4, 0.4, 0.3, 0.3, 0.3]]
    tri = spark.createDataFrame([(k, *t) for k, t in enumerate(tiny + some + huge + flat + tiny[:50])], TRIANGLE).repartition(5).cache()
    query = spark.createDataFrame([(k, *p) for k, p in enumerate(clumped(8, 400) + clumped(9, 200, 0.02) + [[400.0, 0.0, 0.0]])], f"id long, {POINT}").cache()
    for reach in (0.1, 0.6):
        want = {x.id: x.d2 for x in evaluate.triangle_distance_by_all(query, tri, reach).collect()}
        assert {x.id: x.d2 for x in evaluate.triangle_distance(query, tri, reach).collect()} == want
    assert 0 < sum(v is None for v in want.values()) < len(want)
    items = tri.select(*[F.least(*[F.col(f"{v}{a}") for v in "abc"]).alias(f"l{a}") for a in "xyz"], *[F.greatest(*[F.col(f"{v}{a}") for v in "abc"]).alias(f"h{a}") for a in "xyz"])
    nodes, placed = boxtree.tree(items, 0.1)
    assert placed.count() == tri.count() and nodes.select("cls").distinct().count() > 3


def rows_written(spark, make):
    """How many rows stages shuffle or write while make()'s result is collected."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()

    def told():
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        each = [stages.apply(k) for k in range(stages.size())]
        return {x.stageId(): x.shuffleWriteRecords() + x.outputRecords() for x in each}

    before = told()
    got = make().collect()
    return sum(n for k, n in told().items() if k not in before), got


def test_no_pair_of_a_query_and_a_point_is_a_row(spark, clouds):
    """Neither through the tree nor where all are compared with all are there rows for pairs, or many for each query."""
    _, _, r, q = clouds
    n, near = rows_written(spark, lambda: evaluate.nearest(q, r, 0.5))
    assert n < 15 * (q.count() + r.count())
    m, every = rows_written(spark, lambda: evaluate.nearest_by_all(q, r, 0.5, slice_rows=1000))
    assert m < 8 * (q.count() + r.count())
    assert {(x.id, x.idx, x.d2) for x in near} == {(x.id, x.idx, x.d2) for x in every}


def test_large_triangles_in_one_place(spark):
    """Boxes of large triangles hold most of all points; still no row is made for each pair."""
    r = random.Random(11)
    tri = spark.createDataFrame([(k, *[r.gauss(0, 0.12) for _ in range(9)]) for k in range(700)], TRIANGLE).cache()
    query = spark.createDataFrame([(k, *[r.gauss(0, 0.12) for _ in range(3)]) for k in range(900)], f"id long, {POINT}").cache()
    n, got = rows_written(spark, lambda: evaluate.triangle_distance(query, tri, 0.1))
    assert n < 15 * 1600
    assert {(x.id, x.d2) for x in got} == {(x.id, x.d2) for x in evaluate.triangle_distance_by_all(query, tri, 0.1).collect()}
