"""Shared proofs of every subset of small trees, of many trees at once, and of proofs that were tampered with."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from scanengine.operators import commit, multiproof

LEAF = "tree long, idx long, hash binary"
NODE = "tree long, level int, idx long, hash binary"


def node(left, right):
    return hashlib.sha256(b"\x01" + left + right).digest()


def levels(n, tree):
    out = [[hashlib.sha256(b"\x00" + f"{tree}:{i}".encode()).digest() for i in range(n)]]
    while len(out[-1]) > 1:
        x = out[-1]
        out.append([node(x[i], x[i + 1]) if i + 1 < len(x) else x[i] for i in range(0, len(x), 2)])
    return out


@pytest.fixture(scope="module")
def cases(spark):
    """Trees of 1 to 6 leaves with every subset of them, and larger ones with some: (tree, n, wanted)."""
    r = random.Random(2)
    some = [(n, w) for n in range(1, 7) for k in range(1, n + 1) for w in itertools.combinations(range(n), k)]
    some += [(n, tuple(sorted(r.sample(range(n), min(n, k))))) for n in (7, 8, 9, 33, 64, 130) for k in (1, 2, 5, 40)]
    return [(t, n, w) for t, (n, w) in enumerate(some)]


@pytest.fixture(scope="module")
def forest(spark, cases):
    data = spark.createDataFrame([(t, i, f"{t}:{i}") for t, n, _ in cases for i in range(n)], "tree long, idx long, data string").repartition(3)
    nodes = multiproof.forest(data).cache()
    n = multiproof.sizes(data).cache()
    wanted = spark.createDataFrame([(t, i) for t, _, w in cases for i in w], "tree long, idx long")
    return nodes, n, wanted, multiproof.prove(nodes, wanted, n).cache()


def asked(nodes, wanted):
    return nodes.where("level = 0").join(wanted, ["tree", "idx"]).select("tree", "idx", "hash")


def test_shared_proofs_are_least_and_lead_to_the_root(spark, cases, forest):
    nodes, n, wanted, proof = forest
    known = {t: levels(n_, t) for t, n_, _ in cases}
    assert {(r.tree, r.level, r.idx): bytes(r.hash) for r in nodes.collect()} == {(t, k, i): h for t, ls in known.items() for k, row in enumerate(ls) for i, h in enumerate(row)}
    got = {(r.tree, r.level, r.idx) for r in proof.collect()}
    need = set()
    for t, _, w in cases:
        have = set(w)
        for k, row in enumerate(known[t][:-1]):
            need |= {(t, k, i ^ 1) for i in have if i ^ 1 < len(row) and i ^ 1 not in have}
            have = {i // 2 for i in have}
    assert got == need
    out = {r.tree: r for r in multiproof.check(asked(nodes, wanted), proof, n).collect()}
    assert set(out) == set(known) and all(r.problem is None and bytes(r.root) == known[t][-1][0] for t, r in out.items())
    assert {r.tree: bytes(r.root) for r in multiproof.roots(nodes, n).collect()} == {t: ls[-1][0] for t, ls in known.items()}
    paths = {r.tree: r.nodes for r in multiproof.path_nodes(wanted, n).collect()}
    for t, n_, w in cases:
        assert paths.get(t, 0) == sum(sum((i >> k ^ 1) < len(row) for k, row in enumerate(known[t][:-1])) for i in w)


def test_one_tree_is_that_of_commit(spark):
    d = spark.range(77).select(F.lit(5).cast("long").alias("tree"), F.col("id").alias("idx"), F.col("id").cast("string").alias("data"))
    assert bytes(multiproof.roots(multiproof.forest(d), multiproof.sizes(d)).first().root) == commit.root(d)


def test_tampered_proofs_are_refused(spark, cases, forest):
    nodes, n, wanted, proof = forest
    known = {t: levels(n_, t) for t, n_, _ in cases}
    rows = sorted(map(tuple, proof.collect()))
    leaves = sorted(map(tuple, asked(nodes, wanted).collect()))
    r = random.Random(9)
    by, own = {}, {}
    for x in rows:
        by.setdefault(x[0], []).append(x)
    for x in leaves:
        own.setdefault(x[0], []).append(x)
    given, held, want = [], [], {}
    for t, n_, w in cases:
        p, l, kind = list(by.get(t, [])), list(own[t]), r.choice(["forged", "missing", "surplus", "twice", "outside", "leaf", "repeat"])
        if not p and kind in ("forged", "missing", "twice") or kind == "surplus" and len(w) == n_ == 1:
            kind = "outside"
        if kind == "forged":
            k = r.randrange(len(p))
            p[k] = (*p[k][:3], bytes(32))
        elif kind == "missing":
            p.pop(r.randrange(len(p)))
        elif kind == "surplus":  # a true node that follows from the leaves, or one beside the paths
            k = r.randrange(len(known[t]) - 1)
            free = [i for i in range(len(known[t][k])) if (t, k, i) not in {x[:3] for x in p}]
            if free:
                i = r.choice(free)
                p.append((t, k, i, known[t][k][i]))
            else:
                kind, p = "outside", [*p, (t, 99, 0, bytes(32))]
        elif kind == "twice":
            p.append(r.choice(p))
        elif kind == "outside":
            p.append((t, 99, 0, bytes(32)))
        elif kind == "leaf":
            l[0] = (t, l[0][1], bytes(32))
        else:
            l.append(l[0])
        given, held, want = given + p, held + l, want | {t: kind}
    out = {x.tree: x for x in multiproof.check(spark.createDataFrame(held, LEAF), spark.createDataFrame(given, NODE), n).collect()}
    assert len(set(want.values())) == 7
    for t, kind in want.items():
        if kind in ("forged", "leaf"):
            assert out[t].problem is None and bytes(out[t].root) != known[t][-1][0]
        else:
            assert out[t].root is None and out[t].problem, (t, kind)
    # a tree of which no leaf is asked for
    assert multiproof.check(spark.createDataFrame(held, LEAF).where("tree <> 40"), spark.createDataFrame(given, NODE), n).where("tree = 40 and problem is not null").count() == (40 in {x[0] for x in given})
