"""Shared proofs of many leaves of many trees (V3, V12): made from the trees, and checked without them.

A shared proof of some leaves of a tree holds the siblings that do not follow from those leaves, each once; so it is never
larger than the leaves' paths, which repeat what they share.  A checker goes up level by level: what it knows and what the
proof gives must make up whole pairs, and every node that the proof gives must be needed.  All trees go up together, with a
shuffle a level; no tree meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanengine.operators.commit import leaf_hash, sha
from scanengine.sources.scratch import kept

NODE = ["tree", "level", "idx", "hash"]


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def _size(n: Column, level: Column | int) -> Column:
    """Nodes at a level: halves, rounded up."""
    power = F.shiftleft(F.lit(1).cast("long"), level) if isinstance(level, int) else F.expr("shiftleft(1L, level)")
    return F.floor((n + power - 1) / power).cast("long")


def _parent(left: Column, right: Column) -> Column:
    return F.when(right.isNull(), left).otherwise(sha(F.concat(F.unhex(F.lit("01")), left, right)))


def sizes(leaves: DataFrame) -> DataFrame:
    """(tree, n): how many leaves each tree has."""
    return leaves.groupBy("tree").agg(F.count("*").alias("n"))


def forest(leaves: DataFrame) -> DataFrame:
    """(tree, level, idx, hash): all nodes of trees over leaves (tree, idx from 0 without gaps in each tree, data); an unpaired
    last node is carried up as it is."""
    level = kept(leaves.select("tree", F.lit(0).alias("level"), F.col("idx").cast("long").alias("idx"), leaf_hash(F.col("data")).alias("hash")), "forest")
    n = kept(sizes(leaves), "sizes")
    top = n.agg(F.max(_height(F.col("n"))).alias("top")).first()["top"] or 0
    out = level
    for k in range(1, top + 1):
        side = lambda s: F.max(F.when(F.col("idx") % 2 == s, F.col("hash")))
        up = level.join(n.where(_height(F.col("n")) >= k).select("tree"), "tree", "left_semi")
        up = up.groupBy("tree", F.shiftright("idx", 1).alias("idx")).agg(side(0).alias("l"), side(1).alias("r"))
        level = kept(up.select("tree", F.lit(k).alias("level"), "idx", _parent(F.col("l"), F.col("r")).alias("hash")), "forest")
        out = out.unionByName(level)
    return out


def roots(nodes: DataFrame, n: DataFrame) -> DataFrame:
    """(tree, root) of whole trees."""
    return nodes.join(n, "tree").where(F.col("level") == _height(F.col("n"))).select("tree", F.col("hash").alias("root"))


def _wanted(wanted: DataFrame, n: DataFrame) -> DataFrame:
    """(tree, level, idx, n): what follows from the wanted leaves (tree, idx), below the root."""
    at = wanted.select("tree", "idx").distinct().join(n, "tree").where(_height(F.col("n")) > 0)
    at = at.withColumn("level", F.explode(F.sequence(F.lit(0), _height(F.col("n")) - 1)))
    return at.select("tree", "level", F.expr("shiftright(idx, level)").alias("idx"), "n").distinct()


def prove(nodes: DataFrame, wanted: DataFrame, n: DataFrame) -> DataFrame:
    """(tree, level, idx, hash): the shared proof of the wanted leaves (tree, idx) of each tree."""
    known = _wanted(wanted, n)
    need = known.select("tree", "level", F.col("idx").bitwiseXOR(F.lit(1)).alias("idx"))
    return need.join(known, ["tree", "level", "idx"], "left_anti").join(nodes, ["tree", "level", "idx"]).select(*NODE)


def path_nodes(wanted: DataFrame, n: DataFrame) -> DataFrame:
    """(tree, nodes): how many siblings the wanted leaves' paths hold, one path a leaf."""
    at = wanted.select("tree", "idx").distinct().join(n, "tree").where(_height(F.col("n")) > 0)
    at = at.withColumn("level", F.explode(F.sequence(F.lit(0), _height(F.col("n")) - 1)))
    there = F.expr("shiftright(idx, level)").bitwiseXOR(F.lit(1)) < _size(F.col("n"), F.col("level"))
    return at.groupBy("tree").agg(F.count_if(there).alias("nodes"))


def check(leaves: DataFrame, proof: DataFrame, n: DataFrame) -> DataFrame:
    """(tree, root, problem): the root that leaves (tree, idx, hash) and a proof (tree, level, idx, hash) lead to in trees of n
    leaves; problem says what is wrong with a tree's proof, and then root is null.

    Refused are: a leaf that comes twice or lies outside of its tree, a proof's node that comes twice, lies outside of its
    level, or is not needed, and a pair of which one node is neither known nor given.  A forged node gives another root.
    Trees without leaves to prove are not among the rows; a proof's nodes of such trees are a problem of theirs.
    """
    asked = leaves.select("tree", F.lit(0).alias("level"), "idx", "hash", F.lit(True).alias("known"))
    given = proof.select(*NODE).withColumn("known", F.lit(False)).join(n, "tree", "left")
    outside = given.where(F.col("n").isNull() | (F.col("level") < 0) | (F.col("level") >= _height(F.col("n"))) | (F.col("idx") < 0) | (F.col("idx") >= _size(F.col("n"), F.col("level"))))
    wrong = [outside.select("tree", F.lit("a node lies outside of its tree").alias("problem"))]
    level = asked.join(n, "tree", "left")
    lost = level.where(F.col("n").isNull() | (F.col("idx") < 0) | (F.col("idx") >= F.col("n")))
    wrong.append(lost.select("tree", F.lit("a leaf lies outside of its tree").alias("problem")))
    top = n.agg(F.max(_height(F.col("n"))).alias("top")).first()["top"] or 0
    done = None
    for k in range(top + 1):
        here = level.where(_height(F.col("n")) == k).groupBy("tree").agg(F.count("*").alias("c"), F.max("hash").alias("root"))
        if k == 0:
            wrong.append(here.where("c > 1").select("tree", F.lit("a node comes twice").alias("problem")))
        done = here if done is None else done.unionByName(here)
        if k == top:
            break
        met = level.where(_height(F.col("n")) > k).unionByName(given.where(F.col("level") == k).select(*level.columns))
        side = lambda s: F.max(F.when(F.col("idx") % 2 == s, F.col("hash")))
        pair = met.groupBy("tree", "n", F.shiftright("idx", 1).alias("up")).agg(
            side(0).alias("l"), side(1).alias("r"), F.count("*").alias("c"), F.countDistinct("idx").alias("d"), F.max("known").alias("known"), F.min("known").alias("all_known")
        )
        alone = 2 * F.col("up") + 1 >= _size(F.col("n"), k)
        problem = (
            F.when(F.col("c") > F.col("d"), "a node comes twice")
            .when(~F.col("known"), "a node is not needed")
            .when(F.col("l").isNull() | (F.col("r").isNull() & ~alone), "a node is missing")
        )
        pair = kept(pair.select("tree", "n", F.col("up").alias("idx"), _parent(F.col("l"), F.col("r")).alias("hash"), problem.alias("problem")), "pairs")
        wrong.append(pair.where("problem is not null").select("tree", "problem"))
        level = pair.where("problem is null").select("tree", F.lit(k + 1).alias("level"), "idx", "hash", F.lit(True).alias("known"), "n")
    bad = wrong[0]
    for w in wrong[1:]:
        bad = bad.unionByName(w)
    bad = bad.groupBy("tree").agg(F.min("problem").alias("problem"))
    every = leaves.select("tree").unionByName(proof.select("tree")).distinct()
    out = every.join(done.select("tree", "root"), "tree", "left").join(bad, "tree", "left")
    problem = F.coalesce("problem", F.when(F.col("root").isNull(), "no leaf is proved"))
    return out.select("tree", F.when(problem.isNull(), F.col("root")).alias("root"), problem.alias("problem"))
