"""Connected components by alternating stars over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanengine.llm.shared import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of links (a, b) reaches.

    Each round turns every node's larger neighbours, then its smaller ones, to the least node it knows, until nothing
    changes; rounds grow with the logarithm of the longest path.  Nodes without links are not among the rows.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    known = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours above u point to u's least
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below u, and u itself, point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        edges = written(small, "star")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if known == (state["n"], state["h"]):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        known = (state["n"], state["h"])
    raise RuntimeError("components did not settle")
