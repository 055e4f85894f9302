"""Nearest items by a tree of boxes that is as deep as its items are dense.

Items (points, triangles) lie in cells by the middle of their box.  A cell with more than MOST items is quartered along each
axis, again and again, so a leaf has few items wherever the data are dense, and large items are in trees of larger cells.
A query starts in the cells around it and goes down only into boxes that are no further than the furthest point of the
best box it knows; so its pairs follow MOST and not how many items, or other queries, are close by.

Many queries go down together: those of a cell are one box (packed()), which meets the leaves that may hold something near
any of them.  A leaf then moves once for thousands of queries, and no pair of query and item is ever a row.

Bounds and distances are made of the same operations in the same order, each monotone, so no rounding lets a box be left
out that holds the nearest item, or one of several that are equally near.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanengine.sources.scratch import kept

CELL = ["cls", "level", "kx", "ky", "kz"]
BOX = ["lx", "ly", "lz", "hx", "hy", "hz"]
#: Items of a leaf, unless it is DEPTH levels deep; a level's cells are a 2^HALVINGS-th as wide as those above.
MOST = 32
DEPTH = 15
HALVINGS = 2
#: Cells are this much wider than they need be, so that rounding puts nothing two cells away.
WIDER = 1 + 2.0**-20
#: Nodes that are sent to every task, some 120 bytes each; beyond, queries meet them by shuffles.
SENT = 200_000
#: Queries that go down together, about, and items of a leaf that they meet.
TOGETHER = 4096
HELD = 256


def _class_of(extent: Column, reach: float) -> Column:
    """The smallest k with extent <= 2 reach (2^k - 1): such items, and queries within reach of them, differ by at most a cell
    of reach 2^k."""
    k = F.ceil(F.log2(extent / F.lit(2 * reach) + F.lit(1.0)))
    for _ in range(2):  # rounding of the logarithm
        k = F.when(extent > F.lit(2 * reach) * (F.pow(F.lit(2.0), k) - F.lit(1.0)), k + 1).otherwise(k)
    return k.cast("int")


def _cells(size: Column, at: dict[str, Column]) -> list[Column]:
    return [F.floor(at[a] / size).alias(f"k{a}") for a in "xyz"]


def tree(items: DataFrame, reach: float, most: int = MOST, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(nodes, placed) of items with a box (lx .. hz): nodes are (cls, level, kx, ky, kz, n, box, leaf), placed is items with the
    cell of their leaf, their part of it (more than one only where a leaf could not be split) and their other columns, which must not have the names of a cell's.  Items without a box, or with a box that is not a number, are left out.

    Each level is one aggregation of what lies in crowded cells, written down; nothing but whether any are left reaches the
    driver.
    """
    if taken := set(items.columns) & {*CELL, "part"}:
        raise ValueError(f"items have columns of the tree: {sorted(taken)}")
    known = items
    for c in BOX:
        known = known.where(F.col(c).isNotNull() & ~F.isnan(c))
    middle = {a: (F.col(f"l{a}") + F.col(f"h{a}")) * F.lit(0.5) for a in "xyz"}
    extent = F.greatest(*[F.col(f"h{a}") - F.col(f"l{a}") for a in "xyz"])
    left = known.withColumn("cls", _class_of(extent, reach))
    part = F.pmod(F.xxhash64(*items.columns), F.ceil(F.col("n") / F.lit(most))).alias("part")
    nodes = placed = None
    for level in range(depth + 1):
        size = F.lit(WIDER * reach * 0.5 ** (HALVINGS * level)) * F.pow(F.lit(2.0), F.col("cls"))
        left = kept(left.drop(*CELL[1:]).select("*", F.lit(level).alias("level"), *_cells(size, middle)), "boxes")
        box = [(F.min if c[0] == "l" else F.max)(c).alias(c) for c in BOX]
        here = kept(left.groupBy(*CELL).agg(F.count("*").alias("n"), *box).withColumn("leaf", (F.col("n") <= most) | F.lit(level == depth)), "nodes")
        marked = left.join(here.select(*CELL, "leaf", "n"), CELL).select("*", part).drop("n")
        nodes = here if nodes is None else nodes.unionByName(here)
        settled = marked.where("leaf").drop("leaf")
        placed = settled if placed is None else placed.unionByName(settled)
        if here.where("not leaf").isEmpty():
            break
        left = marked.where("not leaf").drop("leaf", "part")
    return nodes, placed


def _nearest_and_furthest(node: str, low: dict[str, Column], high: dict[str, Column]) -> tuple[Column, Column]:
    """Squared distances from a box, or a point, to the nearest point of a node's box and to the furthest from any of it."""
    near, far = [], []
    for a in "xyz":
        below, above = low[a] - F.col(f"{node}.h{a}"), F.col(f"{node}.l{a}") - high[a]
        gap = F.greatest(below, above, F.lit(0.0))
        span = F.greatest(F.abs(high[a] - F.col(f"{node}.l{a}")), F.abs(F.col(f"{node}.h{a}") - low[a]))
        near.append(gap * gap)
        far.append(span * span)
    return near[0] + near[1] + near[2], far[0] + far[1] + far[2]


def leaves_near(query: DataFrame, nodes: DataFrame, reach: float, sent: int = SENT, room: float = 0.0) -> DataFrame:
    """(id, x, y, z, cls, level, kx, ky, kz): for each query the leaves that may hold its nearest item within reach.  room:
    a share of reach squared by which distances that the caller works out may differ from those to boxes.

    A query may be a box (id, lx .. hz) of points that lie in one cell as wide as reach: then (id, box, cell, near), with the
    leaves that may hold the nearest item of any of its points, and the squared distance to each.
    """
    boxes = set(BOX) <= set(query.columns)
    at = BOX if boxes else list("xyz")
    low, high = ({a: F.col(f"{e}{a}" if boxes else a) for a in "xyz"} for e in "lh")
    spark = query.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # queries are dealt out once; what they meet stays with them
    q = query.where(" and ".join(f"{a} is not null and not isnan({a})" for a in at)).select("id", *at).repartition(parts, "id")
    node = F.struct(*CELL, "leaf", *BOX).alias("node")
    facts = nodes.agg(F.count("*").alias("n"), F.max("level").alias("deepest"), F.collect_set("cls").alias("classes")).first()  # a class for each doubling of size
    small = facts["n"] <= sent
    send = F.broadcast if small else (lambda df: df)
    held = (lambda df: df) if small else (lambda df: kept(df, "front"))
    whole = Window.partitionBy("id")

    def pruned(front: DataFrame) -> DataFrame:
        near, far = _nearest_and_furthest("node", low, high)
        front = front.select("id", *at, "node", near.alias("near"), F.least(F.min(far).over(whole), F.lit(reach * reach)).alias("_bound"))
        return held(front.where(F.col("near") <= F.col("_bound") + F.lit(room * reach * reach)).drop("_bound"))

    roots = nodes.where("level = 0").select("cls", "kx", "ky", "kz", node)
    around = q.select("*", F.explode(F.array(*[F.lit(k) for k in sorted(facts["classes"])]).cast("array<int>")).alias("cls"))
    around = around.select("*", *[c.alias(f"o{a}") for a, c in zip("xyz", _cells(F.lit(WIDER * reach) * F.pow(F.lit(2.0), F.col("cls")), low))])
    for a in "xyz":
        around = around.select("*", F.explode(F.array(*[F.col(f"o{a}") + k for k in (-1, 0, 1)])).alias(f"k{a}"))
    front = pruned(around.join(send(roots), ["cls", "kx", "ky", "kz"]).select("id", *at, "node"))
    up = [F.shiftright(f"k{a}", HALVINGS).alias(f"p{a}") for a in "xyz"]
    kids = nodes.where("level > 0").select("cls", (F.col("level") - 1).alias("level"), *up, node)
    kids = kids.groupBy("cls", "level", "px", "py", "pz").agg(F.collect_list("node").alias("kids"))  # at most 64
    for level in range(facts["deepest"] or 0):
        below = kids.where(F.col("level") == level).select(F.col("cls").alias("_c"), F.col("level").alias("_l"), "px", "py", "pz", "kids")
        same = (F.col("node.cls") == F.col("_c")) & (F.col("node.level") == F.col("_l"))
        for a in "xyz":
            same = same & (F.col(f"node.k{a}") == F.col(f"p{a}"))
        met = front.join(send(below), same, "left")
        front = pruned(met.select("id", *at, F.explode(F.coalesce("kids", F.array("node"))).alias("node")))
    return front.select("id", *at, *[F.col(f"node.{c}").alias(c) for c in CELL], *(["near"] if boxes else []))


def packed(placed: DataFrame, columns: list[str], nodes: DataFrame | None = None, most: int = TOGETHER) -> DataFrame:
    """Placed items, a row a part of a leaf: (cell, part, held: an array of the columns, box).  nodes: leaves with one parent
    are joined, in order, while about `most` items are together; (cls, level, parent, run, part, held, box)."""
    key = [*CELL, "part"]
    if nodes is not None:
        key = ["cls", "level", "px", "py", "pz", "run", "part"]
        leaves = nodes.where("leaf").select(*CELL, "n", *[F.when(F.col("level") > 0, F.shiftright(f"k{a}", HALVINGS)).otherwise(F.col(f"k{a}")).alias(f"p{a}") for a in "xyz"])
        upto = F.sum("n").over(Window.partitionBy("cls", "level", "px", "py", "pz").orderBy("kz", "ky", "kx"))  # at most 64
        placed = placed.join(leaves.select(*CELL, "px", "py", "pz", F.floor((upto - F.col("n")) / F.lit(most)).alias("run")), CELL)
    box = [(F.min if c[0] == "l" else F.max)(c).alias(c) for c in BOX]
    return placed.groupBy(*key).agg(F.collect_list(F.struct(*columns)).alias("held"), *box)


def gaps(points: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Squared distances from points (3, n) to a box (lx .. hz)."""
    x, y, z = np.maximum(np.maximum(box[:3, None] - points, points - box[3:, None]), 0.0)
    return x * x + y * y + z * z


Block = tuple[pa.StructArray, np.ndarray]


def met_by_blocks(query: DataFrame, tree_of_items: tuple[DataFrame, DataFrame], columns: list[str], reach: float, work: Callable[[pa.StructArray, Iterator[Block]], pa.RecordBatch | None], schema: str, room: float = 0.0) -> DataFrame:
    """What work() makes of each block of queries (id, x, y, z) and the leaves of items (columns, box) that may hold the nearest
    item of any of them, the nearest leaf first; nothing where it gives None.  work() takes all leaves.

    The leaves come one by one, so a task holds a block of queries, an answer for each, and a batch of leaves.
    """
    nodes, placed = tree_of_items
    points = query.select("id", *"xyz", *[F.col(a).alias(f"{e}{a}") for e in "lh" for a in "xyz"])
    own, dealt = tree(points, reach, TOGETHER)
    mine = kept(packed(dealt, ["id", *"xyz"], own).select(F.monotonically_increasing_id().alias("id"), "held", *BOX), "queries")
    theirs = packed(placed, columns).select(*CELL, F.col("held").alias("items"), F.array(*BOX).alias("box"))
    met = leaves_near(mine.select("id", *BOX), nodes, reach, room=room).select("id", "near", *CELL).join(theirs, CELL)
    rows = mine.select("id", F.lit(-1.0).alias("near"), "held").unionByName(met.select("id", "near", "items", "box"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((batch, k) for batch in batches for k in range(batch.num_rows))
        ahead = next(each, None)

        def leaves() -> Iterator[Block]:
            nonlocal ahead
            ahead = next(each, None)
            while ahead is not None and ahead[0].column(2)[ahead[1]].values is None:
                batch, k = ahead
                yield batch.column(3)[k].values, batch.column(4)[k].values.to_numpy()
                ahead = next(each, None)

        while ahead is not None:
            if (answers := work(ahead[0].column(2)[ahead[1]].values, leaves())) is not None:
                yield answers

    return rows.select("id", "near", "held", "items", "box").repartition("id").sortWithinPartitions("id", "near").mapInArrow(run, schema)
