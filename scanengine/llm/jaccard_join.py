"""Near duplicates by an exact Jaccard join on word shingles, with the shingles' global order cut into fragments.

Shingles are ordered by the number of documents that hold them, then by hash.  A document's links must share a shingle of
its prefix in that order, and shingles that no other document holds cannot be shared, so most documents have no
candidates at all.  Candidates are checked by vertical partitioning: the order is cut into fragments, each fragment
counts the shared shingles of a pair on its own, and the counts are summed per pair.

Pairs are not made within whole groups: documents with equal sets are one node; the holders of a prefix shingle are
compared with one of them, the centre, whose shingles are the commonest; what that joins needs no more comparing, and
only holders that still lie in different components, and whose places of the shared shingle leave room for a link, are
compared with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanengine.llm import textvec as tv
from scanengine.llm.components import components
from scanengine.llm.exchange import Exchange, Families, stable
from scanengine.llm.shared import row_key, without, written

_U = np.uint64
#: Width of the hashes by which documents are counted; their own hashes keep 52 bits beside a grade of 11.
KEY_BITS = 44
MEMBER = "doc_id long, n_shingles long, node long, prefix int, common int, keys array<long>, key long"


def sets_of(table: pa.Table, shingle: int) -> tv.Words:
    return tv.distinct_sets(tv.shingles(tv.words(table["text"]), shingle))


def nodes_of(sets: tv.Words) -> np.ndarray:
    """A hash of each whole set; 0 for an empty one."""
    n = sets.counts
    edge = np.concatenate([[_U(0)], np.cumsum(tv.mix(sets.hashes), dtype=np.uint64)])
    total = edge[sets.first[1:]] - edge[sets.first[:-1]]
    out = tv.combine(total, n.astype(np.uint64))
    out[n == 0] = 0
    return out


def _firsts(nodes: np.ndarray) -> np.ndarray:
    """Whether a document is the first of its node in the unit."""
    out = np.zeros(len(nodes), bool)
    out[np.unique(nodes, return_index=True)[1]] = True
    return out & (nodes != 0)


def grade(df: np.ndarray) -> np.ndarray:
    """A number of documents in 11 bits that rises with it: itself below 1024, then 32 steps to each doubling, up to 2^41."""
    e = np.frexp(np.maximum(df, _U(1)).astype(np.float64))[1] - 1
    above = 1024 + (e - 10) * 32 + ((df >> np.maximum(e - 5, 0).astype(np.uint64)) & _U(31)).astype(np.int64)
    return np.minimum(np.where(df < 1024, df.astype(np.int64), above), 2047).astype(np.uint64)


def members(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """A row a document: its set's size and node; and for documents that may have links, the length of their prefix and
    their shared shingles in global order."""

    def families(table: pa.Table) -> Families:
        sets = sets_of(table, shingle)
        one = np.repeat(_firsts(nodes_of(sets)), sets.counts)
        keys, counts = np.unique(sets.hashes[one] >> _U(64 - KEY_BITS), return_counts=True)
        return [(keys, [counts])]

    def work(table: pa.Table, own: Families, totals: list[list[np.ndarray]]) -> pa.RecordBatch:
        sets = sets_of(table, shingle)
        n, nodes = sets.counts, nodes_of(sets)
        first = _firsts(nodes)
        one = np.repeat(first, n)
        df = np.zeros(len(sets.hashes), np.uint64)
        df[one] = totals[0][0][np.searchsorted(own[0][0], sets.hashes[one] >> _U(64 - KEY_BITS))]
        shared = df > 1
        doc = sets.doc_of()
        n_shared = np.bincount(doc[shared], minlength=len(n))
        need = (percent * n + 99) // 100
        prefix = (n - need + 1) - (n - n_shared)
        hopeful = first & (prefix > 0)
        keep = shared & hopeful[doc]
        rank = (grade(df[keep]) << _U(52)) | (sets.hashes[keep] >> _U(12))
        order = np.lexsort((rank, doc[keep]))
        sizes = np.where(hopeful, n_shared, 0)
        # how common a document's shingles are: a thousand times their mean binary logarithm of documents
        common = 1000 * np.bincount(doc, np.log2(np.maximum(df, 1)), len(n)) / np.maximum(n, 1)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rank[order].astype(np.int64)))
        return pa.RecordBatch.from_arrays(
            [
                table["doc_id"].combine_chunks().cast(pa.int64()) if table.num_rows else pa.array([], pa.int64()),
                pa.array(n.astype(np.int64)),
                pa.array(nodes.view(np.int64)),
                pa.array(np.where(hopeful, prefix, 0).astype(np.int32)),
                pa.array(np.where(hopeful, common, 0).astype(np.int32)),
                lists,
                table["key"].combine_chunks() if table.num_rows else pa.array([], pa.int64()),
            ],
            ["doc_id", "n_shingles", "node", "prefix", "common", "keys", "key"],
        )

    return written(Exchange(docs, families, [KEY_BITS]).each(work, MEMBER), "members")


def overlaps(pairs: DataFrame, fragments: DataFrame, count: int) -> DataFrame:
    """pairs (a, b) with both sizes and their overlap: each fragment's own count, summed per pair."""
    left = fragments.select(F.col("node").alias("a"), "fragment", F.col("part").alias("part_a"), F.col("n").alias("n_a"))
    right = fragments.select(F.col("node").alias("b"), "fragment", F.col("part").alias("part_b"), F.col("n").alias("n_b"))
    each = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("fragment"))
    partial = each.join(left, ["a", "fragment"]).join(right, ["b", "fragment"])
    partial = partial.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("shared"))
    return partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))


def linked(docs: DataFrame, percent: int = 80, shingle: int = 5, cuts: int = 8) -> tuple[DataFrame, DataFrame]:
    """(members, roots): a row a document (doc_id, n_shingles, node, key), and the smallest node that each linked node
    reaches."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key().alias("key"))
    m = members(stable(rows, "documents"), percent, shingle)
    sets = written(
        m.where("prefix > 0").select("node", F.col("n_shingles").alias("n"), "prefix", "common", "keys").dropDuplicates(["node"]), "sets"
    )
    # fragments of about equal weight: cuts at the quantiles of what stands at even places in each set
    marks = sets.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(cuts - 1)), lambda i: F.get("keys", F.floor(F.size("keys") * i / cuts).cast("int")))).alias("k"))
    found = marks.select(F.percentile_approx("k", [i / cuts for i in range(1, cuts)], 1000).alias("q")).first()["q"] or []
    pivots = [-1, *sorted(set(found)), (1 << 63) - 1]

    def between(lo: int, hi: int):
        return F.filter("keys", lambda k: (k > F.lit(lo)) & (k <= F.lit(hi)))

    parts = F.array(*[between(lo, hi) for lo, hi in zip(pivots, pivots[1:])])
    fragments = sets.select("node", "n", F.posexplode(parts).alias("fragment", "part"))
    count = len(pivots) - 1
    # at: a shingle's place in the document's whole order, in which the shingles that no other document holds come first
    holders = sets.select(F.posexplode(F.slice("keys", F.lit(1), F.col("prefix"))).alias("i", "key"), "node", "n", "common", (F.col("n") - F.size("keys")).alias("own"))
    holders = written(holders.select("key", "node", "n", "common", (F.col("own") + F.col("i")).alias("at")), "prefixes")
    enough = F.col("shared") * 100 >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("shared"))

    def may_link(n: Column, at: Column, m: Column, to: Column) -> Column:
        """Sizes that fit, and what is left from the first shared shingle on is as much as a link needs.  Of a pair's
        shared shingles the first leaves most, so a pair that can link passes there."""
        left = F.least(n - at, m - to)
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (left * (100 + percent) >= (n + m) * percent)

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        return written(overlaps(pairs, fragments, count).where(enough).select("a", "b"), name)

    def starred(rest: DataFrame) -> DataFrame:
        """Pairs of each key's centre, the holder with the commonest shingles, and the other holders that may link to it."""
        best = F.max(F.struct("common", "node", "n", "at")).alias("c")
        centre = written(rest.groupBy("key").agg(best, F.count("*").alias("k")).where("k > 1").select("key", "c"), "centres")
        met = rest.join(centre, "key").where((F.col("c.node") != F.col("node")) & may_link(F.col("c.n"), F.col("c.at"), F.col("n"), F.col("at")))
        return met.select(F.least("c.node", "node").alias("a"), F.greatest("c.node", "node").alias("b")).distinct()

    tried = written(starred(holders), "pairs")
    links = checked(tried, "linked")
    roots = components(links)
    # keys whose holders lie in different components: every pair across components is compared
    placed = holders.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("holders")).where("lo <> hi")
    # a key's holders are cut into parts of about 256, each of which meets all holders in a task of its own
    split = split.select("key", F.ceil(F.col("holders") / 256).cast("int").alias("parts"))
    rest = written(placed.join(split, "key"), "rest")
    one, two = (rest.select("key", "parts", F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "at", "root")]) for x in "ab")
    one = one.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    two = two.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    fits = may_link(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"))
    across = one.join(two, ["key", "part"]).where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & fits)
    across = across.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    more = checked(across, "linked")
    if more.isEmpty():
        return m, roots
    both = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return m, components(both)


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Two documents link when 100 * shared >= percent * union of their shingle sets.  Null and blank texts have empty sets
    and are components of their own.  A text of fewer than `shingle` words is one shingle.  Rows without doc_id link like
    others but give no component its name; where nothing else is in the component, its name is null.  Rows that repeat a
    doc_id are documents of their own.  Other columns are ignored; an empty table gives no rows.
    """
    m, roots = linked(docs, percent, shingle)
    nodes = m.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = placed.join(names, "root").select(F.col("node").alias("_node"), "component")
    out = m.join(named, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """docs with one row of each component, one of the smallest doc_id; rows without doc_id come after all others.

    Rows that share a doc_id, or have none, are told apart by their texts; of rows that agree in both, one stays.
    Documents without words stay, each as its own component.
    """
    m, roots = linked(docs, percent, shingle)
    m = m.where("n_shingles > 0").select("doc_id", "key", "node")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    nodes = m.groupBy("node").agg(F.min(row).alias("least"))
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = placed.groupBy("root").agg(F.min("least").alias("first"))
    stays = placed.join(first, "root").select(F.col("node").alias("_node"), "first")
    stays = m.join(stays, F.col("node") == F.col("_node")).withColumn("stays", row == F.col("first"))
    each = stays.groupBy("doc_id", "key", "stays").agg(F.count("*").alias("n")).where("not stays or n > 1")
    each = written(each, "repeats")
    left = without(docs, each.where("not stays"))
    again = each.where("stays").select("doc_id", "key")
    if again.isEmpty():
        return left
    same = F.col("doc_id").eqNullSafe(F.col("_again_id")) & (row_key() == F.col("_again_key"))
    again_of = again.select(F.col("doc_id").alias("_again_id"), F.col("key").alias("_again_key"))
    one = left.join(again_of, same).dropDuplicates(["_again_id", "_again_key"]).select(*docs.columns)
    return without(left, again).unionByName(one)
