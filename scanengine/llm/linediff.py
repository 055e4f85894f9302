"""Line dedup by pairwise alignment: overlapping documents meet through hashes of shared runs of lines, are aligned by
patience diff, and the later one loses the aligned common blocks."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanengine.llm import textvec as tv
from scanengine.llm.shared import written

LINES = "pos long, rid long, h array<long>, w array<int>, i array<int>, g array<long>"
REMOVED = "pos long, rid long, removed array<int>"


def anchors(a: Sequence[int], b: Sequence[int], free: Sequence[bool]) -> list[tuple[int, int]]:
    """Patience anchors of the lines of a and the free lines of b: common lines that are unique on both sides, or where
    there are none the least repeated ones at their first places; of those the longest chain that rises on both sides."""
    in_a, in_b = Counter(a), Counter(x for x, f in zip(b, free) if f)
    common = {x: max(in_a[x], n) for x, n in in_b.items() if x in in_a}
    if not common:
        return []
    least = min(common.values())
    at = {}
    for i, x in enumerate(a):
        if common.get(x) == least:
            at.setdefault(x, i)
    pairs, seen = [], set()
    for j, x in enumerate(b):
        if free[j] and x in at and x not in seen:
            seen.add(x)
            pairs.append((at[x], j))
    # longest chain with rising i, as pairs come with rising j
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(pairs):
        p = bisect_left(tails, i)
        back.append(ends[p - 1] if p else -1)
        tails[p:], ends[p:] = ([i], [k]) if p == len(tails) else ([i, *tails[p + 1 :]], [k, *ends[p + 1 :]])
    chain, k = [], ends[-1]
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def common_blocks(a: Sequence[int], b: Sequence[int], words: Sequence[int], least: int) -> list[int]:
    """The places in b of all blocks, of `least` words or more, that also stand in a.

    Anchors grow in both directions while lines agree.  Lines of found blocks leave b and the rest is aligned again, so
    blocks that changed places or come twice are found as well.  Where a repeats lines, an anchor may stand at another
    copy than the block's; there the short runs of b that are left are looked up in a as well.
    """
    free, gone = [True] * len(b), []
    while True:
        taken = 0
        for i, j in anchors(a, b, free):
            if not free[j]:
                continue
            lo = 0
            while i - lo > 0 and j - lo > 0 and free[j - lo - 1] and a[i - lo - 1] == b[j - lo - 1]:
                lo += 1
            hi = 1
            while i + hi < len(a) and j + hi < len(b) and free[j + hi] and a[i + hi] == b[j + hi]:
                hi += 1
            block = range(j - lo, j + hi)
            for k in block:
                free[k] = False
            taken += 1
            if sum(words[k] for k in block) >= least:
                gone += block
        if not taken:
            break
    if len(set(a)) == len(a):
        return sorted(gone)
    found, lo, hi = set(gone), *runs(np.array(words, np.int64), np.array([0, len(b)]), least)
    left = [(i, j) for i, j in zip(lo.tolist(), hi.tolist()) if not found.issuperset(range(i, j))]
    for n in {j - i for i, j in left}:
        held = {tuple(a[k : k + n]) for k in range(len(a) - n + 1)}
        for i, j in left:
            if j - i == n and tuple(b[i:j]) in held:
                found.update(range(i, j))
    return sorted(found)


def runs(words: np.ndarray, edge: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first line, line after the last) of the shortest run of `least` words or more from each line on, and up to each.

    words: of each line of all texts; edge: each text's first line, with one more at the end.  Every line of a block of
    `least` words or more is in such a run that lies in the block.
    """
    n = np.arange(len(words))
    start, end = np.repeat(edge[:-1], np.diff(edge)), np.repeat(edge[1:], np.diff(edge))
    before = np.concatenate([[0], np.cumsum(words)])
    to = np.searchsorted(before, before[:-1] + least)
    since = np.searchsorted(before, before[1:] - least, side="right") - 1
    on, up = to <= end, since >= start
    size = len(words) + 1
    both = np.unique(np.append(n[on], since[up]) * size + np.append(to[on], n[up] + 1))
    return both // size, both % size


def run_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each run of line hashes."""
    acc = tv.mix(h[lo].view(np.uint64))
    which, at = np.arange(len(lo)), lo + 1
    while len(which):
        more = at < hi[which]
        which, at = which[more], at[more]
        acc[which] = tv.combine(acc[which], h[at].view(np.uint64))
        at = at + 1
    return acc.view(np.int64)


def lines_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines of all texts that hold words: text, place in the text from 0, hash of the words (A-Z lowered), words."""
    raw, off = tv.text_bytes(text)
    byte, starts, length = tv.word_spans(raw, off)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, none
    breaks = np.flatnonzero(raw == 10)
    doc = np.searchsorted(off, starts, side="right") - 1
    before = np.searchsorted(breaks, starts)
    at = before - np.searchsorted(breaks, off[doc])
    new = np.ones(len(starts), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    place = np.arange(len(starts)) - np.repeat(first, n)
    each = tv.combine(tv.hash_spans(byte, starts, length), place.astype(np.uint64))
    return doc[first], at[first], np.add.reduceat(each, first).view(np.int64), n


def line_table(docs: DataFrame, least_words: int) -> DataFrame:
    """(pos, rid, h, w, i, g): each document's lines with words as arrays of hashes, word counts and places, and hashes of
    its short runs of `least_words` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in tv.slices(whole, 2)):
            doc, at, h, n = lines_of(batch.column(2))
            edge = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            lo, hi = runs(n, edge, least_words)
            offsets, cuts = (pa.array(x.astype(np.int32)) for x in (edge, np.searchsorted(lo, edge)))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h, n.astype(np.int32), at.astype(np.int32))]
            lists.append(pa.ListArray.from_arrays(cuts, pa.array(run_hashes(h, lo, hi))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["pos", "rid", "h", "w", "i", "g"])

    at = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(at.alias("pos"), F.xxhash64("doc_id", "text").alias("rid"), "text")
    return rows.mapInArrow(run, LINES).where(F.size("h") > 0)


def removed_lines(docs: DataFrame, least_words: int = 40) -> DataFrame:
    """(pos, rid, removed): the lines, from 0, that each document loses.  docs: doc_id, text.

    pos and rid place a document: by doc_id (rows without one last), then by a hash of its text.  Every short run of
    lines of `least_words` words or more is held first by one document; every later holder meets that first holder alone,
    so a run in any number of documents makes as many pairs as it has holders.  Each line of a block that any earlier
    document holds is in such a run within the block, and so in one that the document it meets holds whole: what is
    removed are the lines of all blocks that any earlier document holds, whichever documents held their lines first.  A
    line's first holder never loses it to this pair or any other, so each distinct line stays somewhere.
    """
    d = written(line_table(docs, least_words).dropDuplicates(["pos", "rid"]), "lines")
    own = d.select(F.struct("pos", "rid").alias("doc"), F.explode(F.array_distinct("g")).alias("g"))
    first = own.groupBy("g").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("g", "first")
    # a table of its own, so that the join shuffles both sides and a very common run's holders can be split
    first = written(first, "first-holders")
    pairs = own.join(first, "g").where(F.col("doc") != F.col("first")).select("first", "doc").distinct()
    pairs = written(pairs.select(F.col("first.pos").alias("p0"), F.col("first.rid").alias("r0"), F.col("doc.pos").alias("pos"), F.col("doc.rid").alias("rid")), "overlaps")
    earlier = d.select(F.col("pos").alias("p0"), F.col("rid").alias("r0"), F.col("h").alias("a"))
    both = pairs.join(earlier, ["p0", "r0"]).join(d, ["pos", "rid"]).select("pos", "rid", "a", "h", "w", "i")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [
                [int(i[k]) for k in common_blocks(a.tolist(), h.tolist(), w.tolist(), least_words)] for a, h, w, i in zip(pdf.a, pdf.h, pdf.w, pdf.i)
            ]
            out = pd.DataFrame({"pos": pdf.pos, "rid": pdf.rid, "removed": found})
            yield out[out.removed.map(len) > 0]

    gone = both.mapInPandas(align, REMOVED)
    return gone.groupBy("pos", "rid").agg(F.array_distinct(F.flatten(F.collect_list("removed"))).alias("removed"))


def dedup_lines(docs: DataFrame, least_words: int = 40) -> DataFrame:
    """docs with text without the blocks that an earlier document holds, and columns removed_lines and removed_words.

    Blocks are runs of whole lines that agree but for case and white space and have `least_words` words or more in all;
    shorter repeats, as licence lines or greetings, stay.  Null texts stay null; a text that loses nothing stays as it
    is; one that loses all lines is empty.  Rows that repeat doc_id and text are one document and share its fate; rows
    that repeat doc_id alone are ordered by a hash; rows without doc_id come last.  An empty table gives no rows.
    Columns named like the added ones are replaced.
    """
    own = [c for c in docs.columns if c not in ("removed_lines", "removed_words")]
    gone = removed_lines(docs.select("doc_id", "text"), least_words)
    gone = gone.select(F.col("pos").alias("_pos"), F.col("rid").alias("_rid"), F.col("removed").alias("_removed"))
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    d = docs.select(*own).withColumn("_at", at).withColumn("_key", F.xxhash64("doc_id", "text"))
    d = d.join(gone, (F.col("_at") == F.col("_pos")) & (F.col("_key") == F.col("_rid")), "left")
    lines = F.split("text", "\n")
    stays = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("_removed"), i)), "\n")
    lost = F.array_join(F.filter(lines, lambda x, i: F.array_contains(F.col("_removed"), i)), "\n")
    n_words = F.coalesce(F.regexp_count(lost, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(stays)
    return d.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in own],
        F.when(F.col("_removed").isNull(), 0).otherwise(F.size("_removed")).cast("long").alias("removed_lines"),
        F.when(F.col("_removed").isNull(), 0).otherwise(n_words).cast("long").alias("removed_words"),
    )
