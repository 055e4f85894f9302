"""Benchmark decontamination: item-sized windows by SimHash, multi-index Hamming blocks, and exact verification.

Of all windows as long as an item, those get a fingerprint that can be alike enough.  Of N shingles each, `percent` percent
alike, an item and a window share 2 N percent / (100 + percent) at least; so many places of the window hold shingles of items
of its size.  And a window whose first place holds none is no more alike than the one a word further on, so of each item's
best windows the last begins at such a place, or ends where the document ends.  Both follow from the places where a
document holds shingles of items of one size, without regard to which items those are: that is left to the fingerprints.

Each window and item gets a 64-bit SimHash of its words.  The hashes are cut into four blocks of 16 bits; two hashes at most
15 bits apart agree within 3 bits in some block, so items filed under every value within 3 bits of each block meet all
windows within the radius.  What meets is verified by the exact weighted similarity of its shingles.  Built-in functions
alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanengine.llm.shared import lower_az, row_key, words_of, written

RADIUS, BLOCKS, WIDTH, NEAR = 15, 4, 16, 3
#: Item shingles up to this many (about 64 bytes each) are sent to every executor; more are joined by shuffling.
BROADCAST_ROWS = 1_000_000


def simhash(hashes: str) -> Column:
    """The SimHash of an array of word hashes; repeated words weigh as often as they come."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(aggregate({hashes}, 0, "
        "(s, h) -> s + cast((shiftright(h, b) & 1) * 2 - 1 as int)) > 0, shiftleft(1L, b), 0L))"
    )


def shingle_hashes(words: Column, k: Column | int) -> Column:
    """Hashes of all runs of k words, with repeats.  words has at least k."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(F.slice(words, i, k)))


def items_of(bench: DataFrame, shingle: int) -> DataFrame:
    """item_id, words, n, k (words a shingle: fewer where the item is shorter), shingles, fp.  Empty items are left out."""
    b = bench.select("item_id", words_of(lower_az(F.col("text"))).alias("words")).where(F.size("words") > 0)
    b = b.withColumn("n", F.size("words")).withColumn("k", F.least(F.col("n"), F.lit(shingle)))
    b = b.withColumn("shingles", shingle_hashes(F.col("words"), F.col("k"))).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    return b.withColumn("fp", simhash("h")).drop("h")


def windows(docs: DataFrame, items: DataFrame, percent: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, start, n, k, words): the item-sized windows that can be `percent` percent alike to an item of their size.

    Places of shared shingles are gathered by document, which the tasks that find them hold whole; words are cut out of
    the documents that have such windows by a second pass over them.
    """
    names = F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b")
    words = words_of(lower_az(F.col("text"))).alias("words")
    laid = None
    for (k,) in sorted(items.select("k").distinct().collect()):
        # a table, so that a join that shuffles can split the holders of a very common shingle
        keys = written(items.where(F.col("k") == k).select("n", F.explode("shingles").alias("s")).distinct(), "item-shingles")
        # words stay in this stage as long as it stays in generated code, so nothing with a lambda is in it
        d = docs.select(*names, words)
        at = d.select("a", "b", "words", F.size("words").alias("m"), F.explode(F.when(F.size("words") >= k, F.sequence(F.lit(0), F.size("words") - k))).alias("i"))
        at = at.select("a", "b", "m", "i", F.xxhash64(F.array(*[F.get("words", F.col("i") + t) for t in range(k)])).alias("s"))
        met = at.join(F.broadcast(keys) if keys.count() <= broadcast_rows else keys, "s")
        held = met.groupBy("a", "b", "m", "n").agg(F.array_sort(F.collect_set("i")).alias("at"))
        theirs, ours = F.col("n") - k + 1, F.least("n", "m") - k + 1
        need = F.ceil(F.lit(percent) * (theirs + ours) / (100 + percent)).cast("int")
        held = held.select("*", need.alias("need"), ours.alias("ours"), F.greatest(F.lit(0), F.col("m") - F.col("n")).alias("last"))
        begun = F.filter("at", lambda x, j: (x <= F.col("last")) & (F.get("at", j + F.col("need") - 1) < x + F.col("ours")))
        ended = F.when(F.get("at", F.size("at") - F.col("need")) >= F.col("last"), F.array("last")).otherwise(F.array().cast("array<int>"))
        some = held.select("a", "b", "n", F.lit(k).alias("k"), F.explode(F.array_union(begun, ended)).alias("start"))
        laid = some if laid is None else laid.unionByName(some)
    if laid is None:
        return None
    laid = written(laid, "places")
    return docs.select("doc_id", *names, words).join(laid, ["a", "b"]).select("doc_id", "start", "n", "k", F.slice("words", F.col("start") + 1, F.col("n")).alias("words")).distinct()


def within_radius(found: DataFrame, items: DataFrame) -> DataFrame:
    """Windows (fp, n, k and others) with every item of their size whose fingerprint is at most RADIUS bits away."""
    part = lambda fp: F.array(*[F.shiftrightunsigned(fp, WIDTH * j).bitwiseAND(F.lit((1 << WIDTH) - 1)) for j in range(BLOCKS)])
    masks = F.expr(f"filter(sequence(0L, {(1 << WIDTH) - 1}L), x -> bit_count(x) <= {NEAR})")
    filed = items.select("item_id", "n", "k", F.col("fp").alias("item_fp"), F.posexplode(part(F.col("fp"))).alias("block", "v"))
    filed = filed.select("item_id", "n", "k", "item_fp", "block", F.explode(masks).alias("mask"), "v")
    filed = filed.withColumn("value", F.col("v").bitwiseXOR(F.col("mask"))).drop("v", "mask")
    looked = found.select("*", F.posexplode(part(F.col("fp"))).alias("block", "value"))
    # the filed values are many times the items they come from; never broadcast on the items' size
    met = looked.join(filed.hint("merge"), ["n", "k", "block", "value"]).drop("block", "value")
    met = met.withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
    return met.where(F.col("hamming") <= RADIUS).dropDuplicates(["doc_id", "start", "n", "fp", "item_id"])


def leaks(docs: DataFrame, bench: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """A row for each document and benchmark item it holds: doc_id, item_id, start (in words), n_words, hamming, similarity.

    The similarity weighs each shingle by how often it comes: the sum of the smaller counts over the sum of the larger.
    It is of the best window, of equals the last.  Words are compared in lower case (A-Z).  Null and blank texts and
    items are never found; an item of fewer than `shingle` words is one shingle and found where it stands whole.  A
    document shorter than an item is one window.  Rows that repeat doc_id count as one document, items that repeat
    item_id as one item.  Other columns are ignored; empty tables give no rows.
    """
    items = written(items_of(bench, shingle), "items")
    found = windows(docs, items, percent)
    if found is None:
        schema = "doc_id long, item_id long, start int, n_words int, hamming int, similarity double"
        return docs.sparkSession.createDataFrame([], schema)
    # a table, so that later conditions stay out of the pass over all words
    found = written(found, "windows").withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    found = found.withColumn("fp", simhash("h")).drop("h")
    met = within_radius(found, items).join(items.select("item_id", F.col("fp").alias("item_fp"), F.col("shingles").alias("theirs")), ["item_id", "item_fp"])
    met = met.withColumn("pair", F.xxhash64("doc_id", "start", "words", "item_id", "item_fp"))
    met = written(met.select("pair", "doc_id", "item_id", "start", "n", "hamming", "theirs", shingle_hashes(F.col("words"), F.col("k")).alias("ours")).dropDuplicates(["pair"]), "candidates")
    # how often each shingle comes on either side, counted apart: linear in an item's length
    count = lambda c: met.select("pair", F.explode(c).alias("x")).groupBy("pair", "x").agg(F.count("*").alias(c))
    shared = count("ours").join(count("theirs"), ["pair", "x"]).groupBy("pair").agg(F.sum(F.least("ours", "theirs")).alias("shared"))
    met = met.select("pair", "doc_id", "item_id", "start", "n", "hamming", (F.size("ours") + F.size("theirs")).alias("sizes")).join(shared, "pair")
    met = met.withColumn("all", F.col("sizes") - F.col("shared"))
    met = met.where(F.col("shared") * 100 >= F.lit(percent) * F.col("all")).withColumn("similarity", F.col("shared") / F.col("all"))
    best = met.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", F.col("start").alias("s"), "n", (-F.col("hamming")).alias("d"))).alias("b"))
    return best.select(
        "doc_id", "item_id", F.col("b.s").alias("start"), F.col("b.n").alias("n_words"), (-F.col("b.d")).alias("hamming"), F.col("b.similarity").alias("similarity")
    )


def cleaned(docs: DataFrame, bench: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns.  Each row is judged by its own text."""
    keyed = docs.select(row_key().alias("doc_id"), "text")
    found = leaks(keyed, bench, percent, shingle).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, row_key() == F.col("_leak"), "left_anti")
