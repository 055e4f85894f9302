"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The schedule says how many turns each source has and when; a source's target words, taken from its shuffled documents in
their order and again from the first, are dealt over its turns in blocks of equal words.  So blocks of all sources have
nearly the same size, as the points are spread evenly, and each source meets its target to the word, however small it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanengine.llm.shared import WORD, running_start, written

#: Slots follow (i * STEP mod 2^31) / 2^31: STEP is the odd number next to 2^31 divided by the golden ratio.
STEP, PERIOD = 1327217885, 1 << 31
#: Words of a slot: the mix has as many slots as its words fill.
SLOT_WORDS = 4096
#: Cells into which [0, 1) is cut so that slots meet sources in an equality join.
CELLS = 1 << 14


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), volume: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: source, rank, source_size, target, words (the target, whole) and the span [lo, hi) of its share of
    all words.

    docs: source, size.  Sources in code point order, null last, weigh `weights`, repeating, and share volume times all
    sizes.  No target is above `most` times its source's size; the excess is shared again by weight.  In order of
    cap / weight the full sources come first, and the level that fills the others follows from running sums.
    """
    s = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = s.withColumn("rank", rank).withColumn("weight", weight)
    full = F.col("source_size") * F.lit(float(most))
    s = s.withColumn("cap", full).withColumn("fills_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fills_at", "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(float(volume)) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(rest)
    s = s.withColumn("level", level)
    # the first source that the level of those from it on doesn't fill, gives the level of all that follow
    holds = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "rank", "level"))).over(Window.partitionBy())
    s = s.withColumn("holds", holds)
    target = F.when(F.col("holds").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("holds")["level"] * F.col("weight")))
    s = s.withColumn("target", target)
    s = s.withColumn("words", F.round("target").cast("long"))
    hi = F.sum("words").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    total = F.greatest(F.lit(1), F.sum("words").over(Window.partitionBy()))
    return s.select("source", "rank", "source_size", "target", "words", ((hi - F.col("words")) / total).alias("lo"), (hi / total).alias("hi"))


def schedule(targets: DataFrame, n: int, step: int = STEP) -> DataFrame:
    """(s, slot, turn): the source, by rank, that each of n slots draws from, and which of its turns that is.

    Slot i maps the i-th golden-ratio point through the cumulative targets, so after any number of slots each source has
    had its share but for a few.  Turns are ranked by chunks of slots, so no source's slots meet in one task.  A source whose
    span is too narrow for any point has one turn all the same, in the slot that lies in the mix where its span does.
    """
    spark = targets.sparkSession
    slots = spark.range(0, n, 1, max(1, min(4096, n // 50_000))).withColumnRenamed("id", "slot")
    u = ((F.col("slot") % PERIOD) * step % PERIOD) / F.lit(float(PERIOD))
    slots = slots.withColumn("u", u).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    some = targets.where("words > 0").select(F.col("rank").alias("s"), "lo", "hi")
    ends = F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.floor(F.col("hi") * CELLS).cast("int"))
    cells = some.select("*", F.explode(ends).alias("cell"))
    drawn = slots.join(cells, "cell").where("u >= lo and u < hi").select("slot", "s")
    middle = F.least(F.lit(n - 1), F.floor((F.col("lo") + F.col("hi")) / 2 * n)).cast("long")
    drawn = written(drawn, "slots")
    lone = some.join(drawn.select("s").distinct(), "s", "left_anti").select(middle.alias("slot"), "s")
    drawn = drawn.unionByName(lone).select("slot", "s", F.floor(F.col("slot") / 4096).alias("chunk"), F.lit(1).alias("one"))
    return running_start(drawn, "s", "chunk", [F.col("slot")], "one", "turn").select("s", "slot", "turn")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    volume: float = 1.5,
    most: float = 2.0,
    slot_words: int = SLOT_WORDS,
    rows_a_bucket: int = 2000,
    step: int = STEP,
) -> DataFrame:
    """A row a document: doc_id, source, size, source_size, target (the source's), taken (its words in the mix, repeats
    counted) and first_slot (the first slot of the mix that holds words of it, null for none).

    docs: doc_id, source, text; any other columns are ignored, so clashing names do no harm.  The mix has a slot for every
    slot_words words.  A source's documents, shuffled by the MD5 of doc_id, are read in order, and again from the first, for
    as many words as its target has; these are cut into equal blocks (but for one word), one for each turn that the schedule
    gives the source.  So every source meets its rounded target, and no document is read more than ceil(most) times.

    Null texts have size 0 and nothing is taken of them; a null source is a source of its own, last; rows with equal
    doc_id are placed by size and text and count each on its own, rows without one by the MD5 of their text; an empty
    table gives no rows.  Reruns agree.  Rows of all sources' sums, one a source, meet in windows of one task.
    """
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    tie = F.xxhash64("text")
    sized = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), place.alias("_o"), tie.alias("_tie")), "sizes")
    targets = written(source_targets(sized, weights, volume, most), "targets")
    sums = targets.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    turns = written(schedule(targets, max(1, -(-sums["words"] // slot_words)), step), "turns")
    # turn t of T has words // T words, and one more if t < words % T
    had = turns.groupBy("s").agg(F.count("*").alias("turns"))
    per = targets.withColumnRenamed("rank", "s").join(had, "s", "left")
    per = per.withColumn("each", F.when(F.col("turns") > 0, F.expr("words div turns")).otherwise(0)).withColumn("odd", F.when(F.col("turns") > 0, F.col("words") % F.col("turns")).otherwise(0))

    digits = max(1, min(8, len(f"{max(1, sized.count() // rows_a_bucket):x}")))
    ordered = sized.join(per.withColumnRenamed("source", "_src"), F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    ordered = ordered.withColumn("_bucket", F.substring("_o", 1, digits))
    placed = running_start(ordered, "s", "_bucket", [F.col("_o"), F.col("doc_id"), F.col("size"), F.col("_tie")], "size", "at")
    # a document's words in each pass over its source, as far as the target reaches
    passes = F.expr("explode(sequence(0L, (words - 1) div source_size))").alias("pass")
    read = placed.where("size > 0 and words > 0").select("s", "at", "size", "words", "source_size", "each", "odd", passes)
    begin = F.col("pass") * F.col("source_size") + F.col("at")
    read = read.withColumn("begin", begin).withColumn("end", F.least(begin + F.col("size"), F.col("words"))).where("begin < end")
    turn_of = lambda x: F.expr(f"if({x} < odd * (each + 1), ({x}) div (each + 1), odd + (({x}) - odd * (each + 1)) div greatest(each, 1))")
    pieces = read.select("s", "at", "begin", "end", "each", "odd", F.explode(F.sequence(turn_of("begin"), turn_of("end - 1"))).alias("turn"))
    starts = lambda t: t * F.col("each") + F.least(t, F.col("odd"))
    inside = F.least(F.col("end"), starts(F.col("turn") + 1)) - F.greatest(F.col("begin"), starts(F.col("turn")))
    # words lie at places of their own in a source, so (s, at) names a document that has any
    taken = pieces.withColumn("inside", inside).join(turns, ["s", "turn"]).groupBy("s", "at").agg(F.sum("inside").alias("taken"), F.min("slot").alias("first_slot"))
    some = placed.where("size > 0").join(taken, ["s", "at"], "left")
    every = some.unionByName(placed.where("size = 0"), allowMissingColumns=True)
    return every.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
