"""One-permutation MinHash fingerprints of word shingles, densified and packed to four bits a bin, in built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanengine.llm.shared import lower_az, words_of

#: Bins, taken from a hash's top byte; bits kept of a bin's least hash.
BINS, BITS = 256, 4
_VALUE = (1 << 56) - 1
_PROBES = 8


def with_fingerprint(df: DataFrame, text: str, out: str, shingle: int = 5) -> DataFrame:
    """Adds column `out`: 256 hex digits, a digit a bin, or '' for a text without words.

    Each shingle is hashed once; the hash's top byte is its bin and the least hash of a bin stays.  An empty bin copies a
    full one: it probes bins in an order of its own, as optimal densification does (first by independent draws, then,
    where several draws have failed, along a full cycle), so equal sets have equal fingerprints and bins stay unbiased.
    Null counts as an empty text; a text of fewer than five words is one shingle.  Words are lower-cased in A-Z.
    """
    c = lambda name: f"_{out}_{name}"
    w, h, s, d, f = (c(x) for x in ("words", "hashes", "sorted", "dense", "filled"))
    df = df.withColumn(w, F.transform(words_of(lower_az(F.col(text))), lambda x: F.xxhash64(x)))
    last = F.greatest(F.size(w) - F.lit(shingle), F.lit(0))
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(shingle)]))
    df = df.withColumn(h, F.when(F.size(w) > 0, hashed).otherwise(F.array().cast("array<bigint>")))
    # a sentinel ends each bin, so that the first of each bin are BINS entries in the order of bins
    ends = F.expr(f"transform(sequence(-128L, 127L), i -> shiftleft(i, 56) | {_VALUE}L)")
    df = df.withColumn(s, F.array_sort(F.concat(F.col(h), ends)))
    bin_of = lambda x: F.shiftright(x, 56)
    first = F.filter(F.col(s), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(s), i - 1))))
    df = df.withColumn(d, first)
    full = lambda x: x.bitwiseAND(F.lit(_VALUE)) != F.lit(_VALUE)
    none = F.lit(None).cast("bigint")

    def draws(i: Column) -> Column:
        turns = F.array(*[F.lit(t) for t in range(_PROBES)])
        return F.aggregate(turns, none, lambda acc, t: F.coalesce(acc, F.get(F.filter(F.array(F.get(F.col(d), F.pmod(F.xxhash64(i, t), F.lit(BINS)).cast("int"))), full), F.lit(0))))

    def cycle(i: Column) -> Column:
        step = F.pmod(F.xxhash64(i), F.lit(BINS // 2)).cast("int") * 2 + 1
        turns = F.sequence(F.lit(0), F.lit(BINS - 1))
        return F.aggregate(turns, none, lambda acc, t: F.coalesce(acc, F.get(F.filter(F.array(F.get(F.col(d), F.pmod(i + t * step, F.lit(BINS)).cast("int"))), full), F.lit(0))))

    filled = F.transform(F.col(d), lambda x, i: F.when(full(x), x).otherwise(F.coalesce(draws(i), cycle(i))))
    df = df.withColumn(f, F.when(F.size(h) > 0, filled))
    # hashed with the bin's number, so that copies of one value agree by chance in each bin on its own
    low = lambda x, i: F.xxhash64(x, i).bitwiseAND(F.lit((1 << BITS) - 1))
    digit = lambda x, i: F.substr(F.lit("0123456789abcdef"), (low(x, i) + 1).cast("int"), F.lit(1))
    df = df.withColumn(out, F.coalesce(F.array_join(F.transform(F.col(f), digit), ""), F.lit("")))
    return df.drop(w, h, s, d, f)


def likeness(a: Column, b: Column) -> Column:
    """The estimated resemblance of two fingerprints, 0 to 1: equal digits, less those that agree by chance.

    Of unlike bins one in 2^BITS agrees; that share is taken off.  Two empty texts are alike, an empty one and another not.
    """
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & (x != "")), lambda x: x))
    chance = 1.0 / (1 << BITS)
    estimate = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), estimate))


def bucket_by_range(df: DataFrame, column: str, rows_a_bucket: int = 2000, most: int = 16384) -> tuple[Column, Column]:
    """(bucket, crowded): a column that numbers ranges of `column` in descending order, null last, and whether a row's value
    has a range to itself because it comes so often.

    The bounds are quantiles, at most `most` of them whatever the input; a row finds its range by two short searches.  A
    value that is a bound twice or more holds more rows than a range should, as may null.
    """
    n = df.count()
    want = max(1, min(most, n // rows_a_bucket))
    at = [k / want for k in range(1, want)]
    found = df.select(F.percentile_approx(column, at, 20 * want + 100).alias("q")).first()["q"] if at else []
    found = found or []
    bounds = sorted(set(found), reverse=True)
    often = [x for x in bounds if found.count(x) > 1] if len(bounds) < len(found) else []
    wide = 128
    coarse, fine = bounds[::wide], [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    value = F.col(column)
    crowded = F.coalesce(value.isin(often), F.lit(False)) if often else F.lit(False)
    if not bounds:
        bucket = F.lit(0)
    else:
        above = lambda a: F.size(F.filter(a, lambda b: b > value))
        block = F.greatest(F.lit(0), above(F.array(*[F.lit(x) for x in coarse])) - 1)
        table = F.array(*[F.array(*[F.lit(x) for x in part]) for part in fine])
        bucket = block * wide + above(F.get(table, block))
    # a crowded value is the least of its range, so it may follow the rest of it
    bucket = bucket * 2 + crowded.cast("int")
    return F.when(value.isNull(), F.lit(2 * len(bounds) + 2)).otherwise(bucket).cast("long"), crowded | value.isNull()


def with_next(docs: DataFrame, key: str, carried: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda d: d, parts: int = 256) -> DataFrame:
    """prepare(docs) and next_<name> for each carried column: its value in the next row by descending key, after the last
    the first.

    Rows with equal keys are ordered by the hash of the first carried column, which docs must hold.  One shuffle: rows meet
    in ranges of keys, those of a key that fills a range, or of none, in `parts` ranges of that hash.  Only the first row
    of each range is sent to the range before it; it is prepared apart, for those rows alone.
    """
    bucket, crowded = bucket_by_range(docs.select(key), key)
    tie = F.xxhash64(carried[0])
    # hashes from the least to the largest: the top eight bits with the sign turned
    piece = F.when(crowded, F.shiftright(tie, 56) + 128).otherwise(0) % parts
    keyed = docs.withColumn("_tie", tie).withColumn("_bucket", bucket * 256 + piece)
    d = prepare(keyed)
    order = Window.partitionBy("_bucket").orderBy(F.col(key).desc_nulls_last(), "_tie")
    inside = d.select("*", *[F.lead(c).over(order).alias(f"_in_{c}") for c in carried], F.lead(F.lit(1)).over(order).alias("_has"))
    # the largest key and, of its rows, the least hash
    heads = keyed.groupBy("_bucket").agg(F.max(F.struct(F.col(key), F.bitwise_not("_tie").alias("t"))).alias("_h"))
    by = Window.orderBy("_bucket")
    heads = heads.select(
        F.col(f"_h.{key}").alias("_head"), F.bitwise_not(F.col("_h.t")).alias("_head_tie"), F.coalesce(F.lag("_bucket").over(by), F.max("_bucket").over(Window.partitionBy())).alias("_prev")
    )
    # a row for each range: at most twice the bounds, and `parts` for each crowded value and null
    found = keyed.drop("_bucket").join(F.broadcast(heads), F.col(key).eqNullSafe(F.col("_head")) & (F.col("_tie") == F.col("_head_tie")))
    # rows that agree in key and hash carry the same, so any of them will do
    one = found.groupBy("_prev").agg(*[F.first(c).alias(c) for c in docs.columns])
    first = prepare(one).select(F.col("_prev").alias("_bucket"), *[F.col(c).alias(f"_out_{c}") for c in carried])
    joined = inside.join(first, "_bucket", "left")
    chosen = [F.when(F.col("_has").isNotNull(), F.col(f"_in_{c}")).otherwise(F.col(f"_out_{c}")).alias(f"next_{c}") for c in carried]
    return joined.select(*[c for c in d.columns if c not in ("_bucket", "_tie")], *chosen)


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, text and its fingerprint.  Other columns are ignored."""
    return with_fingerprint(plain_texts(docs), "text", "fingerprint")


def plain_texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, whose second half is the start of the next document's text.

    The next document is by descending doc_id, after the last the first; a lone document is its own next.  Null texts are
    empty; rows with equal doc_id each count; rows without one come last; an empty table gives no rows.
    """
    d = with_next(plain_texts(docs), "doc_id", ["text", "fingerprint"], lambda x: with_fingerprint(x, "text", "fingerprint"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    d = d.select(
        "doc_id", n.cast("long").alias("n_chars"), "fingerprint", F.col("next_fingerprint"), edited.alias("edited")
    )
    d = with_fingerprint(d, "edited", "edited_fingerprint")
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
