"""Ranks, order statistics and dense numbers without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_numbers(df: DataFrame, order: list[Column], bucket: Column, out: str) -> DataFrame:
    """df with `out`: each row's place, from 0, in the order of (bucket, order).  Rows are numbered within buckets, which
    start where the counts of earlier buckets end; bucket must rise with the order and hold few rows."""
    d = df.withColumn("_bucket", bucket)
    n = d.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = n.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return d.withColumn("_k", inside).join(start, "_bucket").withColumn(out, F.col("_start") + F.col("_k")).drop("_bucket", "_k", "_start")


def order_statistics(df: DataFrame, value: str, ranks: list[int], gather: int = 50_000, bins: int = 4096) -> list[float]:
    """The values at some ranks, from 0, of a column in ascending order; nulls are left out.

    Spans that hold a wanted rank are counted by ever finer bins until they hold at most `gather` rows or one value; those
    rows' values alone reach the driver.  Exact, in as many passes as the logarithm of the rows to the base `bins`.
    """
    d = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    whole = d.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if any(not 0 <= r < whole["n"] for r in ranks):
        raise ValueError("a rank outside the rows")
    # span -> (rows below it, rows in it, wanted ranks)
    spans = {(whole["lo"], whole["hi"]): (0, whole["n"], sorted(set(ranks)))}
    found: dict[int, float] = {}
    while spans:
        for (lo, hi), (_, _, wanted) in list(spans.items()):
            if lo == hi:
                found |= {r: lo for r in wanted}
                del spans[lo, hi]
        small = {s: x for s, x in spans.items() if x[1] <= gather}
        large = {s: x for s, x in spans.items() if x[1] > gather}
        inside = lambda s: (F.col("v") >= F.lit(s[0])) & (F.col("v") <= F.lit(s[1]))
        for s, (below, _, wanted) in small.items():
            n, left = below, list(wanted)
            for r in sorted(d.where(inside(s)).groupBy("v").agg(F.count("*").alias("n")).collect(), key=lambda r: r["v"]):
                n += r["n"]
                while left and left[0] < n:
                    found[left.pop(0)] = r["v"]
        spans = {}
        for s, (below, _, wanted) in large.items():
            lo, hi = s
            width = (hi - lo) / bins
            cell = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)) if width > 0 and lo + width > lo else F.col("v")
            n, left = below, list(wanted)
            for r in sorted(d.where(inside(s)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["c"]):
                here = [k for k in left if k < n + r["n"]]
                if here:
                    spans[r["lo"], r["hi"]] = (n, r["n"], here)
                    left = left[len(here) :]
                n += r["n"]
    return [found[r] for r in ranks]


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Quantiles, linear between neighbours; null of no rows."""
    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return [None] * len(shares)
    at = [p * (n - 1) for p in shares]
    pairs = [(int(x), min(n - 1, int(x) + 1), x - int(x)) for x in at]
    v = dict(zip(ranks := sorted({r for a, b, _ in pairs for r in (a, b)}), order_statistics(df, value, ranks)))
    return [v[a] + f * (v[b] - v[a]) for a, b, f in pairs]
