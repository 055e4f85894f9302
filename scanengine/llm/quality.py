"""Quality by importance resampling: how much likelier a target model finds a text than a model of all raw text.

Both models are bags of hashed n-grams.  Beside words and word pairs, hashed shapes of words (the kinds of their first and
last characters and their length) and whether a word repeats the one before are n-grams too; they carry over to words
never seen.  A document's weight is its mean log ratio a word, as if each had SHARPNESS words; Gumbel noise and a top-k
over all documents then draw k of them without replacement, in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanengine.llm import textvec as tv
from scanengine.llm.labelled import id_text, ids_of, label_of, sample, summed
from scanengine.llm.shared import row_key, without, written

_U = np.uint64
BINS = 1 << 16
FAMILIES = 4
#: Words that each document counts as having, whatever its length.
SHARPNESS = 100.0

_KIND = np.arange(256, dtype=np.int64) + 16
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 4


def features(text: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each family the hashed n-grams and their documents; and each document's number of words."""
    raw, off = tv.text_bytes(text)
    byte, starts, length = tv.word_spans(raw, off, fold=False)
    w = tv.Words(tv.hash_spans(byte, starts, length), np.searchsorted(starts, off))
    doc = w.doc_of()
    n = w.counts
    if not len(starts):
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * FAMILIES, n
    h, inner = w.hashes, doc[1:] == doc[:-1]
    end = starts + length - 1
    shape = ((_KIND[byte[end]] * 300 + _KIND[byte[np.maximum(end - 1, starts)]]) * 300 + _KIND[byte[starts]]) * 4 + np.minimum(length, 3)
    same = np.zeros(len(h), np.uint64)
    same[1:] = (h[1:] == h[:-1]) & inner
    bins = lambda x: (x % _U(BINS)).astype(np.int64)
    pairs = tv.combine(h[:-1], h[1:])[inner]
    return [(bins(h), doc), (bins(pairs), doc[1:][inner]), (bins(tv.mix(shape.astype(np.uint64))), doc), (bins(tv.mix(same + _U(1))), doc)], n


@dataclass
class Ratio:
    """Log ratios of target and raw by family and bin, and the mean ratio from which a document is kept."""

    logs: np.ndarray
    least: float


def score_batch(text: pa.Array, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's mean log ratio a word (0 without words) and number of words."""
    found, n = features(text)
    total = np.zeros(len(n))
    for k, (f, doc) in enumerate(found):
        total += np.bincount(doc, logs[k][f], len(n))
    return total / np.maximum(n, 1), n


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 100_000) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(log ratios, the labelled sample).  Raw counts cover all documents; target counts those labelled 1 in the sample of
    about `most` labelled rows, but for a quarter of them kept for the threshold.  Without any such all ratios are 0."""
    ids, y = sample(labels, label, most)
    learn = (tv.mix(ids.astype(np.uint64)) % _U(4)) != 0
    good = ids[learn & (y == 1)]

    def count(batch: pa.RecordBatch) -> np.ndarray:
        target = label_of(ids_of(batch.column(0)), good, np.ones(len(good), np.int64), 0) == 1
        out = np.zeros((2, FAMILIES, BINS), np.int64)
        found, _ = features(batch.column(1))
        for k, (f, doc) in enumerate(found):
            out[0, k] = np.bincount(f, minlength=BINS)
            out[1, k] = np.bincount(f[target[doc]], minlength=BINS)
        return out.ravel()

    raw, target = summed(docs.select("doc_id", "text"), 2 * FAMILIES * BINS, count, text=1).reshape(2, FAMILIES, BINS).astype(float)
    if not target.any():
        return np.zeros((FAMILIES, BINS)), (ids, y)
    return log_ratios(raw, target), (ids, y)


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = 5.0) -> np.ndarray:
    """log of the target model over the raw model, both with `prior` n-grams more at the raw rate: what was seen seldom
    says little, so a new word in a small target is no sign of bad text."""
    expected = raw * (target.sum(1, keepdims=True) / np.maximum(raw.sum(1, keepdims=True), 1))
    return np.log((target + prior) / (expected + prior))


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest span of scores that parts the labels best; -inf if one label is missing."""
    if not (y == 1).any() or not (y == 0).any():
        return -np.inf
    order = np.argsort(score, kind="stable")
    s, one = score[order], y[order] == 1
    lost = np.concatenate([[0], np.cumsum(one)]) / one.sum()
    let = 1 - np.concatenate([[0], np.cumsum(~one)]) / (~one).sum()
    edge = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    cost = np.where(edge[1:] > edge[:-1], lost + let, np.inf)
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = best[np.argmax(edge[best + 1] - edge[best])]
    return float((edge[k] + edge[k + 1]) / 2)


def kth_largest(scores: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a column, by counts of ever finer spans: `bins` numbers reach the driver each round."""
    span = scores.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if not span["n"] or k < 1:
        return None
    if k >= span["n"]:
        return span["lo"]
    lo, hi, left = span["lo"], span["hi"], k
    while True:
        width = (hi - lo) / bins
        inside = scores.where((F.col(column) >= lo) & (F.col(column) <= hi))
        if width <= 0 or lo + width <= lo:
            return lo
        cell = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        rows = inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["c"]):
            if left <= r["n"]:
                break
            left -= r["n"]
        lo, hi = r["lo"], r["hi"]
        if left == r["n"]:
            return lo


def drawn(docs: DataFrame, labels: DataFrame, keep: int | None, label: str, most: int, seed: int, sharpness: float | None = SHARPNESS) -> DataFrame:
    """What resample() gives, with each row's row_key() as key."""
    logs, (ids, y) = fit(docs, labels, label, most)
    held = (tv.mix(ids.astype(np.uint64)) % _U(4)) == 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in tv.slices(whole, 1)):
            mean, n = score_batch(batch.column(1), logs)
            y_of = label_of(ids_of(batch.column(0)), ids[held], y[held])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(mean), pa.array(y_of.astype(np.int32)), batch.column(2), batch.column(3)],
                ["doc_id", "n_words", "log_ratio", "label", "noise", "key"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64(id_text(), F.coalesce("text", F.lit("")), F.lit(seed)).alias("noise"), row_key().alias("key"))
    scored = rows.mapInArrow(score, "doc_id long, n_words long, log_ratio double, label int, noise long, key long")
    u = (F.shiftrightunsigned("noise", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    scored = scored.withColumn("sample_key", F.when(F.col("n_words") > 0, F.col("log_ratio") * (F.col("n_words") if sharpness is None else F.lit(float(sharpness))) - F.log(-F.log(u))))
    scored = written(scored.drop("noise"), "scores")
    if keep is None:
        # one row for each label of the sample, whatever repeats its doc_id
        known = scored.where("label >= 0 and n_words > 0").groupBy("doc_id").agg(F.min_by(F.struct("log_ratio", "label"), "key").alias("s")).select("s.*").toPandas()
        least = best_threshold(known.log_ratio.to_numpy(), known.label.to_numpy()) if len(known) else -np.inf
        keep = scored.where((F.col("n_words") > 0) & (F.col("log_ratio") >= F.lit(float(least)))).count()
    edge = kth_largest(scored, "sample_key", keep)
    kept = F.lit(False) if edge is None else F.coalesce(F.col("sample_key") >= F.lit(edge), F.lit(False))
    return scored.select("doc_id", "n_words", "log_ratio", "sample_key", kept.alias("kept"), "key")


def resample(docs: DataFrame, labels: DataFrame, keep: int | None = None, label: str = "quality", most: int = 100_000, seed: int = 7, sharpness: float | None = SHARPNESS) -> DataFrame:
    """A row a document: doc_id, n_words, log_ratio (mean a word), sample_key and kept.

    keep: how many documents to draw; by default as many as have a log ratio on the good side of the threshold that
    parts the labelled sample best (all that have words, if the sample lacks a label); of documents that share a labelled
    doc_id one counts there.  sharpness: how many words each document counts as having, so that its length does not decide;
    None for the whole log ratio of the two models, as of independent draws, by which long documents win or lose.  Null, empty and blank texts have
    no weight and are never drawn.  Rows with equal doc_id and text have equal keys and are drawn alike, even beyond
    keep.  Columns other than doc_id and text are ignored, as are labels of unknown documents.  An empty table gives no
    rows.  The noise follows from doc_id, text and seed, so reruns agree.
    """
    return drawn(docs, labels, keep, label, most, seed, sharpness).drop("key")


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 100_000, seed: int = 7) -> DataFrame:
    """The rows of docs that resample() draws, with their columns.  Each row is judged by its own doc_id and text; only
    rows that agree in both share a fate."""
    return without(docs, drawn(docs, labels, None, label, most, seed).where("not kept").select("doc_id", "key").distinct())
