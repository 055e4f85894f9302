"""A trigram model by deleted interpolation: maximum-likelihood estimates mixed by buckets of context frequency.

Training documents are parted once more: the counts of most give the estimates whose mixture is fitted, by
expectation-maximisation, to the counts of the rest; the final estimates come from all of them.  Counts cover every
training document, and travel by scanengine.llm.exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanengine.llm import textvec as tv
from scanengine.llm.exchange import Exchange, key_bits, stable
from scanengine.llm.labelled import fold

_U = np.uint64
#: Hashes that stand for a text's end and for the places before its start.
END, START = _U(0x5D1CE9B3A7F0E211), _U(0x2B7E151628AED2A7)
#: Context counts are binned by powers of two, 0 to 7 and more, of the two words before and of the one before.
BINS = 8
#: Estimates are binned by half powers of ten for the mixture's fit; a bin keeps their sums.
STEPS = 17


class Tokens(list):
    """A unit's families, and the places of its tokens in them."""


def tokens_of(table: pa.Table, bits: list[int]) -> Tokens:
    """Keys and counts in training of words, pairs and triples.  Columns: text, part (0 held out of the training, 1
    training, 2 the part of the training to which the mixture is fitted: the exchange's lane 1)."""
    w = tv.words(table["text"])
    n = w.counts + 1
    first = np.concatenate([[0], np.cumsum(n)])
    h = np.full(first[-1], END, np.uint64)
    inside = np.ones(len(h), bool)
    inside[first[1:] - 1] = False
    h[inside] = w.hashes
    del w, inside
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    one, two = np.roll(h, 1), np.roll(h, 2)
    begin = first[:-1]
    one[begin] = two[begin] = START
    two[(begin + 1)[n > 1]] = START
    pair = tv.combine(one, h)
    triple = tv.combine(two, pair)
    del one, two
    part = table["part"].to_numpy()[doc]
    taught = part > 0
    out = Tokens()
    out.place = []
    keyed = [h, pair, triple]
    del h, pair, triple
    for k in range(3):
        keys, back = np.unique(keyed[k] >> _U(64 - bits[k]), return_inverse=True)
        keyed[k] = None
        out.append((keys, [np.bincount(back[taught], minlength=len(keys)).astype(np.uint64)]))
        out.place.append(back.astype(np.int32))
    out.doc, out.begin, out.n = doc, begin, n
    return out


@dataclass
class Estimates:
    """Of each token the three maximum-likelihood estimates, longest context first, and its bucket."""

    p: np.ndarray
    bucket: np.ndarray


def bucket_of(c3: np.ndarray, c2: np.ndarray) -> np.ndarray:
    log = lambda c: np.minimum(np.frexp(c)[1], BINS - 1)  # noqa: E731  0, 1, 2-3, 4-7, ...
    return log(c3) * BINS + log(c2)


def estimates(t: Tokens, counts: list[np.ndarray], n_tokens: int, n_texts: int) -> Estimates:
    """counts: of the unit's words, pairs and triples.  A context's count is that of its words as an n-gram; the places
    before the start come once a text."""
    c1, c2, c3 = (c.astype(np.float64)[place] for c, place in zip(counts, t.place))
    before1, before2 = np.roll(c1, 1), np.roll(c2, 1)
    before1[t.begin] = before2[t.begin] = n_texts
    ratio = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    p = np.stack([ratio(c3, before2), ratio(c2, before1), c1 / max(1, n_tokens)])
    return Estimates(p, bucket_of(before2, before1))


def usable(bucket: int) -> np.ndarray:
    """Which of the four estimates (triple, pair, word, any) a bucket has: none without a seen context."""
    return np.array([bucket // BINS > 0, bucket % BINS > 0, True, True])


def fit_mixture(cells: dict[int, tuple[float, np.ndarray]], uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights of each bucket's four estimates by expectation-maximisation.

    cells: by bucket and binned estimates, the number of held-out tokens and the sums of their three estimates.  Each
    usable weight gets one count in advance, so none vanishes; buckets without held-out tokens mix evenly.
    """
    weights = np.zeros((BINS * BINS, 4))
    by: dict[int, list] = {}
    for cell, (n, sums) in cells.items():
        by.setdefault(cell // STEPS**3, []).append((n, sums))
    for b in range(BINS * BINS):
        ok = usable(b).astype(float)
        w = ok / ok.sum()
        if b in by:
            n = np.array([x[0] for x in by[b]])
            p = np.column_stack([np.array([x[1] for x in by[b]]) / n[:, None], np.full(len(n), uniform)]) * ok
            for _ in range(rounds):
                part = p * w
                share = (part / np.maximum(part.sum(1, keepdims=True), 1e-300) * n[:, None]).sum(0) + ok
                w = share / share.sum()
        weights[b] = w
    return weights


def score(docs: DataFrame, parts: int = 10, held: int = 0, tuned: int = 1) -> DataFrame:
    """A row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Documents whose crc32 of doc_id as text, mod parts, is `held` are not learned from; those where it is `tuned` fit the
    mixture: their tokens are counted by bucket and by half powers of ten of the three estimates, so that
    expectation-maximisation runs over a bounded table, whose cells stand for the mean estimates of their tokens.  Tokens
    are words in lower case (A-Z) and an end.  Null texts are empty: one token, the end.  An unknown word has the
    probability of any unknown word, a share of one over the known words and one.  Rows that repeat a doc_id count each.  Without training documents all probabilities are uniform.  An empty table gives no rows; columns other
    than doc_id and text are ignored.
    """
    f = fold(parts)
    part = F.when(f == held, 0).when(f == tuned, 2).otherwise(1).cast("int")
    d = stable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), part.alias("part"), (part == 2).cast("int").alias("lane")), "documents")
    width = key_bits(d)
    bits = [64, width, width]
    exchange = Exchange(d, lambda table: tokens_of(table, bits), bits, lane="lane")
    n_all, v_all = exchange.totals(0, 0)
    n_tuned, _ = exchange.totals(0, 1)
    texts = {r["part"]: r["n"] for r in d.groupBy("part").agg(F.count("*").alias("n")).collect()}
    texts_all, texts_kept = texts.get(1, 0) + texts.get(2, 0), texts.get(1, 0)
    uniform = 1.0 / (v_all + 1)

    def held_out_cells(table: pa.Table, t: Tokens, totals: list) -> pa.RecordBatch | None:
        e = estimates(t, [c[0] - c[1] for c in totals], n_all - n_tuned, texts_kept)
        p, bucket = e.p, e.bucket
        with np.errstate(divide="ignore"):
            q = np.where(p > 0, np.minimum(1 + np.floor(-2 * np.log10(np.maximum(p, 1e-300))), STEPS - 1), 0).astype(np.int64)
        cell = ((bucket * STEPS + q[0]) * STEPS + q[1]) * STEPS + q[2]
        cells, back = np.unique(cell, return_inverse=True)
        sums = [np.bincount(back, x, len(cells)) for x in p]
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.bincount(back).astype(np.int64)), *map(pa.array, sums)], ["cell", "n", "a", "b", "c"])

    found = exchange.each(held_out_cells, "cell long, n long, a double, b double, c double", only=1)
    # a bounded histogram: BINS^2 * STEPS^3 cells at the most, whatever the input
    rows = found.groupBy("cell").agg(*[F.sum(x).alias(x) for x in ("n", "a", "b", "c")]).collect()
    weights = fit_mixture({r["cell"]: (r["n"], np.array([r["a"], r["b"], r["c"]])) for r in rows}, uniform)

    def scores(table: pa.Table, t: Tokens, totals: list) -> pa.RecordBatch:
        e = estimates(t, [c[0] for c in totals], n_all, texts_all)
        w = weights[e.bucket]
        p = (w[:, 0] * e.p[0] + w[:, 1] * e.p[1]) + (w[:, 2] * e.p[2] + w[:, 3] * uniform)
        c = totals[0][0].astype(np.float64)[t.place[0]]
        base = np.log10((c + 0.1) / (n_all + 0.1 * (v_all + 1)))
        size = len(t.n)
        add = lambda x: np.bincount(t.doc, x, size)
        return pa.RecordBatch.from_arrays(
            [
                table["doc_id"].combine_chunks(),
                pa.array(table["part"].to_numpy() == 0),
                pa.array(t.n.astype(np.int64)),
                pa.array(add((c > 0).astype(float)).astype(np.int64)),
                pa.array(np.full(size, n_all, np.int64)),
                pa.array(add(base)),
                pa.array(add(np.log10(p))),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return exchange.each(scores, schema)
