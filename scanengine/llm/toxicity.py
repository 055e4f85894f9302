"""Toxicity by logistic regression on hashed words, regularised by counterfactuals.

Where a labelled text holds an identity term, the term is swapped for others of its kind, and the fit is penalised by the
squared change of the text's score, so that naming a group moves no score by itself.  Kinds are those of a list of names, and
what the labelled texts themselves show: common words that are as frequent under either label, and that stand in the same
company.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanengine.llm import textvec as tv
from scanengine.llm.labelled import fold, ids_of, label_of, sample, summed

_U = np.uint64
BINS = 1 << 18
#: Terms found in the texts: as many at most; in at least this share of the labelled texts; with a chi-squared below this
#: (one in twenty by chance) their labels say nothing; and with company at least this alike (a cosine) two are of a kind.
TERMS, COMMON, NEUTRAL, ALIKE = 64, 0.005, 3.84, 0.9

#: Names of groups in English, German, French and Spanish, by kind of group; swaps stay within a kind.
GROUPS = (
    ("women", "men", "transgender", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslims", "jews", "christians", "hindus", "atheists", "muslime", "juden", "christen", "musulmans", "juifs", "chrétiens", "musulmanes", "judíos", "cristianos"),
    ("muslim", "jewish", "christian", "hindu", "atheist", "jüdisch", "christlich", "juif", "chrétien", "judío", "cristiano"),
    ("black", "white", "asian", "latino", "african", "european", "schwarze", "weiße", "noirs", "blancs", "negros", "blancos"),
    ("gay", "lesbian", "straight", "bisexual", "schwul", "lesbisch", "homosexuel", "hétérosexuel", "homosexual", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "einwanderer", "flüchtlinge", "immigrés", "réfugiés", "inmigrantes", "refugiados"),
    ("disabled", "blind", "deaf", "behindert", "handicapé", "discapacitado"),
)

_LETTERS = np.zeros(256, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def word_bins(text: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashed words (runs of letters, A-Z lowered), their documents, and how many documents there are."""
    raw, off = tv.text_bytes(text)
    letters = _LETTERS[raw]
    byte, starts, length = tv.word_spans(np.where(letters == 0, np.uint8(32), letters), off, fold=False)
    first = np.searchsorted(starts, off)
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(first))
    return (tv.hash_spans(byte, starts, length) % _U(BINS)).astype(np.int64), doc, len(off) - 1


def bin_of(words: list[str]) -> list[int]:
    return [int(word_bins(pa.array([w]))[0][0]) for w in words]


def presence(bins: np.ndarray, doc: np.ndarray, n: int, columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct bins, or, of those chosen in columns (bin to column, -1 for none), its distinct columns."""
    if columns is not None:
        bins = columns[bins]
        doc, bins = doc[bins >= 0], bins[bins >= 0]
    both = np.unique(doc * BINS + bins)
    return both // BINS, both % BINS


@dataclass
class Model:
    columns: np.ndarray
    weights: np.ndarray
    bias: float
    #: how many swaps of terms in labelled texts the fit was penalised for
    swaps: int = 0

    def score(self, text: pa.Array) -> np.ndarray:
        bins, doc, n = word_bins(text)
        d, c = presence(bins, doc, n, self.columns)
        return 1 / (1 + np.exp(-(self.bias + np.bincount(d, self.weights[c], n))))


def neutral_terms(pos: np.ndarray, neg: np.ndarray, gain: np.ndarray) -> list[int]:
    """The commonest bins whose texts have either label as often as all texts do, at most TERMS."""
    n = pos + neg
    texts = n.max(initial=0)
    ok = np.flatnonzero((gain < NEUTRAL) & (n >= np.maximum(20, COMMON * texts)))
    return [int(b) for b in ok[np.lexsort((ok, -n[ok]))][:TERMS]]


def company(rows: np.ndarray, cols: np.ndarray, terms: np.ndarray, k: int) -> np.ndarray:
    """For each term, a column, how often the texts that hold it hold each of k columns, less how often any text does."""
    base = np.bincount(cols, minlength=k) / max(1, len(np.unique(rows)))
    out = np.zeros((len(terms), k))
    for t, c in enumerate(terms):
        mine = np.isin(rows, rows[cols == c])
        out[t] = np.bincount(cols[mine], minlength=k) / max(1, len(np.unique(rows[mine]))) - base
    return out


def kinds_of(rows: np.ndarray, cols: np.ndarray, terms: list[int], k: int) -> list[tuple[int, int]]:
    """Pairs of terms, as columns, that stand in the same company, both ways; the two are no company of each other, as terms of
    a kind stand for one another."""
    at = np.array(terms, np.int64)
    if not len(at):
        return []
    c = company(rows, cols, at, k)
    own = c[:, at]
    both = c @ c.T - np.diag(own)[:, None] * own.T - own * np.diag(own)[None, :]
    size = (c * c).sum(1)[:, None] - np.diag(own)[:, None] ** 2 - own**2
    alike = both / np.sqrt(np.maximum(size * size.T, 1e-300))
    a, b = np.nonzero((alike >= ALIKE) & ~np.eye(len(at), dtype=bool))
    return list(zip(at[a].tolist(), at[b].tolist()))


def counterfactuals(rows: np.ndarray, cols: np.ndarray, column_of: dict[int, int], found: list[tuple[int, int]] | tuple = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, n): the swaps of columns, and in how many labelled texts each can be made: those that hold the one term and
    lack the other.  Swaps are of names of one kind, and of the pairs `found`."""
    pairs = set(found)
    for kind in GROUPS:
        named = [column_of[b] for b in bin_of(list(kind)) if b in column_of]
        pairs |= {(a, b) for a in named for b in named if a != b}
    holds = {c: set(rows[cols == c].tolist()) for c in {x for p in pairs for x in p}}
    out = np.array([(a, b, len(holds[a] - holds[b])) for a, b in sorted(pairs)], np.int64).reshape(-1, 3)
    out = out[out[:, 2] > 0]
    return out[:, 0], out[:, 1], out[:, 2]


def fit_weights(
    rows: np.ndarray, cols: np.ndarray, y: np.ndarray, k: int, swaps: tuple[np.ndarray, np.ndarray, np.ndarray], l2: float = 0.1, fairness: float = 10.0, steps: int = 400
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the log loss, l2 |w|^2 / 2n, and fairness times the mean squared change under swaps."""
    w, b, n = np.zeros(k), 0.0, max(1, len(y))
    m = np.zeros(k + 1)
    v = np.zeros(k + 1)
    a, c, many = swaps
    for t in range(1, steps + 1):
        g = 1 / (1 + np.exp(-(b + np.bincount(rows, w[cols], len(y))))) - y
        grad = np.append((np.bincount(cols, g[rows], k) + l2 * w) / n, g.sum() / n)
        if len(a):
            change = (w[c] - w[a]) * many * (2 * fairness / many.sum())
            grad[:k] += np.bincount(c, change, k) - np.bincount(a, change, k)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:k]
        b -= step[k]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, held: int = 2, most: int = 40_000, width: int = 2048, fairness: float = 10.0) -> Model:
    """Fits on about `most` labelled rows outside the held-out fold.

    The `width` hashed words that tell the labels apart best (chi-squared over the labelled rows), all names of groups, and
    the neutral terms are the model's inputs.  Without labelled rows every score is 0.5.
    """
    known = labels.where(fold(parts) != held)
    ids, y = sample(known, label, most)
    spark = docs.sparkSession
    chosen = spark.createDataFrame(pa.table({"_id": pa.array(ids), "_y": pa.array(y)})) if len(ids) else None
    if chosen is None or not (y == 1).any():
        return Model(np.full(BINS, -1), np.zeros(1), 0.0 if not len(y) else -5.0)
    # at most about `most` rows, so the broadcast is bounded; and one row for each of them learns, so what is gathered is
    learn = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.max("_y").alias("_y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    learn = learn.select("_y", "text", "doc_id")

    def count(batch: pa.RecordBatch) -> np.ndarray:
        bins, doc, n = word_bins(batch.column(1))
        d, f = presence(bins, doc, n)
        one = batch.column(0).to_numpy(zero_copy_only=False)[d] == 1
        return np.concatenate([np.bincount(f[one], minlength=BINS), np.bincount(f[~one], minlength=BINS)])

    pos, neg = summed(learn, 2 * BINS, count).reshape(2, BINS).astype(float)
    rate = (y == 1).mean()
    expected = (pos + neg) * rate
    gain = np.where(pos + neg >= 3, (pos - expected) ** 2 / np.maximum(expected * (1 - rate), 1e-9), 0)
    names = sorted({b for kind in GROUPS for b in bin_of(list(kind))})
    best = [int(b) for b in np.argsort(-gain, kind="stable")[:width] if gain[b] > 0]
    neutral = neutral_terms(pos, neg, gain)
    inputs = best + [b for b in dict.fromkeys([*names, *neutral]) if b not in set(best)]
    columns = np.full(BINS, -1, np.int64)
    columns[inputs] = np.arange(len(inputs))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in tv.slices(whole, 1)):
            bins, doc, n = word_bins(batch.column(1))
            d, c = presence(bins, doc, n, columns)
            cut = np.searchsorted(d, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).cast(pa.int64()), batch.column(0).cast(pa.int32()), pa.array([c[i:j].astype("<i2").tobytes() for i, j in zip(cut, cut[1:])], pa.binary())],
                ["doc_id", "y", "columns"],
            )

    got = learn.mapInArrow(gather, "doc_id long, y int, columns binary").toPandas().sort_values(["doc_id", "columns"])
    each = [np.frombuffer(x, "<i2") for x in got["columns"]]
    rows = np.repeat(np.arange(len(each)), [len(x) for x in each])
    cols = np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64)
    column_of = {b: k for k, b in enumerate(inputs)}
    swaps = counterfactuals(rows, cols, column_of, kinds_of(rows, cols, [column_of[b] for b in neutral], len(inputs)))
    weights, bias = fit_weights(rows, cols, got.y.to_numpy(float), len(inputs), swaps, fairness=fairness)
    return Model(columns, weights, bias, int(swaps[2].sum()))


def score(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, least: float = 0.3, most: int = 40_000) -> DataFrame:
    """A row a document: doc_id, held_out (its fold is not learned from), score (0 to 1), predicted (score >= least) and swaps
    (how many swaps of terms the fit was penalised for, the same in each row).

    Null and empty texts get the score of a text without known words.  Labels without document or of unknown documents,
    and null labels, teach nothing; of labels that repeat a doc_id the largest counts, and of documents that share a
    labelled one the text with the least hash.  Rows that repeat a doc_id are scored each.  Columns other than doc_id and text are never read.  An empty table gives no rows.
    """
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), parts=parts, held=held, most=most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in tv.slices(whole, 2)):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(model.score(batch.column(2)))], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", (fold(parts) == held).alias("held_out"), "text")
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= least).cast("int")).withColumn("swaps", F.lit(model.swaps).cast("long"))
