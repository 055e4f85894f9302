"""A bounded sample of labelled rows, and sums of feature counts over all documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanengine.llm import textvec as tv


def id_text(doc_id: str = "doc_id") -> Column:
    """doc_id as text; null is empty."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def fold(parts: int, doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, mod parts."""
    return (F.crc32(F.encode(id_text(doc_id), "UTF-8")) % parts).cast("int")


def sample(labels: DataFrame, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids ascending, labels) of about `most` labelled rows at the most, chosen by a hash of doc_id.

    Rows without id or label are left out; of rows that repeat an id the largest label counts.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    n = one.count()
    if n > most:
        one = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    rows = one.select(F.col("doc_id").cast("long"), F.col("y").cast("int")).toPandas().sort_values("doc_id")
    return rows.doc_id.to_numpy(np.int64), rows.y.to_numpy(np.int64)


def label_of(ids: np.ndarray, known: np.ndarray, y: np.ndarray, missing: int = -1) -> np.ndarray:
    """The label of each id, `missing` for those without."""
    if not len(known):
        return np.full(len(ids), missing, np.int64)
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return np.where(known[at] == ids, y[at], missing)


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids as int64; null becomes the smallest number, which no label has."""
    return column.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else ids_of(column.combine_chunks())


def summed(docs: DataFrame, width: int, count: Callable[[pa.RecordBatch], np.ndarray], pieces: int = 64, salts: int = 64, text: int = 1) -> np.ndarray:
    """The sum over all documents of count(batch), an array of `width` whole numbers.  text: the column of texts, by which
    batches are cut to a few megabytes.

    Each partition adds up its own batches; partial sums are added by piece of the array and salt, then by piece.
    """
    step = -(-width // pieces)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(width, np.int64)
        for batch in (part for whole in batches for part in tv.slices(whole, text)):
            total += count(batch)
        cut = [total[k * step : (k + 1) * step] for k in range(pieces)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(pieces), pa.int32()),
                pa.array([TaskContext.get().partitionId() % salts] * pieces, pa.int32()),
                pa.array([c.astype("<i8").tobytes() for c in cut], pa.binary()),
            ],
            ["piece", "salt", "sums"],
        )

    def add(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x, "<i8") for x in table["sums"].to_pylist())
        return pa.table({"piece": table["piece"][:1], "salt": table["salt"][:1], "sums": pa.array([sums.astype("<i8").tobytes()], pa.binary())})

    schema = "piece int, salt int, sums binary"
    parts = docs.mapInArrow(partial, schema).groupBy("piece", "salt").applyInArrow(add, schema)
    rows = parts.groupBy("piece").applyInArrow(add, schema).collect()
    out = np.zeros(pieces * step, np.int64)
    for r in rows:
        v = np.frombuffer(r["sums"], "<i8")
        out[r["piece"] * step : r["piece"] * step + len(v)] = v
    return out[:width]
