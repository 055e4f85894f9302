"""Sorted rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows looked at together, whatever the session's batches are.
ROWS = 8192


def whole_runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, cut anew so that rows alike in some columns are never parted.  What is held is a batch and the
    run at its end."""
    joined = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    key = lambda b: tuple(b[c][b.num_rows - 1].as_py() for c in by)
    held: list[pa.RecordBatch] = []
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        last, same = key(batch), np.ones(batch.num_rows, bool)
        for c, x in zip(by, last):
            alike = pc.is_null(batch[c]) if x is None else pc.fill_null(pc.equal(batch[c], x), False)
            same &= alike.to_numpy(zero_copy_only=False)
        cut = batch.num_rows - int(same.sum())  # where the run at the end begins
        if not cut and held and key(held[-1]) == last:
            held.append(batch)
            continue
        if cut:
            held.append(batch.slice(0, cut))
        if held:
            yield joined(held)
        held = [batch.slice(cut)]
    if held:
        yield joined(held)
