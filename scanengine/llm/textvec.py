"""Words of whole Arrow string columns as 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_M1, _M2, _M3 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)

#: Byte classes: white space becomes 0, A-Z lower case, all else itself.  NUL counts as a word byte, mapped to 1.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0] = 1
_FOLD[65:91] += 32
_FOLD[[32, 9, 10, 11, 12, 13]] = 0
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[0] = 1
_PLAIN[[32, 9, 10, 11, 12, 13]] = 0
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered pair of hashes as one."""
    return mix(a * _M3 + b + _M2)


@dataclass
class Words:
    """hashes: of each word, in order; first: index of each document's first word, with one more at the end."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), self.counts)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    binary = pa.types.is_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: int, most_bytes: int = 4 << 20) -> list[pa.RecordBatch]:
    """A batch in runs of rows of about most_bytes of text, so that a task's arrays stay small; a row is never cut."""
    if not batch.num_rows:
        return []
    _, off = text_bytes(batch.column(text))
    step = off[1:] // most_bytes
    cut = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
    return [batch.slice(i, j - i) for i, j in zip(cut, cut[1:])]


def word_spans(raw: np.ndarray, off: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes, and each word's first byte and length.  No word crosses two rows."""
    byte = (_FOLD if fold else _PLAIN)[raw]
    inside = byte != 0
    if not len(byte):
        return byte, np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(byte))]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(start)
    return byte, starts, np.flatnonzero(end) - starts + 1


def words(column: pa.Array | pa.ChunkedArray, fold: bool = True) -> Words:
    """The words `[^\\x20\\x09-\\x0D]+` of each text; fold lower-cases A-Z."""
    raw, off = text_bytes(column)
    byte, starts, length = word_spans(raw, off, fold)
    return Words(hash_spans(byte, starts, length), np.searchsorted(starts, off))


def hash_spans(byte: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(byte) + 16, np.uint8)
    padded[: len(byte)] = byte
    wide = np.ndarray((len(byte) + 8,), "<u8", padded, 0, (1,))
    h = mix((wide[starts] & _MASK[np.minimum(length, 8)]) + length.astype(np.uint64) * _M3)
    at, left = starts, length
    which = np.flatnonzero(left > 8)
    at, left = at[which] + 8, left[which] - 8
    while len(which):
        h[which] = combine(h[which], wide[at] & _MASK[np.minimum(left, 8)])
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    return h


def shingles(w: Words, size: int = 5) -> Words:
    """Each document's shingles of `size` words in order; a shorter document has its whole sequence as one."""
    n, h = w.counts, w.hashes
    many = np.maximum(n - size + 1, (n > 0).astype(n.dtype))
    first = np.concatenate([[0], np.cumsum(many)])
    if not first[-1]:
        return Words(np.zeros(0, np.uint64), first)
    doc = np.repeat(np.arange(len(n)), many)
    at = w.first[:-1][doc] + np.arange(first[-1]) - first[:-1][doc]
    long = n[doc] >= size
    out = np.zeros(first[-1], np.uint64)
    i = at[long]
    if len(i):
        acc = h[i]
        for k in range(1, size):
            acc = combine(acc, h[i + k])
        out[long] = acc
    for j in np.flatnonzero((n > 0) & (n < size)):
        acc = h[w.first[j]]
        for k in range(1, n[j]):
            acc = combine(np.array([acc]), h[w.first[j] + k : w.first[j] + k + 1])[0]
        out[first[j]] = mix(np.array([acc ^ _U(int(n[j]))]))[0]
    return Words(out, first)


def distinct_sets(s: Words) -> Words:
    """Each document's hashes sorted and without repeats."""
    doc = s.doc_of()
    order = np.lexsort((s.hashes, doc))
    h, d = s.hashes[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return Words(h[keep], np.searchsorted(d[keep], np.arange(len(s.first))))


def pack(keys: np.ndarray) -> bytes:
    """Ascending unsigned keys as gaps of 7-bit groups."""
    gaps = np.diff(keys, prepend=_U(0)) if len(keys) else keys
    return pack_counts(gaps)


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_counts(data), dtype=np.uint64)


def pack_counts(v: np.ndarray) -> bytes:
    """Unsigned numbers as 7-bit groups, the lowest first (LEB128)."""
    v = v.astype(np.uint64)
    if not len(v):
        return b""
    size = np.ones(len(v), np.int64)
    rest = v >> _U(7)
    while rest.any():
        size += rest != 0
        rest >>= _U(7)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    which, rest, k = np.arange(len(v)), v, 0
    while len(which):
        more = size[which] > k + 1
        out[at[which] + k] = (rest & _U(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        which, rest, k = which[more], rest[more] >> _U(7), k + 1
    return out.tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    last = b < 128
    end = np.flatnonzero(last)
    start = np.concatenate([[0], end[:-1] + 1])
    pos = np.arange(len(b)) - np.repeat(start, end - start + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (pos * 7).astype(np.uint64), start)
