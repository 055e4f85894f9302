"""Alignment of two tokenizers over documents, each distinct segment of text tokenised and aligned once.

A text is cut before runs of blanks, where neither vocabulary can merge across; `cuts_hold` verifies that from the
vocabularies.  Documents of a unit send their distinct segments to the tasks of the segments' hashes, which tokenise and
align each distinct segment once and answer every unit that holds it.  Units then compose their documents from the
answers.  How many documents hold a pair of ids linked is counted corpus-wide by the exchange of counts.

Groups of an alignment lie between the byte offsets where tokens of both sides end.  A segment starts and ends at such an
offset, so a document's groups are those of its segments, one after another.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanengine.llm import textvec as tv
from scanengine.llm.exchange import Exchange, Families, units
from scanengine.llm.shared import removed, scratch, written

_U = np.uint64
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"

#: UTF-8 of white space beyond ASCII, of U+2581 and of marks that some engines take for white space.
_WIDE_BLANKS = (
    [0xC285, 0xC2A0, 0xE19A80, 0xE1A08E, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE281A0, 0xE29681, 0xE38080, 0xEFBBBF]
    + list(range(0xE28080, 0xE28090))
)
_NARROW_BLANKS = np.zeros(256, bool)
_NARROW_BLANKS[[*range(9, 14), *range(28, 33)]] = True

UNIT = "unit long, doc_ids array<long>, n_segments binary, idx binary, lens binary, raw binary"
ASK = "bucket int, unit long, at binary, lens binary, raw binary"
ALIGNED = "a binary, b binary, ga binary, gb binary, n binary"
COMPOSED = f"unit long, doc_ids array<long>, n_segments binary, idx binary, {ALIGNED}, keys binary, n_docs binary"

#: An odd number and its inverse modulo 2^32: spread pairs of ids evenly over the range of keys, and back.
_ODD = 0x9E3779B1
_BACK = pow(_ODD, -1, 1 << 32)


def squeeze(x: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type, byte planes apart, compressed."""
    top = int(x.max()) if len(x) else 0
    kind = np.dtype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if top < 256 ** np.dtype(k).itemsize))
    planes = np.ascontiguousarray(x, kind).view(np.uint8).reshape(len(x), kind.itemsize).T.tobytes()
    return bytes([kind.itemsize]) + len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def spread(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)


def binaries(lens: np.ndarray, raw: bytes) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(off), pa.py_buffer(raw)])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """Lengths and concatenated bytes of a binary array."""
    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = column.buffers()[2]
    return np.diff(off).astype(np.int64), b"" if data is None else data.to_pybytes()[off[0] : off[-1]]


def gather(first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the elements of the given rows lie, rows one after another; first: where each row begins, and the end."""
    many = first[rows + 1] - first[rows]
    edge = np.cumsum(many) - many
    return np.repeat(first[rows] - edge, many) + np.arange(int(many.sum()))


def edges(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = edges(values)
    return total[first[1:]] - total[first[:-1]]


class Pair:
    """Both tokenizers with the bytes of each of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # their strings in texts are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        back = {c: b for b, c in _byte_letters().items()}
        plain = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = token.encode() if token in plain else bytes(back[c] for c in token)
        self.b_bytes = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode())
        self.a_len = np.array([len(x) for x in self.a_bytes])
        self.b_len = np.array([len(x) for x in self.b_bytes])
        self.cut = cuts_hold(self)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of texts that begin with a blank, which the second tokenizer puts before any text itself."""
        return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)


@functools.lru_cache(2)
def tokenizers(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable Latin-1 is itself, the rest follow U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


def cuts_hold(pair: Pair) -> bool:
    """Whether no token of either side can reach over a cut: none has a blank right after something that is not white
    space, and on texts made to try it (runs of blanks, line ends, digits, signs) cut and whole texts have the same ids."""
    wide = "|".join(re.escape(x.to_bytes(2 + (x > 0xFFFF), "big").decode()) for x in _WIDE_BLANKS)
    over = re.compile(rf"(?:(?!{wide})[^\x09-\x0d\x1c-\x20]) ")
    if any(over.search(x.decode("utf-8", "replace")) for x in chain(pair.a_bytes, pair.b_bytes)):
        return False
    ends, begins = ["a", "é", "1", ".", "'", "it's", "日", "́", "</s>", "<0x0A>"], [" a", "  b", "   ", " \n c", " 's", " 1", " .", "    é", " ▁"]
    tails = ["x", "1", "'s", "\n"]
    whole = [" " + e + s + t for e in ends for s in begins for t in tails]
    left, right = [" " + e for e in ends for _ in begins for _ in tails], [s + t for _ in ends for s in begins for t in tails]
    got = [pair.encode(x) for x in (whole, left, right)]
    return all(w == l + r for k in (0, 1) for w, l, r in zip(got[0][k], got[1][k], got[2][k]))


def segments(column: pa.ChunkedArray, cut: bool = True) -> tuple[np.ndarray, pa.Array]:
    """How many segments each text has, and the segments of all.  A segment is a run of blanks and what follows up to the
    next cut; the first one has the blank that goes before a text.  A run that ends a text is no cut.  Null and empty
    texts have none."""
    raw, off = tv.text_bytes(column)
    size = np.diff(off)
    some = size > 0
    b = np.insert(raw, off[:-1][some], 32)
    start = (edges(size[some] + 1))[:-1]
    n = np.zeros(len(size), np.int64)
    if not len(b):
        return n, pa.array([], pa.binary())
    starts = start
    if cut:
        last = np.maximum.reduceat(np.where(b != 32, np.arange(len(b), dtype=np.int32), np.int32(-1)), start)
        at = np.flatnonzero(b == 32)
        doc = np.searchsorted(start, at, side="right") - 1
        at = at[(at > start[doc]) & (at < last[doc])]
        p1 = b[at - 1]
        blank = _NARROW_BLANKS[p1]
        high = np.flatnonzero(p1 >= 128)
        code = (b[np.maximum(at[high] - 2, 0)].astype(np.int64) << 8) | p1[high]
        blank[high] = np.isin(code, _WIDE_BLANKS) | np.isin((b[np.maximum(at[high] - 3, 0)].astype(np.int64) << 16) | code, _WIDE_BLANKS)
        starts = np.union1d(start, at[~blank])
    n[some] = np.diff(np.searchsorted(starts, np.append(start, len(b))))
    return n, binaries(np.diff(np.append(starts, len(b))), b.tobytes())


def align(pair: Pair, lens: np.ndarray, raw: bytes) -> tuple[np.ndarray, ...]:
    """a, b: ids of all segments, one after another; ga, gb: ids of each group; n: groups of each segment, 0 where the
    bytes of either side's tokens are not those of the segment."""
    spans = edges(lens)
    parts = [raw[i:j] for i, j in zip(spans[:-1], spans[1:])]
    ia, ib = pair.encode([p.decode() for p in parts])
    ok = np.array([b"".join([pair.a_bytes[k] for k in x]) == p == b"".join([pair.b_bytes[k] for k in y]) for p, x, y in zip(parts, ia, ib)], bool)
    if not ok.all():
        ia, ib = [x if k else [] for x, k in zip(ia, ok)], [x if k else [] for x, k in zip(ib, ok)]
    a, b = (np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (ia, ib))
    ends_a, ends_b = np.cumsum(pair.a_len[a]), np.cumsum(pair.b_len[b])
    both = np.intersect1d(ends_a, ends_b, assume_unique=True)
    ga, gb = (np.bincount(np.searchsorted(both, e), minlength=len(both)) for e in (ends_a, ends_b))
    n = np.diff(np.searchsorted(both, edges(lens * ok), side="right"))
    return a, b, ga, gb, n


def linked(a, b, ga, gb, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of ids (a * 2^16 + b) that share a group, how often each does, and the segment, in the order of segments.
    A group's repeats of an id are counted before they meet the other side."""
    group = np.arange(len(ga))

    def bag(ids, sizes):
        code, count = np.unique((np.repeat(group, sizes) << 16) | ids, return_counts=True)
        return code & 0xFFFF, count, edges(np.bincount(code >> 16, minlength=len(group)))

    xa, ca, fa = bag(a, ga)
    xb, cb, fb = bag(b, gb)
    of_a = np.repeat(group, np.diff(fa))
    left = np.repeat(np.arange(len(xa)), np.diff(fb)[of_a])
    right = gather(fb, of_a)
    return (xa[left] << 16) | xb[right], ca[left] * cb[right], np.repeat(np.arange(len(n)), n)[of_a[left]]


def group_texts(a, b, ga, gb, n, most: int = 32_768) -> list[bytes]:
    """Each segment's groups as `a1,a2|b1;`, every group with its `;`; some segments at a time."""
    out: list[bytes] = []
    group, token_a, token_b = edges(n), edges(ga), edges(gb)
    for i in range(0, len(n), most):
        j = min(i + most, len(n))
        g = slice(group[i], group[j])
        ids = a[token_a[group[i]] : token_a[group[j]]], b[token_b[group[i]] : token_b[group[j]]]
        out += _group_texts(*ids, ga[g], gb[g], n[i:j])
    return out


def _group_texts(a, b, ga, gb, n) -> list[bytes]:
    group = np.arange(len(ga))
    words = []
    for ids, sizes in ((a, ga), (b, gb)):
        last = np.zeros(len(ids), np.int64)
        last[np.cumsum(sizes) - 1] = 1
        words.append(ids * 2 + last)
    codes = np.concatenate([words[0], words[1] + (1 << 17)])
    # a group's first ids, then its second ones
    order = np.argsort(np.concatenate([np.repeat(group, ga) * 2, np.repeat(group, gb) * 2 + 1]), kind="stable")
    used, back = np.unique(codes[order], return_inverse=True)
    marks = {(0, 0): b",", (0, 1): b"|", (1, 0): b",", (1, 1): b";"}
    named = [str((k & 0x1FFFF) >> 1).encode() + marks[k >> 17, k & 1] for k in used.tolist()]
    size = np.array([len(x) for x in named], np.int64)
    flat = b"".join([named[k] for k in back.tolist()])
    at = edges(size[back])[edges(ga + gb)[edges(n)]].tolist()
    return [flat[i:j] for i, j in zip(at, at[1:])]


def _composed(table: pa.Table) -> tuple[np.ndarray, ...]:
    """n_segments, idx and the aligned dictionary of a unit's row."""
    return tuple(spread(table[c][0].as_py()) for c in ("n_segments", "idx", "a", "b", "ga", "gb", "n"))


def _whole(first: np.ndarray, idx: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which documents have tokens: some segments, all of them aligned."""
    return (np.diff(first) > 0) & (sums((n == 0)[idx].astype(np.int64), first) == 0)


def aligned(docs: DataFrame, byte_path: str = BYTE_BPE, piece_path: str = PIECE_BPE, unit_bytes: int = 6 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """A row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups, the ids of both sides by
    group, as `a1,a2|b1;a3|b2,b3`.

    n_links: pairs of token occurrences that share a group.  A pair of ids counts the documents of the corpus that hold it
    linked; n_best: links whose pair has its first id's highest count, ties included; count_sum: the sum of the counts of
    all links.  Null and empty texts, and texts whose bytes the tokens of either side do not give back (those with U+2581),
    have zeros and empty groups, and count for no pair.  Strings of special tokens in texts are plain text.  Rows that
    repeat a doc_id, or lack one, count each for itself.  A text without blanks, however long, is one segment.  An empty
    table gives no rows; columns other than doc_id and text are ignored.  Where the vocabularies do not allow cuts, texts
    are their own segments.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, may = TaskContext.get().partitionId(), tokenizers(byte_path, piece_path).cut
        for _, u, table in units(batches, "text", unit_bytes):
            n, all_of = segments(table["text"], may)
            coded = all_of.dictionary_encode()
            index = coded.indices.to_numpy().astype(np.int64)
            order = np.argsort(-np.bincount(index, minlength=len(coded.dictionary)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            lens, raw = bytes_of(coded.dictionary.take(pa.array(order)))
            ids = pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64()))
            cells = [squeeze(n), squeeze(rank[index]), squeeze(lens), raw]
            yield pa.RecordBatch.from_arrays([pa.array([(pid << 32) | u], pa.int64()), ids, *[pa.array([c], pa.binary()) for c in cells]], ["unit", "doc_ids", "n_segments", "idx", "lens", "raw"])

    spark = docs.sparkSession
    path = scratch(spark, "segments")
    d.mapInArrow(cut, UNIT).write.option("compression", "zstd").parquet(path)
    held = spark.read.schema(UNIT).parquet(path)
    buckets = max(8, held.count() * unit_bytes // bucket_bytes)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                unit, lens, raw = batch["unit"][row], spread(batch["lens"][row].as_py()), batch["raw"][row].as_py()
                known = binaries(lens, raw)
                place = np.fromiter((zlib.crc32(x) % buckets for x in known.to_pylist()), np.int64, len(known))
                order = np.argsort(place, kind="stable")
                bound = np.searchsorted(place[order], np.arange(buckets + 1))
                rows = []
                for k in range(buckets):
                    at = order[bound[k] : bound[k + 1]]
                    if len(at):
                        size, data = bytes_of(known.take(pa.array(at)))
                        rows.append((k, unit.as_py(), squeeze(at), squeeze(size), squeeze(np.frombuffer(data, np.uint8))))
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "unit", "at", "lens", "raw"])

    def answer(table: pa.Table) -> pa.Table:
        pair = tokenizers(byte_path, piece_path)
        asked = [binaries(spread(r["lens"]), spread(r["raw"]).astype(np.uint8).tobytes()) for r in table.select(["lens", "raw"]).to_pylist()]
        coded = pa.concat_arrays(asked).dictionary_encode()
        known, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        lens, raw = bytes_of(known)
        spans = edges(lens)
        # half a megabyte of segments at a time
        for i, j in _runs(spans, 1 << 19):
            for out, x in zip(found, align(pair, lens[i:j], raw[spans[i] : spans[j]])):
                out.append(x.astype(np.int32))
        a, b, ga, gb, n = (np.concatenate(x) for x in found)
        group, token_a, token_b = edges(n), edges(ga), edges(gb)
        out = {c: [] for c in ("a", "b", "ga", "gb", "n")}
        at = edges([len(x) for x in asked])
        for i, j in zip(at[:-1], at[1:]):
            own = index[i:j]
            g = gather(group, own)
            for c, x in (("a", a[gather(token_a, g)]), ("b", b[gather(token_b, g)]), ("ga", ga[g]), ("gb", gb[g]), ("n", n[own])):
                out[c].append(squeeze(x))
        return pa.table({"unit": table["unit"], "at": table["at"], **{c: pa.array(v, pa.binary()) for c, v in out.items()}})

    answers = held.select("unit", "lens", "raw").mapInArrow(ask, ASK).groupBy("bucket").applyInArrow(answer, f"unit long, at binary, {ALIGNED}")

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        """A unit's dictionary put in its own order, and how many of its documents hold each pair."""
        parts = [[spread(r[c]) for c in ("at", "a", "b", "ga", "gb", "n")] for r in right.to_pylist()]
        at, a, b, ga, gb, n = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 6
        order = np.argsort(at)
        g = gather(edges(n), order)
        dictionary = a[gather(edges(ga), g)], b[gather(edges(gb), g)], ga[g], gb[g], n[order]
        n_segments, idx = spread(left["n_segments"][0].as_py()), spread(left["idx"][0].as_py())
        first = edges(n_segments)
        key, _, segment = linked(*dictionary)
        known, place = np.unique(_mixed(key), return_inverse=True)
        whole = np.repeat(_whole(first, idx, dictionary[4]), n_segments)
        doc = np.repeat(np.arange(len(n_segments)), n_segments)
        own = np.unique((doc[whole] << 32) | idx[whole])
        of_segment = edges(np.bincount(segment, minlength=len(n)))
        rows = own & 0xFFFFFFFF
        held_pairs = np.unique(np.repeat(own >> 32, np.diff(of_segment)[rows]) * len(known) + place[gather(of_segment, rows)])
        count = np.bincount(held_pairs % max(1, len(known)), minlength=len(known))
        some = count > 0
        cells = [*map(squeeze, dictionary), tv.pack(known[some].astype(_U)), squeeze(count[some])]
        names = ["a", "b", "ga", "gb", "n", "keys", "n_docs"]
        return pa.table({**{c: left[c] for c in ("unit", "doc_ids", "n_segments", "idx")}, **{c: pa.array([x], pa.binary()) for c, x in zip(names, cells)}})

    docs_of = held.select("unit", "doc_ids", "n_segments", "idx")
    done = written(docs_of.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(compose, COMPOSED), "aligned")
    removed(spark, path)  # all that is in it now lies in the units' rows

    def families(table: pa.Table) -> Families:
        return [(tv.unpack(table["keys"][0].as_py()), [spread(table["n_docs"][0].as_py()).astype(_U)])]

    # each unit's row is a unit of the exchange; a row's idx has about a fifth as many bytes as it has pairs in a bucket
    counts = Exchange(done, families, [32], text="idx", unit_bytes=1, keys_a_bucket=4_000_000)

    def highest(table: pa.Table, own: Families, totals: list[list[np.ndarray]]) -> pa.RecordBatch:
        ids = _unmixed(own[0][0].astype(np.int64)) >> 16
        order = np.lexsort((totals[0][0], ids))
        last = np.append(ids[order][1:] != ids[order][:-1], True) if len(ids) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(ids[order][last]), pa.array(totals[0][0][order][last].astype(np.int64))], ["id", "most"])

    # as many rows as the first vocabulary has ids, whatever the input
    best = np.zeros(1 << 16, np.int64)
    for r in counts.each(highest, "id long, most long").groupBy("id").agg(F.max("most").alias("most")).collect():
        best[r["id"]] = r["most"]

    def rows(table: pa.Table, own: Families, totals: list[list[np.ndarray]]) -> pa.RecordBatch:
        n_segments, idx, *dictionary = _composed(table)
        first, n = edges(n_segments), dictionary[4]
        key, times, segment = linked(*dictionary)
        known, df = own[0][0].astype(np.int64), totals[0][0].astype(np.int64)
        count = np.zeros(len(key), np.int64)
        if len(known):
            mixed = _mixed(key)
            at = np.minimum(np.searchsorted(known, mixed), len(known) - 1)
            count = np.where(known[at] == mixed, df[at], 0)
        of_segment, group = edges(np.bincount(segment, minlength=len(n))), edges(n)
        whole = _whole(first, idx, n)

        def per_doc(of_each: np.ndarray) -> pa.Array:
            return pa.array(np.where(whole, sums(of_each[idx], first), 0))

        texts = group_texts(*dictionary)
        joined = [b"".join([texts[k] for k in idx[i:j].tolist()])[:-1].decode() if w else "" for i, j, w in zip(first[:-1].tolist(), first[1:].tolist(), whole.tolist())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(table["doc_ids"][0].as_py(), pa.int64()),
                per_doc(sums(dictionary[2], group)),
                per_doc(sums(dictionary[3], group)),
                per_doc(n),
                per_doc(sums(times, of_segment)),
                per_doc(sums(times * (count == best[key >> 16]), of_segment)),
                per_doc(sums(times * count, of_segment)),
                pa.array(joined, pa.string()),
            ],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
        )

    return counts.each(rows, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def _mixed(key: np.ndarray) -> np.ndarray:
    return ((key.astype(_U) * _U(_ODD)) & _U(0xFFFFFFFF)).astype(np.int64)


def _unmixed(key: np.ndarray) -> np.ndarray:
    return ((key.astype(_U) * _U(_BACK)) & _U(0xFFFFFFFF)).astype(np.int64)


def _runs(spans: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; a row is never cut."""
    i, last = 0, len(spans) - 1
    while i < last:
        j = min(last, max(i + 1, int(np.searchsorted(spans, spans[i] + most, side="right")) - 1))
        yield i, j
        i = j
