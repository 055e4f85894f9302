"""Aligned tokenizers against whole texts encoded one by one."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scanengine.llm import alignment

PIECES = ["the", "Ka", " ", "  ", "   ", "\n", "\t", "é", "日本", "😀", "12", "3.5", "'s", "<|endoftext|>", "</s>", "<s>", " ", "　", " ", "\x85", "\x1c", "x" * 40, "́", ".", "--", "\r\n", "\x00"]


@pytest.fixture(scope="module")
def pair():
    return alignment.tokenizers(alignment.BYTE_BPE, alignment.PIECE_BPE)


def whole(pair, text):
    """Groups of a whole text as lists of ids, or None."""
    if not text:
        return None
    (a,), (b,) = pair.encode([" " + text])
    if b"".join(pair.a_bytes[k] for k in a) != (" " + text).encode() or b"".join(pair.b_bytes[k] for k in b) != (" " + text).encode():
        return None
    ends = lambda ids, size: np.cumsum([size[k] for k in ids]).tolist()
    ea, eb = ends(a, pair.a_len), ends(b, pair.b_len)
    out, i, j = [], 0, 0
    for at in sorted(set(ea) & set(eb)):
        x, y = ea.index(at) + 1, eb.index(at) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def expected(pair, rows):
    groups = [whole(pair, t) for _, t in rows]
    held = collections.Counter()
    for g in groups:
        held.update({(x, y) for a, b in g or [] for x in a for y in b})
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), g in zip(rows, groups):
        links = [(x, y) for a, b in g or [] for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        out.append((i, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), text))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()), key=str)


def corpus(seed=3, n=60):
    r = random.Random(seed)
    out = [(k, "".join(r.choice(PIECES) for _ in range(r.randrange(1, 60)))) for k in range(n)]
    out += [(n, None), (n + 1, ""), (n + 2, " "), (n + 3, "   \n "), (n + 4, "a ▁ b"), (n + 5, "▁"), (n + 6, " " * 999 + "end"), (n + 7, "wide " * 3000), (n + 8, "q" * 5000)]
    return [*out, out[0], (None, "the end"), (None, None)]


def test_aligned_equals_whole_texts(spark, pair):
    rows = corpus()
    df = spark.createDataFrame([(*x, "1", "2") for x in rows], "doc_id long, text string, idx string, unit string")
    assert got(alignment.aligned(df)) == expected(pair, rows)
    # the same from many partitions, small units and small buckets
    assert got(alignment.aligned(df.repartition(5), unit_bytes=500, bucket_bytes=2000)) == expected(pair, rows)


def test_aligned_of_given_documents(spark, pair):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(alignment.aligned(df)) == expected(pair, rows)


def test_aligned_of_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(df).count() == 0


def test_vocabularies_allow_cuts(pair):
    assert pair.cut
    broken = type("Broken", (), {"a_bytes": [b"x y"], "b_bytes": [], "encode": pair.encode})
    assert not alignment.cuts_hold(broken)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30), st.text(max_size=8))
def test_segments_encode_as_their_text(pieces, more):
    pair = alignment.tokenizers(alignment.BYTE_BPE, alignment.PIECE_BPE)
    text = "".join(pieces) + more
    n, parts = alignment.segments(pa.chunked_array([pa.array([text, None])]))
    assert n.tolist() == [len(parts), 0]
    parts = [p.decode() for p in parts.to_pylist()]
    assert "".join(parts) == (" " + text if text else "")
    if text:
        a, b = pair.encode(parts)
        (wa,), (wb,) = pair.encode([" " + text])
        assert sum(a, []) == wa and sum(b, []) == wb


@given(st.lists(st.integers(0, 2**40)))
def test_squeeze_round_trip(values):
    assert alignment.spread(alignment.squeeze(np.array(values, np.int64))).tolist() == values
