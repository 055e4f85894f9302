"""Conversations rendered by a chat template, encoded once, with loss masks found by offsets.

A turn is <|turn|>role<|text|>text</s>.  These marks are tokens of their own, so no token reaches over the edge of a text.
A control string inside a role or a text gets a backslash after its first character; one that has backslashes there gets one
more, so taking one away gives the text back.

A part of a conversation is rendered as a whole and encoded once; each token's bytes tell its offsets, and the sorted spans of
the turns under loss are met with the tokens' spans by binary search.  A part is a whole conversation unless that is longer
than any model's context.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TURN, TEXT, END = MARKS = ("<|turn|>", "<|text|>", "</s>")

#: Marks of this template, and strings that other templates and tokenizers take for control.
CONTROL = (*MARKS, "<s>", "<unk>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "[INST]", "[/INST]")
#: Fixed value: how the vocabulary's rank file expects text to be cut before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BODY = "|".join(re.escape(c[1:]) for c in CONTROL)
_PUT = re.compile(rf"([<\[]\\*)(?={_BODY})")
_TAKE = re.compile(rf"([<\[]\\*)\\(?={_BODY})")

FORMATTED = "part long, n_turns long, text string, tokens array<int>, loss array<struct<first:int,last:int>>"
DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
BUCKETS = 4096


def escape(text: str) -> str:
    return _PUT.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _TAKE.sub(r"\1", text)


@functools.lru_cache(2)
def encoding(path: str):
    """The tokenizer, with the marks as tokens after its own."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    free = max(ranks.values()) + 1
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={m: free + k for k, m in enumerate(MARKS)})


@functools.lru_cache(2)
def token_bytes(path: str) -> np.ndarray:
    """How many bytes each token has."""
    e = encoding(path)
    return np.array([len(e.decode_single_token_bytes(k)) for k in range(e.n_vocab)])


def render(turns: list[tuple[str, str]], under_loss: str) -> tuple[str, list[tuple[int, int]]]:
    """The text of some turns, and the spans of bytes, in order, of the texts whose role is under loss."""
    out, spans, size = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        at, length = size + len(head.encode()), len(body.encode())
        if role == under_loss:
            spans.append((at, at + length))
        out += [head, body, END]
        size = at + length + len(END)
    return "".join(out), spans


def mask(path: str, text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[dict]]:
    """Tokens of a text, and for each span the run of tokens that lie under it, first and one past the last."""
    tokens = np.array(encoding(path).encode(text, allowed_special=set(MARKS), disallowed_special=()), np.int32)
    end = np.cumsum(token_bytes(path)[tokens])
    start = end - token_bytes(path)[tokens]
    lo, hi = np.array(spans, np.int64).reshape(-1, 2).T
    first, last = np.searchsorted(end, lo, side="right"), np.searchsorted(start, hi, side="left")
    last = np.maximum(first, last)
    full = last > first
    if (start[first[full]] != lo[full]).any() or (end[last[full] - 1] != hi[full]).any() or (lo[~full] != hi[~full]).any():
        raise ValueError("a token reaches over the edge of a text under loss")
    return tokens, [{"first": int(i), "last": int(j)} for i, j in zip(first, last)]


def format_conversations(rows: DataFrame, path: str = RANKS, under_loss: str = "assistant", turns_a_part: int = 512, part_chars: int = 4 << 20) -> DataFrame:
    """A row a part of a conversation: conv_id, part, n_turns, text, tokens, loss (runs of tokens) and whole (all parts of
    the conversation lie together, in order).

    rows: conv_id, turn, role, text.  Turns are ordered by turn, nulls first, then role and text; rows that repeat are turns
    of their own.  Null roles and texts are empty.  Rows without conv_id are one conversation.  An empty table gives no
    rows; other columns are ignored.  A conversation within turns 0 to turns_a_part - 1 is one part, a longer one has a
    part for each turns_a_part turns, made in tasks of their own; a part ends early after part_chars characters, between
    turns.  As marks are tokens of their own, the tokens of the parts are those of the whole.
    """
    span = F.coalesce(F.floor(F.col("turn") / turns_a_part), F.lit(-(1 << 40)))
    d = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumns({"span": span, "bucket": F.pmod(F.xxhash64("conv_id"), F.lit(BUCKETS)).cast("int")})
    # which of a fixed number of buckets hold a long conversation
    longer = [r["bucket"] for r in d.where("span <> 0").select("bucket").distinct().collect()]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, size, sub, done, chars = None, [], 0, 0, [], 0

        def part() -> tuple:
            text, spans = render(turns, under_loss)
            tokens, loss = mask(path, text, spans)
            # the number of a part: its span of turns, then its place in that
            return key[0], (key[1] << 20) + sub, len(turns), text, tokens, loss

        for batch in batches:
            for conv, at, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "span", "role", "text"))):
                if (conv, at) != key or size >= part_chars:
                    if turns:
                        done.append(part())
                        chars += size
                    sub = sub + 1 if (conv, at) == key else 0
                    key, turns, size = (conv, at), [], 0
                turns.append((role, text))
                size += len(text)
                if len(done) >= 256 or chars >= part_chars:
                    yield _batch(done)
                    done, chars = [], 0
        if turns:
            done.append(part())
        if done:
            yield _batch(done)

    def formatted(part_of: DataFrame, keys: list[str], whole: bool) -> DataFrame:
        dealt = part_of.repartition(*keys).sortWithinPartitions("conv_id", "span", "turn", "role", "text")
        return dealt.select("conv_id", "span", "role", "text").mapInArrow(parts, f"conv_id long, {FORMATTED}").withColumn("whole", F.lit(whole))

    if not longer:
        return formatted(d, ["conv_id"], True)
    many = F.col("bucket").isin(longer)
    return formatted(d.where(~many), ["conv_id"], True).unionByName(formatted(d.where(many), ["conv_id", "span"], False))


def _batch(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]
    names = ["conv_id", "part", "n_turns", "text", "tokens", "loss"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)


def turns_of(text: str) -> list[tuple[str, str]]:
    """The turns that a formatted text holds."""
    out = []
    for turn in text.split(TURN)[1:]:
        role, body = turn.split(TEXT)
        out.append((unescape(role), unescape(body.removesuffix(END))))
    return out


def loss_texts(path: str, tokens: list[int], loss: list[dict]) -> list[str]:
    """The texts under the loss mask, decoded from their tokens."""
    e = encoding(path)
    return [unescape(e.decode_bytes(tokens[r["first"] : r["last"]]).decode()) for r in loss]


def read_back(formatted: DataFrame, path: str = RANKS) -> DataFrame:
    """A row a conversation, from what format_conversations gave: n_turns, digests of its turns and of the texts under the
    loss mask, and lengths in code points.  Digests run over a conversation's parts in their order, one at a time."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != conv:
                    if state is not None:
                        out.append(_ended(conv, state))
                    conv, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = turns_of(row["text"])
                state[0] += len(turns)
                state[1].update("".join(f"{role}\n{text}\n" for role, text in turns).encode())
                under = "".join(loss_texts(path, row["tokens"], row["loss"]))
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += len(row["text"])
            if out:
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                out = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([_ended(conv, state)], _SCHEMA)

    schema = f"conv_id long, {DIGEST}"
    used = ["conv_id", "text", "tokens", "loss"]
    here = formatted.where("whole").select(*used).mapInArrow(digests, schema)
    apart = formatted.where("not whole").select(*used, "part").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return here.unionByName(apart.select(*used).mapInArrow(digests, schema))


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _ended(conv: int | None, state: list) -> dict:
    n, turns, chars, loss, size = state
    return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}
