"""Chat formatting: exact round trips, masks by the definition, long and broken conversations."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scanengine.llm import chat

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string, part string, whole string"
STRINGS = [*chat.CONTROL, "<\\s>", "[\\\\INST]", "<\\|turn|>", "\\", "<", "[", "<|", "é", "日本 ", " a", "\n", "  ", "😀", "x", "\x00"]
texts = st.lists(st.sampled_from(STRINGS), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(texts)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "</s>", ""]), texts), min_size=1, max_size=6))
def test_turns_and_loss_read_back(turns):
    text, spans = chat.render(turns, "assistant")
    tokens, loss = chat.mask(chat.RANKS, text, spans)
    assert chat.encoding(chat.RANKS).decode_bytes(tokens.tolist()) == text.encode()
    assert chat.turns_of(text) == turns
    assert chat.loss_texts(chat.RANKS, tokens.tolist(), loss) == [t for r, t in turns if r == "assistant"]
    # by the definition: a token is under loss if it has a byte in a span
    ends, at = [], 0
    for t in tokens.tolist():
        size = len(chat.encoding(chat.RANKS).decode_single_token_bytes(t))
        ends.append((at, at + size))
        at += size
    brute = {k for k, (i, j) in enumerate(ends) for lo, hi in spans if i < hi and j > lo}
    assert brute == {k for r in loss for k in range(r["first"], r["last"])}


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = []
    for conv, turns in by.items():
        turns = sorted(((t is not None, t or 0, r or "", x or "") for _, t, r, x in turns))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        size = sum(len(chat.escape(r)) + len(chat.escape(x)) + sum(map(len, chat.MARKS)) for *_, r, x in turns)
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted((tuple(r) for r in chat.read_back(chat.format_conversations(df, **kw)).collect()), key=str)


def test_conversations_of_every_kind(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 1, "assistant", None), (3, 5, None, "x"), (3, None, "assistant", "</s>[INST] ok [/INST]")]
    rows += [(4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "same")]
    rows += [(5, 0, "user", "long " * 60_000), (5, 1, "assistant", "é" * 200_000)]
    rows += [(6, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(-3, 1500)]
    rows += [(None, 0, "user", "q"), (None, 700, "assistant", "no id"), (7, 3, "assistant", "alone"), (8, 0, "assistant", "a"), (8, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, "p", "w") for r in rows], ROWS).repartition(5)
    assert got(df) == expected(rows)
    # the same in small parts
    assert got(df, turns_a_part=4, part_chars=10) == expected(rows)
    parts = chat.format_conversations(df).where("conv_id = 6")
    assert parts.count() == 4 and parts.where("whole").count() == 0
    assert got(df.where("1 = 0")) == []


def test_only_long_conversations_go_to_a_second_shuffle(spark):
    df = spark.createDataFrame([(k, t, "user", "x", "p", "w") for k in range(9) for t in range(3)], ROWS)
    plan = chat.read_back(chat.format_conversations(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1


def test_given_conversations(spark):
    from scanengine.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    found = queries.queries()["op11_chat_format"](spark, SF)
    assert found.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(rows)


def test_a_token_over_an_edge_is_refused():
    text, spans = chat.render([("assistant", "word")], "assistant")
    with pytest.raises(ValueError):
        chat.mask(chat.RANKS, text, [(spans[0][0] + 1, spans[0][1])])
