"""op1: round trips, masks and odd rows."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scanlake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "x", "<", "/s>", "[", "INST]", " "]), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_bare_control(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert all(e[:i].endswith("\\") for c in chat.CONTROLS for i in range(len(e)) if e.startswith(c, i))


def expected(turns):
    turns = sorted(turns, key=lambda t: (t[0], t[1] is not None, t[1] or "", t[2] is not None, t[2] or ""))
    pairs = [(r or "", t or "") for _, r, t in turns]
    loss = "".join(t for r, t in pairs if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(pairs), sha("".join(f"{r}\n{t}\n" for r, t in pairs)), len(loss), sha(loss)


def test_read_back(spark):
    convs = {
        1: [(0, "user", "hi"), (1, "assistant", "</s>[INST] ok [/INST]"), (2, "assistant", None), (3, "assistant", "é 日本 \\<s>")],
        2: [(0, None, None)],
        3: [(0, "assistant", "same"), (0, "assistant", "same")],
        4: [(5, "user", "b"), (5, "user", "a"), (None, "user", "z"), (1, "as</s>sistant", "x")],
        5: [(0, "assistant", "w " * 30_000)],
    }
    rows = [(c, t if t is not None else None, r, x) for c, ts in convs.items() for t, r, x in ts]
    out = {r.conv_id: r for r in chat.digest(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    for c, turns in convs.items():
        r = out[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected([(-1 if t is None else t, a, b) for t, a, b in turns])
    assert out[1].formatted_chars > sum(len(x or "") for _, _, x in convs[1])


def test_masks_cover_assistant_texts_only(spark):
    f = chat.format_chats(spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "assistant", "c d e")], SCHEMA)).orderBy("turn").collect()
    assert not any(f[0].loss)
    ids, loss = f[1].ids, f[1].loss
    assert [i for i, m in zip(ids, loss) if m] == ids[ids.index(chat.SEP) + 1 : -1] and ids[-1] == chat.END


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", ids string, loss int")
    assert chat.digest(chat.format_chats(empty)).count() == 0


@pytest.mark.parametrize("texts", [["", "a"], ["x" * 10_000]])
def test_assemble_bounds(texts):
    from scanlake.llm.token_store import Encoder, tokenizer_path

    ids, loss, begin = chat.assemble(Encoder.here(tokenizer_path(), literal=True), ["assistant"] * len(texts), texts)
    assert len(ids) == len(loss) == begin[-1] and loss.sum() == len(ids) - 3 * len(texts) - sum(1 for _ in texts) * (len(Encoder.here(tokenizer_path(), literal=True)(["assistant"])[0]))
