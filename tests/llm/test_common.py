"""Word hashing and the tables that stages hand on."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scanlake.llm import common as C


def plain_words(text):
    return [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_word_spans_are_the_words(texts):
    data, offsets = C.text_bytes(pa.array(texts, pa.string()))
    starts, ends, first = C.word_spans(data, offsets)
    raw = data.tobytes()
    got = [[raw[a:z].decode() for a, z in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
    assert got == [plain_words(t or "") for t in texts]


def test_hashes_do_not_depend_on_the_place_or_the_batch():
    a, _ = C.word_hashes(pa.array(["x yes no", "no  yes"], pa.string()))
    b, _ = C.word_hashes(pa.array(["YES"], pa.string()))
    assert a[1] == b[0] == a[4] and a[2] == a[3] and len(set(a.tolist())) == 3


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    whole, _ = C.word_hashes(pa.array([text], pa.string()))
    monkeypatch.setattr(C, "CHUNK", 64)
    pieces, _ = C.word_hashes(pa.array([text], pa.string()))
    assert (whole == pieces).all() and len(set(whole.tolist())) == 97


def test_ngrams_stay_in_their_text():
    w, first = C.word_hashes(pa.array(["a b c", "", "a b", "b c"], pa.string()))
    h, begin = C.ngram_hashes(w, first, 2)
    assert begin.tolist() == [0, 2, 2, 3, 4] and h[0] == h[2] and h[1] == h[3]


@pytest.mark.parametrize("values", [[], [7], [1, 2, 1 << 40]])
def test_packed_integers(values):
    x = np.array(values, dtype=np.uint64)
    assert (C.unpack_integers(C.pack_integers(x), np.uint64) == x).all()


def mirrored():
    """Two words that any polynomial hash modulo a power of two takes for one."""
    signs = [0]
    for _ in range(10):
        signs += [1 - v for v in signs]
    return "".join("ab"[v] for v in signs), "".join("ba"[v] for v in signs)


def test_words_equal_by_no_construction():
    x, y = mirrored()
    h, _ = C.word_hashes(pa.array([x, y, x.upper()], pa.string()))
    assert h[0] != h[1] and h[0] == h[2]


@pytest.mark.parametrize("size", [1, 7, 8, 9, 16, 63, 64, 65, 200])
def test_hashes_of_every_length(size):
    rng = np.random.default_rng(size)
    texts = ["".join(rng.choice(list("abc\xe9"), size)) for _ in range(300)]
    texts += [t[:-1] for t in texts] + [t + "\0" for t in texts]
    a, _ = C.word_hashes(pa.array([" ".join(texts)], pa.string()))
    b, _ = C.word_hashes(pa.array(texts, pa.string()))
    assert len(np.unique(b)) == len({t for t in texts if t})
    assert (a == b).all()
