"""op2, op3, op7: against plain forms, and odd rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.llm import common as C
from scanlake.llm import langid, lm_score, quality

TEXTS = ["a b c a b d", "a b c", "", None, "z", "a  B\nc", "q " * 400, "a b c a b d"]


def plain_scores(texts, order=3, alpha=0.4, least=1):
    words = [(t or "").lower().split() for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))
    out = []
    for w in words:
        s = 0.0
        for i in range(len(w)):
            top = min(order, i + 1)
            for n in range(top, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1 or counts[g] >= least:
                    s += (top - n) * math.log(alpha) + math.log(counts[g] / (counts[g[:-1]] if n > 1 else total))
                    break
        out.append((len(w), s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores(make, order, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 64)
    got = {r.doc_id: r for r in lm_score.score(make([(i, t) for i, t in enumerate(TEXTS)], extra=True), order=order).collect()}
    for i, (n, s) in enumerate(plain_scores(TEXTS, order)):
        assert got[i].n_words == n and math.isclose(got[i].log_score, s, abs_tol=1e-6)
        assert (got[i].mean_log_score is None) == (n == 0)


def test_lm_scores_of_rarer_ngrams_left_out(make):
    got = {r.doc_id: r.log_score for r in lm_score.score(make([(i, t) for i, t in enumerate(TEXTS)]), min_count=2).collect()}
    assert all(math.isclose(got[i], s, abs_tol=1e-6) for i, (_, s) in enumerate(plain_scores(TEXTS, least=2)))


def test_lm_scores_of_a_text_beyond_a_block(make, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 50)
    texts = ["a b c " * 100, "c a", "b c a " * 3]
    got = {r.doc_id: r.log_score for r in lm_score.score(make([(i, t) for i, t in enumerate(texts)])).collect()}
    assert all(math.isclose(got[i], s, abs_tol=1e-6) for i, (_, s) in enumerate(plain_scores(texts)))


def test_lm_scores_of_nothing(make):
    assert lm_score.score(make([])).count() == 0
    assert [r.n_words for r in lm_score.score(make([(1, None), (1, None)])).collect()] == [0, 0]


def words(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), size=rng.integers(2, 7))) for _ in range(n))


def language_docs():
    rng = np.random.default_rng(5)
    kinds = {"aa": "abcde", "bb": "efghi", "cc": "ijklm"}
    return [(i, words(rng, kinds[k], 40), k) for i, k in enumerate(list(kinds) * 30)]


def test_language_of_held_out_documents(make):
    rows = language_docs()
    odd = [(900, None, None), (901, "", "aa"), (902, "12 34 !!", "bb"), (903, "abc", None), (904, "x" * 60_000, "aa"), (903, "abc", None)]
    docs = make(rows + odd, extra=True)
    out = langid.predict(docs, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0.0 for i in (900, 901, 902))
    assert all(0.0 <= r.score <= 1.0 for r in got.values()) and out.count() == len(rows) + len(odd)
    assert "k" in out.columns and out.columns.count("score") == 1


def test_language_without_labels_or_rows(make):
    assert {r.lang_pred for r in langid.predict(make([(1, "abc"), (2, None)])).collect()} == {"und"}
    assert langid.predict(make([])).count() == 0


def plain_phrases(texts, learnt):
    """Greedy longest matches by substring search."""
    import re

    norm = lambda t: re.sub(r"[\W\d_]+", " ", (t or "").lower()).encode()
    held = b"\n".join(norm(t) for t in learnt)
    out = []
    for t in texts:
        t, i, n = norm(t), 0, 0
        while i < len(t):
            j = i + 1
            while j <= len(t) and t[i:j] in held:
                j += 1
            i, n = max(i + 1, j - 1), n + 1
        out.append(n)
    return out


@pytest.mark.parametrize("segment", [1, 2, 7, 64, 4096])
def test_phrases_equal_a_plain_greedy_parse(segment, monkeypatch):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    rng = np.random.default_rng(segment)
    learnt = {k: [words(rng, a, 30) for _ in range(4)] for k, a in (("aa", "abcde"), ("bb", "dé\u65e5\u672c"), ("cc", "zz"))}
    texts = [words(rng, a, int(rng.integers(0, 60))) for a in ("abcde", "abcxyz", "\u65e5\u672cé", "q", "aab") for _ in range(6)]
    texts += ["", None, " ", "x", "Abc  \n\n ab", learnt["aa"][0], learnt["aa"][0] + learnt["aa"][1], "zzzzzzzzz" * 30, "\u65e5" * 50]
    data, offsets = C.text_bytes(langid.normal(texts))
    got = langid.Parser(langid.fit(learnt)).phrases(data, offsets)
    for k, lang in enumerate(sorted(learnt)):
        assert got[:, k].tolist() == plain_phrases(texts, learnt[lang])


def test_learning_does_not_depend_on_ids(make):
    rng = np.random.default_rng(3)
    rows = [(i, t, k) for ids, k, a, n in (((7,), "aa", "abc", 400), ((8, 9, None), "bb", "cde", 300), ((None,), "cc", "efg", 200)) for j in range(n) for i, t in [(ids[j % len(ids)], words(rng, a, 12))]]
    got = langid.sample(make(rows), F.lit(True), sample_docs=50)
    assert {k: len(v) for k, v in got.items()} == {"aa": 50, "bb": 50, "cc": 50}
    own = {(k, t) for _, t, k in rows}
    assert all((k, t) in own for k, v in got.items() for t in v) and got == langid.sample(make(rows[::-1]).repartition(3), F.lit(True), sample_docs=50)


def test_sample_is_bounded_by_bytes_and_copies_count_once(make):
    rows = [(i, "same text", "aa") for i in range(100)] + [(i, "x" * 500, "bb") for i in range(3)] + [(9, "y" * 400, "bb")]
    got = langid.sample(make(rows), F.lit(True), sample_docs=10, sample_bytes=100)
    assert got == {"aa": ["same text"], "bb": ["y" * 400]}


def test_language_without_spaces(make):
    rng = np.random.default_rng(9)
    run = lambda a, n=900: "".join(rng.choice(list(a), n))
    rows = [(i, run(a), k) for i in range(20) for k, a in (("ja", "\u3042\u3044\u3046\u3048\u304a"), ("th", "\u0e01\u0e02\u0e04\u0e07\u0e08"))]
    out = langid.predict(make(rows), F.col("doc_id") % 5 != 0, sample_bytes=9_000).collect()
    assert all(r.lang_pred == r.lang for r in out)


def test_automaton_holds_all_substrings_and_no_others():
    text = b"abcbcabb"
    nexts = langid.suffix_automaton(text)
    def holds(w):
        s = 0
        for c in w:
            if c not in nexts[s]:
                return False
            s = nexts[s][c]
        return True
    subs = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    assert all(holds(w) for w in subs) and not holds(b"cc") and not holds(b"abcc")


def quality_docs():
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["the", "cat", "sat", "over", "there", "quietly"], 60)) + "." for _ in range(60)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "|", "FREE!!"], 60)) for _ in range(60)]
    return [(i, t) for i, t in enumerate(good + bad)], [(i, int(i < 60)) for i in range(120)]


def test_quality_of_held_out_documents(spark, make):
    docs, labels = quality_docs()
    odd = [(500, None), (501, ""), (502, "y" * 80_000), (0, docs[0][1])]
    y = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, y int").filter("doc_id is null or doc_id % 3 <> 1")
    out = quality.score(quality.document_statistics(make(docs + odd, extra=True)), y).collect()
    got = {r.doc_id: r for r in out}
    held = [(got[i].predicted, q) for i, q in labels if i % 3 == 1]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)
    assert len(out) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_quality_equals_a_plain_ridge(spark, make):
    docs, labels = quality_docs()
    rng = np.random.default_rng(8)
    labels = [(i, int(rng.random() < (0.8 if y else 0.3))) for i, y in labels] + [(5, 1), (5, 0), (90, 1)]
    y = spark.createDataFrame(labels, "doc_id long, y int")
    got = {r.doc_id: r.score for r in quality.score(quality.document_statistics(make(docs).repartition(7)), y, features=32, ridge=1e-2).collect()}
    import pyarrow as pa

    x = quality.statistics(pa.array([t for _, t in docs], pa.string()))
    at, t = x[[i for i, _ in labels]], np.array([float(q) for _, q in labels])
    scale = at.std(0)
    m = quality.Model(at.mean(0), np.where(scale < 1e-5, 1.0, scale), 32, 4.0, 7)
    z = m.features(at)
    # Ridge as least squares with added rows.
    m.beta = np.linalg.lstsq(np.vstack([z, np.sqrt(1e-2 * len(t)) * np.eye(33)]), np.append(t, np.zeros(33)), rcond=None)[0]
    k = np.floor((z @ m.beta + 1) / 3 * quality.BINS).astype(int)
    bins = np.unique(k)
    s, n = np.array([t[k == b].sum() for b in bins]), np.array([(k == b).sum() for b in bins])
    # Isotonic by its min-max form.
    value = [max(min(s[i : j + 1].sum() / n[i : j + 1].sum() for j in range(b, len(bins))) for i in range(b + 1)) for b in range(len(bins))]
    m.at, m.value = (bins + 0.5) / quality.BINS * 3 - 1, np.array(value)
    want = m.score(x)
    assert max(abs(got[i] - want[i]) for i, _ in docs) < 1e-6


def test_quality_fits_on_a_bounded_sample(spark, make):
    docs, labels = quality_docs()
    y = spark.createDataFrame(labels + [(3, 1)] * 500, "doc_id long, y int")
    out = quality.score(quality.document_statistics(make(docs)), y, fit_rows=60).collect()
    assert sum(r.predicted == int(r.doc_id < 60) for r in out) >= 0.95 * len(docs)


def test_quality_without_labels_or_rows(spark, make):
    none = spark.createDataFrame([], "doc_id long, y int")
    assert {r.score for r in quality.score(quality.document_statistics(make([(1, "x"), (2, None)])), none).collect()} == {0.5}
    assert quality.score(quality.document_statistics(make([])), none).count() == 0


def test_isotonic():
    y, w = np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.array([1.0, 1, 1, 2, 1])
    v = quality.pool_adjacent(y, w)
    assert (np.diff(v) >= 0).all() and math.isclose((v * w).sum(), (y * w).sum()) and v[1] == v[2] == v[3]
