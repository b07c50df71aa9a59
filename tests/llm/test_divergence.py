"""op13: against a plain count, over odd rows, and with everything split."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scanlake.llm import divergence as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs=10, top=10):
    """rows: (text, lang, source)."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [(s, w) for x, s, w in docs if x == lang]
        df, n = Counter(t for _, w in mine for t in set(w)), {None: Counter()}
        for s, w in mine:
            n.setdefault(s, Counter()).update(w)
            n[None].update(w)
        kept = [t for t in df if df[t] >= min_docs]
        total = {s: sum(c[t] for t in kept) for s, c in n.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s, c in n.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in n.keys() - {None}:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in n.keys() - {None, s}]
            terms = [(-f(p[s][t], p[None][t]), t) for t in kept if n[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out |= {(lang, s, part, item, -v, r) for r, (v, item) in enumerate(found, 1)}
    return out


def got(df):
    rows = df.select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def sample(words=60, docs=240):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(docs):
        source = f"s{min(rng.randrange(9), rng.randrange(9))}"
        pool = [f"W{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(words)] + ["été", "Été", "É", "naïve"]
        rows.append((" ".join(rng.choices(pool[rng.randrange(3) * 20 :], k=rng.randrange(0, 30))) + ", a1b a_b", ["en", "fr", None, ""][i % 4], source if i % 17 else None))
    return rows


def frame(make, rows, extra=False):
    return make([(i, *r) for i, r in enumerate(rows)], extra)


def test_equals_a_plain_count(make):
    rows = sample()
    assert got(D.audit(frame(make, rows, extra=True).withColumn("term", F.lit("clash")).withColumn("p", F.lit(1)))) == plain(rows)


def test_split_groups_terms_texts_and_counts(make, monkeypatch):
    for name, value in (("SHARE", 4), ("POSTINGS", 3), ("HELD", 5), ("PIECE", 7)):
        monkeypatch.setattr(D, name, value)
    rows = sample(docs=160)
    assert got(D.audit(frame(make, rows).repartition(7), min_docs=3, top=2)) == plain(rows, 3, 2)


def test_nothing_kept_and_odd_texts(make):
    rows = [(None, "en", "a"), ("", "en", "b"), ("123 -- __", None, None), ("word " * 30, "de", "x"), ("other", "de", "y")]
    assert got(D.audit(frame(make, rows))) == plain(rows)
    assert got(D.audit(frame(make, []))) == set()
    # Repeated rows count as documents; a group without terms takes part.
    rows = [("same Same words", "en", "a")] * 12 + [("same", "en", "b"), ("", "en", "c"), (None, None, None)]
    assert got(D.audit(frame(make, rows))) == plain(rows) != set()


def test_large_counts_stay_exact(spark):
    n = 10**14
    df = spark.createDataFrame([(n, 3 * n, 7)], "n long, total long, v long").select(D.share("n", "total", "v").alias("p"), D.gap("1000000001L", "1L").alias("f")).first()
    assert df.p == 1 + 10**9 * (n + 2) // (3 * n + 14) and df.f == 10**18 // (10**9 + 2)


@pytest.mark.parametrize("text", ["aa bb", "a" * 50, " " * 50, "a " * 25, "é" * 9 + " " + "b" * 20])
def test_pieces_part_between_terms(text, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 4)
    gap, term = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]"), re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    pieces = list(D._pieces(text.encode(), gap))
    assert b"".join(pieces) == text.encode() and [t for p in pieces for t in term.findall(p)] == term.findall(text.encode())
