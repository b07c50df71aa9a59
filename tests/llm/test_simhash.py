"""op11: against plain fingerprints and all pairs; the codes; odd rows."""

import random
import re

import numpy as np
import pytest
import xxhash

from scanlake.llm import simhash as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, threshold=3):
    """doc_id, fingerprint, component_id, n_links of (doc_id, fingerprint)."""
    fps = sorted({f for _, f in rows})
    near = {f: [g for g in fps if g != f and (f ^ g).bit_count() <= threshold] for f in fps}
    label = {}
    for f in fps:
        todo, seen = [f], {f}
        while todo:
            for g in near[todo.pop()]:
                if g not in seen:
                    seen.add(g)
                    todo.append(g)
        label[f] = min((d for d, g in rows if g in seen and d is not None), default=None)
    return sorted(((d, f"{f:016x}", label[f], len(near[f])) for d, f in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id", "n_links").collect()), key=repr)


@pytest.mark.parametrize("code", S.codes())
def test_codes_are_perfect(code):
    radius = 3 if code.bits == 23 else 1
    leaders = code.difference[code.excess == 0]
    assert len(leaders) == 1 << code.check and len(np.unique(code.syndrome(leaders))) == len(leaders)
    x = np.random.default_rng(0).integers(0, 1 << code.bits, 200)
    word = x ^ code.difference[code.at[code.syndrome(x)]]
    assert not code.syndrome(word).any() and np.bitwise_count(word ^ x).max() <= radius
    # Every codeword within radius + what the budget allows is visited, and no other.
    every = np.arange(1 << code.bits)
    every = every[code.syndrome(every) == 0]
    for budget in range(4):
        row, found, left = code.visits(x[:20], np.full(20, budget))
        for i in range(20):
            d = np.bitwise_count(every ^ x[i])
            assert sorted(found[row == i]) == sorted(every[d <= radius + budget] >> code.check)
            assert sorted(left[row == i]) == sorted(budget - np.maximum(d[d <= radius + budget].astype(int) - radius, 0))


def near_fingerprints(rng, n, copies):
    out = []
    for _ in range(n):
        f = rng.getrandbits(64)
        out.append(f)
        for _ in range(rng.randrange(copies)):
            for b in rng.sample(range(64), rng.randrange(6)):
                f ^= 1 << b
            out.append(f)
    return out


@pytest.mark.parametrize("limit", [0, 2, 5000])
def test_links_equal_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "PAIRS", 50)
    rng = random.Random(limit)
    fps = sorted(set(near_fingerprints(rng, 30, 6) + [1 << i for i in range(12)] + [0]))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = S.links(df, limit=limit).collect()
    n = {}
    for r in found:
        n[r.a % (1 << 64)] = n.get(r.a % (1 << 64), 0) + r.n
    assert {f: k for f, k in n.items() if k} == {f: k for f in fps if (k := sum(1 for g in fps if g != f and (f ^ g).bit_count() <= 3))}
    root = {f: f for f in fps}
    find = lambda x: x if root[x] == x else find(root[x])
    for r in found:
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        root[find(a)] = find(b)
    want = {d: c for d, _, c, _ in plain_components([(f, f) for f in fps])}
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(want[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 120, 400]))
        out.append(" ".join(words))
        if len(words) > 100:
            for k in (1, 2):
                words[rng.randrange(len(words))] = "Other"
                out.append("\t".join(words) if k == 1 else "  ".join(words).upper() + " ")
    return out


def test_documents_equal_a_plain_rule(make, monkeypatch):
    monkeypatch.setattr(S, "HASHES", 37)
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(texts(rng, 60))]
    rows += [(1000, rows[0][1]), (900, rows[5][1]), (None, rows[7][1]), (2000, None), (2001, ""), (2002, " \t\n"), (2003, "É é \xa0x"), (2003, "twice"), (None, None)]
    want = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert got(S.near_duplicates(make(rows, extra=True).repartition(5))) == want
    assert len({c for _, _, c, _ in want}) < len(rows) - 5


def test_null_ids_and_empty_tables(make):
    assert got(S.near_duplicates(make([]))) == []
    assert got(S.near_duplicates(make([(None, "only this text here")]))) == [(None, f"{plain_fingerprint('only this text here'):016x}", None, 0)]
    assert got(S.near_duplicates(make([(3, None), (2, ""), (5, "a")])))[0][2] == 2


def test_one_large_group_stays_small(spark):
    """Many fingerprints that all link: rows by members, not by pairs."""
    fps = [0] + [1 << i for i in range(64)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(1)
    found = S.links(df).collect()
    assert sum(r.n for r in found) == 65 * 64 and len(found) < 71 * 65


def test_a_long_text(make):
    text = " ".join(f"w{i % 1000}" for i in range(60_000))
    assert got(S.near_duplicates(make([(1, text), (2, text.upper() + "\n")]))) == plain_components([(1, plain_fingerprint(text)), (2, plain_fingerprint(text))])
