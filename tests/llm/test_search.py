"""op4, op8: recall against brute force, planted passages, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.llm import decontaminate, neighbours

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)


def brute(rows, query, k):
    q = np.array(dict(rows)[query], dtype=float)
    s = sorted((-float(np.dot(q, np.array(v, dtype=float))), i) for i, v in rows if i != query)
    return [i for _, i in s[:k]]


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(600)]
    out = neighbours.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=10, recall=0.95).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = [len(set(found[q]) & set(brute(rows, q, 10))) for q in range(0, 600, 20)]
    assert sum(hits) >= 0.9 * 10 * 30 and all(len(v) == 10 and q not in v for q, v in found.items())
    for r in out[:50]:
        assert r.score == pytest.approx(float(np.dot(dict(rows)[r.query_id], dict(rows)[r.vec_id])), abs=1e-12)


def test_split_groups_and_leaves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 40)
    monkeypatch.setattr(neighbours, "ASKED", 3)
    rng = np.random.default_rng(4)
    near = rng.normal(size=6)
    rows = [(i, (near + 1e-3 * rng.normal(size=6) if i % 3 else rng.normal(size=6)).tolist()) for i in range(500)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    out = neighbours.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=10, recall=1.0).collect()
    found = {q: {r.vec_id for r in out if r.query_id == q} for q in range(0, 500, 20)}
    assert all(len(v) == 10 for v in found.values()) and len(out) == 250
    assert sum(len(found[q] & set(brute(rows, q, 10))) for q in found) >= 0.9 * 250


def test_a_bounded_sample_and_all_rows_as_queries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(400)]
    out = neighbours.search(vectors(spark, rows), F.col("vec_id") >= 0, k=5, fit_rows=50).collect()
    hits = sum(r.vec_id in brute(rows, r.query_id, 5) for r in out)
    assert len(out) == 2000 and hits >= 0.85 * 2000


def test_unusable_vectors_and_copies(spark):
    same = [1.0, 2.0]
    rows = [(0, same), *((i, same) for i in range(1, 60)), (100, [0.0, 0.0]), (120, None), (140, [1.0, None]), (160, [float("nan"), 1.0]), (180, [float("inf"), 1.0]), (200, [1.0, 2.0, 3.0]), (61, [0.5, 0.5])]
    out = neighbours.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in out} == {0, 20, 40}
    first = sorted((r.rank, r.vec_id) for r in out if r.query_id == 20)
    assert [v for _, v in first] == [i for i in range(21) if i != 20] and [r for r, _ in first] == list(range(1, 21))


def test_few_or_no_vectors(spark):
    assert neighbours.search(vectors(spark, []), F.lit(True)).count() == 0
    out = neighbours.search(vectors(spark, [(0, [1.0]), (1, [2.0])]), F.lit(True)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in out) == [(0, 1, 1), (1, 1, 0)]


def item(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, make):
    rng = np.random.default_rng(2)
    items = [item(rng, n) for n in (20, 45, 2)]
    filler = lambda: item(rng, 80)
    edited = items[1].split()
    edited[10], edited[30] = "other", "words"
    docs = [
        (0, f"{filler()} {items[0]} {filler()}"), (1, f"{filler()}\n{items[0].upper().replace(' ', ', ')}! {filler()}"), (2, " ".join(edited)), (3, f"{filler()} {' '.join(items[1].split()[:10])} {filler()}"),
        (4, filler()), (5, None), (6, ""), (7, items[2]), (8, f"{filler()} {items[0]}"), (8, f"{filler()} {items[0]}"), (9, (filler() + " ") * 300 + items[1]),
    ]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(9, None, "x"), (10, "", "x")], "item_id long, text string, score string")
    return decontaminate.find(make(docs, extra=True), bench).collect()


def test_planted_passages_are_found(planted):
    assert sorted((r.doc_id, r.item_id) for r in planted) == [(0, 0), (1, 0), (2, 1), (7, 2), (8, 0), (8, 0), (9, 1)]
    assert {r.similarity for r in planted if r.item_id == 0} == {1.0} and all(0.8 < r.similarity < 1 for r in planted if r.doc_id == 2)


def test_spans_hold_the_passage(planted):
    r = next(r for r in planted if r.doc_id == 0)
    assert r.byte_to - r.byte_from == 20 * 6 - 1


def test_the_first_of_equal_alignments_and_rows_without_ids(spark, make):
    rng = np.random.default_rng(6)
    x, far = item(rng, 12), item(rng, 200)
    rows = [(1, f"{x} {far} {x}"), (None, x), (None, x), (None, None), (2, f"{far} {x} {far} {x[:40]}")]
    bench = spark.createDataFrame([(1, x), (None, x)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.similarity, r.byte_from, r.byte_to) for r in decontaminate.find(make(rows), bench).collect()), key=repr)
    n, m = len(x), len(far) + 1
    want = [(d, t, 1.0, a, a + n) for t in (1, None) for d, a in ((1, 0), (None, 0), (None, 0), (2, m))]
    assert got == sorted(want, key=repr)


def test_nothing_to_compare(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(make([(1, "a b c")]), none).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.find(make([]), some).count() == 0


def test_blocks_of_items(spark, make, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 30)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(6))) for i in range(5)]
    out = decontaminate.find(make(items), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == [(i, i) for i in range(5)]


def test_alignment_of_words():
    a, b = np.array([[1, 2, 3, 4]], dtype=np.uint64), np.array([[9, 1, 2, 8, 3, 4, 9]], dtype=np.uint64)
    score, ae, be = decontaminate.align(a, b, np.array([4]), np.array([7]))
    assert (score[0], ae[0], be[0]) == (3, 4, 6)


def test_dense_edits_against_alignment_of_all_pairs(spark, make):
    rng = np.random.default_rng(7)
    items = [item(rng, n).split() for n in (40, 40, 24, 9, 6, 5, 4, 3)]
    docs = []
    for w in items:
        docs.append(["edit" if i % 4 == 3 else x for i, x in enumerate(w)])
        for every in (2, 3):
            docs.append([y for i, x in enumerate(w) for y in ([x, f"new{i}"] if i % every == every - 1 else [x])])
        for _ in range(12):
            p, out = rng.choice([0.1, 0.2, 0.3, 0.4]), []
            for i, x in enumerate(w):
                out += [[x], ["edit"], [], [x, f"new{i}"]][int(rng.choice(4, p=[1 - p, p / 4, p / 4, p / 2]))]
            docs.append(out)
    docs += [item(rng, 30).split() for _ in range(20)]
    # Most pairs of items 0 are common, so that few are rare.
    docs += [items[0][i : i + 7] for i in range(0, 33, 3)] * 2
    code = {}
    number = lambda w: np.array([[code.setdefault(x, len(code) + 1) for x in w]], dtype=np.uint64)
    want = set()
    for d, w in enumerate(docs):
        for t, x in enumerate(items):
            if w and decontaminate.align(number(x), number(w), np.array([len(x)]), np.array([len(w)]))[0][0] >= 0.5 * len(x):
                want.add((d, t))
    bench = spark.createDataFrame([(t, " ".join(x)) for t, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(make([(d, " ".join(w)) for d, w in enumerate(docs)]), bench).collect()}
    assert got == want and len(want) > 60


def test_an_opening_that_many_items_share(spark, make, monkeypatch):
    """Its 3-grams are no seeds, and all alignments are found still."""
    monkeypatch.setattr(decontaminate, "PLACES", 100)
    monkeypatch.setattr(decontaminate, "REGIONS", 3)
    rng = np.random.default_rng(8)
    opening = "which of the following is the best".split()
    items = [opening + item(rng, int(rng.integers(3, 12))).split() for _ in range(40)] + [opening, opening[:3], opening[:2]]
    docs = [opening * 30 + item(rng, 20).split() for _ in range(5)]
    for w in items[:20]:
        keep = rng.random(len(w)) < 0.8
        docs.append(item(rng, 5).split() + [x for x, k in zip(w, keep) if k] + item(rng, 5).split())
        docs.append([y for i, x in enumerate(w) for y in ([x, "new"] if i % 3 == 2 else [x])])
        docs.append(w[len(w) // 2 :] + item(rng, 9).split())
    code = {}
    number = lambda w: np.array([[code.setdefault(x, len(code) + 1) for x in w]], dtype=np.uint64)
    want = {
        (d, t) for d, w in enumerate(docs) for t, x in enumerate(items)
        if decontaminate.align(number(x), number(w), np.array([len(x)]), np.array([len(w)]))[0][0] >= (0.5 if len(x) > 2 else 1) * len(x)
    }
    bench = spark.createDataFrame([(t, " ".join(x)) for t, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(make([(d, " ".join(w)) for d, w in enumerate(docs)]), bench).collect()}
    assert got == want and len(want) > 200


def test_seeds_of_a_shared_opening_are_few():
    """Places laid out grow with items and hits of rare seeds, not with their product."""
    rng = np.random.default_rng(9)
    opening = "which of the following"
    items = [f"{opening} {item(rng, 20)}" for _ in range(500)]
    block = decontaminate.Block(list(range(500)), items, 3)
    import pyarrow as pa

    text = " ".join(f"{opening} {item(rng, 3)}" for _ in range(2000)) + " " + items[7]
    words, first, *_ = decontaminate._words(pa.array([text]))
    counts = {}
    for size, (h, _, _) in block.grams.items():
        g = np.unique(h)
        counts[size] = np.bincount(decontaminate._find(g, decontaminate.ngram_hashes(words, first, size)[0])[1], minlength=len(g))
    block.choose(counts, 0.5)
    laid = 0
    for size, (seeds, at, _, _) in block.seeds.items():
        _, k = decontaminate._find(seeds, decontaminate.ngram_hashes(words, first, size)[0])
        laid += int((at[k + 1] - at[k]).sum())
    owner, found, lo, hi = decontaminate.regions(block, words, first)
    assert laid < 3000 and 7 in found.tolist()
