"""op5, op6, op9, op10 and the pipeline: exact round trips and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.llm import jaccard, mixing, repeats, token_store

STRANGE = ["", None, " ", "a  b", "\n\n x", "it's we'll 'sfoo é×é", "日本 語 — x", "<|endoftext|> z", "x" * 30_000, "don't!'s 12ab3_"]


def plain_ids(texts):
    """From the library as it comes."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_store.tokenizer_path())
    return [np.array(library.encode(t or "", add_special_tokens=False).ids, dtype=np.uint32) for t in texts]


def test_encoder_equals_the_library():
    enc = token_store.Encoder.here(token_store.tokenizer_path())
    rng = random.Random(4)
    texts = [t or "" for t in STRANGE] + ["".join(rng.choice(" \n\tabé'stmdrevl0.!_×—") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    assert all(np.array_equal(a, b) for a, b in zip(enc(texts), plain_ids(texts)))


def test_special_tokens_in_texts_are_the_librarys():
    path = token_store.tokenizer_path()
    texts = ["plain words", "a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|> y " + "w " * 50, "<|endoftext|"]
    got = token_store.Encoder.here(path)(texts)
    assert got[1].tolist() == [64, 50256, 65] and all(np.array_equal(a, b) for a, b in zip(got, plain_ids(texts)))
    assert 50256 not in np.concatenate(token_store.Encoder.here(path, literal=True)(texts))


def test_store(make):
    rows = [(i * 3 % 11, t) for i, t in enumerate(STRANGE)] + [(5, "twice"), (5, "twice")]
    got = sorted(token_store.store(make(rows, extra=True)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0
    want = sorted((d, zlib.crc32(np.append(x, 2).astype("<u4").tobytes()), len(x) + 1) for (d, _), x in zip(rows, plain_ids([t for _, t in rows])))
    assert sorted((r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == want


def test_one_doc_id_with_many_texts_is_in_a_fixed_order(make):
    rng = random.Random(6)
    rows = [(rng.choice([None, 4, 4, 4, 9]), " ".join(rng.choices("abcdef", k=rng.randint(0, 9)))) for _ in range(300)]
    key = lambda docs: [tuple(r) for r in token_store.store(docs).orderBy("start").collect()]
    first = key(make(rows))
    rng.shuffle(rows)
    assert first == key(make(rows).repartition(5)) and [r[0] for r in first] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))


def test_store_of_nothing(make):
    assert token_store.store(make([])).count() == 0


@pytest.mark.parametrize("bits", [3, 8, 12])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_any_id_without_decoding_others(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 17, size=n).astype(np.uint32)
    s = token_store.Shard(token_store.pack(ids, [1], np.array([n]), bits))
    assert np.array_equal(s.span(0, n), ids) and len(s) == n
    assert all(s[i] == ids[i] for i in range(0, n, 37))
    cuts = sorted(np.random.default_rng(1).integers(0, n + 1, size=60).tolist())
    assert all(np.array_equal(s.span(a, z), ids[a:z]) for a, z in zip(cuts, cuts[1:]))
    with pytest.raises(IndexError):
        s[n]


def shingles(text, n=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for y in w for x in y.replace("\n", " ").replace("\t", " ").split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = {d: shingles(t, n) for d, t in rows}
    root = {d: d for d in sets}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(seed, n_docs=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.choice([3, 8, 25, 60, 140]))] for _ in range(12)]
    rows = []
    for d in range(n_docs):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 12])):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[word()], [], [w[k], word()]])
            w = w or [word()]
        rows.append((d, " ".join(w + (passage if d % 4 == 0 else []))))
    return rows


@pytest.mark.parametrize("seed,n,percent", [(1, 3, 90), (2, 5, 80), (3, 3, 80), (4, 2, 60)])
def test_jaccard_components(make, monkeypatch, seed, n, percent):
    monkeypatch.setattr(jaccard, "BLOCK", 700)  # so that units are split
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(make(rows, extra=True), n, percent).collect()}
    assert got == brute_components(rows, n, percent)


@pytest.mark.parametrize("seed,n,percent", [(1, 3, 90), (3, 3, 80)])
def test_jaccard_join_gives_every_link(make, monkeypatch, seed, n, percent):
    monkeypatch.setattr(jaccard, "BLOCK", 700)
    rows = near_copies(seed) + [(500, None), (501, "")]
    sets = {}
    for d, text in rows:
        w = (text or "").split()
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else [])
    first = {}
    for d in sorted(sets, reverse=True):
        first[sets[d]] = d
    reps = [(d, x) for x, d in first.items() if x]
    want = {(a, b) for a, x in reps for b, y in reps if a < b and 100 * len(x & y) >= percent * len(x | y)}
    pairs, members = jaccard.similarity_join(make(rows, extra=True), n, percent)
    assert {(r.a, r.b) for r in pairs.collect()} == want and pairs.count() == len(want)
    assert {(r.doc_id, r.rep, r.n_links) for r in members.collect()} == {(d, first[x], sum(first[x] in p for p in want)) for d, x in sets.items() if x}
    assert [t.count() for t in jaccard.similarity_join(make([]), n, percent)] == [0, 0]


def test_jaccard_odd_rows(make):
    rows = [(5, None), (4, ""), (3, "One two"), (2, "one  TWO"), (1, "one"), (7, "one two three"), (7, "one two three"), (6, "one two three"), (None, "one two three"), (8, "w " * 20_000), (9, "w " * 20_000)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(make(rows), 3, 90).collect()), key=repr)
    assert got == sorted([(5, 0, 5), (4, 0, 4), (3, 1, 2), (2, 1, 2), (1, 1, 1), (7, 1, 6), (7, 1, 6), (6, 1, 6), (None, 1, None), (8, 1, 8), (9, 1, 8)], key=repr)
    assert jaccard.components(make([]), 3, 90).count() == 0


def test_a_doc_id_with_several_texts_has_the_links_of_all(make):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(1, a), (5, a + " end"), (5, b + " end"), (2, b), (7, c), (8, b.upper()), (5, text()), (5, ""), (9, c), (7, None), (10, text()), (10, "")]
    for order in (rows, rows[::-1]):
        got = {(r.doc_id, r.component_id) for r in jaccard.components(make(order).repartition(3), 3, 90).collect()}
        assert got == {(1, 1), (2, 1), (5, 1), (8, 1), (7, 7), (9, 7), (10, 10)}


def test_trees_compare_few_pairs_of_a_group_of_copies():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    sets = [np.unique(np.concatenate([base, rng.integers(0, 1 << 63, 5).astype(np.uint64)])) for _ in range(300)]
    t = jaccard.Trees(sets, 90)
    node = t.build(list(range(300)))
    t.join(node, node)
    assert len(t.links) == 299 and t.compared < 2000


@pytest.mark.parametrize("sizes,want", [([100, 100], [150.0, 60.0]), ([10, 0, 1000], None), ([], [])])
def test_targets(sizes, want):
    got = mixing.targets(sizes)
    assert all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes)) and abs(sum(got) - 1.5 * sum(sizes)) < 1e-6
    if sizes == [100, 100]:
        assert [round(x, 3) for x in got] == [200.0, 100.0]


def test_mixing(make):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 900]), None, rng.choice(["hot", "hot", "b", "é", "Z", None])) for i in range(400)] + [(7, None, None, "b"), (8, "x y", None, "b"), (8, "x y", None, "b")]
    docs = make(rows, extra=True)
    out = mixing.mix(docs, block_words=64).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in out)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and own[0].source_size == sum(r.size for r in own)
    key = lambda rs: sorted((r.doc_id, r.size, r.taken) for r in rs)
    assert key(out) == key(mixing.mix(docs.repartition(3), block_words=64).collect())


def plain_mix(rows, block, seed=17):
    """A loop over the keyed order. `rows`: doc_id, source, key, size."""
    names = sorted({r[1] for r in rows}, key=lambda x: (x is None, x or ""))
    sizes = [sum(r[3] for r in rows if r[1] == x) for x in names]
    target = mixing.targets(sizes)
    need = [-(-round(t) // block) for t in target]
    at, slots, place, cum = 0, {}, [0] * len(names), np.cumsum(target)
    for i in range(sum(need)):  # the r-th slot of each source
        sid = min(int(np.searchsorted(cum, (i + 1) * mixing.GOLDEN % 1.0 * cum[-1], "right")), len(names) - 1)
        if place[sid] < need[sid]:
            slots[sid, place[sid]] = i
        place[sid] += 1
    out = []
    for sid, x in enumerate(names):
        at = 0
        for doc, _, key, size in sorted((r for r in rows if r[1] == x), key=lambda r: (r[2] % mixing.BUCKETS, r[2], r[0] is not None, r[0] or 0, r[3])):
            runs = [(a, min(a + size, round(target[sid]))) for a in (at, at + sizes[sid])]
            got = sum(max(0, z - a) for a, z in runs)
            first = slots.get((sid, at // block), sum(need)) if got else None
            out.append((doc, size, sizes[sid], got, x, first))
            at += size
    return sorted(out, key=repr)


def test_mixing_equals_a_plain_loop(make):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3, *range(9, 120)]), " ".join("ab"[k % 2] for k in range(rng.choice([0, 1, 7, 40, 300]))), None, rng.choice(["hot", "hot", "b", "é", None])) for _ in range(250)]
    rows += [(77, "same row here", None, "hot")] * 90
    docs = make(rows, extra=True).repartition(4)
    out = mixing.mix(docs, block_words=64).collect()
    keyed = [tuple(r) for r in mixing.word_counts(docs, 17).collect()]
    got = sorted(((r.doc_id, r.size, r.source_size, r.taken, r.source, r.first_slot) for r in out), key=repr)
    assert got == plain_mix(keyed, 64)


def test_mixing_of_nothing(make):
    assert mixing.mix(make([])).count() == 0
    assert [r.taken for r in mixing.mix(make([(1, None), (2, "")])).collect()] == [0, 0]


def test_schedule_is_even_and_covers_each_slot_once(make):
    docs = make([(i, "w " * 50, None, "ab"[i % 2]) for i in range(200)])
    pieces, _ = mixing.schedule(docs, block_words=50)
    slots = [(r.slot, r.sid) for r in pieces.select("slot", "sid", "r").distinct().orderBy("slot").collect()]
    shares = [sum(s == 0 for _, s in slots[: k + 1]) / (k + 1) for k in range(20, len(slots) - 10, 20)]
    assert max(shares) - min(shares) < 0.1


def brute_repeats(rows, length):
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = {}
    for _, b in raw:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for d, b in raw:
        hit = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                hit[i : i + length] = True
        edge = np.diff(np.concatenate([[0], hit.astype(int)]))
        out.append((d, len(b), int(hit.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~hit[:-1]])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,hot", [(1, 2048), (2, 2048), (3, 4), (4, 1), (5, 1), (6, 20)])
def test_repeats(make, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "SHARD", 40)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PAIRS", [32, 3, 1][seed % 3])
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abc é") for _ in range(n))
    shared = [text(n) for n in (99, 100, 101, 130, 260)]
    rows = [(i, text(rng.randint(0, 150)) + rng.choice(shared) + text(rng.randint(0, 90)) + rng.choice(shared)[: rng.choice([60, 100, 400])]) for i in range(50)]
    rows += [(60, None), (61, ""), (62, text(99)), (63, "a" * 700), (64, "ab" * 300), (65, rows[3][1]), (65, rows[3][1]), (None, rows[4][1]), (66, text(5000))]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(repeats.find_repeats(make(rows, extra=True), 100)).collect()), key=repr)
    assert got == brute_repeats(rows, 100)


def test_places_do_not_grow_with_copies(make):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    places = [repeats.shared_anchors(make([(i if i % 2 else None, text) for i in range(n)] + [(9, text[:3000] + "!" + text[3000:])]).repartition(4), 200).count() for n in (100, 400)]
    assert places[0] == places[1] > 10


@pytest.mark.parametrize("hot", [2048, 30])
def test_a_common_line_and_hundreds_of_copies(make, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage, base = text(60), text(150), text(400)
    rows = [(i, text(80) + line + text(80)) for i in range(120)] + [(200 + i, text(60) + passage + text(60)) for i in range(120)]
    rows += [(400 + i, base[: 200 + i] + "#" + base[200 + i :]) for i in range(0, 90, 3)] + [(None, base)] * 150 + [(7, base)] * 150 + [(8, text(300))]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(repeats.find_repeats(make(rows).repartition(5), 100)).collect()), key=repr)
    assert got == brute_repeats(rows, 100)


def test_repeats_leave_no_tables(make, spark, monkeypatch):
    """Anchors with few places come portion by portion, each in one; of what a step writes
    only runs are left. Before, all windows lay on disk at once, and tables of hot anchors stayed."""
    monkeypatch.setattr(repeats, "HOT", 3)
    parts, kept, write, drop, few = [], set(), repeats.materialize, repeats.drop_table, repeats.repeats

    def table(df):
        out = write(df)
        kept.add((out.inputFiles()[0].rsplit("/", 1)[0], tuple(out.columns)))
        return out

    def dropped(df):
        gone = df.inputFiles()[0].rsplit("/", 1)[0]
        kept.difference_update([x for x in kept if x[0] == gone])
        drop(df)

    def portion(docs, marked, length):
        parts.append({r.h for r in marked.select("h").collect()})
        return few(docs, marked, length)

    for name, f in (("materialize", table), ("drop_table", dropped), ("repeats", portion)):
        monkeypatch.setattr(repeats, name, f)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    x, y = " ".join(words[:300]), " ".join(words[300:360])
    rows = [(1, x), (2, x + "!"), *((10 + i, f"{y} {' '.join(rng.choices(words, k=40))} {y[: 150 + 40 * i]}") for i in range(5))]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(repeats.find_repeats(make(rows).repartition(3), 100)).collect()), key=repr)
    assert got == brute_repeats(rows, 100)
    assert len(parts) == repeats.PORTIONS > 1 and all(parts) and not set.intersection(*parts)
    assert {columns for _, columns in kept} == {("k1", "k2", "lo", "hi")}


def test_repeats_of_nothing(make):
    assert repeats.digest(repeats.find_repeats(make([]))).count() == 0


def test_pipeline(spark, make, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(3)
    word = lambda k: "".join(rng.choice(k) for _ in range(5))
    text = lambda k="abcdefg", n=60: " ".join(word(k) for _ in range(n))
    leak = text(n=30)
    rows = [(i, text(), "en", "s1") for i in range(30)] + [(100, f"{text()} {leak} {text()}", "en", "s2"), (101, "123 !!", "en", "s2"), (102, None, None, None)]
    rows += [(200, rows[0][1] + " end", "en", "s2"), (0, rows[0][1], "en", "s1"), (None, text(), "en", "s1")]
    make(rows).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in p.STAGES:
        docs = p.materialize(stage(spark, docs, str(tmp_path)))
        seen[name] = sorted((r.doc_id for r in docs.collect()), key=repr)
        assert name == "tokens" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 101 not in seen["language"] and 102 not in seen["language"] and len(seen["language"]) == len(rows) - 2
    assert sorted(set(seen["language"]) - set(seen["near_duplicates"]), key=repr) == [200] and len(seen["near_duplicates"]) == 32
    assert set(seen["near_duplicates"]) - set(seen["decontaminate"]) == {100}
    assert set(seen["mix"]) <= set(seen["decontaminate"]) and len(seen["mix"]) > len(seen["decontaminate"])
    assert seen["tokens"] == seen["mix"]


def test_pipeline_of_nothing(spark, make, tmp_path):
    import corpus_pipeline as p

    make([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_pipeline_rows_without_an_id(spark, make, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(5)
    text = lambda n=60: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    leak = text(30)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [text() for _ in range(40)]
    run = lambda stage, rows: stage(spark, p.materialize(make(rows)), str(tmp_path)).collect()

    copied = [(None, clean[0]), (None, clean[0] + " end"), (None, clean[1]), (7, clean[1]), (9, clean[1] + " end"), (None, clean[2]), (None, clean[2]), (None, clean[3])]
    got = run(p.near_duplicates, copied)
    assert len(got) == 4 and {r.text for r in got} - {clean[0], clean[0] + " end"} == {clean[1], clean[2], clean[3]}
    assert [r.doc_id for r in got if r.doc_id is not None] == [7]

    got = run(p.decontaminate, [(None, t) for t in clean] + [(None, f"{text()} {leak} {text()}"), (3, leak), (4, text())])
    assert sorted(r.text for r in got if r.doc_id is None) == sorted(clean) and [r.doc_id for r in got if r.doc_id is not None] == [4]

    got = run(p.mix, [(None, t, "en", "s1") for t in clean])
    times = [sum(r.text == t for r in got) for t in clean]
    assert set(times) == {1, 2} and abs(sum(times) - 60) <= 1


def test_pipeline_mix_gives_each_source_its_words(spark, make, tmp_path):
    """One long document, equal rows, and texts cut after the last word taken."""
    import corpus_pipeline as p

    one = "\t x " + "  \n".join(f"w{i}" for i in range(5000)) + " "
    rows = [(1, one, "en", "a", len(one))] + [(2, "same words here", "en", "b", 15)] * 7 + [(3, "other words", "en", "b", 11), (4, " ", "en", "c", 1), (5, None, "en", None, 0)]
    docs = p.materialize(make(rows))
    got = p.mix(spark, docs, str(tmp_path)).collect()
    want = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    for source in "ab":
        mine = [r for r in got if r.source == source]
        assert abs(sum(len(r.text.split()) for r in mine) - want[source]) <= 1
        assert all(r.n_chars == len(r.text) for r in mine)
    cut = [r.text for r in got if r.source == "a" and r.text != one]
    assert len(cut) <= 1 and all(one.startswith(t) and not t[-1].isspace() for t in cut)
    assert {r.doc_id for r in got} <= {1, 2, 3} and sum(r.text == one for r in got) <= 2


def mirrored_words():
    from test_common import mirrored

    return mirrored()


def test_words_that_polynomial_hashes_confuse(make):
    """Pieces, shingles and counts of the two are told apart, in one task."""
    from scanlake.llm import lm_score

    x, y = mirrored_words()
    got = token_store.store(make([(1, x), (2, y)]).coalesce(1)).orderBy("doc_id").collect()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.append(i, 2).astype("<u4").tobytes()) for i in plain_ids([x, y])]
    rows = [(1, x + " x y"), (2, y + " x y")]
    assert [r.component_id for r in jaccard.components(make(rows), 3, 90).orderBy("doc_id").collect()] == [1, 2]
    scores = {r.doc_id: r.log_score for r in lm_score.score(make([(1, x), (2, y)])).collect()}
    assert scores[1] == scores[2] == pytest.approx(np.log(1 / 2))


@pytest.mark.parametrize("hot", [0, 2048])
def test_strings_that_polynomial_hashes_confuse(make, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    x, y = mirrored_words()
    rng = random.Random(8)
    p, q = ("".join(rng.choices("cdefghij", k=600)) for _ in range(2))
    got = repeats.digest(repeats.find_repeats(make([(1, p + x + q), (2, p + y + q)]), 1500)).collect()
    assert [r.n_removed for r in got] == [0, 0]
    got = repeats.digest(repeats.find_repeats(make([(1, p + x + q), (2, p + x + q[:300])]), 1500)).collect()
    assert sorted(r.n_removed for r in got) == [1924, 1924]
