"""SimHash near duplicates, found at the anchors of a covering code.

A document's fingerprint has the bits that more than half of its shingles' hashes
have set. Fingerprints link when at most `THRESHOLD` bits differ. Equal fingerprints
are one class; links are sought between classes.

Anchors are codewords. The 64 bits are the direct sum of four perfect cyclic codes,
of 23, 23, 15 and 3 bits and radius 3, 3, 1 and 1 (two Golay codes, a Hamming code
and a repetition code), so each pattern of a part lies within the radius of exactly
one codeword: the fingerprint's home. A fingerprint whose parts differ from another's
in e1 + e2 + ... <= THRESHOLD bits lies within radius + e of the other's home in each
part, so every fingerprint visits all anchors whose distances exceed the radii by
THRESHOLD together at most, and each link is found at the homes of both its ends. Only
homes are compared with visitors, never visitors with each other.

The code's first part alone gives 4,096 anchors and 71 visits a fingerprint. Anchors
that are home to more than LIMIT fingerprints are told apart by the next part also
(24 bits of anchor, about 300 visits), and so on. How many live where is counted
beforehand. LIMIT grows beyond 2^20 times itself, so at most 2^20 anchors are named
to the tasks.

A task reads its anchors sorted, homes first, and holds the homes of one anchor and a
batch of visitors. It hands on how many links each home has and a tree of what is
linked, not the pairs, so a group of near copies costs rows by its members.

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lowered.

Defined cases: null or wordless text: fingerprint zero, linked like any other; fewer
words than a shingle: the whole sequence is one. Rows are nodes: those that repeat a
doc_id each have their own text's links. A null doc_id takes part and is no component's
name, which is null where no row of it has one. Texts of any length are taken whole,
their hashes a slice at a time. An empty table gives no rows. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm.common import LOWER, SPACE, drop_table, materialize, read, small_batches, text_bytes, trimmed, word_spans
from scanlake.operators.components import connected_components, smallest_labels

SEED = 42
SHINGLE = 3
THRESHOLD = 3
#: Fingerprints at home at an anchor before the code's next part parts them.
LIMIT = 2048
#: Hashes, fingerprints' visits and pairs that a step holds.
HASHES = 1 << 16
PAIRS = 1 << 21


def shingles(column, n: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered texts with one space between words; begin and end of every shingle in
    them; and each text's first shingle (one more value than texts)."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_spans(data, offsets)
    low, kept = LOWER[data], ~SPACE[data]
    parted = np.ones(len(starts), dtype=bool)
    parted[first[1:][np.diff(first) > 0] - 1] = False  # a text's last word
    low[ends[parted]] = 0x20
    kept[ends[parted]] = True
    length = ends - starts
    begin_of_word = np.cumsum(length + parted) - length - parted
    words = np.diff(first)
    m = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    begin = np.concatenate([[0], np.cumsum(m)])
    at = np.repeat(first[:-1] - begin[:-1], m) + np.arange(begin[-1])
    last = at + np.repeat(np.minimum(words, n) - 1, m)
    return low[kept].tobytes(), begin_of_word[at], begin_of_word[last] + length[last], begin


def fingerprint(column, n: int = SHINGLE) -> np.ndarray:
    import xxhash

    raw, a, z, begin = shingles(column, n)
    size = np.diff(begin)
    held = np.flatnonzero(size)
    starts = begin[held]
    counts = np.zeros((len(size), 64), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for s in range(0, len(a), HASHES):
        e = min(s + HASHES, len(a))
        h = np.fromiter((digest(raw[i:j], SEED) for i, j in zip(a[s:e].tolist(), z[s:e].tolist())), dtype="<u8", count=e - s)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = int(np.searchsorted(starts, s, "right")) - 1, int(np.searchsorted(starts, e, "left"))
        counts[held[lo:hi]] += np.add.reduceat(bits, np.maximum(starts[lo:hi], s) - s, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of every row."""
    small_batches(docs.sparkSession, 1000, "4m")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprint(b.column(1), n).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), "doc_id long, fp long")


class Code:
    """A perfect cyclic code of `bits` bits and some radius. Codewords are the multiples
    of the generator polynomial; their number is their bits above its degree."""

    def __init__(self, bits: int, generator: int, radius: int, beyond: int):
        self.bits, self.check = bits, generator.bit_length() - 1
        self.words = bits - self.check
        self.remainder = []
        r = 1
        for _ in range(bits):
            self.remainder.append(r)
            r <<= 1
            if r >> self.check:
                r ^= generator
        # All differences up to radius + beyond, by syndrome and weight.
        weight = [np.zeros(1, np.int64)]
        while len(weight) <= min(radius + beyond, bits):
            weight.append(np.concatenate([weight[-1][weight[-1] < 1 << i] | 1 << i for i in range(bits)]))
        v, excess = np.concatenate(weight), np.repeat(np.maximum(np.arange(len(weight)) - radius, 0), [len(w) for w in weight])
        s = self.syndrome(v)
        order = np.lexsort((excess, s))
        self.difference, self.excess, s = v[order], excess[order], s[order]
        self.at = np.searchsorted(s, np.arange(1 << self.check))
        # For each syndrome and excess, how many differences have that excess at most.
        by_excess = np.zeros((1 << self.check, beyond + 1), np.int64)
        np.add.at(by_excess, (s, self.excess), 1)
        self.within = np.cumsum(by_excess, axis=1)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for i, r in enumerate(self.remainder):
            out ^= (x >> i & 1) * r
        return out

    def home(self, x: np.ndarray) -> np.ndarray:
        return (x ^ self.difference[self.at[self.syndrome(x)]]) >> self.check

    def visits(self, x: np.ndarray, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, codeword and what is left of the budget, of all codewords within reach."""
        s = self.syndrome(x)
        n = self.within[s, budget]
        row = np.repeat(np.arange(len(x)), n)
        which = np.repeat(self.at[s] - np.cumsum(n) + n, n) + np.arange(len(row))
        return row, (x[row] ^ self.difference[which]) >> self.check, budget[row] - self.excess[which]


def codes(threshold: int = THRESHOLD) -> list[Code]:
    # Fixed: length, generator polynomial and radius of the codes.
    return [Code(*c, threshold) for c in ((23, 0xC75, 3), (23, 0xC75, 3), (15, 0x13, 1), (3, 0x7, 1))]


def _parts(fp: np.ndarray, parts: list[Code]) -> list[np.ndarray]:
    bits, out, at = fp.view(np.uint64), [], 0
    for code in parts:
        out.append((bits >> np.uint64(at) & np.uint64((1 << code.bits) - 1)).astype(np.int64))
        at += code.bits
    return out


def homes(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """p1 to p4: the number of each fingerprint's home, by one part of the code and more."""

    def run(batches):
        parts = codes(threshold)
        for b in batches:
            prefix, cols = np.zeros(b.num_rows, np.int64), []
            for code, x in zip(parts, _parts(b.column(0).to_numpy(), parts)):
                prefix = prefix << code.words | code.home(x)
                cols.append(pa.array(prefix))
            yield pa.RecordBatch.from_arrays(cols, ["p1", "p2", "p3", "p4"])

    return fps.select("fp").mapInArrow(trimmed(run), "p1 long, p2 long, p3 long, p4 long")


def crowded(fps: DataFrame, limit: int, threshold: int = THRESHOLD) -> list[np.ndarray]:
    """By part, the anchors that are home to more than `limit` fingerprints, ascending.
    They number at most fingerprints / limit."""
    rows, out = homes(fps, threshold), []
    for p in ("p1", "p2", "p3"):
        hot = [r[0] for r in rows.groupBy(p).count().filter(F.col("count") > limit).select(p).collect()]
        out.append(np.sort(np.array(hot, dtype=np.int64)))
        if not hot:
            break
        named = fps.sparkSession.createDataFrame([(x,) for x in hot], f"{p} long")
        rows = rows.join(named, p)
    return out + [np.zeros(0, np.int64)] * (4 - len(out))


def visits(fps: DataFrame, hot: list[np.ndarray], threshold: int = THRESHOLD) -> DataFrame:
    """anchor, visitor (false at home), fp."""

    def run(batches):
        parts = codes(threshold)
        for b in batches:
            fp = b.column(0).to_numpy()
            for i in range(0, len(fp), 256):
                some = fp[i : i + 256]
                row, prefix, budget = np.arange(len(some)), np.zeros(len(some), np.int64), np.full(len(some), threshold)
                for level, (code, x) in enumerate(zip(parts, _parts(some, parts))):
                    back, word, left = code.visits(x[row], budget)
                    row, prefix, budget = row[back], prefix[back] << code.words | word, left
                    on = np.isin(prefix, hot[level]) if len(hot[level]) else np.zeros(len(row), dtype=bool)
                    here = ~on
                    yield pa.RecordBatch.from_arrays([pa.array(prefix[here] | level << 40), pa.array(budget[here] < threshold), pa.array(some[row[here]])], ["anchor", "visitor", "fp"])
                    row, prefix, budget = row[on], prefix[on], budget[on]
                    if not len(row):
                        break

    return fps.select("fp").mapInArrow(trimmed(run), "anchor long, visitor boolean, fp long")


def compare(anchor: np.ndarray, visitor: np.ndarray, fp: np.ndarray, old: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by anchor, homes first: the fingerprints that link, each with its
    tree's smallest, and its number of links if it is at home. The first `old` rows are
    homes that have been compared with each other before."""
    cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    segment = np.cumsum(np.concatenate([[0], (anchor[1:] != anchor[:-1]).astype(np.int64)]))
    n_homes = np.add.reduceat((~visitor).astype(np.int64), cut)
    n = n_homes[segment]  # homes that each row meets
    first = cut[segment]
    total = np.cumsum(n)
    n_links = np.zeros(len(fp), dtype=np.int64)
    node = tree = np.zeros(0, np.int64)
    i = 0
    while i < len(fp):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
        row = np.repeat(np.arange(i, j), n[i:j])
        home = np.repeat(first[i:j] - np.cumsum(n[i:j]) + n[i:j], n[i:j]) + np.arange(len(row))
        near = np.bitwise_count(fp[row].view(np.uint64) ^ fp[home].view(np.uint64)) <= threshold
        near &= (row != home) & ~((row < old) & (home < old))
        row, home = row[near], home[near]
        np.add.at(n_links, home, 1)
        if len(row):
            node, tree = smallest_labels(np.concatenate([node, fp[row]]), np.concatenate([tree, fp[home]]))
        i = j
    linked = np.flatnonzero(n_links)
    return np.concatenate([node, fp[linked]]), np.concatenate([tree, fp[linked]]), np.concatenate([np.zeros(len(node), np.int64), n_links[linked]])


def links(fps: DataFrame, limit: int = LIMIT, threshold: int = THRESHOLD) -> DataFrame:
    """a, b, n: trees over all that links (b is smaller, or a itself), and numbers of
    links, to be added up by a. `fps`: fp, each once."""
    small_batches(fps.sparkSession, 1 << 16, "8m")
    hot = crowded(fps, max(limit, fps.count() >> 20), threshold)

    def run(batches):
        held = None
        for b in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(rows[0]):
                continue
            old = 0
            if held is not None and held[0][0] == rows[0][0]:
                old = len(held[0])
                rows = [np.concatenate(x) for x in zip(held, rows)]
            a, link, n = compare(*rows, old, threshold)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(link), pa.array(n)], ["a", "b", "n"])
            at_home = (rows[0] == rows[0][-1]) & ~rows[1]
            held = [c[at_home] for c in rows] if at_home.any() else None

    placed = visits(fps, hot, threshold).repartition("anchor").sortWithinPartitions("anchor", "visitor")
    return placed.mapInArrow(trimmed(run), "a long, b long, n long")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, threshold: int = THRESHOLD, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint, component_id, n_links (with how many other fingerprints its
    own links) of every row."""
    rows = materialize(fingerprints(docs, n))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = materialize(links(classes, limit, threshold))
    label = connected_components(found.select("a", "b"))
    counts = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("n_links"))
    linked = materialize(classes.join(label, F.col("fp") == F.col("node")).select("fp", "label", "least"))
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = linked.drop("least").join(least, "label").join(counts, F.col("fp") == F.col("a")).select("fp", "component_id", "n_links")
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    named = materialize(named)
    drop_table(found)
    out = rows.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
