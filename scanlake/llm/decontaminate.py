"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

Benchmark items are split into blocks of at most BLOCK_BYTES, which is what a
worker holds of them; each block is set against all documents. A first scan counts how
often an item's 3-grams and pairs of neighbouring words occur, and its seeds are chosen
so that they occur least. A second finds seeds in the whole texts, and around each
(widened by the item's length) aligns the words with the item's by Smith-Waterman: match
1, mismatch -1, gap -1. A pair is reported when score / item words >= `similarity`. Texts
are never shuffled and no candidate is capped; left out are those where fewer words are
the item's than the score needs.

Which seeds: say c of an item's 3-grams are not used, the commonest, and let an alignment
of its m words hold no other 3-gram whole, u words unmatched and s matched alone. Its
other runs hold two words each and, all together, c more at most, and an error parts each
run from the next; so the score is at most (m - u - s + c) / 2 + 1, and one that reaches
the similarity has u + s <= 2 + c + (1 - 2 similarity) m. Any other word lies in a whole
pair. So the two pairs around each of one word more than that will do, the rarest. Of all
numbers c the one whose seeds occur least is taken: an opening that thousands of items
share costs two rare pairs for each 3-gram of it. Short items are seeded with all pairs.
For other `seed_words` than 3 (2 seeds with all pairs) there is no such proof, and the
n-grams are the only seeds.

What seeds point at is laid out PLACES at a time and at once united to regions of a text
for an item, so a worker holds regions, not hits.

Words are runs of bytes other than ASCII non-alphanumerics, A-Z lowered, so case
and punctuation don't hide a copy. Items of fewer words than a seed are seeds as a
whole.

Defined cases: null and wordless items and texts match nothing. Repeated items or
documents are reported each, as are rows without an id. Of alignments with the same
score the first in the text is reported. Texts of any length are scanned whole. An
empty benchmark or table gives no rows. Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm.common import LOWER, NOT_ALNUM, ngram_hashes, read, small_batches, span_hashes, text_bytes, trimmed, word_spans

SEED_WORDS = 3
SIMILARITY = 0.5
BLOCK_BYTES = 4 << 20
#: Places of items in texts that are laid out at once, and regions aligned at once.
PLACES = 1 << 20
REGIONS = 2048


def _words(column):
    data, offsets = text_bytes(column)
    starts, ends, first = word_spans(data, offsets, NOT_ALNUM)
    return span_hashes(LOWER[data], starts, ends), first, starts, ends, offsets


def _sums(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the first 0, 1, ... values of each group of n values, and where each
    group's begin."""
    begin = np.cumsum(n + 1) - n - 1
    group = np.repeat(np.arange(len(n)), n + 1)
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[np.arange(len(group)) - group] - total[(begin - np.arange(len(n)))[group]], begin


class Block:
    """Items of a block: their words, and for each n-gram size the sorted seeds
    with the (item, offset) places where each stands."""

    def __init__(self, ids: list, texts: list[str], n: int):
        self.ids = ids
        self.words, self.first, *_ = _words(pa.array(texts, pa.string()))
        self.length = np.diff(self.first)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        #: Of items from which seeds are to be chosen: hash, item and offset of each n-gram.
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({int(min(x, n)) for x in self.length if x}):
            h, item, offset = self._grams(size)
            own = self.length[item] >= n if size == n else self.length[item] == size
            if size == n == 3:
                self.grams[3] = h[own], item[own], offset[own]
                h, item, offset = self._grams(2)
                own = self.length[item] >= 3
                self.grams[2] = h[own], item[own], offset[own]
            else:
                self._index(size, h[own], item[own], offset[own])

    def _grams(self, size):
        h, begin = ngram_hashes(self.words, self.first, size)
        item = np.repeat(np.arange(len(self.ids)), np.diff(begin))
        return h, item, np.arange(len(h)) - begin[item]

    def _index(self, size, h, item, offset):
        """Add seeds to those of this size."""
        if size in self.seeds:
            seeds, at, items, offsets = self.seeds[size]
            h, item, offset = (np.concatenate(x) for x in ((np.repeat(seeds, np.diff(at)), h), (items, item), (offsets, offset)))
        order = np.argsort(h, kind="stable")
        seeds, at = np.unique(h[order], return_index=True)
        self.seeds[size] = seeds, np.append(at, len(h)), item[order], offset[order]

    def choose(self, occurrences: dict[int, np.ndarray], similarity: float) -> Block:
        """Take as seeds the 3-grams and pairs that occur least. `occurrences`: of the
        distinct n-grams of each size, in order."""
        if not self.grams:
            return self
        often = {size: occurrences[size][np.unique(h, return_inverse=True)[1]].astype(np.float64) for size, (h, _, _) in self.grams.items()}
        (_, item3, offset3), (_, item2, offset2) = self.grams[3], self.grams[2]
        inner = np.flatnonzero(offset2 > 0)  # a word with a pair on both sides
        cost = often[2][inner] + often[2][inner - 1]
        common = np.lexsort((offset3, -often[3], item3))
        rare = np.lexsort((offset2[inner], cost, item2[inner]))
        n3, n2 = (np.bincount(x, minlength=len(self.ids)) for x in (item3, item2[inner]))
        left_out, begin3 = _sums(often[3][common], n3)
        added, begin2 = _sums(cost[rare], n2)
        item = np.repeat(np.arange(len(self.ids)), n3 + 1)
        c = np.arange(len(item)) - begin3[item]
        words = np.minimum(np.floor(2 + (1 - 2 * similarity) * self.length + 1e-9).astype(np.int64)[item] + 1 + c, n2[item])
        price = added[begin2[item] + words] - left_out
        best = np.flatnonzero(price == np.minimum.reduceat(price, begin3)[item])
        best = best[np.unique(item[best], return_index=True)[1]]
        rank = np.arange(len(common)) - (np.cumsum(n3) - n3)[item3[common]]
        kept = common[rank >= c[best][item3[common]]]
        self._index(3, *(x[kept] for x in self.grams[3]))
        rank = np.arange(len(rare)) - (np.cumsum(n2) - n2)[item2[inner][rare]]
        chosen = inner[rare[rank < words[best][item2[inner][rare]]]]
        kept = np.unique(np.concatenate([chosen, chosen - 1]))
        self._index(2, *(x[kept] for x in self.grams[2]))
        return self


def blocks(benchmark: DataFrame, n: int):
    """The benchmark's items, a bounded block at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").toLocalIterator():
        if texts and size + len(r.text) > BLOCK_BYTES:
            yield Block(ids, texts, n)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    if texts:
        yield Block(ids, texts, n)


def _find(seeds: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in h whose value is a seed, and which."""
    if not len(seeds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Most n-grams are no seed: a table of 2^20 bits passes few on to the search.
    table = np.zeros(1 << 20, dtype=bool)
    table[(seeds >> np.uint64(44)).astype(np.int64)] = True
    at = np.flatnonzero(table[(h >> np.uint64(44)).astype(np.int64)])
    k = np.minimum(np.searchsorted(seeds, h[at]), len(seeds) - 1)
    hit = seeds[k] == h[at]
    return at[hit], k[hit]


def align(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of many pairs at once; rows of `a` (items) and `b` (texts)
    are padded. Best score and the ends of the alignment in both (exclusive).
    Gaps along `b` come from a running maximum, so a step handles a whole row."""
    n, w = b.shape
    inside = np.arange(w) < b_len[:, None]
    slope = np.arange(w + 1, dtype=np.int32)
    h = np.zeros((n, w + 1), dtype=np.int32)
    best, a_end, b_end = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(a.shape[1]):
        new = np.zeros_like(h)
        step = np.where((b == a[:, i : i + 1]) & inside, 1, -1)
        new[:, 1:] = np.maximum(np.maximum(h[:, :-1] + step, h[:, 1:] - 1), 0)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        new[i >= a_len] = 0
        top = new.argmax(1)
        value = new[np.arange(n), top]
        more = value > best
        best[more], a_end[more], b_end[more] = value[more], i + 1, top[more]
        h = new
    return best, a_end, b_end


def _pad(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in parts])
    out = np.zeros((len(parts), max(int(size.max()), 1)), dtype=np.uint64)
    for row, x in zip(out, parts):
        row[: len(x)] = x
    return out, size


def compare(block: Block, pairs: list[tuple[int, int, np.ndarray]]) -> list[tuple[float, int, int, int]]:
    """For each (item, place, words around it): score, and where in the words the
    alignment begins and ends. The beginning comes from the reversed alignment."""
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][2]), block.length[pairs[i][0]]))
    at = 0
    while at < len(order):
        widest = max(1, len(pairs[order[min(at + 63, len(order) - 1)]][2]))
        some = order[at : at + max(1, min(64, (1 << 21) // widest))]
        at += len(some)
        items = [block.words[block.first[pairs[i][0]] : block.first[pairs[i][0] + 1]] for i in some]
        a, al = _pad(items)
        b, bl = _pad([pairs[i][2] for i in some])
        score, ae, be = align(a, b, al, bl)
        ra, ral = _pad([x[:e][::-1] for x, e in zip(items, ae)])
        rb, rbl = _pad([pairs[i][2][:e][::-1] for i, e in zip(some, be)])
        _, _, back = align(ra, rb, ral, rbl)
        for i, s, e, k in zip(some, score.tolist(), be.tolist(), back.tolist()):
            out[i] = (s, e - k, e)
    return out


def _occurrences(docs: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """How often each distinct 3-gram and pair of the block occurs: as many numbers as
    the block, of bounded bytes, has of them."""
    grams = {size: np.unique(h) for size, (h, _, _) in block.grams.items()}
    if not grams:
        return {}

    def count(batches):
        total = {size: np.zeros(len(g), dtype=np.int64) for size, g in grams.items()}
        for b in batches:
            words, first, *_ = _words(b.column(0))
            for size, g in grams.items():
                total[size] += np.bincount(_find(g, ngram_hashes(words, first, size)[0])[1], minlength=len(g))
        for size, n in total.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), size)), pa.array(k), pa.array(n[k])], ["size", "k", "n"])

    out = {size: np.zeros(len(g), dtype=np.int64) for size, g in grams.items()}
    rows = docs.select(F.col("text").cast("string")).mapInArrow(trimmed(count), "size long, k long, n long")
    for r in rows.groupBy("size", "k").agg(F.sum("n").alias("n")).collect():
        out[r["size"]][r.k] = r.n
    return out


def _unite(owner: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Regions (of an item in a text) no further apart than the item is long are one."""
    order = np.lexsort((lo, item, owner))
    owner, item, lo, hi = owner[order], item[order], lo[order], hi[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])])[: len(owner)]
    far = np.cumsum(new) << 40
    top = np.maximum.accumulate(hi + far) - far
    new[1:] |= lo[1:] - top[:-1] > length[item[1:]]
    at = np.flatnonzero(new)
    return owner[at], item[at], lo[at], top[np.append(at[1:], len(lo)) - 1] if len(at) else hi


def regions(block: Block, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, item, and between which words the item would begin, by its seeds."""
    out = tuple(np.zeros(0, np.int64) for _ in range(4))
    for size, (seeds, at, items, offsets) in block.seeds.items():
        h, begin = ngram_hashes(words, first, size)
        hit, k = _find(seeds, h)
        n = at[k + 1] - at[k]
        total = np.cumsum(n)
        i = 0
        while i < len(hit):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PLACES, "right")))
            m = n[i:j]
            where = np.repeat(at[k[i:j]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            where_in_text = np.repeat(hit[i:j], m)
            owner = np.searchsorted(begin, where_in_text, "right") - 1
            place = where_in_text - begin[owner] - offsets[where]
            out = _unite(*(np.concatenate(x) for x in zip(out, (owner, items[where], place, place))), block.length)
            i = j
    return out


def find(docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, score, byte_from, byte_to: for each document
    and item the best alignment that reaches `similarity`."""
    spark = docs.sparkSession
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, score int, byte_from long, byte_to long"
    out = spark.createDataFrame([], schema)
    rows = docs.select("doc_id", F.col("text").cast("string"))
    for block in blocks(benchmark, seed_words):
        small_batches(spark, 1000, "4m")
        out = out.unionByName(rows.mapInArrow(trimmed(_search(block.choose(_occurrences(docs, block), similarity), similarity, benchmark.schema["item_id"])), schema))
    return out


def _search(block: Block, similarity: float, field):
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(field.dataType)

    def run(batches):
        for b in batches:
            words, first, starts, ends, offsets = _words(b.column(1))
            owner, item, lo, hi = regions(block, words, first)
            m = block.length[item]
            # An alignment that reaches the similarity spends at most m gaps.
            begin, end = np.maximum(first[owner], first[owner] + lo - m), np.minimum(first[owner + 1], first[owner] + hi + 2 * m)
            best: dict = {}
            for i in range(0, len(owner), REGIONS):
                pairs, who = [], []
                for d, t, a, z in zip(*(x[i : i + REGIONS].tolist() for x in (owner, item, begin, end))):
                    own = block.words[block.first[t] : block.first[t + 1]]
                    if np.isin(words[a:z], own).sum() >= similarity * len(own):
                        pairs.append((t, a, words[a:z]))
                        who.append(d)
                for (t, a, _), d, (s, x, y) in zip(pairs, who, compare(block, pairs)):
                    if s >= similarity * block.length[t] and s > best.get((d, t), (0,))[0]:
                        best[d, t] = s, starts[a + x] - offsets[d], ends[a + y - 1] - offsets[d]
            keys = list(best)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array([d for d, _ in keys], pa.int64())), pa.array([block.ids[t] for _, t in keys], item_type),
                    pa.array([best[k][0] / float(block.length[k[1]]) for k in keys], pa.float64()), pa.array([best[k][0] for k in keys], pa.int32()),
                    pa.array([int(best[k][1]) for k in keys], pa.int64()), pa.array([int(best[k][2]) for k in keys], pa.int64()),
                ],
                ["doc_id", "item_id", "similarity", "score", "byte_from", "byte_to"],
            )

    return run


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
