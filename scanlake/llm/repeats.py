"""Repeated strings: every byte that lies in a string of `length` bytes which also
starts elsewhere, found with suffix arrays of what surrounds shared anchors.

Of each run of W = length - K + 1 consecutive K-byte grams the one of smallest hash
is an anchor; equal strings of `length` bytes hold equal anchors at equal places. So
only suffixes at anchors are compared, and only of grams that occur more than once:
a sparse suffix array. Around an anchor lies a window of W - 1 bytes before it and
`length` from it on, and equal windows of a batch are one row.

Windows meet by anchor, in shards of whole anchor groups. A shard has two suffix
arrays: of what follows the anchors, and of what precedes them, read backwards.
Both are built by Larsson-Sadakane refinement (ranks of 8 bytes, then of pairs of
ranks, doubling). Neighbours' common prefixes give, as the least of those between, the
common prefix of any two, and the classes of suffixes that agree for d bytes. A string
that starts o bytes before its anchor equals another just if the two agree in o bytes
backwards and length - o forwards: small groups are settled by pairs, others by classes.

An anchor with more than HOT places is in no shard. Its windows are counted by a
128-bit hash, equal ones of a batch as one: one that occurs twice is repeated
throughout, and one of each kind goes on. Of RANGE neighbouring offsets the strings share some bytes and cover others: if no
other window shares the former, none of them is repeated; if one shares the latter,
all are; what is left is told apart by the hash of each string. So no window meets all
others of its anchor in one task, and results come back by joins whose other side is
unique.

Equal texts are one text, named by 128 bits of its hash: each task passes one on, and
one of `length` bytes or more that occurs twice is repeated throughout. Places are
thus in proportion to distinct texts, however often they are repeated.

Defined cases: null text: no bytes, nothing removed. Texts shorter than `length`
lose nothing. Rows that repeat, with one doc_id, several or none, are copies of one
another. Texts of any length are whole; one is held by one task. Windows that tie in
all bytes are one. An empty table gives no rows. Other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import gc
import hashlib
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm.common import BYTE, CHUNK, drop_table, materialize, mix64, powers, read, signed, small_batches, text_bytes, trimmed

GRAM = 32
#: Windows of a shard, or a few more: those of an anchor stay together.
SHARD = 8192
#: Places of an anchor beyond which its windows are compared by hashes.
HOT = 2048
#: Windows of a group that is settled by pairs.
PAIRS = 32
#: Portions of the anchors with few places, one after another, so that the windows of
#: one only lie on disk at a time. An anchor is in one portion.
PORTIONS = 2
#: Offsets that are told apart together there.
RANGE = 21
#: Bytes whose sums are made at once, so that they stay near the processor.
STEP = 1 << 15
MIXER = np.uint64(0x9E3779B97F4A7C15)
#: Texts that a task knows to have passed on.
KNOWN = 1 << 18


def _sliding(f, v: np.ndarray, w: int) -> np.ndarray:
    """f over each run of w values, by doubling."""
    n, m = 1, v
    while 2 * n <= w:
        m = f(m[: len(m) - n], m[n:])
        n *= 2
    size = len(v) - w + 1
    return m[:size] if n == w else f(m[:size], m[w - n : w - n + size])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors and their grams' hashes; grams lie in one text."""
    w = length - gram + 1
    at, hashes = [], []
    step = max(CHUNK, 4 * length)
    for a in range(0, max(len(data) - gram + 1, 0), step):
        lo, hi = max(0, a - w + 1), min(len(data), a + step + w + gram)
        part = data[lo:hi]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(BYTE[part] * powers(len(part)), out=sums[1:])
        v = mix64((sums[gram:] - sums[:-gram]) * powers(len(part) - gram + 1, True))
        edges = offsets[(offsets > lo) & (offsets < hi)] - lo
        crossing = np.zeros(len(v) + 1, dtype=np.int32)
        np.add.at(crossing, np.maximum(edges - gram + 1, 0), 1)
        np.add.at(crossing, np.minimum(edges, len(v)), -1)
        crossing = np.cumsum(crossing[:-1]) > 0
        v[crossing] = ~np.uint64(0)
        low = _sliding(np.minimum, np.concatenate([np.full(w - 1, ~np.uint64(0)), v, np.full(w - 1, ~np.uint64(0))]), w)
        chosen = (_sliding(np.maximum, low, w) == v) & ~crossing
        chosen[: a - lo] = False
        chosen[a + step - lo :] = False
        p = np.flatnonzero(chosen)
        at.append(p + lo)
        hashes.append(v[p])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(at), np.concatenate(hashes)


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].reshape(x.shape).astype(np.int64)


def suffix_order(group: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Rows in order of (group, context bytes): a suffix array by refinement. Ranks
    of 8-byte words are refined to ranks of pairs until one rank spans the row."""
    words = np.pad(context, ((0, 0), (0, -context.shape[1] % 8))).reshape(-1).view(">u8").reshape(len(context), -1)
    rank = _ranks(words.astype(np.uint64))
    while rank.shape[1] > 1:
        if rank.shape[1] % 2:
            rank = np.hstack([rank, np.zeros((len(rank), 1), np.int64)])
        rank = _ranks(rank[:, ::2] * (int(rank.max()) + 1) + rank[:, 1::2])
    return np.lexsort((rank[:, 0], group))


def common_prefixes(order: np.ndarray, group: np.ndarray, context: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes that each row of the order shares with the one before; -1 across groups."""
    out = np.full(len(order), -1, dtype=np.int32)
    a, b = order[1:], order[:-1]
    differ = context[a] != context[b]
    same = np.where(differ.any(1), differ.argmax(1), context.shape[1])
    out[1:] = np.where(group[a] == group[b], np.minimum(same, np.minimum(size[a], size[b])), -1)
    return out


class Least:
    """The least value of any stretch, from those of stretches of powers of two."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while 2 * (n := 1 << (len(self.levels) - 1)) <= len(x):
            self.levels.append(np.minimum(self.levels[-1][:-n], self.levels[-1][n:]))

    def __call__(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Of a to z, both included."""
        k = np.frexp((z - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=self.levels[0].dtype)
        for level in np.unique(k):
            own = k == level
            out[own] = np.minimum(self.levels[level][a[own]], self.levels[level][z[own] - (1 << level) + 1])
        return out


def repeated(group: np.ndarray, before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Row i, column o: whether the string that starts o bytes before anchor i also
    starts elsewhere. `before` is read backwards from the anchor; groups ascend."""
    n, length, widest = len(group), after.shape[1], before.shape[1]
    order_b, order_f = suffix_order(group, before), suffix_order(group, after)
    shared_b, shared_f = common_prefixes(order_b, group, before, n_before), common_prefixes(order_f, group, after, n_after)
    # The most that a row shares with any other, on each side.
    most_b, most_f = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    for most, order, shared in ((most_b, order_b, shared_b), (most_f, order_f, shared_f)):
        most[order] = np.maximum(shared, np.append(shared[1:], -1))
    edges = np.zeros((n, widest + 2), dtype=np.int32)  # +1 where a run of offsets begins, -1 after it

    def add(rows, first, last):
        some = first <= last
        np.add.at(edges, (rows[some], first[some]), 1)
        np.add.at(edges, (rows[some], last[some] + 1), -1)

    twice = np.flatnonzero(copies > 1)
    add(twice, np.maximum(0, length - n_after[twice]), np.minimum(n_before[twice], widest))
    large = np.bincount(group)[group] > PAIRS
    place_b, least = np.empty(n, np.int64), Least(shared_b)
    place_b[order_b] = np.arange(n)
    # Small groups: pairs at distance d in the forward order, while they share enough.
    i = np.flatnonzero(~large[order_f])
    common = np.full(len(i), length, dtype=np.int32)
    d = 0
    while len(i):
        d += 1
        on = i + d < n
        i, common = i[on], np.minimum(common[on], shared_f[i[on] + d])
        a, b = order_f[i], order_f[np.minimum(i + d, n - 1)]
        on = (common >= 0) & (common + most_b[a] >= length)  # else farther ones share too little as well
        i, common, a, b = i[on], common[on], a[on], b[on]
        low, high = np.minimum(place_b[a], place_b[b]), np.maximum(place_b[a], place_b[b])
        back = least(low + 1, high) if len(a) else common
        for rows in (a, b):
            add(rows, length - common, np.minimum(back, widest))

    def label(order: np.ndarray, shared: np.ndarray, d: int) -> np.ndarray:
        x = np.empty(n, dtype=np.int64)
        x[order] = np.cumsum(shared < d)
        return x

    # Large ones: classes, offset by offset, of the rows that may have a partner there.
    rows = np.flatnonzero(large & (most_b + most_f >= length))
    first, last = length - most_f[rows], np.minimum(most_b[rows], widest)
    single = copies[rows] < 2
    for o in range(widest + 1) if len(rows) else ():
        fits = (first <= o) & (o <= last)
        if not (fits & single).any():
            continue
        own = rows[fits]
        key = label(order_b, shared_b, o)[own] * (n + 2) + label(order_f, shared_f, length - o)[own]
        order = np.argsort(key, kind="stable")
        equal = np.concatenate([[False], key[order[1:]] == key[order[:-1]], [False]])
        found = own[order[equal[1:] | equal[:-1]]]
        edges[found, o] += 1
        edges[found, o + 1] -= 1
    return np.cumsum(edges[:, :-1], axis=1) > 0


KEY = ["k1", "k2"]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumns({"k1": F.xxhash64(F.lit(1), "text"), "k2": F.xxhash64(F.lit(2), "text")})


class Sums:
    """128-bit hashes of any spans of a batch of bytes. Half of the bits sum up bytes,
    half what a mixer makes of eight neighbouring ones: strings built so that one sum
    agrees don't agree in the other."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.inverse = powers(n), powers(n + 1, True)
        eight = np.ndarray((max(n - 7, 0),), "<u8", np.ascontiguousarray(data), strides=(1,))
        self.sums = [np.zeros(n + 1, dtype=np.uint64), np.zeros(n + 1, dtype=np.uint64)]
        for a in range(0, n, STEP):
            z = min(a + STEP, n)
            self.sums[0][a + 1 : z + 1] = BYTE[data[a:z]] * power[a:z]
            mixed = eight[a:z] * MIXER
            mixed ^= mixed >> np.uint64(29)
            self.sums[1][a + 1 : a + 1 + len(mixed)] = mixed * power[a : a + len(mixed)]
        for x in self.sums:
            np.cumsum(x, out=x)

    def __call__(self, lo: np.ndarray, hi: np.ndarray, *also: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the bytes lo to hi and of further numbers."""
        out = []
        for seed, x in enumerate(self.sums):
            end = np.maximum(hi - 7, lo) if seed else hi
            h = mix64((x[end] - x[lo]) * self.inverse[lo] + np.uint64(seed))
            for more in (hi - lo, *also):
                h = mix64(h + more.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            out.append(signed(h))
        return out[0], out[1]


def long_texts(docs: DataFrame, length: int, f, schema: str) -> DataFrame:
    """Run f(k1, k2, texts) -> a batch over texts of `length` bytes or more, of which
    a task passes on one of each kind (as far as it remembers)."""

    def run(batches):
        known: set = set()
        for b in batches:
            names = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            new = [i for i, x in enumerate(names) if x not in known and (known.add(x) or True)]
            if len(known) > KNOWN:
                known.clear()
            if new:
                yield f(*(b.take(pa.array(new)) if len(new) < len(names) else b).columns)

    return _keyed(docs).filter(F.octet_length("text") >= length).select(*KEY, "text").mapInArrow(trimmed(run), schema)


def shared_anchors(docs: DataFrame, length: int) -> DataFrame:
    """k1, k2, p, h, n: the anchors whose gram has n > 1 places. A gram's places are
    counted in each task before they meet; the join back splits those of a hot one."""
    small_batches(docs.sparkSession, 1000, "4m")

    def mark(k1, k2, texts):
        data, offsets = text_bytes(texts)
        p, h = anchors(data, offsets, length)
        d = np.searchsorted(offsets, p, "right") - 1
        own = pa.array(d)
        return pa.RecordBatch.from_arrays([pa.array(signed(h)), k1.take(own), k2.take(own), pa.array((p - offsets[d]).astype(np.int32))], ["h", "k1", "k2", "p"])

    places = materialize(long_texts(docs, length, mark, "h long, k1 long, k2 long, p int"))
    # As a table of its own, so that Spark may split the places of a hot gram between tasks.
    shared = materialize(places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    release(docs.sparkSession)
    # A text that several tasks have passed on has its places several times.
    marked = materialize(places.join(shared, "h").select(*KEY, "p", "h", "n").distinct())
    drop_table(places)
    drop_table(shared)
    return marked


def _marked_texts(docs: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """k1, k2, text, marks (p, h) of the texts that have any; a text may come from
    several tasks, one after another."""
    small_batches(docs.sparkSession, 1000, "4m")
    grouped = marks.groupBy(*KEY).agg(F.collect_list(F.struct("p", "h")).alias("marks"))  # of one text
    same = lambda k1, k2, texts: pa.RecordBatch.from_arrays([k1, k2, texts], ["k1", "k2", "text"])
    return long_texts(docs, length, same, "k1 long, k2 long, text string").join(grouped, KEY).select(*KEY, "text", "marks")


def _around(b: pa.RecordBatch, length: int):
    """Of a batch of marked texts: bytes, the text, place, gram and position of each
    mark, and where its window begins and ends."""
    data, offsets = text_bytes(b.column(2))
    count = b.column(3).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = b.column(3).flatten()
    p, h = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False)
    d = np.repeat(np.arange(b.num_rows), count)
    at = offsets[d] + p
    return data, d, p, h, at, np.maximum(at - (length - GRAM), offsets[d]), np.minimum(at + length, offsets[d + 1])


def windows(docs: DataFrame, marked: DataFrame, length: int) -> DataFrame:
    """h, n_before, window, k1s, k2s, ps: the distinct windows of each batch, and
    where they lie."""

    def cut(batches):
        for b in batches:
            if not b.num_rows:
                continue
            data, d, p, h, at, lo, hi = _around(b, length)
            w1, w2 = Sums(data)(lo, hi, at - lo)
            order = np.lexsort((w2, w1, h))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (w1[order[1:]] != w1[order[:-1]]) | (w2[order[1:]] != w2[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
            first = order[new]
            ends = pa.array(np.append(np.flatnonzero(new), len(order)).astype(np.int32))
            raw = data.tobytes()
            text = pa.array([raw[a:z] for a, z in zip(lo[first].tolist(), hi[first].tolist())], pa.binary())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (b.column(0).to_numpy()[d[order]], b.column(1).to_numpy()[d[order]], p[order])]
            yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array((at - lo)[first].astype(np.int32)), text, *lists], ["h", "n_before", "window", "k1s", "k2s", "ps"])

    small_batches(docs.sparkSession, 300, "2m")
    rows = _marked_texts(docs, marked, length)
    return rows.mapInArrow(trimmed(cut), "h long, n_before int, window binary, k1s array<long>, k2s array<long>, ps array<long>")


def hot_repeats(docs: DataFrame, marked: DataFrame, length: int) -> DataFrame:
    """k1, k2, lo, hi: the repeated runs around anchors with many places, as a table. What
    a step has read for the last time is deleted before the next one."""
    w = length - GRAM + 1

    def describe(batches):
        """A row for each distinct window of a batch: the least of its places, all of
        them, and for each range of offsets the hashes of shared and covered bytes."""
        for b in batches:
            if not b.num_rows:
                continue
            data, d, p, h, at, lo, hi = _around(b, length)
            first, last = np.maximum(0, length - (hi - at)), np.minimum(at - lo, w - 1)
            keep = first <= last
            d, p, h, at, lo, hi, first, last = (x[keep] for x in (d, p, h, at, lo, hi, first, last))
            k1, k2, sums = b.column(0).to_numpy()[d], b.column(1).to_numpy()[d], Sums(data)
            w1, w2 = sums(lo, hi, at - lo, h)
            r = signed(mix64(k1.view(np.uint64) + mix64(k2.view(np.uint64) + mix64(p.astype(np.uint64)))))
            order = np.lexsort((r, w2, w1))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (w1[order[1:]] != w1[order[:-1]]) | (w2[order[1:]] != w2[order[:-1]])
            one, ends = order[new], np.append(np.flatnonzero(new), len(order)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order])) for x in (k1, k2, p)]
            own, a = np.divmod(np.arange(len(one) * -(-w // RANGE)), -(-w // RANGE))
            a *= RANGE
            k = one[own]
            x, y = np.maximum(first[k], a), np.minimum(last[k], np.minimum(a + RANGE, w) - 1)
            own, a, k, x, y = (v[x <= y] for v in (own, a, k, x, y))
            z = np.minimum(a + RANGE, w)
            shared, covered = sums(at[k] - a, at[k] + length - z + 1, h[k], a), sums(at[k] - y, at[k] + length - x, h[k], x, y)
            parts = pa.StructArray.from_arrays([pa.array(v) for v in (*shared, *covered, x, y)], ["g1", "g2", "o1", "o2", "x", "y"])
            parts = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(one) + 1)).astype(np.int32)), parts)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(v[one]) for v in (k1, k2, p, h, w1, w2, at - lo, first, last, r)), pa.array(r[order][ends[1:] - 1]), *lists, parts,
                    pa.array([raw[i:j] for i, j in zip(lo[one].tolist(), hi[one].tolist())], pa.binary()),
                ],
                ["k1", "k2", "p", "h", "w1", "w2", "n_before", "first", "last", "low", "high", "k1s", "k2s", "ps", "parts", "window"],
            )

    def spread(batches):
        """All places of windows that are repeated throughout; runs of a text that meet are one."""
        for b in batches:
            n = b.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if not n.sum():
                continue
            k1, k2, p = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(3))
            first, last = (np.repeat(b.column(i).to_numpy(), n) for i in (3, 4))
            lo, hi = p - last, p - first + length
            order = np.lexsort((lo, k2, k1))
            k1, k2, lo, hi = k1[order], k2[order], lo[order], hi[order]
            text = np.cumsum(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
            top = np.maximum.accumulate(hi + (text << 40)) - (text << 40)
            at = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (lo[1:] > top[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[at], k2[at], lo[at], top[np.append(at[1:], len(lo)) - 1])], ["k1", "k2", "lo", "hi"])

    def strings(batches):
        for b in batches:
            if not b.num_rows:
                continue
            window = b.column(5).cast(pa.large_binary())
            begin = np.frombuffer(window.buffers()[1], dtype=np.int64)[window.offset : window.offset + len(window) + 1]
            data, begin = np.frombuffer(window.buffers()[2], dtype=np.uint8)[begin[0] : begin[-1]], begin - begin[0]
            parts = b.column(6)
            d = np.repeat(np.arange(b.num_rows), parts.value_lengths().to_numpy(zero_copy_only=False))
            x, y = (parts.flatten().field(i).to_numpy() for i in range(2))
            n = y - x + 1
            o = np.repeat(x, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            d = np.repeat(d, n)
            at = begin[d] + b.column(4).to_numpy()[d] - o
            s1, s2 = Sums(data)(at, at + length, b.column(3).to_numpy()[d], o)
            own = pa.array(d)
            yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), b.column(0).take(own), b.column(1).take(own), pa.array(b.column(2).to_numpy()[d] - o)], ["s1", "s2", "k1", "k2", "lo"])

    small_batches(docs.sparkSession, 2000, "4m")
    kinds = (
        "k1 long, k2 long, p long, h long, w1 long, w2 long, n_before long, first long, last long, low long, high long, k1s array<long>, k2s array<long>, ps array<long>, "
        "parts array<struct<g1: long, g2: long, o1: long, o2: long, x: long, y: long>>, window binary"
    )
    rows = materialize(_marked_texts(docs, marked, length).mapInArrow(trimmed(describe), kinds))
    release(docs.sparkSession)
    # A text may have come twice, so places are told apart, not counted.
    seen = materialize(rows.groupBy("w1", "w2").agg(F.min("low").alias("one"), F.max("high").alias("other")))
    both = materialize(rows.join(seen, ["w1", "w2"]))
    drop_table(rows)
    release(docs.sparkSession)
    whole = materialize(both.filter("one <> other").select("k1s", "k2s", "ps", "first", "last").mapInArrow(trimmed(spread), "k1 long, k2 long, lo long, hi long").distinct())
    single = both.filter("low = one")
    parts = single.select("w1", "w2", *KEY, "p", F.explode("parts").alias("v")).select("w1", "w2", *KEY, "p", "v.*")
    shared = parts.groupBy("g1", "g2").agg(F.min("w1").alias("a"), F.max("w1").alias("b")).filter("a <> b").select("g1", "g2")
    covered = parts.groupBy("o1", "o2").agg(F.min("w1").alias("lead"), F.max("w1").alias("b")).filter("lead <> b").select("o1", "o2", "lead")
    left = materialize(parts.join(shared, ["g1", "g2"]).join(covered, ["o1", "o2"], "left").select("w1", "w2", *KEY, "p", "x", "y", "lead"))
    drop_table(seen)
    release(docs.sparkSession)
    runs = materialize(left.filter("lead is not null").select(*KEY, (F.col("p") - F.col("y")).alias("lo"), (F.col("p") - F.col("x") + length).alias("hi")).distinct())
    # The rest, and of each kind of repeated ranges one.
    open_ = left.filter("lead is null or lead = w1").groupBy("w1", "w2").agg(F.collect_list(F.struct("x", "y")).alias("ranges"))  # at most a window's ranges
    rest = single.join(open_, ["w1", "w2"]).select(*KEY, "p", "h", "n_before", "window", "ranges")
    found = materialize(rest.mapInArrow(trimmed(strings), "s1 long, s2 long, k1 long, k2 long, lo long").withColumn("r", F.xxhash64(*KEY, "lo")))
    drop_table(both)
    drop_table(left)
    release(docs.sparkSession)
    twice = materialize(found.groupBy("s1", "s2").agg(F.min("r").alias("one"), F.max("r").alias("other")).filter("one <> other").select("s1", "s2"))
    release(docs.sparkSession)
    more = materialize(found.join(twice, ["s1", "s2"]).select(*KEY, "lo", (F.col("lo") + length).alias("hi")).distinct())
    drop_table(found)
    drop_table(twice)
    return whole.unionByName(runs).unionByName(more)


def _shard(rows: pa.Table, length: int) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    h, nb = rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(np.int64)
    text = rows.column(2).chunk(0).cast(pa.large_binary())
    start = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    flat, start = np.frombuffer(text.buffers()[2], dtype=np.uint8)[start[0] : start[-1]], start - start[0]
    size = np.diff(start)
    # Equal windows are one; the first row of each stands for it.
    group = np.unique(h, return_inverse=True)[1]
    w1, w2 = Sums(flat)(start[:-1], start[1:], nb, group)
    order = np.lexsort((w2, w1, group))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (w1[order[1:]] != w1[order[:-1]]) | (w2[order[1:]] != w2[order[:-1]]) | (group[order[1:]] != group[order[:-1]])
    one, kind = order[new], np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    # Their places; a text that came twice has its places twice.
    lists = [rows.column(i).chunk(0) for i in (3, 4, 5)]
    owner = np.repeat(kind, lists[0].value_lengths().to_numpy(zero_copy_only=False))
    k1, k2, p = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    order = np.lexsort((p, k2, k1, owner))
    owner, k1, k2, p = owner[order], k1[order], k2[order], p[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (p[1:] != p[:-1])
    owner, k1, k2, p = owner[new], k1[new], k2[new], p[new]
    n = len(one)
    copies = np.bincount(owner, minlength=n)
    w, nb, size, start = length - GRAM + 1, nb[one], size[one], start[:-1][one]
    after, before = np.zeros((n, length), dtype=np.uint8), np.zeros((n, w - 1), dtype=np.uint8)
    i = np.repeat(np.arange(n), size)
    c = np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
    raw = flat[start[i] + c]
    c -= nb[i]
    after[i[c >= 0], c[c >= 0]] = raw[c >= 0]
    before[i[c < 0], -1 - c[c < 0]] = raw[c < 0]
    found = repeated(group[one], before, nb, after, size - nb, copies)
    # Runs of neighbouring starts: the string from the largest offset to the smallest, at each place.
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    times, begin = copies[row], (np.cumsum(copies) - copies)[row]
    at = np.repeat(begin - np.cumsum(times) + times, times) + np.arange(times.sum())
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[at], k2[at], p[at] - np.repeat(last, times), p[at] - np.repeat(first, times) + length)], ["k1", "k2", "lo", "hi"])


def repeats(docs: DataFrame, marked: DataFrame, length: int) -> DataFrame:
    """k1, k2, lo, hi: the repeated runs around anchors with few places."""
    cut = windows(docs, marked, length)

    def match(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column(0).to_numpy()
            last = int(np.searchsorted(h, h[-1], "left"))  # the batch's last group may go on
            if held and (n >= SHARD or n + last >= SHARD) and (last or held[-1].column(0)[-1].as_py() != h[0]):
                held.append(b.slice(0, last))
                yield _shard(pa.Table.from_batches(held), length)
                held, n, b = [], 0, b.slice(last)
            held.append(b)
            n += b.num_rows
        if held:
            yield _shard(pa.Table.from_batches(held), length)

    return cut.repartition("h").sortWithinPartitions("h").mapInArrow(trimmed(match), "k1 long, k2 long, lo long, hi long")


def unite(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of intervals."""
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > top[:-1]
    at = np.flatnonzero(new)
    return lo[at], top[np.append(at[1:], len(lo)) - 1]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over: it does when their
    plans are collected, and Python's references to them go first, a moment later."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def find_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, text, spans (array of lo, hi in bytes, maximal, ascending) per row."""
    spark = docs.sparkSession
    marked = shared_anchors(docs, length)
    release(spark)
    few = marked.filter(F.col("n") <= HOT)
    runs = None
    for i in range(PORTIONS):
        part = materialize(repeats(docs, few.filter(F.pmod("h", F.lit(PORTIONS)) == i), length))
        runs = part if runs is None else runs.unionByName(part)
        release(spark)
    hot = marked.filter(F.col("n") > HOT)
    if hot.head(1):
        runs = runs.unionByName(hot_repeats(docs, hot, length))
        release(spark)
    drop_table(marked)
    # Texts that occur twice are repeated from end to end.
    copied = _keyed(docs).filter(F.octet_length("text") >= length).groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1")
    runs = runs.unionByName(copied.select(*KEY, F.lit(0).cast("long").alias("lo"), F.lit(1 << 62).alias("hi")))
    small_batches(spark, 1000, "4m")
    grouped = runs.distinct().groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))  # of one text
    kind = docs.schema["doc_id"].dataType.simpleString()

    def gather(batches):
        for b in batches:
            lists = b.column(2)
            size = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)
            spans = []
            for i in range(b.num_rows):
                if not lists[i].is_valid:
                    spans.append([])
                    continue
                x = lists[i].values
                lo, hi = unite(x.field(0).to_numpy(), np.minimum(x.field(1).to_numpy(), size[i]))
                spans.append([{"lo": a, "hi": z} for a, z in zip(lo.tolist(), hi.tolist())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["doc_id", "text", "spans"])

    rows = _keyed(docs).join(grouped, KEY, "left").select("doc_id", "text", "runs")
    return rows.mapInArrow(trimmed(gather), f"doc_id {kind}, text string, spans array<struct<lo: long, hi: long>>")


def digest(found: DataFrame) -> DataFrame:
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1), b.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, at = hashlib.sha256(), 0
                for s in spans:
                    kept.update(raw[at : s["lo"]])
                    at = s["hi"]
                kept.update(raw[at:])
                rows.append((len(raw), sum(s["hi"] - s["lo"] for s in spans), len(spans), kept.hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), pa.int64()) for c in cols[:3]), pa.array(list(cols[3]), pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(trimmed(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_repeats(read(spark, sf_dir, "documents")))
