"""N-gram Jaccard join with signature trees.

Documents are sets of hashed word shingles; two link when
100 * |intersection| >= percent * |union|. Equal sets are one class.

Which sets can meet at all: shingles have an order, those in fewer documents first,
then by hash. Sets that link share a shingle among the first
n - percent * n / 100 + 1 of each. Those are signatures, and documents that share
one are candidates. That finds every linked pair, and a passage in many documents
makes no candidates as long as a document has rarer shingles of its own.

Candidates' components are units. A unit's sets are packed by size into blocks of
bounded bytes, pairs of blocks whose size ranges can link form the top of the
hierarchy, and in each pair signature trees are traversed together: a node holds
the OR (and AND) of its sets' token bitmaps and their size range, and a pair of
nodes is left when the largest overlap these allow is too small, or, where only
components are asked for, when both lie in one already. What remains is compared
exactly. So a group of copies costs components() about as many comparisons as members;
similarity_join() gives every link.

Defined cases: null or wordless text: empty set, linked with nothing, its own
component. Fewer words than a shingle: the whole sequence is one. Rows that repeat
a doc_id are one node, which has the links of all their texts. A null doc_id has a
null component. Long texts are whole sets; one beyond a block is a block of its own.
Sets that tie in order and size are ordered by id. An empty table gives no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm import lm_score
from scanlake.llm.common import materialize, mix64, ngram_hashes, pack_integers, read, signed, small_batches, trim, trimmed, unpack_integers, word_hashes
from scanlake.llm.repeats import release
from scanlake.operators.components import connected_components

#: Shingles of a block.
BLOCK = 1 << 20
#: Bits of a node's bitmaps; a set is its own at a leaf.
BITS = 1 << 16
FAN = 8
#: Size and hashes of a set: sets of equal name are equal.
NAME = ["n_shingles", "f1", "f2"]


def shingle_sets(column, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = word_hashes(column)
    h, begin = ngram_hashes(words, first, n)
    size = np.diff(first)
    out = [np.unique(h[a:z]) if z > a else h[:0] for a, z in zip(begin[:-1].tolist(), begin[1:].tolist())]
    for m in range(1, n):
        if len(rows := np.flatnonzero(size == m)):
            g, at = ngram_hashes(words, first, m)
            for i in rows:
                out[i] = g[at[i] : at[i] + 1]
    return out


def prefix(s: np.ndarray, frequency: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the order of (frequency, hash), so many that
    two sets that link share one of them: each misses fewer of the other's. A
    shingle that no other document has is no use."""
    order = np.lexsort((s, frequency))[: len(s) - -(-percent * len(s) // 100) + 1]
    return s[order[frequency[order] > 1]]


def _names(sets: list[np.ndarray]) -> list[np.ndarray]:
    """128 bits of each set."""
    return [signed(np.array([mix64(s + np.uint64(c)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)) for c in (1, 0xABCDEF)]


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2: the size of each set and 128 bits of it."""
    small_batches(docs.sparkSession, 1000)

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(1), n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, _names(sets))], ["doc_id", "n_shingles", "f1", "f2"])

    return docs.mapInArrow(trimmed(run), "doc_id long, n_shingles long, f1 long, f2 long")


def frequencies(packed: DataFrame, n: int, bits: int, drop: int) -> DataFrame:
    """block, n, bucket, total: in how many documents each shingle of a block occurs,
    in the order of their hashes. A block asks for each of its shingles once."""
    small_batches(packed.sparkSession, 1)

    def ask(batches):
        for b in batches:
            for block, ids, blob in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                sets = shingle_sets(lm_score.open_block(blob.as_buffer().to_pybytes(), len(ids)), n)
                yield lm_score.question(block, n, np.sort(np.concatenate(sets) >> np.uint64(drop) << np.uint64(drop)), bits, drop)

    return lm_score.answers(packed.select("block", "ids", "texts").mapInArrow(trimmed(ask), lm_score.QUESTION), drop)


def _least_per_key(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the least document of each, and edges (n, 2) from
    the other documents of a key to its least."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    head = doc[new]
    hubs = head[np.cumsum(new) - 1]
    far = hubs != doc
    return key[new], head, np.unique(np.stack([doc[far], hubs[far]], axis=1), axis=0)


def candidate_edges(docs: DataFrame, n: int, percent: int, shingles: int) -> DataFrame:
    """a, b: documents that share a signature (a shingle of the prefix), each with
    the smallest that does. A block of documents ties its own and passes on each
    signature once, with its least document, so a signature that a third of the
    documents share is a row a block. Frequencies and signatures travel packed, in
    columns by hash bucket; `shingles` (of all documents) sets the number of buckets."""
    spark = docs.sparkSession
    bits = max(0, int(shingles >> 20).bit_length())
    drop = max(0, 64 - lm_score.SPARE_BITS - max(16, int(shingles).bit_length()))
    packed = materialize(lm_score.blocks(docs.filter("doc_id is not null")))
    counted = materialize(frequencies(packed, n, bits, drop))
    release(spark)
    small_batches(spark, 1000)

    def sign(left, right):
        ids = np.array(left.column("ids")[0].as_py(), dtype=np.int64)
        sets = shingle_sets(lm_score.open_block(left.column("texts")[0].as_py(), len(ids)), n)
        rows = sorted(zip(right.column("bucket").to_pylist(), right.column("total").to_pylist()))
        total = np.concatenate([np.zeros(0, np.uint64), *(unpack_integers(x, np.uint64) for _, x in rows)])
        everything = np.concatenate(sets) >> np.uint64(drop) << np.uint64(drop)
        frequency = total[np.unique(everything, return_inverse=True)[1]] if len(everything) else total
        cut = np.cumsum([0, *map(len, sets)]).tolist()
        one = np.zeros(len(sets), dtype=bool)  # of equal sets, one signs
        one[np.unique(np.stack(_names(sets), axis=1), axis=0, return_index=True)[1]] = True
        own = [prefix(s, frequency[a:z], percent) if len(s) and x else s[:0] for s, x, a, z in zip(sets, one, cut, cut[1:])]
        sig, doc, edges = _least_per_key(np.concatenate(own), np.repeat(ids, [len(x) for x in own]))
        bucket = (sig >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sig), np.int64)
        cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(sig))
        names = bucket[cut[:-1]].tolist() + [-1 - int(mix64(np.array([left.column("block")[0].as_py()]))[0] % np.uint64(1 << max(bits, 6)))]
        keys = [pack_integers(np.diff(sig[x:z], prepend=np.uint64(0))) for x, z in zip(cut, cut[1:])] + [pack_integers(edges[:, 0])]
        values = [pack_integers(doc[x:z]) for x, z in zip(cut, cut[1:])] + [pack_integers(edges[:, 1])]
        trim()
        return pa.table({"bucket": pa.array(names, pa.int64()), "keys": pa.array(keys, pa.binary()), "docs": pa.array(values, pa.binary())})

    def tie(table):
        keys, values = table.column("keys").to_pylist(), table.column("docs").to_pylist()
        doc = np.concatenate([unpack_integers(x, np.int64) for x in values])
        if table.column("bucket")[0].as_py() < 0:  # edges that a batch has found
            edges = np.stack([np.concatenate([unpack_integers(x, np.int64) for x in keys]), doc], axis=1)
        else:
            edges = _least_per_key(np.concatenate([np.cumsum(unpack_integers(x, np.uint64), dtype=np.uint64) for x in keys]), doc)[2]
        return pa.table({"a": pa.array(edges[:, 0]), "b": pa.array(edges[:, 1])})

    met = packed.select("block", "ids", "texts").groupBy("block").cogroup(counted.groupBy("block"))
    signed_rows = met.applyInArrow(sign, "bucket long, keys binary, docs binary")
    return signed_rows.groupBy("bucket").applyInArrow(tie, "a long, b long").distinct()


class Node:
    __slots__ = ("any", "all", "low", "high", "bits", "below", "rows", "one")

    def __init__(self, any_, all_, low, high, bits, below, rows):
        self.any, self.all, self.low, self.high, self.bits = any_, all_, low, high, bits
        self.below, self.rows, self.one = below, rows, False


class Trees:
    """Signature trees over sets, and the links found between them: all, or as many
    as span the components."""

    def __init__(self, sets: list[np.ndarray], percent: int, spanning: bool = True):
        self.sets, self.percent, self.spanning = sets, percent, spanning
        self.root = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []
        self.compared = 0

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def build(self, rows: list[int]) -> Node | None:
        if not rows:
            return None
        rows = sorted(rows, key=lambda i: (len(self.sets[i]), self.sets[i][0]))
        nodes = [Node(0, 0, len(self.sets[i]), len(self.sets[i]), 0, [], [i]) for i in rows]
        leaves = True
        while len(nodes) > 1:
            up = []
            for k in range(0, len(nodes), FAN):
                g = nodes[k : k + FAN]
                maps = [self.bitmap(x.rows[0]) for x in g] if leaves else [(x.any, x.all, x.bits) for x in g]
                any_, all_ = 0, -1
                for one, every, _ in maps:
                    any_ |= one
                    all_ &= every
                up.append(Node(any_, all_, min(x.low for x in g), max(x.high for x in g), min(m[2] for m in maps), g, None))
            nodes, leaves = up, False
        return nodes[0]

    def bitmap(self, i: int) -> tuple[int, int, int]:
        flags = np.zeros(BITS, dtype=np.uint8)
        flags[(self.sets[i] & np.uint64(BITS - 1)).astype(np.int64)] = 1
        bits = int.from_bytes(np.packbits(flags).tobytes(), "big")
        return bits, bits, bits.bit_count()

    def label(self, x: Node) -> int | None:
        """The component of a node's sets, if all have one."""
        if x.rows:
            return self.find(x.rows[0])
        if x.one:
            return self.label(x.below[0])
        labels = {self.label(y) for y in x.below}
        if len(labels) == 1 and None not in labels:
            x.one = True
            return labels.pop()
        return None

    def possible(self, x: Node, y: Node) -> bool:
        """Whether the largest overlap that sizes and bitmaps allow can link sets
        of x and y: a bit of one that the other lacks is a shingle not shared."""
        p = self.percent
        if min(x.high, y.high) * 100 < p * max(x.low, y.low):
            return False
        if x.rows or y.rows:
            return True  # a set of one: comparing it is as cheap
        both = (x.any & y.any).bit_count()
        only_x = max(x.bits - both, (x.all & ~y.any).bit_count(), 0)
        only_y = max(y.bits - both, (y.all & ~x.any).bit_count(), 0)
        # Overlap / union is largest where the smaller side is all shared but these.
        overlap = min(x.high - only_x, y.high - only_y)
        if overlap <= 0:
            return False
        union = max(x.low + only_y, y.low + only_x, overlap + only_x + only_y)
        return overlap * 100 >= p * union

    def join(self, x: Node, y: Node) -> None:
        todo = [(x, y)]
        while todo:
            x, y = todo.pop()
            if x is y:
                if x.below:
                    b = x.below
                    # Popped last first: within the children before between them.
                    todo += [(b[i], b[j]) for i in range(len(b)) for j in range(len(b) - 1, i, -1)]
                    todo += [(c, c) for c in b]
                continue
            a = self.label(x) if self.spanning else None
            if a is not None and a == self.label(y) or not self.possible(x, y):
                continue
            if x.rows and y.rows:
                i, j = x.rows[0], y.rows[0]
                s, t = self.sets[i], self.sets[j]
                if len(s) > len(t):
                    s, t = t, s
                self.compared += 1
                shared = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                if shared * 100 >= self.percent * (len(s) + len(t) - shared):
                    self.root[max(self.find(i), self.find(j))] = min(self.find(i), self.find(j))
                    self.links.append((i, j))
            elif x.rows or (y.below and len(y.below) and y.high > x.high and not y.rows):
                todo += [(x, c) for c in y.below]
            else:
                todo += [(c, y) for c in x.below]


def links(docs: DataFrame, members: DataFrame, n: int, percent: int, spanning: bool = True) -> DataFrame:
    """a, b: links of each unit's sets, as names `rep`: those that span the components,
    or every link, each once.
    `members`: rep, doc_id, unit, n_shingles, f1, f2 of one document per class, in
    units of two or more. A doc_id with several texts may stand for several classes."""
    spark = docs.sparkSession
    # Blocks by size: how much lies before a size is summed per (unit, size), not per document.
    from pyspark.sql import Window

    by_size = members.groupBy("unit", "n_shingles").agg(F.sum("n_shingles").alias("own"))
    order = Window.partitionBy("unit").orderBy("n_shingles")
    by_size = by_size.withColumn("before", F.sum("own").over(order) - F.col("own"))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    placed = members.join(by_size, ["unit", "n_shingles"]).withColumn("block", F.floor((F.col("before") + spread * F.col("own")) / BLOCK))
    placed = materialize(placed.select("rep", "doc_id", "unit", "block", "n_shingles", "f1", "f2"))
    tops = placed.groupBy("unit", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    left, right = tops.select("unit", F.col("block").alias("i"), F.col("high").alias("hi")), tops.select("unit", F.col("block").alias("j"), F.col("low").alias("lo"))
    pairs = left.join(right, "unit").filter((F.col("i") <= F.col("j")) & (F.col("hi") * 100 >= F.col("lo") * percent)).select("unit", "i", "j")
    sides = pairs.select("unit", F.col("i").alias("block"), "i", "j").unionByName(pairs.filter("i < j").select("unit", F.col("j").alias("block"), "i", "j"))
    small_batches(spark, 500, "4m")

    def pack(batches):
        for b in batches:
            sets = shingle_sets(b.column(1), n)
            own = [x.to_numpy() for x in b.columns[4:6]]
            kept = pa.array(np.flatnonzero(np.all([f == x for f, x in zip(_names(sets), own)], axis=0)))
            yield pa.RecordBatch.from_arrays([b.column(6).take(kept), b.column(2).take(kept), b.column(3).take(kept), pa.array([sets[i].tobytes() for i in kept.to_pylist()], pa.binary())], ["doc_id", "unit", "block", "set"])

    # Merged at any size: one class in a few documents is no side to broadcast.
    texts = docs.join(placed.select("rep", "doc_id", "unit", "block", "f1", "f2").hint("merge"), "doc_id").withColumn("h", F.xxhash64("text"))
    texts = texts.dropDuplicates(["doc_id", "f1", "f2", "h"]).select("doc_id", "text", "unit", "block", "f1", "f2", "rep")
    dealt = texts.mapInArrow(trimmed(pack), "doc_id long, unit long, block long, set binary").join(sides, ["unit", "block"])

    def run(table):
        ids, block = table.column("doc_id").to_pylist(), table.column("block").to_pylist()
        trees = Trees([np.frombuffer(x, dtype=np.uint64) for x in table.column("set").to_pylist()], percent, spanning)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        first = trees.build([k for k, x in enumerate(block) if x == i])
        # Links inside a block are found where it meets itself.
        second = first if i == j else trees.build([k for k, x in enumerate(block) if x == j])
        if first and second:
            trees.join(first, second)
        return pa.table({"a": pa.array([ids[x] for x, _ in trees.links], pa.int64()), "b": pa.array([ids[y] for _, y in trees.links], pa.int64())})

    return dealt.groupBy("unit", "i", "j").applyInArrow(run, "a long, b long")


def _classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sets of all rows (doc_id, n_shingles, f1, f2), those that can link, their classes
    of equal sets under the smallest doc_id `rep`, and the classes of units of several."""
    base = materialize(fingerprints(docs, n))
    shingles = base.agg(F.sum("n_shingles")).first()[0] or 0
    units = connected_components(candidate_edges(docs, n, percent, shingles)).select(F.col("node").alias("doc_id"), F.col("label").alias("unit"))
    units = materialize(units)
    release(docs.sparkSession)
    # A class of equal sets goes by its smallest doc_id; each lies in one unit, as its members share all signatures.
    known = base.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(known.groupBy(*NAME).agg(F.min("doc_id").alias("rep")))
    placed = known.join(units, "doc_id").groupBy(*NAME).agg(F.min("doc_id").alias("doc_id"), F.min("unit").alias("unit"))
    members = materialize(classes.join(placed, NAME))
    several = members.groupBy("unit").agg(F.count("*").alias("n")).filter("n > 1").select("unit")
    return base, known, classes, members.join(several, "unit")


def similarity_join(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and who holds them: pairs (a, b) of classes of
    equal sets, each under its smallest doc_id `rep`, a < b, and membership (doc_id, rep,
    n_links: with how many other classes its own links). Equal sets link as well, which
    sharing a `rep` says; they are not spelt out. As many pairs as there are links, so a
    group of different near copies gives about the square of its members. Rows that repeat
    a doc_id and a set are one member; empty sets and null doc_ids are no members. Where a
    doc_id holds several sets, `rep` may name several classes: (a, b) then stands for a
    link of any of them, and each member carries the most links of them."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    _, known, classes, several = _classes(docs, n, percent)
    found = links(docs, several, n, percent, spanning=False).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(found.filter("a <> b").distinct())
    counts = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    members = known.join(classes, NAME).select("doc_id", "rep").distinct()
    return pairs, members.join(counts, "rep", "left").select("doc_id", "rep", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    base, known, classes, several = _classes(docs, n, percent)
    found = links(docs, several, n, percent)
    # A doc_id with several texts ties their classes.
    mixed = base.filter("doc_id is not null").groupBy("doc_id").agg(F.min("f1").alias("a"), F.max("f1").alias("b")).filter("a <> b").select("doc_id")
    ties = known.join(mixed, "doc_id").join(classes, NAME).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = materialize(connected_components(found.unionByName(ties)))
    named = materialize(classes.join(labels, classes.rep == labels.node, "left").select(*NAME, F.coalesce("label", "rep").alias("own")))
    full = base.filter("n_shingles > 0").join(named, NAME, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("own")).alias("component_id"))
    empty = base.filter("n_shingles = 0").join(labels, base.doc_id == labels.node, "left").select(base.doc_id, "n_shingles", F.coalesce("label", base.doc_id).alias("component_id"))
    return full.unionByName(empty)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents"), n=3, percent=90)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), ranked AS (
  SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY hash(s), s) AS r FROM shingles JOIN sizes USING (doc_id)
), prefix AS (SELECT doc_id, s, n FROM ranked WHERE r <= n - CAST(ceil(0.9 * n) AS BIGINT) + 1
), pairs AS (
  SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM prefix a JOIN prefix b ON a.s = b.s AND a.doc_id < b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
), linked AS (
  SELECT x, y FROM pairs JOIN shingles a ON a.doc_id = x JOIN shingles b ON b.doc_id = y AND b.s = a.s
  GROUP BY x, y, nx, ny HAVING 100 * count(*) >= 90 * (nx + ny - count(*))
), edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked
), reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT e.x, reach.r FROM edges e JOIN reach ON reach.d = e.y
)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(r) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.d = d.doc_id GROUP BY d.doc_id
"""
