"""Approximate nearest neighbours by largest inner product: a hierarchical
k-means tree, searched best bin first.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M
the largest norm. The tree is fitted on at most `fit_rows` vectors (those of
smallest hash); every vector is indexed. Equal vectors are one class with the
smallest `k` + 1 ids (no answer needs more of them), so a vector that a third of
the rows share weighs as one. A query walks the tree with a priority queue of
bins by distance to their centre and visits leaves in that order. How many is
calibrated: a bounded set of vectors that are no queries is also answered by brute
force, and visits widen until their recall reaches `recall`.

Leaves are numbered as the tree grows, so neighbouring numbers are neighbouring
leaves. Runs of them that hold about CHUNK classes are searched as one group, and a
query goes to the groups that hold its leaves, once each. A leaf of more classes is
split, and so are the queries of a group beyond ASKED, so no task holds more than
about CHUNK vectors and ASKED queries.

Scores are inner products of the original vectors in double precision, summed in
order of the components.

Defined cases: a vector that is null, zero, of another length than most or that
holds null or non-finite components takes no part; nor does a row without id.
Repeated ids count once per row. Ties go to the smaller id. Vectors of any length
work alike. With no vectors, no rows. Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanlake.llm.common import materialize, read, small_batches, trimmed

FIT_ROWS = 50_000
BRANCH = 16
LEAVES = 256
#: Classes and queries that one search holds, or so.
CHUNK = 16384
ASKED = 4096
CALIBRATION = 256
RECALL = 0.94


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _array(x: np.ndarray, kind) -> pa.Array:
    d = x.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d), pa.array(x.ravel(), kind))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, v (doubles) of the vectors that take part, and their length."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0].d if sizes else 0
    return rows.filter(F.size("v") == d), d


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.argmin(-2 * x @ centres.T + (centres**2).sum(1), axis=1)
        for j in range(len(centres)):
            if (mine := own == j).any():
                centres[j] = x[mine].mean(0)
    own = np.argmin(-2 * x @ centres.T + (centres**2).sum(1), axis=1)
    return centres, own


class Tree:
    """children[node]: (centres, child nodes); a negative child is leaf ~child."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = 64, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.nodes: list = []
        self.leaves = 0
        self.root = self._grow(x, branch, leaf, rng)

    def _grow(self, x, branch, leaf, rng) -> int:
        if len(x) <= leaf:
            self.leaves += 1
            return ~(self.leaves - 1)
        centres, own = kmeans(x, branch, rng)
        kept = [j for j in range(len(centres)) if (own == j).any()]
        if len(kept) == 1:
            self.leaves += 1
            return ~(self.leaves - 1)
        at = len(self.nodes)
        self.nodes.append(None)
        below = [self._grow(x[own == j], branch, leaf, rng) for j in kept]
        c = centres[kept]
        self.nodes[at] = (c, (c**2).sum(1), below)
        return at

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            c, norms, below = self.nodes[node]
            own = np.argmin(norms - 2 * x[rows] @ c.T, axis=1)
            todo += [(child, r) for j, child in enumerate(below) if len(r := rows[own == j])]
        return out

    def best_bins(self, q: np.ndarray, visits: int, held=None, least: int = 0) -> list[int]:
        """Leaves in the order of a best-bin-first walk: `visits`, and more until
        they hold (`held` by leaf) at least `least` vectors."""
        heap, out = [(0.0, 0, self.root)], []
        tie = got = 0
        while heap and (len(out) < visits or got < least):
            _, _, node = heapq.heappop(heap)
            if node < 0:
                out.append(~node)
                got += int(held[~node]) if held is not None else least
                continue
            c, norms, below = self.nodes[node]
            for dist, child in zip((norms - 2 * c @ q + q @ q).tolist(), below):
                tie += 1
                heapq.heappush(heap, (dist, tie, child))
        return out


def _lift(x: np.ndarray, m2: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(m2 - (x**2).sum(1), 0.0))[:, None]])


def _query(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.zeros((len(x), 1))])


def _ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _top(q: np.ndarray, x: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x) among which are the k best of each q, with their
    scores; all that tie with the last. `seen`: which pairs count."""
    rough = q @ x.T
    if seen is not None:
        rough[~seen] = -np.inf
    if len(x) > k:
        least = -np.partition(-rough, k - 1, axis=1)[:, k - 1 : k]
        i, j = np.nonzero((rough >= least - 1e-9) & (rough > -np.inf))
    else:
        i, j = np.nonzero(rough > -np.inf)
    return i, j, _ordered_dot(q[i], x[j])


def _expand(i, j, s, ids: pa.ListArray, q_ids: np.ndarray, k: int):
    """Pairs of classes to pairs of ids, without a query itself: its k best."""
    n = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, begin = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(n) - n
    times = n[j]
    at = np.repeat(begin[j] - np.cumsum(times) + times, times) + np.arange(times.sum())
    i, s, own, c = np.repeat(i, times), np.repeat(s, times), np.repeat(j, times), flat[at]
    keep = c != q_ids[i]
    i, s, own, c = i[keep], s[keep], own[keep], c[keep]
    order = np.lexsort((c, -s, i))
    i, s, own, c = i[order], s[order], own[order], c[order]
    first = np.searchsorted(i, np.arange(len(q_ids) + 1))
    best = np.arange(len(i)) - first[i] < k
    return i[best], c[best], s[best], own[best]


def search(vectors: DataFrame, queries, k: int = 20, recall: float = RECALL, fit_rows: int = FIT_ROWS, branch: int = BRANCH, calibration: int = CALIBRATION) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id
    fulfils `queries` (a condition on vec_id)."""
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    schema = "query_id long, rank int, vec_id long, score double"
    rows, d = usable(vectors)
    if not d:
        return spark.createDataFrame([], schema)
    rows = materialize(rows)
    # Classes of equal vectors. The window keeps k + 1 rows a class in each task before it shuffles.
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    classes = few.groupBy("v").agg(F.collect_list("vec_id").alias("ids")).withColumn("h", F.xxhash64("v"))
    m2 = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    classes = materialize(classes)
    n = classes.count()
    # Hashes of distinct vectors are spread evenly, so a threshold leaves about as many as wanted.
    share = min(1.0, fit_rows / n + 4 * np.sqrt(fit_rows) / n)
    some = sorted((r.h, r.v) for r in classes.select("h", "v").filter(F.col("h") <= F.lit(int(min(share * 2.0**64 - 2.0**63, 2.0**63 - 1025)))).toLocalIterator()) if share < 1 else sorted((r.h, r.v) for r in classes.select("h", "v").toLocalIterator())
    sample = np.array([v for _, v in some[:fit_rows]])
    # About sqrt(rows) leaves, at least LEAVES: visits and comparisons then grow alike.
    n_leaves = max(LEAVES, int(np.sqrt(n)))
    tree = spark.sparkContext.broadcast(Tree(_lift(sample, m2), branch, max(4, -(-len(sample) * 2 // n_leaves))))  # bounded by fit_rows

    def index(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.value.assign(_lift(_matrix(b.column(0), d), m2)))], ["v", "ids", "h", "leaf"])

    indexed = materialize(classes.mapInArrow(trimmed(index), "v array<double>, ids array<long>, h long, leaf int"))
    asked = rows.filter(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    held_by, classes_in = np.zeros(tree.value.leaves, dtype=np.int64), np.zeros(tree.value.leaves, dtype=np.int64)
    for r in indexed.groupBy("leaf").agg(F.sum(F.size("ids")).alias("n"), F.count("*").alias("m")).collect():  # at most a row per leaf
        held_by[r.leaf], classes_in[r.leaf] = r.n, r.m
    others = rows.filter(~queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    visits = _calibrate(spark, indexed, others if others.head(1) else asked, tree, d, k, recall, calibration)
    # Runs of leaves; one that is too large has a group of its own.
    group_of = np.zeros(tree.value.leaves, dtype=np.int32)
    size = 0
    for leaf in range(1, tree.value.leaves):
        size = classes_in[leaf - 1] + (size if leaf > 1 and group_of[leaf - 1] == group_of[leaf - 2] else 0)
        group_of[leaf] = group_of[leaf - 1] + (size + classes_in[leaf] > CHUNK)
    parts_of = np.maximum(1, -(-np.bincount(group_of, classes_in).astype(np.int64) // CHUNK))

    def walk(batches):
        for b in batches:
            rep, group, leaves = [], [], []
            for i, x in enumerate(_query(_matrix(b.column(1), d))):
                bins = np.array(tree.value.best_bins(x, visits, held_by, k + 1), dtype=np.int32)
                bins = bins[held_by[bins] > 0]
                own = group_of[bins]
                for g in np.unique(own):
                    rep.append(i)
                    group.append(g)
                    leaves.append(bins[own == g])
            at = pa.array(np.cumsum([0, *map(len, leaves)]).astype(np.int32))
            rep = pa.array(rep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rep), b.column(1).take(rep), pa.array(group, pa.int32()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(leaves) if leaves else np.zeros(0, np.int32)))], ["query_id", "q", "group", "leaves"])

    visiting = materialize(asked.mapInArrow(trimmed(walk), "query_id long, q array<double>, group int, leaves array<int>"))
    counted = visiting.groupBy("group").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("asks"))
    cuts = spark.createDataFrame([(g, int(n)) for g, n in enumerate(parts_of)], "group int, parts int").join(counted, "group")  # a row per group
    groups = spark.createDataFrame([(i, int(g)) for i, g in enumerate(group_of)], "leaf int, group int")  # a row per leaf
    held = indexed.join(groups, "leaf").join(cuts, "group").withColumn("part", F.pmod("h", "parts").cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    visiting = visiting.join(cuts, "group").withColumn("ask", F.pmod(F.xxhash64("query_id"), "asks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def nearest(left, right):
        out = []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            x, leaf, ids = _matrix(right.column("v").chunk(0), d), right.column("leaf").to_numpy(), right.column("ids").chunk(0)
            for a in range(0, left.num_rows, 256):
                some = left.slice(a, 256).combine_chunks()
                q_ids, lists = some.column("query_id").to_numpy(), some.column("leaves").chunk(0)
                visited = np.zeros((len(q_ids), tree.value.leaves), dtype=bool)
                visited[np.repeat(np.arange(len(q_ids)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()] = True
                i, j, s = _top(_matrix(some.column("q").chunk(0), d), x, k + 1, visited[:, leaf])
                i, c, s, _ = _expand(i, j, s, ids, q_ids, k)
                out.append((q_ids[i], c, s))
        found = [np.concatenate(z) for z in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    met = visiting.select("group", "part", "ask", "query_id", "q", "leaves").groupBy("group", "part", "ask").cogroup(held.select("group", "part", "ask", "leaf", "v", "ids").groupBy("group", "part", "ask")).applyInArrow(nearest, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrate(spark, indexed, asked, tree, d, k, recall, calibration) -> int:
    """Leaves to visit: a few queries are answered by brute force over all
    classes, each task keeping its k best, and the walk is widened until it finds
    the wanted share of the answers."""
    some = asked.withColumn("h", F.xxhash64("query_id")).orderBy("h", "query_id").limit(calibration).collect()
    if not some:
        return 1
    q, q_ids = np.array([r.q for r in some]), [r.query_id for r in some]

    def brute(batches):
        best: list = [[] for _ in q]
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0), d)
            i, c, s, own = _expand(*_top(q, x, k + 1), b.column(2), np.array(q_ids), k)
            leaf = b.column(1).to_numpy()[own]
            for row, id_, score, at in zip(i.tolist(), c.tolist(), s.tolist(), leaf.tolist()):
                best[row].append((-score, id_, at))
            best = [sorted(y)[:k] for y in best]
        found = [(i, *y) for i, own in enumerate(best) for y in own]
        yield pa.RecordBatch.from_arrays([pa.array([y[0] for y in found], pa.int32()), pa.array([-y[1] for y in found], pa.float64()), pa.array([y[2] for y in found], pa.int64()), pa.array([y[3] for y in found], pa.int32())], ["i", "score", "vec_id", "leaf"])

    near = indexed.select("v", "leaf", "ids").mapInArrow(trimmed(brute), "i int, score double, vec_id long, leaf int")
    order = Window.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    truth = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).collect()
    ranks = []
    for i, x in enumerate(_query(q)):
        place = {leaf: n for n, leaf in enumerate(tree.value.best_bins(x, tree.value.leaves))}
        ranks += [place[r.leaf] for r in truth if r.i == i]
    if not ranks:
        return 1
    ranks.sort()
    return ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] + 1


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
