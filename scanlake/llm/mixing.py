"""Mix sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled by a keyed hash, form one stream of words,
read up to twice and cut into blocks of `block_words` words. Golden-ratio points
pass through the cumulative targets and so give each slot of the mix a source;
the r-th slot of a source takes its r-th block. The last block of a source ends
at its target, so what a source gives equals its target to within a word.

Rows that repeat stand together in the stream; each task counts them, so a row that
a third of the table repeats is as many rows as tasks until their places are known.

Defined cases: null text or no words: size 0, never taken. A null source is a source
of its own, the last; a null doc_id is a value like any other. Rows that repeat are
documents of their own. Rows of equal key are ordered by doc_id and size. A long text
spans many blocks. An empty table gives no rows. Other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanlake.llm.common import materialize, read, small_batches, text_bytes, trimmed, word_spans

WEIGHTS = (5.0, 2.0, 1.0)
#: Parts of a source's stream whose prefix sums are taken apart.
BUCKETS = 4096
GOLDEN = (math.sqrt(5.0) - 1.0) / 2.0


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, key, size: a keyed hash and the words of each text."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        for b in batches:
            first = word_spans(*text_bytes(b.column(3)))[2]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(first))], ["doc_id", "source", "key", "size"])

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(F.lit(seed), "doc_id", F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(count), f"doc_id {kind}, source string, key long, size long")


def targets(sizes: list[int], share: float = 1.5, weights=WEIGHTS, most: float = 2.0) -> list[float]:
    """Share out `share` of all sizes by weight; no target above `most` times its
    size, and what is above goes to the others by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, active = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while active:
        unit = left / sum(w[i] for i in active)
        over = [i for i in active if unit * w[i] > most * sizes[i]]
        for i in over or active:
            out[i] = float(most * sizes[i]) if over else unit * w[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return out


def source_table(sized: DataFrame, share: float = 1.5, weights=WEIGHTS, most: float = 2.0) -> list[tuple]:
    """(sid, source, source_size, target), one per source, by code point, null
    last. The list of source names is the one thing that comes to the driver."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows = sorted(((r.source, r.n) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    return [(i, s, n, t) for i, ((s, n), t) in enumerate(zip(rows, targets([n for _, n in rows], share, weights, most)))]


def slots(spark: SparkSession, table: list[tuple], block_words: int) -> DataFrame:
    """slot, sid, r: for each slot of the mix the source and the rank of the slot
    among the source's. Ranks are counted in two levels, so that no source's
    slots meet in one task."""
    need = [-(-round(t) // block_words) for _, _, _, t in table]
    cuts = np.cumsum([t for _, _, _, t in table])
    total, span = sum(need), float(cuts[-1]) if len(cuts) else 0.0
    if not total:
        return spark.range(0).select(F.col("id").alias("slot"), F.lit(0).alias("sid"), F.col("id").alias("r"))

    def place(batches):
        for b in batches:
            i = b.column(0).to_numpy()
            sid = np.searchsorted(cuts, np.mod((i + 1) * GOLDEN, 1.0) * span, "right")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.minimum(sid, len(cuts) - 1).astype(np.int32))], ["slot", "sid"])

    placed = spark.range(total).mapInArrow(trimmed(place), "slot long, sid int").withColumn("part", F.expr("slot div 65536"))
    before = placed.groupBy("sid", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n"))
    ranked = placed.withColumn("k", F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot")) - 1)
    ranked = ranked.join(before.drop("n"), ["sid", "part"]).select("slot", "sid", (F.col("before") + F.col("k")).alias("r"))
    # A source that the points left short gets its last slots at the end.
    have = before.groupBy("sid").agg(F.sum("n").alias("n"))
    names = spark.createDataFrame([(i, n) for i, n in enumerate(need) if n], "sid int, need long")
    short = names.join(have, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("need > n")
    short = short.select(F.lit(total).cast("long").alias("slot"), "sid", F.explode(F.sequence(F.col("n"), F.col("need") - 1)).alias("r"))
    return ranked.join(names, "sid").filter("r < need").drop("need").unionByName(short)


def schedule(docs: DataFrame, share: float = 1.5, weights=WEIGHTS, most: int = 2, block_words: int = 2048, seed: int = 17):
    """(pieces, sized). pieces: slot, sid, r, pos, doc_id, word_from, word_to, one
    row for each run of a document's words in a slot of the mix. sized: every
    document with sid, pos (its place in its source's stream) and size."""
    spark = docs.sparkSession
    counted = materialize(word_counts(docs, seed))
    table = source_table(counted, share, weights, most)
    known = spark.createDataFrame(table, "sid int, source string, source_size long, target double")
    # Equal rows of a task are one until they have their places.
    grouped = counted.groupBy("doc_id", "source", "key", "size", F.spark_partition_id().alias("task")).agg(F.count("*").alias("copies"))
    keyed = grouped.join(known, grouped.source.eqNullSafe(known.source)).drop(known.source)
    keyed = keyed.withColumn("bucket", F.pmod("key", F.lit(BUCKETS))).withColumn("all", F.col("size") * F.col("copies"))
    before = keyed.groupBy("sid", "bucket").agg(F.sum("all").alias("n"))
    before = before.withColumn("base", F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).drop("n")
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size", "task").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("upto", F.sum("all").over(inside)).join(before, ["sid", "bucket"])
    placed = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    sized = materialize(placed.select("doc_id", "source", "size", "source_size", "target", "sid", (F.col("base") + F.col("upto") - F.col("all") + F.col("nth") * F.col("size")).alias("pos")))

    B = F.lit(block_words)
    runs = sized.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    runs = runs.withColumn("a", F.col("pos") + F.col("epoch") * F.col("source_size")).withColumn("z", F.least(F.col("a") + F.col("size"), F.round("target").cast("long")))
    runs = runs.filter("a < z").withColumn("r", F.explode(F.sequence(F.expr(f"a div {block_words}"), F.expr(f"(z - 1) div {block_words}"))))
    runs = runs.withColumn("lo", F.greatest("a", F.col("r") * B)).withColumn("hi", F.least("z", (F.col("r") + 1) * B))
    pieces = slots(spark, table, block_words).join(runs.select("sid", "r", "pos", "doc_id", (F.col("lo") - F.col("a")).alias("word_from"), (F.col("hi") - F.col("a")).alias("word_to")), ["sid", "r"])
    return pieces, sized


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and first_slot (where in the
    mix it first comes, null if never) of every document."""
    pieces, sized = schedule(docs, **options)
    taken = pieces.groupBy("sid", "pos").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("got"), F.min("slot").alias("slot"))
    out = sized.join(taken, ["sid", "pos"], "left")
    got = F.when(F.col("size") > 0, F.coalesce("got", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", got.alias("taken"), "source", F.when(F.col("size") > 0, F.col("slot")).alias("first_slot"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
