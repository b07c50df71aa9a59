"""Connected components by alternating large and small stars.

A round replaces each edge set by one with the same components in which nodes
point nearer to the smallest of their component; a node's smallest neighbour is a
grouped minimum, combined in each task, and is joined back to its edges, a join
whose one side has unique keys, so a hub's edges can be split among tasks. Each
round is written to the shared folder. The number of rounds grows with the
logarithm of the longest path.

Graphs that fall into many bounded ones, as the points of frames do, need no rounds:
each is settled in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from scanlake.storage import drop_table, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the node's smallest neighbour: one
    edge for each before. Repeated ones go with the small star."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label of every node that has an edge to another: the smallest node of
    its component. Null ends and loops are no edges."""
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    now = materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        # The edges' number and the sum of their hashes are taken as they are written.
        mark = Observation()
        new = materialize(_small_star(_large_star(now)).observe(mark, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
        drop_table(now)
        now = new
        # A round leaves stars as they are, and nothing else.
        if mark.get == seen:
            break
        seen = mark.get
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def smallest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a-b, ascending, and for each the smallest of its
    component: trees hook on to smaller ones and are flattened, all at once."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[root]


def components_of_frames(edges: DataFrame) -> DataFrame:
    """frame_id, point_idx, label of every point that has an edge (frame_id, a, b) to
    another: the smallest index of its component. A frame is one scan, which bounds a
    task."""
    kind = edges.schema["frame_id"].dataType

    def settle(frame):
        nodes, label = smallest_labels(*(frame.column(k).to_numpy() for k in ("a", "b")))
        key = pa.array([frame.column("frame_id")[0].as_py()] * len(nodes), frame.schema.field("frame_id").type)
        return pa.table([key, pa.array(nodes), pa.array(label)], ["frame_id", "point_idx", "label"])

    rows = edges.select("frame_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null")
    return rows.groupBy("frame_id").applyInArrow(settle, f"frame_id {kind.simpleString()}, point_idx long, label long")
