"""Clusters as connected components of neighbour graphs, and what is made of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions.geometry import c
from scanlake.operators.aggregates import aabb, centroids, cluster_quality, range_image, relabel
from scanlake.operators.components import components_of_frames
from scanlake.operators.joins import neighbours


def _components(points: DataFrame, edges: DataFrame) -> DataFrame:
    """frame_id, point_idx, label: the smallest index of each point's component."""
    labels = components_of_frames(edges)
    return points.select("frame_id", "point_idx").join(labels, ["frame_id", "point_idx"], "left").select("frame_id", "point_idx", F.coalesce("label", "point_idx").alias("label"))


def euclidean(points: DataFrame, tolerance: float, min_size: int = 1, max_size: int = 1 << 30, voxel: float | None = None) -> DataFrame:
    """frame_id, point_idx, label, cluster_id (-1 outside the sizes). Labels are
    those of converged components, whatever the number of rounds."""
    labels = _components(points, neighbours(points, tolerance, voxel))
    kept = relabel(labels, min_size, max_size).select("frame_id", "label", "cluster_id")
    return labels.join(kept, ["frame_id", "label"], "left").select("frame_id", "point_idx", "label", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def image_edges(pixels: DataFrame, distance: float, angle: float, width: int = 360, adaptive_from: float = 5.0, adaptive_max: float = 4.0) -> DataFrame:
    """frame_id, a, b: neighbouring pixels (eight, around the seam) whose points are
    near and in nearly the same direction. The distance grows with range; of two
    points the larger limit holds, so an edge doesn't depend on who looks."""
    limit = F.when(c("range") > adaptive_from, distance * F.least(c("range") / adaptive_from, F.lit(adaptive_max))).otherwise(F.lit(distance))
    p = pixels.withColumn("limit", limit).select("frame_id", "row", "col", c("point_idx").alias("b"), *(c(k).alias(f"{k}2") for k in ("x", "y", "z", "range", "limit")))
    # Half of the eight directions: each pair is made once.
    half = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    q = pixels.withColumn("limit", limit).withColumn("o", half)
    q = q.select("frame_id", (c("row") + c("o.i")).alias("row"), F.pmod(c("col") + c("o.j"), F.lit(width)).alias("col"), c("point_idx").alias("a"), "x", "y", "z", "range", "limit")
    met = q.join(p, ["frame_id", "row", "col"])
    d = F.sqrt(sum(((c(k) - c(f"{k}2")) * (c(k) - c(f"{k}2")) for k in "xyz"), F.lit(0.0)))
    cos = sum((c(k) * c(f"{k}2") for k in "xyz"), F.lit(0.0)) / (c("range") * c("range2"))
    between = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
    return met.filter((c("a") != c("b")) & (d < F.greatest("limit", "limit2")) & (between < angle)).select("frame_id", "a", "b")


def range_image_clusters(points: DataFrame, distance: float = 0.1, angle: float = 0.1, width: int = 360, height: int = 32, min_size: int = 2, max_size: int = 5000) -> DataFrame:
    """frame_id, point_idx, label, cluster_id of the points that are nearest in
    their pixel."""
    pixels = range_image(points, width, height).join(points.select("frame_id", "point_idx", "x", "y", "z"), ["frame_id", "point_idx"])
    labels = _components(pixels, image_edges(pixels, distance, angle, width))
    kept = relabel(labels, min_size, max_size).select("frame_id", "label", "cluster_id")
    return labels.join(kept, ["frame_id", "label"], "left").select("frame_id", "point_idx", "label", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def multi_level(points: DataFrame, levels: int = 2, distance: float = 0.1, angle: float = 0.1, distance_step: float = 0.15, angle_step: float = 0.07, **options) -> DataFrame:
    """frame_id, point_idx, level, label: clusters of growing thresholds; a level
    sees the points that no earlier one has taken."""
    out, rest = None, points
    for k in range(levels):
        found = range_image_clusters(rest, distance + k * distance_step, angle + k * angle_step, **options).filter("cluster_id >= 0")
        found = found.select("frame_id", "point_idx", F.lit(k).alias("level"), "label")
        out = found if out is None else out.unionByName(found)
        rest = rest.join(found.select("frame_id", "point_idx"), ["frame_id", "point_idx"], "left_anti")
    return out


def merge_greedily(points: DataFrame, threshold: float) -> DataFrame:
    """frame_id, cluster_id, merged_id: clusters whose centroids are nearer than the
    threshold are joined, first pair first, with new centroids each time. The order
    counts, so a frame's clusters (a row each) are folded together: each cluster that is
    settled or merged takes one comparison with all others of its frame."""
    sums = points.groupBy("frame_id", "cluster_id").agg(*(F.sum(a).alias(a) for a in "xyz"), F.count("*").alias("n"))
    kind = points.schema["frame_id"].dataType.simpleString()

    def run(g):
        g = g.sort_values("cluster_id")
        ids, n = g["cluster_id"].to_numpy(), g["n"].to_numpy().astype(float)
        total = g[["x", "y", "z"]].to_numpy(dtype=float)
        mean = total / n[:, None]
        into, alive = np.arange(len(ids)), np.ones(len(ids), dtype=bool)
        # Before `i` no two clusters are near. A merge moves one centroid only, so the next
        # first pair is that centroid with an earlier one, or else with a later one.
        i = 0
        while i < len(ids):
            near = alive & (np.sqrt(((mean - mean[i]) ** 2).sum(axis=1)) < threshold) if alive[i] else np.zeros(len(ids), dtype=bool)
            near[i] = False
            other = np.flatnonzero(near)
            if not len(other):
                i += 1
                continue
            keep, gone = sorted((i, other[0]))
            total[keep] += total[gone]
            n[keep] += n[gone]
            mean[keep] = total[keep] / n[keep]
            alive[gone], into[into == gone] = False, keep
            i = keep
        return pd.DataFrame({"frame_id": g["frame_id"].iloc[0], "cluster_id": ids, "merged_id": ids[into]})

    return sums.groupBy("frame_id").applyInPandas(run, f"frame_id {kind}, cluster_id int, merged_id int")


def good_clusters(points: DataFrame, **limits) -> DataFrame:
    """Points of clusters of positive quality."""
    q = cluster_quality(points, "frame_id", "cluster_id", **limits).filter("quality > 0").select("frame_id", "cluster_id")
    return points.join(q, ["frame_id", "cluster_id"], "left_semi")


def published_ids(labels: DataFrame) -> DataFrame:
    """Ids from 1 in label order; points outside clusters are appended with 0."""
    order = Window.partitionBy("frame_id").orderBy("label")
    kept = labels.filter("cluster_id >= 0").select("frame_id", "label").distinct().withColumn("published_id", F.row_number().over(order))
    return labels.join(kept, ["frame_id", "label"], "left").select("frame_id", "point_idx", F.coalesce("published_id", F.lit(0)).alias("published_id"))


def every_kth_frame(rows: DataFrame, k: int) -> DataFrame:
    return rows.filter(c("frame_id") % k == 0)


def cluster_node(points: DataFrame, box: dict, max_points: int, tolerance: float, min_size: int, max_size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Region of interest, cap, clustering, size filter; then the labelled points,
    the centroids and the boxes."""
    from scanlake.operators.clouds import cap, roi

    seen = cap(roi(points, box), max_points)
    labels = euclidean(seen, tolerance, min_size, max_size).filter("cluster_id >= 0").select("frame_id", "point_idx", "cluster_id")
    cloud = seen.join(labels, ["frame_id", "point_idx"])
    return cloud, centroids(cloud, "frame_id", "cluster_id"), aabb(cloud, "frame_id", "cluster_id")


def match(votes: DataFrame, totals: DataFrame, min_points: int = 6, min_ratio: float = 0.3, exclusive: bool = True, max_clusters: int = 50) -> DataFrame:
    """frame_id, det_idx, cluster_id, votes, rank: clusters of each detection, by
    votes. `votes`: points per frame, detection and cluster; `totals`: per frame and
    cluster. With `exclusive` a cluster goes to the first detection that takes it:
    a fold over a frame's few votes."""
    v = votes.join(totals, ["frame_id", "cluster_id"]).filter(c("votes") >= max(1, min_points))
    if min_ratio > 0:
        v = v.filter(c("votes") / c("total") >= min_ratio)
    kinds = {x.name: x.dataType.simpleString() for x in votes.schema}
    if not exclusive:
        order = Window.partitionBy("frame_id", "det_idx").orderBy(F.desc("votes"), "cluster_id")
        return v.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= max(1, max_clusters)).select("frame_id", "det_idx", "cluster_id", "votes", "rank")

    def run(g):
        g = g.sort_values(["det_idx", "votes", "cluster_id"], ascending=[True, False, True])
        taken, rank, keep = set(), {}, []
        for i, (d, k) in enumerate(zip(g.det_idx, g.cluster_id)):
            if k not in taken and rank.get(d, 0) < max(1, max_clusters):
                taken.add(k)
                rank[d] = rank.get(d, 0) + 1
                keep.append((i, rank[d]))
        out = g.iloc[[i for i, _ in keep]][["frame_id", "det_idx", "cluster_id", "votes"]].copy()
        out["rank"] = [r for _, r in keep]
        return out

    return v.groupBy("frame_id").applyInPandas(run, f"frame_id {kinds['frame_id']}, det_idx {kinds['det_idx']}, cluster_id {kinds['cluster_id']}, votes long, rank int")


def vote(pixels_in_detections: DataFrame) -> DataFrame:
    """Points per detection and cluster."""
    return pixels_in_detections.filter("cluster_id >= 0").groupBy("frame_id", "det_idx", "cluster_id").agg(F.count("*").alias("votes"))


def detections(model_output: DataFrame, names: DataFrame, confidence: float = 0.2, most: int = 300) -> DataFrame:
    """Detections above a confidence, best first, named by class; a class without a
    name is class_<id>."""
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_idx")
    kept = model_output.filter(c("score") >= confidence).withColumn("_n", F.row_number().over(order)).filter(c("_n") <= most).drop("_n")
    named = kept.join(F.broadcast(names), "class", "left")
    return named.withColumn("class_id", F.coalesce("name", F.concat(F.lit("class_"), c("class")))).drop("name")


def masks_to_images(masks: DataFrame) -> DataFrame:
    """0/1 masks (arrays) as grey values."""
    return masks.withColumn("grey", F.transform("mask", lambda v: (v * 255).cast("int")))
