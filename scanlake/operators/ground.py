"""Ground segmentation.

Rays are the unit of work: a ray is a narrow sector of one frame, so its points are
few. The ray and scan filters carry a state from point to point. They run over points
sorted by (frame, ray, radius), in batches of whole rays, all rays of a batch in step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions.geometry import TAU, c


def with_rays(points: DataFrame, divider_deg: float, swapped: bool = False) -> DataFrame:
    """radius and ray of each point. The scan filter measures from the y axis."""
    theta = F.atan2("x", "y") if swapped else F.atan2("y", "x")
    theta = F.when(theta < 0, theta + TAU).otherwise(theta)
    return points.withColumns({"radius": F.sqrt(c("x") * c("x") + c("y") * c("y")), "ray": F.floor(theta / math.radians(divider_deg)).cast("int")})


def _fold(rays: DataFrame, start, step, labels: list[str], out: str = "label") -> DataFrame:
    """Label the points of each ray, by radius, then index. All rays of a batch go in
    step: `step(i, state, r, x, y, z)` takes the i-th point of every ray that has one,
    updates `state` (arrays by ray, from `start(n)`) and returns their labels' numbers.
    Rays of a frame are dealt out by key; a batch holds many whole rays."""
    rows = rays.select("frame_id", "point_idx", "ray", "radius", "x", "y", "z").repartition("frame_id", "ray").sortWithinPartitions("frame_id", "ray", "radius", "point_idx")
    names = np.array(labels)

    def run(batches):
        held: list[pd.DataFrame] = []  # what is there of the last ray
        for b in batches:
            if not len(b):
                continue
            own = (b.frame_id == b.frame_id.iloc[-1]) & (b.ray == b.ray.iloc[-1])
            cut = len(b) - int(own.sum())
            goes_on = not cut and held and held[-1].frame_id.iloc[-1] == b.frame_id.iloc[0] and held[-1].ray.iloc[-1] == b.ray.iloc[0]
            if not goes_on:
                if whole := [*held, *([b[:cut]] if cut else [])]:
                    yield label(pd.concat(whole, ignore_index=True))
                held = []
            held.append(b[cut:])
        if held:
            yield label(pd.concat(held, ignore_index=True))

    def label(rows):
        frame, ray = rows.frame_id.to_numpy(), rows.ray.to_numpy()
        at = np.flatnonzero(np.concatenate([[True], (frame[1:] != frame[:-1]) | (ray[1:] != ray[:-1])]))
        size = np.diff(np.append(at, len(rows)))
        order = np.argsort(-size, kind="stable")  # rays that go on stand first
        at, size = at[order], size[order]
        r, x, y, z = (rows[k].to_numpy(dtype=float) for k in ("radius", "x", "y", "z"))
        state, found = start(len(at)), np.zeros(len(rows), dtype=np.int8)
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i, "left"))
            state = {k: v[:n] for k, v in state.items()}
            k = at[:n] + i
            found[k] = step(i, state, r[k], x[k], y[k], z[k])
        return rows[["frame_id", "point_idx"]].assign(**{out: names[found]})

    kinds = {x.name: x.dataType.simpleString() for x in rays.schema}
    return rows.mapInPandas(run, f"frame_id {kinds['frame_id']}, point_idx long, {out} string")


def _first_crossing(x: np.ndarray, y: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Where the way from the origin to (x, y) first meets the border of a box (min x,
    max x, min y, max y), as a share of it; inf if it does not."""
    first = np.full(len(x), np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for along, across, bounds, (low, high) in ((x, y, box[:2], box[2:]), (y, x, box[2:], box[:2])):
            for bound in bounds:
                t = bound / along
                meets = (t >= 0) & (t <= 1) & (across * t >= low) & (across * t <= high)
                first = np.where(meets, np.minimum(first, t), first)
    return first


def ray_filter(
    points: DataFrame, general: float = 10.0, local: float = 7.0, initial: float = 3.0, divider: float = 0.5, min_height: float = 0.03, concentric: float = 0.15, reclass: float = 0.15,
    footprint: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """frame_id, point_idx, label (ground, obstacle) by slopes along each ray.
    Angles are in degrees. With a `footprint` (min x, max x, min y, max y) a ray starts
    where it leaves it; a first point that lies inside is passed over as obstacle."""
    tg, tl, ti = (math.tan(math.radians(a)) for a in (general, local, initial))

    def start(n):
        return {"near": np.zeros(n), "height": np.zeros(n), "ground": np.zeros(n, dtype=bool)}

    def step(i, s, r, x, y, z):
        passed = np.zeros(len(r), dtype=bool)
        near = s["near"]
        if not i and footprint:
            t = _first_crossing(x, y, footprint)
            passed = np.isinf(t)
            near = np.where(passed, 0.0, np.where(passed, 0.0, t) * r)
        gap, level = r - near, np.abs(z) <= tg * r
        even = np.abs(z - s["height"]) <= np.maximum((tl if i else ti) * gap, min_height)
        now = np.where(gap < concentric, s["ground"], np.where(even, s["ground"] | level, (gap > reclass) & level)) & ~passed
        for name, value in (("near", r), ("height", z), ("ground", now)):
            s[name][~passed] = value[~passed]
        return now.astype(np.int8)

    return _fold(with_rays(points, divider), start, step, ["obstacle", "ground"])


def scan_filter(
    points: DataFrame, global_slope: float = 10.0, local_slope: float = 13.0, tolerance: float = 0.40, split_height: float = 0.50, divider: float = 0.5, wheel_base: float = 2.79, virtual_ground: bool = True,
) -> DataFrame:
    """frame_id, point_idx, label (ground, obstacle, follow) by running centroids of
    ground and obstacle points along each ray. A point that follows one without a
    label stays `follow`. Distances are in space; centroids without points are 0."""
    steepest, local, angle = math.tan(math.radians(global_slope)), math.radians(local_slope), math.radians(divider)
    FOLLOW, GROUND, OBSTACLE = 0, 1, 2

    def start(n):
        s = {k: np.zeros(n) for k in ("px", "py", "pz", "gr", "gz", "slope", "sum_r", "sum_z", "n_ground", "sum_o", "n_obstacle")}
        return s | {"last": np.full(n, FOLLOW)}

    def step(i, s, r, x, y, z):
        if not i:
            s["px"][:] = s["gr"][:] = np.where(virtual_ground & (x > wheel_base), wheel_base, 0.0)
        apart = np.sqrt((x - s["px"]) ** 2 + (y - s["py"]) ** 2 + (z - s["pz"]) ** 2)
        close = apart < r * angle + tolerance
        n = np.maximum(s["n_ground"], 1)
        rise, run = np.where(close, z - s["sum_z"] / n, z - s["gz"]), np.where(close, r - s["sum_r"] / n, r - s["gr"])
        sloped = np.where(np.arctan2(rise, run) - s["slope"] > local, OBSTACLE, GROUND)
        steep = z > steepest * r
        parted = (s["last"] == OBSTACLE) & (np.abs(z - s["sum_o"] / np.maximum(s["n_obstacle"], 1)) >= split_height)
        along = close & (np.abs(z - s["gz"]) < split_height)
        now = np.select([steep, parted, along], [np.full(len(r), OBSTACLE), sloped, s["last"]], sloped)
        anew = ~steep & (parted | ~along) & (sloped == GROUND)
        for name in ("sum_r", "sum_z", "n_ground", "sum_o", "n_obstacle"):
            s[name][anew] = 0.0
        ground, obstacle = now == GROUND, now == OBSTACLE
        for name, value in (("sum_r", r), ("sum_z", z), ("n_ground", np.ones(len(r)))):
            s[name][ground] += value[ground]
        for name, value in (("sum_o", z), ("n_obstacle", np.ones(len(r)))):
            s[name][obstacle] += value[obstacle]
        s["gr"][ground], s["gz"][ground] = r[ground], z[ground]
        s["slope"][ground] = np.arctan2(s["sum_z"][ground] / s["n_ground"][ground], s["sum_r"][ground] / s["n_ground"][ground])
        s["px"][:], s["py"][:], s["pz"][:], s["last"][:] = x, y, z, now
        return now.astype(np.int8)

    return _fold(with_rays(points, divider, swapped=True), start, step, ["follow", "ground", "obstacle"])


def split(points: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ground and obstacle points."""
    both = points.join(labels, ["frame_id", "point_idx"])
    return both.filter("label = 'ground'"), both.filter("label = 'obstacle'")


#: Centroids that are set against all planes of a frame at once.
SLICE = 4096


def ransac(points: DataFrame, iterations: int = 200, threshold: float = 0.15, tilt: float = 15.0, height: float = 0.20, voxel: float = 0.10, seed: int = 1) -> DataFrame:
    """frame_id, point_idx, is_obstacle. Voxel centroids vote for planes through
    three of them, chosen by a seeded hash, so the result is the same each time;
    the plane with most votes (first of equals) is refitted to them. A frame
    without a plane, or with one tilted by more than `tilt`, passes whole.

    Points are dealt by frame once; leaves, votes and the plane follow where they lie. A
    frame's planes are a matrix of `iterations` rows; its centroids, a scan's, are folded
    into a vector of votes a slice at a time. What leaves a frame is its plane and the
    moments of those near it."""
    from scanlake.operators.aggregates import voxel_downsample

    kind = points.schema["frame_id"].dataType.simpleString()
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = voxel_downsample(points.select("frame_id", "x", "y", "z").repartition(tasks, "frame_id"), voxel)
    leaves = leaves.select("frame_id", c("frame_id").cast("long").alias("number"), "vx", "vy", "vz", "x", "y", "z")
    moments = ("mx", "my", "mz", "xx", "yy", "xy", "xz", "yz")
    names = ["frame_id", "a", "b", "k", "d", *moments]

    def vote(leaf: pa.Table) -> pa.Table:
        number, n = leaf.column("number")[0].as_py(), len(leaf)
        none = pa.table({m: pa.array([], leaf.column(m).type if m == "frame_id" else pa.float64()) for m in names})
        if number is None or n < 3:
            return none
        order = pc.sort_indices(leaf, sort_keys=[(v, "ascending") for v in ("vx", "vy", "vz")], null_placement="at_start")
        at = np.stack([leaf.column(v).take(order).to_numpy() for v in "xyz"], axis=1)
        # A multiplicative hash of the try and the corner.
        h = np.arange(iterations, dtype=np.int64)
        i1, i2, i3 = (((h * 3 + i) * 2_654_435_761 + number * 40_503 + seed >> 8) % n for i in (1, 2, 3))
        apart = (i1 != i2) & (i2 != i3) & (i1 != i3)
        p, q, r = (at[i[apart]] for i in (i1, i2, i3))
        (ax, ay, az), (bx, by, bz) = (q - p).T, (r - p).T
        a, b, k = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
        s = np.sqrt(a * a + b * b + k * k)
        plane = s > 1e-9
        if not plane.any():
            return none
        a, b, k = (v[plane] / s[plane] for v in (a, b, k))
        d = -(a * p[plane, 0] + b * p[plane, 1] + k * p[plane, 2])
        votes = np.zeros(len(d), dtype=np.int64)
        for i in range(0, n, SLICE):
            x, y, z = at[i : i + SLICE].T
            votes += (np.abs(a[:, None] * x + b[:, None] * y + k[:, None] * z + d[:, None]) <= threshold).sum(1)
        best = int(np.argmax(votes))  # the first of equals
        a, b, k, d = (v[best] for v in (a, b, k, d))
        x, y, z = at[np.abs(a * at[:, 0] + b * at[:, 1] + k * at[:, 2] + d) <= threshold].T
        if not len(x):
            return none
        mx, my, mz = x.mean(), y.mean(), z.mean()
        u, v, w = x - mx, y - my, z - mz
        row = (a, b, k, d, mx, my, mz, (u * u).mean(), (v * v).mean(), (u * v).mean(), (u * w).mean(), (v * w).mean())
        return pa.table({"frame_id": leaf.column("frame_id").slice(0, 1)} | {m: [float(e)] for m, e in zip(names[1:], row)})

    m = leaves.groupBy("frame_id").applyInArrow(vote, f"frame_id {kind}, " + ", ".join(f"{m} double" for m in names[1:]))
    # Refit: z as a linear function of x and y over the inliers, by their moments.
    det = c("xx") * c("yy") - c("xy") * c("xy")
    fx, fy = (c("xz") * c("yy") - c("yz") * c("xy")) / det, (c("yz") * c("xx") - c("xz") * c("xy")) / det
    norm = F.sqrt(fx * fx + fy * fy + 1)
    fits = (det > 1e-9) & (F.abs(c("k")) > 0.1)
    refit = m.select(
        "frame_id", F.when(fits, -fx / norm).otherwise(c("a")).alias("a"), F.when(fits, -fy / norm).otherwise(c("b")).alias("b"), F.when(fits, 1 / norm).otherwise(c("k")).alias("k"),
        F.when(fits, (fx * c("mx") + fy * c("my") - c("mz")) / norm).otherwise(c("d")).alias("d"),
    )
    level = refit.filter(F.abs(c("k")) >= math.cos(math.radians(tilt)))
    out = points.join(level, "frame_id", "left")
    far = F.abs(c("a") * c("x") + c("b") * c("y") + c("k") * c("z") + c("d")) > height
    return out.select("frame_id", "point_idx", F.coalesce(far, F.lit(True)).alias("is_obstacle"))
