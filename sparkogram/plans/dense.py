"""Dense stage: neighbour choice, disparity windows, fusion filters, block matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkogram.operators.quantiles import quantile, quantiles

XYZ = ("x", "y", "z")


def neighbour_pairs(cameras: DataFrame, covisibility: DataFrame, points: DataFrame, per_image: int = 2, min_baseline: float = 0.02, max_ratio: float = 0.35) -> DataFrame:
    """(img_i, img_j, baseline, n_shared): every image's most covisible neighbours with a usable baseline.

    The baseline is at least ``min_baseline`` of the median distance of centres
    from their median, and at most ``max_ratio`` of the depth of the scene.
    """
    centre = quantiles(cameras, {f"c{c}": [0.5] for c in XYZ})
    spread = cameras.select(F.sqrt(sum((F.col(f"c{c}") - F.lit(centre[f"c{c}"][0]).cast("double")) ** 2 for c in XYZ)).alias("d"))
    s = quantile(spread, "d", 0.5) or 0.0
    mid = {c: q[0] for c, q in quantiles(points, {c: [0.5] for c in XYZ}).items()}
    a = cameras.select(F.col("image_id").alias("img_i"), *(F.col(f"c{c}").alias(f"a{c}") for c in XYZ))
    b = cameras.select(F.col("image_id").alias("img_j"), *(F.col(f"c{c}").alias(f"b{c}") for c in XYZ))
    both = covisibility.select(F.col("img_a").alias("img_i"), F.col("img_b").alias("img_j"), "n_shared")
    both = both.unionAll(both.select("img_j", "img_i", "n_shared"))
    j = both.join(a, "img_i").join(b, "img_j")
    base = F.sqrt(sum((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in XYZ))
    depth = F.sqrt(sum((F.col(f"a{c}") - F.lit(float(mid[c] or 0.0))) ** 2 for c in XYZ))
    j = j.withColumn("baseline", base).where((F.col("baseline") >= min_baseline * s) & (F.col("baseline") <= max_ratio * depth))
    best = W.partitionBy("img_i").orderBy(F.desc("n_shared"), "img_j")
    return j.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= per_image).select("img_i", "img_j", "baseline", "n_shared")


def disparity_window(depths: np.ndarray, focal: float, baseline: float, width: int) -> tuple[int, int] | None:
    """(least disparity, number of disparities) in multiples of 16 from the sparse depths, or None when too wide."""
    if len(depths) < 8:
        return 0, 256
    near, far = np.percentile(depths, 2) * 0.7, np.percentile(depths, 98) * 1.6
    low = int(np.floor(focal * baseline / far / 16)) * 16
    count = int(np.clip(np.ceil((focal * baseline / near - low) / 16) * 16, 64, 512))
    return None if low + count >= 0.6 * width else (low, count)


def working_scale(width: int, height: int, disparities: int, budget: float = 6e7) -> float:
    """Image scale at which width * height * disparities fits the budget, between 0.1 and 1."""
    return float(np.clip((budget / max(width * height * disparities, 1)) ** (1 / 3), 0.1, 1.0))


def block_match(left: np.ndarray, right: np.ndarray, low: int, count: int, block: int = 5) -> np.ndarray:
    """Disparity of every left pixel by absolute differences over a block; NaN where right-to-left disagrees."""
    h, w = left.shape
    a, b, r = left.astype(np.float32), right.astype(np.float32), block // 2

    def costs(p: np.ndarray, q: np.ndarray, sign: int) -> np.ndarray:
        best, at = np.full((h, w), np.inf, np.float32), np.zeros((h, w), np.int32)
        for d in range(low, low + count):
            diff = np.full((h, w), 255.0, np.float32)
            if d < w:
                if sign > 0:
                    diff[:, d:] = np.abs(p[:, d:] - q[:, : w - d])
                else:
                    diff[:, : w - d] = np.abs(p[:, : w - d] - q[:, d:])
            total = np.cumsum(np.cumsum(np.pad(diff, ((r + 1, r), (r + 1, r)), mode="edge"), 0), 1)
            cost = total[block:, block:] - total[:-block, block:] - total[block:, :-block] + total[:-block, :-block]
            less = cost < best
            best[less], at[less] = cost[less], d
        return at

    lr, rl = costs(a, b, 1), costs(b, a, -1)
    x = np.arange(w)[None, :] - lr
    back = np.take_along_axis(rl, np.clip(x, 0, w - 1), axis=1)
    return np.where((x >= 0) & (np.abs(back - lr) <= 1), lr.astype(float), np.nan)


def valid_disparity(disparity: str, low: float, z: str, depth: str):
    """Above the window's floor, finite, with positive bounded depth in both frames."""
    d, zc = F.col(disparity), F.col(z)
    return (d > low + 0.5) & ~F.isnan(zc) & (zc > 0) & (zc < 1e6) & (F.col(depth) > 0.01)


def scene_filter(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Dense points within three times the 98th percentile radius of the sparse cloud's median centre."""
    if len(sparse.take(8)) < 8:
        r = dense.select(F.sqrt(sum(F.col(c) ** 2 for c in XYZ)).alias("d"))
        limit = 10 * (quantile(r, "d", 0.5) or 0.0)
        return dense.where(F.sqrt(sum(F.col(c) ** 2 for c in XYZ)) < limit)
    mid = quantiles(sparse, {c: [0.5] for c in XYZ})
    d = F.sqrt(sum((F.col(c) - F.lit(mid[c][0])) ** 2 for c in XYZ))
    q = quantile(sparse.select(d.alias("d")), "d", 0.98)
    return dense.where(d <= 3 * q)


#: Cameras that one pass over the points holds (21 numbers each).
BLOCK = 20_000


def depth_consistent(points: DataFrame, cameras: DataFrame, min_views: int = 2) -> DataFrame:
    """Points (pid, x, y, z) that project into at least ``min_views`` images.

    A narrow pass counts, for a batch of points at a time, the cameras that see
    them: matrix products against blocks of cameras, so no row per point and
    camera is ever made.  Cameras come in blocks of BLOCK, each a pass of its own.
    """
    rows = cameras.select("image_id", "R", "t", "K")
    total = rows.count()
    seen = points.withColumn("_n", F.lit(0).cast("long"))
    blocks = -(-total // BLOCK)
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("image_id"), F.lit(blocks)) == k) if blocks > 1 else rows
        got = part.collect()
        pose = [np.array([r[c] for r in got], float) for c in ("R", "t", "K")]
        seen = seen.mapInArrow(_seen_batches([points.columns.index(c) for c in XYZ], *pose), seen.schema)
    return seen.where(F.col("_n") >= min(min_views, total)).drop("_n")


def _seen_batches(at: list[int], r: np.ndarray, t: np.ndarray, k: np.ndarray):
    """mapInArrow function: adds to the last column how many of the cameras see the point."""
    r, width, height = r.reshape(-1, 3, 3), 2 * k[:, 2], 2 * k[:, 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in at])
            n = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).copy()
            for i in range(0, len(r), 256):
                cam = np.einsum("cij,pj->cpi", r[i : i + 256], x) + t[i : i + 256, None]
                z = cam[..., 2]
                safe = np.where(np.abs(z) > 1e-9, z, 1e-9)
                u = k[i : i + 256, 0, None] * cam[..., 0] / safe + k[i : i + 256, 2, None]
                v = k[i : i + 256, 4, None] * cam[..., 1] / safe + k[i : i + 256, 5, None]
                n += ((z > 0.01) & (u >= 0) & (v >= 0) & (u < width[i : i + 256, None]) & (v < height[i : i + 256, None])).sum(axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=batch.schema.names)

    return run


def capped(points: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` points in a seeded hash order (the stage's documented cap)."""
    return points.orderBy(F.xxhash64("pid", F.lit(seed)), "pid").limit(most)
