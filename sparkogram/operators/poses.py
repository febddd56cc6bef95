"""Camera poses: loop, rescue and bridge pairs, alignment sums, pose errors, normalised points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkogram.functions.geometry import matmul, rotation_angle
from sparkogram.operators.quantiles import quantile

XYZ = ("x", "y", "z")


def axes_centre(cameras: DataFrame) -> list[float]:
    """The point closest to all viewing axes (least squares over 9 + 3 sums); the mean centre when they are parallel.

    ``cameras``: image_id, cx, cy, cz (centre), dx, dy, dz (unit viewing direction).
    """
    m = lambda i, j: F.lit(1.0 if i == j else 0.0) - F.col(f"d{XYZ[i]}") * F.col(f"d{XYZ[j]}")
    sums = [F.sum(m(i, j)) for i in range(3) for j in range(3)]
    sums += [F.sum(sum(m(i, j) * F.col(f"c{XYZ[j]}") for j in range(3))) for i in range(3)]
    row = cameras.agg(F.array(*sums).alias("s"), F.array(*(F.avg(f"c{c}") for c in XYZ)).alias("mean")).first()
    if row["s"][0] is None:
        return [0.0, 0.0, 0.0]
    a, b = np.array(row["s"][:9]).reshape(3, 3), np.array(row["s"][9:])
    if np.linalg.matrix_rank(a, tol=1e-9 * max(1.0, float(np.abs(a).max()))) < 3:
        return [float(x) for x in row["mean"]]
    return [float(x) for x in np.linalg.solve(a, b)]


def loop_pairs(cameras: DataFrame, existing: DataFrame, centre: list[float] | None = None, max_angle: float = 45.0, max_ratio: float = 0.6, top: int = 200) -> DataFrame:
    """(img_i, img_j, score): near cameras that look the same way and are no pair yet.

    With r the median distance of the centres from ``centre``: angle up to
    ``max_angle``, distance d between 1e-6 r and max_ratio * r; the score is
    cos * (1 - d / (max_ratio * r)).  A camera is compared with cameras in the 27
    grid cells of side max_ratio * r around it, so distant ones never meet.
    """
    centre = axes_centre(cameras) if centre is None else centre
    d0 = F.sqrt(sum((F.col(f"c{c}") - F.lit(float(v))) ** 2 for c, v in zip(XYZ, centre, strict=True)))
    spark = cameras.sparkSession
    r = quantile(cameras.select(d0.alias("d")), "d", 0.5) if len(cameras.select("image_id").take(3)) == 3 else None
    if not r:
        return spark.createDataFrame([], "img_i long, img_j long, score double")
    far = max_ratio * r
    cell = lambda c: F.floor(F.col(f"c{c}") / F.lit(far))
    a = cameras.select(F.col("image_id").alias("img_i"), *(F.col(f"{p}{c}").alias(f"{p}a{c}") for p in "cd" for c in XYZ), *(cell(c).alias(f"k{c}") for c in XYZ))
    for c in XYZ:
        a = a.withColumn(f"k{c}", F.explode(F.sequence(F.col(f"k{c}") - 1, F.col(f"k{c}") + 1)))
    b = cameras.select(F.col("image_id").alias("img_j"), *(F.col(f"{p}{c}").alias(f"{p}b{c}") for p in "cd" for c in XYZ), *(cell(c).alias(f"k{c}") for c in XYZ))
    pairs = a.join(b, [f"k{c}" for c in XYZ]).where("img_i < img_j")
    cos = sum(F.col(f"da{c}") * F.col(f"db{c}") for c in XYZ)
    dist = F.sqrt(sum((F.col(f"ca{c}") - F.col(f"cb{c}")) ** 2 for c in XYZ))
    pairs = pairs.select("img_i", "img_j", cos.alias("cosine"), dist.alias("distance"))
    pairs = pairs.where(F.col("cosine") >= F.lit(float(np.cos(np.radians(max_angle)))))
    pairs = pairs.where((F.col("distance") >= 1e-6 * r) & (F.col("distance") <= far))
    pairs = pairs.join(existing.select("img_i", "img_j"), ["img_i", "img_j"], "left_anti")
    scored = pairs.select("img_i", "img_j", (F.col("cosine") * (1 - F.col("distance") / F.lit(far))).alias("score"))
    return scored.orderBy(F.desc("score"), "img_i", "img_j").limit(top)


def rescue_pairs(counts: DataFrame, registered: DataFrame, images: DataFrame, top_k: int = 8) -> DataFrame:
    """(img_i, img_j): every unregistered image with its top_k registered partners by raw matches."""
    reg = registered.select("image_id").distinct()
    both = counts.select(F.col("img_i").alias("image_id"), F.col("img_j").alias("other_id"), "n_matches").unionAll(
        counts.select("img_j", "img_i", "n_matches")
    )
    both = both.join(images.join(reg, "image_id", "left_anti").select("image_id").distinct(), "image_id", "left_semi")
    both = both.join(reg.withColumnRenamed("image_id", "other_id"), "other_id", "left_semi")
    best = W.partitionBy("image_id").orderBy(F.desc("n_matches"), "other_id")
    top = both.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top_k)
    return top.select(F.least("image_id", "other_id").alias("img_i"), F.greatest("image_id", "other_id").alias("img_j")).distinct()


def relaxed(ratio: float, min_matches: int) -> tuple[float, int]:
    """Ratio and least matches for rescue pairs."""
    return min(0.9, ratio + 0.1), max(8, min_matches // 2)


def bridge_pairs(components: DataFrame, matched: DataFrame) -> DataFrame:
    """Image pairs of different components that were not matched yet: all are asked for, one row per image."""
    c = components.select("image_id", "component")
    pairs = c.alias("a").join(c.alias("b"), F.expr("a.image_id < b.image_id and a.component <> b.component"))
    pairs = pairs.select(F.col("a.image_id").alias("img_i"), F.col("b.image_id").alias("img_j"))
    return pairs.join(matched.select("img_i", "img_j").distinct(), ["img_i", "img_j"], "left_anti")


def alignment_sums(pairs: DataFrame) -> DataFrame:
    """One row of the sums a similarity fit needs: n, means, 3x3 covariance (dst x src), source variance.

    ``pairs``: sx, sy, sz (source), tx, ty, tz (target).
    """
    mean = pairs.agg(F.count("*").alias("n"), *(F.avg(f"{p}{c}").alias(f"m{p}{c}") for p in "st" for c in XYZ))
    d = pairs.join(F.broadcast(mean))
    dev = {f"{p}{c}": F.col(f"{p}{c}") - F.col(f"m{p}{c}") for p in "st" for c in XYZ}
    cov = [F.avg(dev[f"t{a}"] * dev[f"s{b}"]).alias(f"cov_{a}{b}") for a in XYZ for b in XYZ]
    var = F.avg(sum(dev[f"s{c}"] * dev[f"s{c}"] for c in XYZ)).alias("var_s")
    return d.agg(F.first("n").alias("n"), *(F.first(f"m{p}{c}").alias(f"m{p}{c}") for p in "st" for c in XYZ), *cov, var)


def fit_similarity(pairs: DataFrame) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(scale, R, t) of target = s R source + t; the 3x3 decomposition is all the driver does."""
    from sparkogram.kernels.align import from_moments

    row = alignment_sums(pairs).first()
    if not row["n"] or row["n"] < 3:
        return None
    cov = np.array([[row[f"cov_{a}{b}"] for b in XYZ] for a in XYZ])
    return from_moments(np.array([row[f"ms{c}"] for c in XYZ]), np.array([row[f"mt{c}"] for c in XYZ]), cov, row["var_s"])


def image_key(name: str) -> Column:
    """Image name up to its first dot."""
    return F.split(F.col(name), r"\.").getItem(0)


def pose_errors(estimated: DataFrame, truth: DataFrame) -> DataFrame:
    """(key, position_error, position_percent, rotation_error) after similarity alignment of the centres.

    Both: image_name, R, cx, cy, cz.  The percentage refers to the diagonal of all true centres.
    """
    e = estimated.select(image_key("image_name").alias("key"), F.col("R").alias("re"), *(F.col(f"c{c}").alias(f"s{c}") for c in XYZ))
    t = truth.select(image_key("image_name").alias("key"), F.col("R").alias("rt"), *(F.col(f"c{c}").alias(f"t{c}") for c in XYZ))
    j = e.join(t, "key")
    fit = fit_similarity(j)
    if fit is None:
        raise ValueError("alignment needs three common cameras")
    s, r, shift = fit
    box = truth.agg(*((F.max(f"c{c}") - F.min(f"c{c}")).alias(c) for c in XYZ)).first()
    extent = float(sum(box[c] ** 2 for c in XYZ) ** 0.5)
    moved = [sum(F.lit(float(s * r[i, k])) * F.col(f"s{XYZ[k]}") for k in range(3)) + F.lit(float(shift[i])) for i in range(3)]
    position = F.sqrt(sum((m - F.col(f"t{c}")) ** 2 for m, c in zip(moved, XYZ, strict=True)))
    align = F.array(*(F.lit(float(x)) for x in r.ravel()))
    rotation = rotation_angle(matmul("rt", matmul("re", align, transpose_b=True), transpose_b=True))
    return j.select("key", position.alias("position_error"), (F.lit(100.0) * position / F.lit(extent)).alias("position_percent"), rotation.alias("rotation_error"))


def hartley(points: DataFrame, group: list[str]) -> DataFrame:
    """Points (group, x, y) moved to their centroid and scaled to mean distance sqrt 2, with the group's scale."""
    w = W.partitionBy(*group)
    p = points.withColumn("mx", F.avg("x").over(w)).withColumn("my", F.avg("y").over(w))
    p = p.withColumn("scale", F.lit(2.0**0.5) / F.greatest(F.avg(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))).over(w), F.lit(1e-12)))
    return p.withColumn("nx", (F.col("x") - F.col("mx")) * F.col("scale")).withColumn("ny", (F.col("y") - F.col("my")) * F.col("scale"))
