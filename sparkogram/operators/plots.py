"""The tables behind the figures: what a plot needs, one table each, nothing drawn.

Samples are seeded hash orders, so a figure shows the same rows in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkogram.operators.observations import error_bins, observers, point_errors
from sparkogram.operators.quantiles import quantiles

XYZ = ("x", "y", "z")


def seeded(columns: list[str], seed: int) -> Column:
    """A hash order that depends on the seed."""
    return F.md5(F.concat_ws(":", *columns, F.lit(seed)))


def sampled_images(images: DataFrame, n: int, registered: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """At most n images (image_id), of the registered ones where given; a sampling operator."""
    pool = images.select("image_id").distinct()
    if registered is not None:
        pool = pool.join(registered.select("image_id").distinct(), "image_id", "left_semi")
    return pool.orderBy(seeded(["image_id"], seed), "image_id").limit(n).orderBy("image_id")


def sampled_pairs(pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most n image pairs (img_i, img_j); a sampling operator."""
    pool = pairs.select("img_i", "img_j").distinct()
    return pool.orderBy(seeded(["img_i", "img_j"], seed), "img_i", "img_j").limit(n).orderBy("img_i", "img_j")


def keypoint_overlay(keypoints: DataFrame, image_id: int) -> DataFrame:
    """Keypoints of an image in their order."""
    return keypoints.where(F.col("image_id") == image_id).orderBy("kp_id")


def keypoint_counts(keypoints: DataFrame, top: int = 15) -> DataFrame:
    """(image_id, n, rank): the images with most keypoints."""
    n = keypoints.groupBy("image_id").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "image_id").limit(top).withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "image_id")))  # top rows only


def match_lines(matches: DataFrame, inliers: DataFrame, img_i: int, img_j: int, most: int = 200, seed: int = 42) -> DataFrame:
    """Sampled raw matches of a pair with their inlier flag and the pair's inlier percentage."""
    here = (F.col("img_i") == img_i) & (F.col("img_j") == img_j)
    keys = ["kp_i", "kp_j"]
    raw = matches.where(here).select(*keys).distinct()
    kept = inliers.where(here).select(*keys).distinct().withColumn("inlier", F.lit(True))
    flags = raw.join(kept, keys, "left").withColumn("inlier", F.coalesce("inlier", F.lit(False)))
    share = flags.agg((100.0 * F.avg(F.col("inlier").cast("double"))).alias("inlier_percent"))
    return flags.orderBy(seeded(keys, seed), *keys).limit(most).join(share)  # one row


def graph_nodes(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """(image_id, degree, isolated) of the connectivity graph."""
    ends = pairs.select(F.col("img_i").alias("image_id")).unionAll(pairs.select("img_j"))
    degree = ends.groupBy("image_id").agg(F.count("*").alias("n"))
    got = images.select("image_id").distinct().join(degree, "image_id", "left")
    return got.select("image_id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"), F.col("n").isNull().alias("isolated"))


def graph_edges(pairs: DataFrame, widest: float = 5.0) -> DataFrame:
    """(img_i, img_j, n_inliers, width): line widths from 0.5 to ``widest`` in proportion to the inliers."""
    top = pairs.agg(F.max("n_inliers").alias("top"))
    width = F.lit(0.5) + F.lit(widest - 0.5) * F.try_divide(F.col("n_inliers"), F.col("top"))
    return pairs.join(F.broadcast(top)).select("img_i", "img_j", "n_inliers", width.alias("width"))


def epipolar_lines(inliers: DataFrame, fundamental: str, most: int = 10, seed: int = 42) -> DataFrame:
    """Sampled inliers (img_i, img_j, x1, y1, x2, y2, F) with the lines F x1 in the second and F^T x2 in the first image."""
    f = lambda i: F.col(fundamental).getItem(i)
    order = W.partitionBy("img_i", "img_j").orderBy(seeded(["x1", "y1", "x2", "y2"], seed), "x1", "y1", "x2", "y2")
    second = F.array(*(f(3 * i) * F.col("x1") + f(3 * i + 1) * F.col("y1") + f(3 * i + 2) for i in range(3)))
    first = F.array(*(f(i) * F.col("x2") + f(i + 3) * F.col("y2") + f(i + 6) for i in range(3)))
    some = inliers.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")
    return some.withColumn("line_2", second).withColumn("line_1", first)


def registration_steps(events: DataFrame) -> DataFrame:
    """(step, image_id, n_new, n_points, n_cameras): what every registration added and the totals after it."""
    w = W.orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)  # a row per photo
    return events.select("step", "image_id", "n_new", F.sum("n_new").over(w).alias("n_points"), F.count("*").over(w).alias("n_cameras"))


def adjustment_rounds(events: DataFrame) -> DataFrame:
    """(round, rmse_before, rmse_after, gain_percent, n_cameras, n_removed) of the bundle adjustments."""
    gain = 100 * F.try_divide(F.col("rmse_before") - F.col("rmse_after"), F.col("rmse_before"))
    return events.select("round", "rmse_before", "rmse_after", gain.alias("gain_percent"), "n_cameras", (F.col("n_points_before") - F.col("n_points_after")).alias("n_removed"))


def lifecycle(obs: DataFrame, top: int = 20) -> DataFrame:
    """(n_observers, n_points, mean_error): points by how many images see them, the last bin open."""
    n = observers(obs).withColumn("n_observers", F.least("n_observers", F.lit(top).cast("long")))
    return n.join(point_errors(obs), "point_id", "left").groupBy("n_observers").agg(F.count("*").alias("n_points"), F.avg("err").alias("mean_error"))


def camera_axes(cameras: DataFrame, length: float = 1.0) -> DataFrame:
    """(image_id, step, centre and the ends of the three axes) of cameras in the order of their ids; R rows are the axes."""
    out = [F.col("image_id")]
    for a, axis in enumerate("xyz"):
        out += [(F.col(f"c{c}") + F.lit(length) * F.col("R").getItem(3 * a + i)).alias(f"{axis}{c}") for i, c in enumerate(XYZ)]
    return cameras.select(*out[:1], *(f"c{c}" for c in XYZ), *out[1:])


def error_classes(obs: DataFrame) -> DataFrame:
    """Counts of reprojection errors below 1, from 1 to 2 and from 2 pixels on, per image."""
    return error_bins(obs)


def cloud_view(points: DataFrame, most: int = 20_000, seed: int = 42) -> DataFrame:
    """Sampled points for a scatter plot; a sampling operator."""
    return points.orderBy(seeded(["pid"], seed), "pid").limit(most)


def bounding_box(points: DataFrame) -> DataFrame:
    """One row: corners and extent of a cloud."""
    box = points.agg(*(f(c).alias(f"{n}_{c}") for c in XYZ for f, n in ((F.min, "min"), (F.max, "max"))))
    return box.select("*", *((F.col(f"max_{c}") - F.col(f"min_{c}")).alias(f"extent_{c}") for c in XYZ))


def dashboard(cameras: DataFrame, points: DataFrame, obs: DataFrame, seconds: dict[str, float]) -> DataFrame:
    """(figure, value): the key figures of a run, a row each."""
    spark = points.sparkSession
    n = points.count()
    lengths = obs.groupBy("point_id").agg(F.countDistinct("image_id").alias("n")).agg(F.avg("n").alias("mean"), F.max("n").alias("top")).first()
    errors = obs.where("err is not null").agg(F.sqrt(F.avg(F.col("err") * F.col("err")))).first()[0]
    rows = [("cameras", float(cameras.count())), ("points", float(n)), ("mean_track_length", lengths["mean"]), ("max_track_length", lengths["top"] and float(lengths["top"])), ("rmse", errors)]
    rows += [(f"seconds_{k}", float(v)) for k, v in seconds.items()]
    return spark.createDataFrame(rows, "figure string, value double")


def face_histograms(faces: DataFrame, columns: tuple[str, ...] = ("area", "edge"), bins: int = 40, share: float = 0.99) -> DataFrame:
    """(quantity, bin, low, n, mean, variation): histograms of mesh quantities clipped at a quantile."""
    out = None
    for c in columns:
        have = faces.where(F.col(c).isNotNull())
        hi = quantiles(have, {c: [share]})[c][0]
        lo = have.agg(F.min(c)).first()[0]
        if hi is None:
            continue
        step = (hi - lo) / bins or 1.0
        b = F.least(F.lit(bins - 1), F.floor((F.least(F.col(c), F.lit(hi)) - F.lit(lo)) / F.lit(step))).cast("int")
        stats = have.agg(F.avg(c).alias("mean"), F.try_divide(F.stddev_pop(c), F.avg(c)).alias("variation"))
        part = have.groupBy(b.alias("bin")).agg(F.count("*").alias("n")).join(stats)  # one row
        part = part.select(F.lit(c).alias("quantity"), "bin", (F.lit(lo) + F.col("bin") * F.lit(step)).alias("low"), "n", "mean", "variation")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else faces.sparkSession.createDataFrame([], "quantity string, bin int, low double, n long, mean double, variation double")


def six_views(vertices: DataFrame) -> DataFrame:
    """(vid, view, u, v): vertices centred on their median and scaled by the 98th percentile of their extent, seen along both senses of each axis."""
    q = quantiles(vertices, {c: [0.5] for c in XYZ})
    centred = vertices.select("vid", *((F.col(c) - F.lit(q[c][0] or 0.0)).alias(c) for c in XYZ))
    far = centred.select(F.greatest(*(F.abs(c) for c in XYZ)).alias("d"))
    scale = quantiles(far, {"d": [0.98]})["d"][0] or 1.0
    s = {c: F.col(c) / F.lit(scale) for c in XYZ}
    views = {"front": (s["x"], s["y"]), "back": (-s["x"], s["y"]), "left": (-s["z"], s["y"]), "right": (s["z"], s["y"]), "top": (s["x"], -s["z"]), "bottom": (s["x"], s["z"])}
    pairs = F.array(*(F.struct(F.lit(n).alias("view"), u.alias("u"), v.alias("v")) for n, (u, v) in views.items()))
    return centred.select("vid", F.explode(pairs).alias("p")).select("vid", "p.*")


def summary_lines(figures: DataFrame) -> list[str]:
    """The dashboard as lines of text (a row per figure)."""
    rows = figures.orderBy("figure").collect()
    return [f"{r['figure']}: {'n/a' if r['value'] is None else format(r['value'], '.6g')}" for r in rows]
