"""Observations of points by images: thresholds, summaries, covisibility, links.

Observations: image_id, point_id, x, y and, where stated, err or ordering columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkogram.operators.quantiles import quantile, quantiles
from sparkogram.runtime import cut


def first_observations(obs: DataFrame, order: list[str]) -> DataFrame:
    """The first observation of every (image, point) in a total order."""
    first = W.partitionBy("image_id", "point_id").orderBy(*order)
    return obs.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def seen(obs: DataFrame) -> DataFrame:
    """Distinct (image_id, point_id)."""
    return obs.select("image_id", "point_id").distinct()


def covisibility(obs: DataFrame) -> DataFrame:
    """(img_a, img_b, n_shared) for images a < b that observe a common point.

    A point seen by t images makes t (t - 1) / 2 pairs; tracks are bounded by
    their maximal length.  Counts are combined before the second shuffle.
    """
    s = seen(obs)
    a, b = s.withColumnRenamed("image_id", "img_a"), s.withColumnRenamed("image_id", "img_b")
    return a.join(b, "point_id").where("img_a < img_b").groupBy("img_a", "img_b").agg(F.count("*").alias("n_shared"))


def top_neighbours(pairs: DataFrame, k: int) -> DataFrame:
    """Every image's k best covisible images (image_id, other_id, n_shared, rank)."""
    both = pairs.select(F.col("img_a").alias("image_id"), F.col("img_b").alias("other_id"), "n_shared").unionAll(
        pairs.select("img_b", "img_a", "n_shared")
    )
    best = W.partitionBy("image_id").orderBy(F.desc("n_shared"), "other_id")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def observers(obs: DataFrame) -> DataFrame:
    """Distinct observing images per point."""
    return seen(obs).groupBy("point_id").agg(F.count("*").alias("n_observers"))


def error_threshold(errors: DataFrame, cap: float) -> DataFrame:
    """One row: the smaller of ``cap`` and median + 3 population deviations of finite errors."""
    finite = errors.where("err is not null and not isnan(err) and abs(err) < double('infinity')")
    middle = F.lit(quantile(finite, "err", 0.5)).cast("double")
    return finite.agg(F.least(F.lit(cap), middle + 3 * F.stddev_pop("err")).alias("threshold"))


def robust_scale(errors: DataFrame, least: float = 0.5, most: float = 10.0) -> DataFrame:
    """One row: 1.4826 times the median absolute error, kept between ``least`` and ``most``: the scale of a robust loss."""
    middle = quantile(errors.select(F.abs("err").alias("err")), "err", 0.5)
    scale = None if middle is None else min(max(1.4826 * middle, least), most)
    return errors.sparkSession.createDataFrame([(scale,)], "scale double")


def point_errors(obs: DataFrame) -> DataFrame:
    """Mean finite error per point (observations behind a camera have a null error)."""
    return obs.where("err is not null").groupBy("point_id").agg(F.avg("err").alias("err"))


def inlier_points(errors: DataFrame, cap: float) -> DataFrame:
    """Points (point_id, err, new_id) at or below the threshold.

    The threshold is a one-row aggregate.  ``new_id`` numbers survivors densely by
    point id for exporters: range-sorted partitions plus partition offsets would
    do the same at sizes where one sort task is too much.
    """
    kept = errors.join(F.broadcast(error_threshold(errors, cap))).where("err <= threshold").drop("threshold")
    return dense_ids(kept, "point_id", "new_id")


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """0-based ranks by a unique key without a single-task sort.

    Rows are range partitioned by the key, ranked inside their range, and shifted
    by the number of rows in smaller ranges (one row per partition).
    """
    # written out, because a second run of a range exchange may choose other bounds
    parts = cut(df.repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id()), "ranges")
    ranked = parts.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(key)))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.min(key).alias("_k"))
    shift = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    out = ranked.join(F.broadcast(shift), "_p").withColumn(name, (F.col("_r") + F.col("_s") - 1).cast("long"))
    return out.drop("_p", "_r", "_s")


def error_summary(obs: DataFrame, threshold: float) -> DataFrame:
    """rmse, mean, median, p95, max, share above threshold and counts over finite errors."""
    finite = obs.where("err is not null and abs(err) < double('infinity')")
    median, p95 = (F.lit(x).cast("double") for x in quantiles(finite, {"err": [0.5, 0.95]})["err"])
    return finite.agg(
        F.count("*").alias("n_obs"),
        F.countDistinct("point_id").alias("n_points"),
        F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"),
        F.avg("err").alias("mean"),
        median.alias("median"),
        p95.alias("p95"),
        F.max("err").alias("max"),
        F.avg((F.col("err") > threshold).cast("double")).alias("share_above"),
    )


def error_bins(obs: DataFrame) -> DataFrame:
    """Counts of errors below 1, from 1 to 2 and from 2 pixels on, per image."""
    label = F.when(F.col("err") < 1, "below_1").when(F.col("err") < 2, "1_to_2").otherwise("from_2")
    return obs.where("err is not null").groupBy("image_id", label.alias("bin")).agg(F.count("*").alias("n"))


def mean_colours(obs: DataFrame, points: DataFrame, threshold: float, default: int = 128) -> DataFrame:
    """Mean colour per point over observations up to the threshold, truncated; ``default`` where there are none."""
    good = obs.where(F.col("err") <= threshold)
    mean = good.groupBy("point_id").agg(*(F.avg(c).alias(f"_{c}") for c in ("r", "g", "b")))
    out = points.select("point_id").distinct().join(mean, "point_id", "left")
    return out.select("point_id", *(F.coalesce(F.col(f"_{c}").cast("int"), F.lit(default)).alias(c) for c in ("r", "g", "b")))


def correspondence_counts(matches: DataFrame, links: DataFrame, registered: DataFrame) -> DataFrame:
    """(image_id, n_points): distinct points an unregistered image reaches through matches with registered ones.

    ``matches`` symmetric (image_id, other_id, kp, other_kp); ``links`` (image_id, kp, point_id).
    """
    reg = registered.select("image_id").distinct()
    open_side = matches.join(reg, "image_id", "left_anti")
    other = links.join(reg, "image_id", "left_semi").select(F.col("image_id").alias("other_id"), F.col("kp").alias("other_kp"), "point_id")
    return open_side.join(other, ["other_id", "other_kp"]).groupBy("image_id").agg(F.countDistinct("point_id").alias("n_points"))


def correspondences(matches: DataFrame, links: DataFrame, registered: DataFrame) -> DataFrame:
    """2-D to 3-D correspondences (image_id, point_id, kp) of unregistered images; the first keypoint of a point wins."""
    reg = registered.select("image_id").distinct()
    open_side = matches.join(reg, "image_id", "left_anti")
    other = links.join(reg, "image_id", "left_semi").select(F.col("image_id").alias("other_id"), F.col("kp").alias("other_kp"), "point_id")
    first = W.partitionBy("image_id", "point_id").orderBy("other_id", "ord", "kp")
    joined = open_side.join(other, ["other_id", "other_kp"]).withColumn("_r", F.row_number().over(first))
    return joined.where("_r = 1").select("image_id", "point_id", "kp")


def next_image(counts: DataFrame, least: int = 6) -> DataFrame:
    """The image with most reachable points, when there are at least ``least``; ties to the smaller id."""
    return counts.where(F.col("n_points") >= least).orderBy(F.desc("n_points"), "image_id").limit(1)


def seed_pair(pairs: DataFrame, least_angle: float = 5.0) -> DataFrame:
    """The seed: best baseline * inliers among non-planar pairs of enough median angle, else most inliers.

    ``pairs``: img_i, img_j, n_inliers, baseline, angle, planar.
    """
    wide = (~F.col("planar")) & (F.col("angle") >= least_angle)
    ranked = pairs.select(
        "img_i", "img_j", "n_inliers",
        F.when(wide, 0).otherwise(1).alias("fallback"),
        F.when(wide, F.col("baseline") * F.col("n_inliers")).otherwise(F.col("n_inliers").cast("double")).alias("score"),
    )
    return ranked.orderBy("fallback", F.desc("score"), "img_i", "img_j").limit(1)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys ``old`` does not have are appended, each key once."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    return old.unionByName(fresh)


def completion_candidates(matches: DataFrame, links: DataFrame, obs: DataFrame) -> DataFrame:
    """Matches with one linked end: (image_id, kp, point_id) an image could still observe; the first claim wins."""
    src = links.select(F.col("image_id").alias("other_id"), F.col("kp").alias("other_kp"), "point_id")
    free = matches.join(links.select("image_id", "kp"), ["image_id", "kp"], "left_anti")
    cand = free.join(src, ["other_id", "other_kp"]).join(seen(obs), ["image_id", "point_id"], "left_anti")
    by_kp = W.partitionBy("image_id", "kp").orderBy("other_id", "ord", "point_id")
    by_point = W.partitionBy("image_id", "point_id").orderBy("other_id", "ord", "kp")
    one = cand.withColumn("_a", F.row_number().over(by_kp)).where("_a = 1")
    return one.withColumn("_b", F.row_number().over(by_point)).where("_b = 1").select("image_id", "kp", "point_id")


def track_votes(tracks: DataFrame, links: DataFrame) -> DataFrame:
    """(track_id, point_id): the point that most members of a track are linked to; ties to the smaller point."""
    votes = tracks.join(links, (tracks.image_id == links.image_id) & (tracks.kp_id == links.kp)).groupBy("track_id", "point_id").agg(F.count("*").alias("n"))
    best = W.partitionBy("track_id").orderBy(F.desc("n"), "point_id")
    return votes.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("track_id", "point_id", "n")


def merge_candidates(matches: DataFrame, links: DataFrame) -> DataFrame:
    """Point pairs (p < q) whose keypoints are matched with each other."""
    a = links.select("image_id", "kp", F.col("point_id").alias("pa"))
    b = links.select(F.col("image_id").alias("other_id"), F.col("kp").alias("other_kp"), F.col("point_id").alias("pb"))
    pairs = matches.join(a, ["image_id", "kp"]).join(b, ["other_id", "other_kp"]).where("pa <> pb")
    return pairs.select(F.least("pa", "pb").alias("p"), F.greatest("pa", "pb").alias("q")).distinct()
