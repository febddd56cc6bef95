"""Feature tracks: components of the match graph, cleaned and summarised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkogram.operators.components import connected_components

#: Nodes (image, keypoint) as one long: keypoint numbers stay below 2^24.
SHIFT = 1 << 24


def node(image: str, kp: str) -> F.Column:
    return F.col(image).cast("long") * SHIFT + F.col(kp)


def match_components(matches: DataFrame) -> DataFrame:
    """(component, image_id, kp_id) of the match graph; the label is the smallest node."""
    cc = connected_components(matches.select(node("img_i", "kp_i").alias("a"), node("img_j", "kp_j").alias("b")))
    return cc.select(
        "component", F.expr(f"cast(node div {SHIFT} as int)").alias("image_id"), F.expr(f"cast(node % {SHIFT} as int)").alias("kp_id")
    )


def clean_tracks(components: DataFrame, min_length: int = 2, max_length: int = 200) -> DataFrame:
    """(track_id, image_id, kp_id): images that occur twice in a component leave it whole; lengths are bounded."""
    once = components.groupBy("component", "image_id").agg(F.count("*").alias("n"), F.min("kp_id").alias("kp_id")).where("n = 1")
    length = once.groupBy("component").agg(F.count("*").alias("length")).where(F.col("length").between(min_length, max_length))
    return once.join(length, "component").select(F.col("component").alias("track_id"), "image_id", "kp_id")


def track_lengths(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("track_id").agg(F.count("*").alias("length"))


def length_histogram(tracks: DataFrame, top: int = 12) -> DataFrame:
    """(length, n_tracks); lengths from ``top`` on share the last bin."""
    return track_lengths(tracks).groupBy(F.least("length", F.lit(top)).alias("length")).agg(F.count("*").alias("n_tracks"))


def track_statistics(components: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row: components, conflicting components, tracks, observations, length figures, two-view and longer tracks."""
    per = components.groupBy("component", "image_id").agg(F.count("*").alias("n"))
    c = per.groupBy("component").agg((F.max("n") > 1).cast("long").alias("conflict"), F.sum("n").alias("nodes"))
    left = c.agg(
        F.count("*").alias("n_components"),
        F.coalesce(F.sum("conflict"), F.lit(0)).alias("n_conflicted"),
        F.coalesce(F.sum("nodes"), F.lit(0)).alias("n_nodes"),
        F.coalesce(F.max("nodes"), F.lit(0)).alias("largest_component"),
    )
    right = track_lengths(tracks).agg(
        F.count("*").alias("n_tracks"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("n_observations"),
        F.avg("length").alias("mean_length"),
        F.expr("percentile(length, 0.5)").alias("median_length"),
        F.max("length").alias("max_length"),
        F.coalesce(F.sum((F.col("length") == 2).cast("long")), F.lit(0)).alias("n_two_view"),
        F.coalesce(F.sum((F.col("length") >= 3).cast("long")), F.lit(0)).alias("n_three_plus"),
    )
    return left.join(right)  # one row each


def track_of(tracks: DataFrame, keypoints: DataFrame) -> DataFrame:
    """track_id of given (image_id, kp_id) rows, null where there is none."""
    return keypoints.join(tracks, ["image_id", "kp_id"], "left")


def track_members(tracks: DataFrame, images: DataFrame) -> DataFrame:
    """Track members inside an image set."""
    return tracks.join(images.select("image_id").distinct(), "image_id", "left_semi")


def first_match_per_component(matches: DataFrame, components: DataFrame) -> DataFrame:
    """Per image pair and component only the first match stays, with the pair's new inlier count."""
    label = components.select(F.col("image_id").alias("img_i"), F.col("kp_id").alias("kp_i"), "component")
    first = W.partitionBy("img_i", "img_j", "component").orderBy("ord", "kp_i", "kp_j")
    kept = matches.join(label, ["img_i", "kp_i"]).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    counts = kept.groupBy("img_i", "img_j").agg(F.count("*").alias("n_inliers"))
    return kept.join(counts, ["img_i", "img_j"]).select("img_i", "img_j", "kp_i", "kp_j", "component", "n_inliers")


def image_components(pairs: DataFrame, images: DataFrame, min_inliers: int = 1) -> DataFrame:
    """(image_id, component, size, rank): scene-graph components by size, isolated images included."""
    cc = connected_components(pairs.where(F.col("n_inliers") >= min_inliers), "img_i", "img_j")
    every = images.select("image_id").distinct().join(cc, F.col("image_id") == F.col("node"), "left")
    every = every.select("image_id", F.coalesce("component", "image_id").alias("component"))
    sizes = every.groupBy("component").agg(F.count("*").alias("size"))
    # one row per component of the scene graph
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.desc("size"), "component")))
    return every.join(ranked, "component").select("image_id", "component", "size", "rank")


def keep_largest(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs with both ends in the largest component."""
    inside = components.where("rank = 1").select("image_id")
    a = pairs.join(inside.withColumnRenamed("image_id", "img_i"), "img_i", "left_semi")
    return a.join(inside.withColumnRenamed("image_id", "img_j"), "img_j", "left_semi").select(*pairs.columns)
