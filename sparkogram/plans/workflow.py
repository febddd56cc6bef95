"""The workflow from keypoints (or photos) to cameras, cloud and report."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkogram.kernels.adjust import Options
from sparkogram.kernels.incremental import Settings
from sparkogram.operators import focal, matching, observations, poses, tracks
from sparkogram.plans import backends
from sparkogram.plans import reconstruct as rec
from sparkogram.plans.config import Config
from sparkogram.runtime import cut
from sparkogram.sources.documents import checkpoint_key, load_checkpoint, save_checkpoint, write_cameras

log = logging.getLogger("sparkogram")

FOCAL_FACTORS = (0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.0, 1.05, 1.1, 1.2, 1.3, 1.5, 1.7)


@dataclass
class Outcome:
    K: np.ndarray
    matches: DataFrame
    verified: DataFrame
    result: DataFrame
    cameras: DataFrame
    points: DataFrame
    observations: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)
    summary: dict = field(default_factory=dict)


def settings(cfg: Config) -> Settings:
    ba = Options(cfg.ba_max_nfev, cfg.ba_ftol, cfg.ba_xtol, cfg.ba_gtol, fix_principal_point=cfg.ba_fix_principal_point, separate_focal=cfg.ba_separate_focal, refine_intrinsics=not cfg.no_refine_intrinsics)
    return Settings(cfg.max_reproj_error, ba_interval=cfg.ba_interval, seed=max(cfg.seed, 0), completion=not cfg.no_track_completion, ba=ba, local_window=cfg.local_ba_window)


def merge_tracks(verified: DataFrame) -> DataFrame:
    """Verified pairs with one inlier per pair and track: later matches of a component are dropped and counts rewritten."""
    flat = verified.select("img_i", "img_j", F.posexplode(F.arrays_zip("kp_i", "kp_j")).alias("ord", "m"))
    flat = cut(flat.select("img_i", "img_j", "ord", "m.kp_i", "m.kp_j"), "inliers")
    kept = tracks.first_match_per_component(flat, tracks.match_components(flat))
    packed = kept.groupBy("img_i", "img_j").agg(F.array_sort(F.collect_list(F.struct("kp_i", "kp_j"))).alias("m"))
    new = packed.select("img_i", "img_j", F.size("m").alias("n_inliers"), F.col("m.kp_i").alias("kp_i"), F.col("m.kp_j").alias("kp_j"))
    rest = verified.drop("n_inliers", "kp_i", "kp_j").join(new, ["img_i", "img_j"])
    return rest.select(*verified.columns)


def gates(cfg: Config) -> dict:
    return {"threshold": cfg.ransac_thr, "min_inliers": cfg.min_inliers}


def extract(images: DataFrame, cfg: Config) -> DataFrame:
    """Keypoints of photos by the configured extractor backend (see plans.backends)."""
    return backends.get("extractor", cfg.feature_backend)(images, cfg)


def search_focal(matches: DataFrame, keypoints: DataFrame, K: np.ndarray, cfg: Config) -> tuple[float, DataFrame]:
    """(factor, curve): the focal factor at which most matches triangulate, over a few strong pairs."""
    ranked = matching.pair_counts(matches)
    from sparkogram.operators.reports import greedy_pairs, ranked_pairs

    chosen = greedy_pairs(ranked_pairs(ranked), cfg.focal_search_pairs, 2).select("img_i", "img_j")
    few = matches.join(chosen, ["img_i", "img_j"], "left_semi")
    curve = cut(rec.score_focal(few, keypoints, K, list(FOCAL_FACTORS), cfg.max_reproj_error, max(cfg.seed, 0), **gates(cfg)), "focal")
    best = focal.peak(curve).first()
    return (float(best["refined"]) if best and best["accepted"] else 1.0), curve


def close_loops(out: Outcome, keypoints: DataFrame, cfg: Config) -> DataFrame:
    """Verified pairs with those that proposed loop and rescue pairs add."""
    cams = out.cameras.select("image_id", *(f"c{c}" for c in "xyz"), *(F.col("R").getItem(6 + i).alias(f"d{c}") for i, c in enumerate("xyz")))
    known = out.verified.select("img_i", "img_j")
    near = poses.loop_pairs(cut(cams, "loop"), known, None, cfg.loop_max_angle, cfg.loop_max_centre_ratio, cfg.loop_max_pairs)
    images = keypoints.select("image_id").distinct()
    rescue = poses.rescue_pairs(matching.pair_counts(out.matches), out.cameras, images)
    pairs = near.select("img_i", "img_j").unionByName(rescue).distinct().join(known, ["img_i", "img_j"], "left_anti")
    ratio, least = poses.relaxed(cfg.ratio, cfg.min_matches)
    extra = cut(matching.match_pairs(keypoints, pairs, ratio, True, least).drop("distance"), "loop-matches")
    fresh = rec.verify(extra, keypoints, out.K, seed=max(cfg.seed, 0), **gates(cfg))
    return cut(observations.upsert(out.verified, fresh, ["img_i", "img_j"]), "closed")


def run(keypoints: DataFrame, cfg: Config, K: np.ndarray, known_focal: bool = True, matches: DataFrame | None = None, vectors: DataFrame | None = None, image_hash: str = "", names: DataFrame | None = None) -> Outcome:
    """Match, verify, reconstruct, close loops, filter and summarise.

    ``keypoints``: image_id, kp_id, x, y [, descriptor].  ``matches`` skips
    matching.  With ``checkpoint_dir`` and ``resume`` matches are taken from there
    when they belong to the same image set and options.  ``names`` (image_id,
    image_name) are the photo names of the camera export, else ids stand for them.
    """
    spark: SparkSession = keypoints.sparkSession
    seconds: dict[str, float] = {}

    def timed(name: str, make):
        start = time.time()
        got = make()
        seconds[name] = time.time() - start
        log.info("%s: %.1f s", name, seconds[name])
        return got

    if matches is None:
        strategy = "retrieval" if cfg.retrieval != "none" else cfg.match_strategy
        key = checkpoint_key(strategy, cfg.ratio, cfg.min_matches)
        found = load_checkpoint(spark, cfg.checkpoint_dir, key, image_hash) if cfg.checkpoint_dir and cfg.resume else None
        if found is None:
            top = cfg.retrieval_top_k if strategy == "retrieval" else cfg.vocab_top_k
            pairs = matching.candidate_pairs(keypoints, strategy, cfg.sequential_window, top, vectors, cfg.vocab_words)
            found = timed("matching", lambda: cut(matching.match_pairs(keypoints, pairs, cfg.ratio, True, cfg.min_matches), "matches"))
            if cfg.checkpoint_dir:
                save_checkpoint(found, cfg.checkpoint_dir, key, image_hash)
        matches = found
    matches = matching.at_least(matches, cfg.min_matches)
    if (cfg.focal_search or not known_focal) and not cfg.no_focal_search and cfg.focal is None:
        factor, _ = timed("focal", lambda: search_focal(matches, keypoints, K, cfg))
        K = K.copy()
        K[0, 0], K[1, 1] = K[0, 0] * factor, K[1, 1] * factor
    verified = timed("verification", lambda: cut(rec.verify(matches, keypoints, K, seed=max(cfg.seed, 0), **gates(cfg)), "verified"))
    images = keypoints.select("image_id").distinct()
    comps = cut(tracks.image_components(verified, images), "scene")
    if cfg.loop_closure:
        bridges = poses.bridge_pairs(comps, matches)
        if "descriptor" in keypoints.columns and bridges.take(1):
            more = cut(matching.match_pairs(keypoints, bridges, cfg.ratio, True, cfg.min_matches), "bridges")
            fresh = rec.verify(more, keypoints, K, seed=max(cfg.seed, 0), **gates(cfg))
            verified = cut(observations.upsert(verified, fresh, ["img_i", "img_j"]), "bridged")
            comps = cut(tracks.image_components(verified, images), "scene")
    verified = cut(tracks.keep_largest(verified, comps), "largest")
    if cfg.track_merge:
        verified = cut(merge_tracks(verified), "merged")
    if not verified.take(1):
        raise ValueError("no image pair passes verification")
    result = timed("reconstruction", lambda: cut(rec.reconstruct(verified, keypoints, K, settings(cfg)), "result"))
    out = _outcome(K, matches, verified, result, seconds)
    if cfg.geometric_loop_closure and "descriptor" in keypoints.columns:
        closed = timed("loops", lambda: close_loops(out, keypoints, cfg))
        if closed.count() > verified.count():
            second = timed("second reconstruction", lambda: cut(rec.reconstruct(closed, keypoints, K, settings(cfg)), "result"))
            out = _outcome(K, matches, closed, rec.better(result, second), seconds)
    err = cut(rec.observation_errors(out.observations, out.cameras, out.points), "errors")
    out.summary["prefilter"] = observations.error_summary(err, cfg.max_reproj_error).first().asDict()
    if not cfg.no_filter:
        kept = observations.inlier_points(observations.point_errors(err), cfg.max_reproj_error)
        out.points = cut(out.points.join(kept.select("point_id"), "point_id", "left_semi"), "points")
        out.observations = cut(out.observations.join(kept.select("point_id"), "point_id", "left_semi"), "observations")
        err = err.join(kept.select("point_id"), "point_id", "left_semi")
    out.summary["reprojection"] = observations.error_summary(err, cfg.max_reproj_error).first().asDict()
    out.summary |= {"n_cameras": out.cameras.count(), "n_points": out.points.count(), "stages": seconds}
    if cfg.export_cameras:
        if names is None:
            named = out.cameras.withColumn("image_name", F.col("image_id").cast("string"))
        else:
            named = out.cameras.join(names.select("image_id", "image_name"), "image_id")
        write_cameras(named, cfg.export_cameras, **out.summary)
    return out


def _outcome(K, matches, verified, result, seconds) -> Outcome:
    return Outcome(K, matches, verified, result, rec.cameras_of(result), rec.points_of(result), rec.observations_of(result), seconds)


def save_points(points: DataFrame, path: str) -> None:
    """Coloured or plain PLY through the data source; grey without colours."""
    from sparkogram.sources.ply import PlyDataSource

    points.sparkSession.dataSource.register(PlyDataSource)
    colour = [F.col(c).cast("int").alias(c) if c in points.columns else F.lit(128).alias(c) for c in "rgb"]
    points.select("x", "y", "z", *colour).write.format("ply").mode("append").save(path)
