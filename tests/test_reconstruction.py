"""Verification and reconstruction on an analytic scene."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from scenes import ring

from sparkogram.kernels.incremental import Pair, Reconstruction
from sparkogram.kernels.twoview import homography_poses, verify_pair
from sparkogram.operators import observations as O
from sparkogram.operators import poses as P
from sparkogram.operators.focal import peak
from sparkogram.plans import reconstruct as R


@pytest.fixture(scope="module")
def scene(spark):
    k, poses, world, kp, matches = ring()
    return k, poses, world, spark.createDataFrame(kp).cache(), spark.createDataFrame(matches).cache()


@pytest.fixture(scope="module")
def result(scene):
    k, _, _, kp, matches = scene
    verified = R.verify(matches, kp, k).cache()
    return verified, R.reconstruct(verified, kp, k).cache()


def test_verified_poses_match_truth(scene, result):
    k, poses, *_ = scene
    rows = result[0].collect()
    assert len(rows) >= 5
    for r in rows:
        ri, rj = poses[r["img_i"]][0], poses[r["img_j"]][0]
        rel = rj @ ri.T
        angle = np.degrees(np.arccos(np.clip((np.trace(np.array(r["R"]).reshape(3, 3) @ rel.T) - 1) / 2, -1, 1)))
        assert angle < 3.0


def test_ring_is_reconstructed(spark, scene, result):
    _, poses, *_ = scene
    cams, pts, obs = R.cameras_of(result[1]), R.points_of(result[1]), R.observations_of(result[1])
    assert cams.count() >= 4 and pts.count() >= 50
    err = R.observation_errors(obs, cams, pts)
    assert O.error_summary(err, 4.0).first()["rmse"] <= 2.0
    truth = spark.createDataFrame(
        [(f"{i}.png", [float(x) for x in r.ravel()], *(float(x) for x in -r.T @ t)) for i, (r, t) in enumerate(poses)],
        "image_name string, R array<double>, cx double, cy double, cz double",
    )
    est = cams.withColumn("image_name", F.concat(F.col("image_id").cast("string"), F.lit(".jpg")))
    errors = P.pose_errors(est, truth).collect()
    assert len(errors) >= 4
    assert np.median([e["position_percent"] for e in errors]) < 2 and np.median([e["rotation_error"] for e in errors]) < 2


def test_partitioning_does_not_change_verification(spark, scene):
    k, _, _, kp, matches = scene
    a = R.verify(matches.repartition(1), kp, k).orderBy("img_i", "img_j").collect()
    b = R.verify(matches.repartition(7, "ord"), kp.repartition(3), k).orderBy("img_i", "img_j").collect()
    assert a == b


def test_focal_search_prefers_the_true_focal_length(spark, scene):
    k, _, _, kp, matches = scene
    curve = R.score_focal(matches, kp, k, [0.7, 0.85, 1.0, 1.2, 1.5], max_error=2.0, min_inliers=10)
    best = peak(curve).first()
    assert 0.85 <= best["refined"] <= 1.2


def test_planar_pair_takes_the_homography_or_is_rejected():
    rng = np.random.default_rng(1)
    k = np.array([[1400.0, 0, 800], [0, 1400, 600], [0, 0, 1]])
    x = np.column_stack([rng.uniform(-2, 2, (400, 2)), np.full(400, 6.0)])
    a = np.radians(12)
    r = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
    t = -r @ np.array([0.9, 0, 0])
    proj = lambda r, t: ((x @ r.T + t) @ k.T)[:, :2] / (x @ r.T + t)[:, 2:]
    u, v = proj(np.eye(3), np.zeros(3)) + rng.normal(0, 0.3, (400, 2)), proj(r, t) + rng.normal(0, 0.3, (400, 2))
    got = verify_pair(u, v, k)
    assert got is not None and got.planar
    assert np.degrees(np.arccos(np.clip((np.trace(got.R @ r.T) - 1) / 2, -1, 1))) < 1.0
    assert verify_pair(u, v, k, planar_fallback=False) is None


def test_homography_of_a_pure_rotation():
    assert np.allclose(homography_poses(np.eye(3))[0][1], 0)


def test_too_few_matches_are_rejected():
    assert verify_pair(np.zeros((5, 2)), np.zeros((5, 2)), np.eye(3)) is None


def test_empty_reconstruction():
    rec = Reconstruction({0: np.zeros((0, 2))}, {}, np.eye(3)).run()
    assert not rec.cameras
    assert Pair(np.zeros((0, 2), int), np.eye(3), np.zeros(3)).planar is False
