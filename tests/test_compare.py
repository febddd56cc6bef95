"""Comparisons, close points, track merging and local adjustment."""

from __future__ import annotations

import numpy as np
import pytest
from scenes import ring

from sparkogram.kernels.incremental import Pair, Reconstruction, Settings
from sparkogram.operators import compare
from sparkogram.plans.workflow import merge_tracks


def test_close_points_equal_brute_force(spark):
    x = np.random.default_rng(0).random((150, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "point_id long, x double, y double, z double")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if d[i, j] <= 0.15}
    assert {tuple(r) for r in compare.close_points(df, 0.15).collect()} == want


def test_centre_and_scale(spark):
    x = np.random.default_rng(1).normal(5, 3, (200, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "pid long, x double, y double, z double")
    got = np.array([[r["x"], r["y"], r["z"]] for r in compare.centre_and_scale(df).orderBy("pid").collect()])
    c = x - np.median(x, axis=0)
    assert np.allclose(got, c / np.percentile(np.abs(c), 98))


def test_merge_tracks_keeps_one_match_per_track(spark):
    rows = [(0, 1, 3, [0, 1, 0], [0, 1, 1]), (1, 2, 1, [1], [4])]
    df = spark.createDataFrame(rows, "img_i int, img_j int, n_inliers int, kp_i array<int>, kp_j array<int>")
    got = {(r["img_i"], r["img_j"]): (r["n_inliers"], r["kp_i"], r["kp_j"]) for r in merge_tracks(df).collect()}
    assert got == {(0, 1): (1, [0], [0]), (1, 2): (1, [1], [4])}


def test_local_adjustment_window():
    k, poses, _, kp, matches = ring(120, 5)
    feats = {int(i): g[["x", "y"]].to_numpy() for i, g in kp.groupby("image_id")}
    pairs = {}
    for (i, j), g in matches.groupby(["img_i", "img_j"]):
        (ri, ti), (rj, tj) = poses[i], poses[j]
        r = rj @ ri.T
        t = tj - r @ ti
        pairs[int(i), int(j)] = Pair(g[["kp_i", "kp_j"]].to_numpy(), r, t / np.linalg.norm(t))
    rec = Reconstruction(feats, pairs, k, Settings(local_window=3)).run()
    assert len(rec.cameras) >= 4 and rec.rmse() <= 2.0
    assert any(e["kind"] == "ba" and e["cameras"] == 3 for e in rec.log)
    assert rec.intr[0] == pytest.approx(640, rel=0.1)
