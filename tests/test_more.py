"""Quantiles, events, plot tables, the external runner, evaluation protocols, features and colours."""

from __future__ import annotations

import json
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkogram.functions import geometry as G
from sparkogram.kernels import sift
from sparkogram.operators import cloud, colours, matching, plots
from sparkogram.operators.quantiles import gaps, quantiles
from sparkogram.plans import backends, dense, evaluation
from sparkogram.plans.colmap_runner import ColmapRunner, largest_model
from sparkogram.plans.config import from_arguments
from sparkogram.plans.events import EventLog


@pytest.mark.parametrize("held", [50_000, 40])
def test_quantiles_are_exact_however_few_values_are_held(spark, held):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=700), np.full(200, 0.25), [1e12, -1e12, 5e-324]])
    y = np.round(rng.exponential(size=len(x)), 1)
    rows = [(float(a), float(b) if i % 9 else None) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "x double, y double").repartition(5)
    shares = [0.0, 0.02, 0.5, 0.6, 0.95, 0.999, 1.0]
    got = quantiles(df, {"x": shares, "y": [0.5, 0.9]}, held)
    kept = [b for _, b in rows if b is not None]
    assert np.allclose(got["x"], np.quantile(x, shares), rtol=1e-12) and np.allclose(got["y"], np.quantile(kept, [0.5, 0.9]))
    assert quantiles(df.limit(0), {"x": [0.5]}, held) == {"x": [None]}


def test_gaps_over_range_borders(spark):
    values = [float(v) for v in np.random.default_rng(2).permutation(200)] + [7.0, 7.0]
    got = sorted((r["value"], r["before"]) for r in gaps(spark.createDataFrame([(v,) for v in values], "v double").repartition(7), "v").collect() if r["before"] is not None)
    want = sorted(values)
    assert got == list(zip(want[1:], want, strict=False)) and len(got) == len(values) - 1


def test_depth_consistency_counts_cameras_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    cams = []
    for i in range(9):
        r, t = evaluation.look_at(rng.normal(size=3) * 4)
        cams.append((i, r.ravel().tolist(), t.tolist(), evaluation.camera_matrix(500.0, 640, 480).ravel().tolist()))
    x = rng.uniform(-3, 3, (150, 3))
    cameras = spark.createDataFrame(cams, "image_id long, R array<double>, t array<double>, K array<double>")
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "pid long, x double, y double, z double")
    n = np.zeros(150, int)
    for _, r, t, k in cams:
        uv, z = evaluation.project(np.array(k).reshape(3, 3), np.array(r).reshape(3, 3), np.array(t), x)
        n += (z > 0.01) & (uv >= 0).all(axis=1) & (uv[:, 0] < 640) & (uv[:, 1] < 480)
    for block in (20_000, 3):
        monkeypatch.setattr(dense, "BLOCK", block)
        assert {r["pid"] for r in dense.depth_consistent(points, cameras, 5).collect()} == set(np.flatnonzero(n >= 5).tolist())


def test_nearest_words_by_products_equal_differences(spark):
    rng = np.random.default_rng(4)
    words = np.round(rng.normal(size=(40, 8)), 1)
    words[7] = words[3]  # a tie
    points = np.vstack([words[3], rng.normal(size=(60, 8)), 1e6 + rng.normal(size=(5, 8))])
    kp = spark.createDataFrame([(0, i, p.tolist()) for i, p in enumerate(points)], "image_id int, kp_id int, descriptor array<double>")
    vocabulary = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(words)], "word long, centre array<double>")
    got = {r["kp_id"]: r["word"] for r in matching.nearest_word(kp, vocabulary).collect()}
    want = ((points[:, None] - words[None]) ** 2).sum(axis=2)
    assert got[0] == 3 and all(want[i, w] <= want[i].min() * (1 + 1e-9) for i, w in got.items())


def test_undistortion_inverts_distortion(spark):
    df = spark.range(50).select((F.col("id") / 100.0).alias("x"), (F.col("id") / 90.0 - 0.2).alias("y"), F.lit(-0.1).alias("k1"), F.lit(0.01).alias("k2"))
    df = df.withColumns(dict(zip(("xd", "yd"), G.distort(F.col("x"), F.col("y"), "k1", "k2"), strict=True)))
    u, v = G.undistort(F.col("xd"), F.col("yd"), "k1", "k2", rounds=30)
    assert df.select(F.max(F.abs(u - F.col("x")) + F.abs(v - F.col("y")))).first()[0] < 1e-8


def test_events_become_rows_and_listeners_cannot_stop_a_run(spark):
    seen = []

    def broken(row):
        seen.append(row["event"])
        raise RuntimeError("listener")

    log = EventLog(broken)
    kp = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "image_id int, kp_id int")
    m = spark.createDataFrame([(0, 1, 0, 0)], "img_i int, img_j int, kp_i int, kp_j int")
    log.pipeline_start(2, np.eye(3), {"ratio": 0.75}), log.features_done(kp), log.matching_done(m)
    log.verification_done(m, m.limit(0).withColumn("n_inliers", F.lit(1))), log.seed_selected(0, 1)
    log.camera_registered(0, 5, 1), log.camera_registered(1, 7, 2), log.adjustment_run(2.0, 1.0, 2, 12, 10)
    log.reconstruction_complete(2, 10), log.mesh_complete("m.ply", {"faces": 3}), log.pipeline_complete({"n_points": 10})
    rows = log.frame(spark).orderBy("seq").collect()
    assert [r["event"] for r in rows] == seen and len(rows) == 11
    assert json.loads(rows[1]["details"]) == {"n_images": 2, "n_keypoints": 3} and json.loads(rows[3]["details"])["n_verified"] == 0
    assert [(r["image_id"], r["n_points"], r["n_cameras"]) for r in log.registration(spark).collect()] == [(0, 5, 1), (1, 12, 2)]
    assert [tuple(r) for r in log.adjustments(spark).collect()] == [(0, 2.0, 1.0, 50.0, 2, 2)]


def test_plot_tables(spark):
    kp = spark.createDataFrame([(i % 3, i, float(i), 1.0) for i in range(10)], "image_id long, kp_id long, x double, y double")
    assert [r["kp_id"] for r in plots.keypoint_overlay(kp, 1).collect()] == [1, 4, 7]
    assert [tuple(r) for r in plots.keypoint_counts(kp, 2).orderBy("rank").collect()] == [(0, 4, 1), (1, 3, 2)]
    m = spark.createDataFrame([(0, 1, k, k) for k in range(8)], "img_i int, img_j int, kp_i int, kp_j int")
    lines = plots.match_lines(m, m.where("kp_i < 2"), 0, 1, 5).collect()
    assert len(lines) == 5 and {r["inlier_percent"] for r in lines} == {25.0}
    f = [0.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 1.0, 0.0]
    inl = spark.createDataFrame([(0, 1, 2.0, 3.0, 5.0, 3.0, f)], "img_i int, img_j int, x1 double, y1 double, x2 double, y2 double, F array<double>")
    got = plots.epipolar_lines(inl, "F").first()
    assert got["line_2"] == [0.0, -1.0, 3.0] and got["line_1"] == [0.0, 1.0, -3.0]
    v = spark.createDataFrame([(i, float(i), 2.0 * i, 0.0) for i in range(101)], "vid long, x double, y double, z double")
    views = plots.six_views(v)
    assert views.count() == 606 and views.where("view = 'front' and vid = 50 and u = 0 and v = 0").count() == 1
    assert plots.cloud_view(v.withColumnRenamed("vid", "pid"), 7).count() == 7
    obs = spark.createDataFrame([(0, 1, 0.5), (1, 1, 1.5), (0, 2, 3.0)], "image_id long, point_id long, err double")
    assert plots.error_classes(obs).count() == 3
    board = plots.dashboard(kp, v, obs, {"match": 1.5})
    assert "seconds_match: 1.5" in plots.summary_lines(board) and "points: 101" in plots.summary_lines(board)


def test_external_runner_builds_commands(spark, tmp_path):
    cfg = from_arguments(["--image_dir", "photos", "--match_strategy", "vocab_tree"])
    runner = ColmapRunner(cfg, binary=str(tmp_path / "colmap"), workspace=str(tmp_path / "w"))
    assert runner.extraction()[1] == "feature_extractor" and "photos" in runner.extraction()
    assert runner.matching()[1] == "exhaustive_matcher"  # no vocabulary file
    assert runner.mapper()[1] == "mapper" and [c[1] for c in runner.dense_lines("m")] == ["image_undistorter", "patch_match_stereo", "stereo_fusion"]
    runner._options["mapper"] = {"Mapper.other"}
    assert "--Mapper.min_num_matches" not in runner.mapper()
    with pytest.raises(backends.BackendMissing):
        runner.run(spark)
    runner.execute([sys.executable, "-c", "print(1)"], "fine")
    with pytest.raises(RuntimeError, match="code 3"):
        runner.execute([sys.executable, "-c", "raise SystemExit(3)"], "bad")
    for name, size in (("0", 10), ("1", 30), ("2", 30)):
        (tmp_path / "s" / name).mkdir(parents=True)
        (tmp_path / "s" / name / "points3D.bin").write_bytes(b"x" * size)
    assert largest_model(spark, str(tmp_path / "s")).endswith("/s/1") and largest_model(spark, str(tmp_path / "none")) is None


def test_runs_matrices_and_verdicts(spark, tmp_path):
    program = [sys.executable, "-c"]
    record = evaluation.run("a", ["print('x'); print('{\"n_cameras\": 3, \"n_points\": 9}')"], str(tmp_path), program=program)
    assert record["summary"] == {"n_cameras": 3, "n_points": 9} and record["returncode"] == 0
    cases = {"a": ["print(1)"], "b": ["print('{\"n_cameras\": 1, \"n_points\": 2}')"]}
    assert evaluation.run_matrix(cases, str(tmp_path), program=program) == ["b"] and evaluation.run_matrix(cases, str(tmp_path), program=program) == []
    text = evaluation.report(spark, str(tmp_path), {"first run computes": True})
    assert "| a | 3 | 9 |" in text and "| first run computes | ok |" in text
    assert evaluation.execute([sys.executable, "-c", "import time; time.sleep(30)"], timeout=0.5).code is None
    assert evaluation.flags_with(["focal_search"], {"focal_search": "--x", "other": "--y"}) == ["--y"]
    configurations = evaluation.default_configurations()
    assert configurations["after"] == [] and len(configurations["before"]) == len(evaluation.SWITCHES)
    with pytest.raises(ValueError):
        evaluation.flags_with(["nothing"])
    told = evaluation.robustness(spark, [("named", ["raise SystemExit('no images in x')"], "error", ["No images"]), ("crash", ["1/0"], "error", []), ("fine", ["pass"], "ok", []), ("other", ["raise SystemExit(2)"], "error", ["word"])], program=program)
    assert {r["case"]: r["verdict"] for r in told.collect()} == {"named": "PASS", "crash": "FAIL", "fine": "PASS", "other": "WEAK"}
    same = evaluation.reproducibility(spark, 2, lambda place: [f"open('{place}/o.txt','w').write('same'); open('{place}/p.txt','w').write('{place}')"], str(tmp_path / "r"), ["o.txt", "p.txt"], program)
    assert {r["artefact"]: r["reproducible"] for r in same.collect()} == {"o.txt": True, "p.txt": False}
    runs = spark.createDataFrame([("before", 2), ("after", 5)], "name string, n_cameras long")
    scores = spark.createDataFrame([("after", 0.5)], "name string, error double")
    assert {r["name"]: r["n_cameras_change"] for r in evaluation.ablation(runs, scores).collect()} == {"before": 0, "after": 3}


def test_equal_sizes_do_not_hide_other_photos(spark, tmp_path):
    rng = np.random.default_rng(5)
    first, second = ({"a.bmp": evaluation.bitmap(rng.integers(0, 255, (8, 8, 3), dtype=np.uint8))} for _ in range(2))
    assert len(first["a.bmp"]) == len(second["a.bmp"]) and not evaluation.stale_hits(spark, first, second, str(tmp_path))
    cache: dict = {}

    def step(name, options):
        key = json.dumps({k: v for k, v in options.items() if k in ("ratio", "photos")})
        if options.get("cache") == "removed":
            cache.clear()
        hit = bool(options.get("resume")) and key in cache
        cache[key] = True
        return {"reused": hit, "result": key}

    assert all(evaluation.checkpoint_protocol(step).values())
    assert evaluation.log_figures("12 cameras, rmse = 0.5") == {"cameras": "12", "points": None, "rmse": "0.5", "reused": None}
    names = [c[0] for c in evaluation.degenerate_folders(str(tmp_path / "d"))]
    assert len(names) == len(set(names)) == 6


def test_planar_pairs_need_the_homography(spark):
    rows = evaluation.planar_report()
    best = {(r["scene"], r["fallback"]): r["rotation_error"] for r in rows}
    assert best["volume", True] is not None and best["volume", True] < 1.0
    assert best["planar", True] is not None and best["planar", True] < 2.0
    sweep = evaluation.focal_sweep(spark, [0.9, 1.1], lambda s, f: {"n_cameras": 6, "n_points": 9, "rmse": 1.0, "focal": 100 * f})
    assert {r["factor"]: r["accepted"] for r in evaluation.focal_verdicts(sweep, 95.0).collect()} == {0.9: True, 1.1: False}


def test_features_follow_a_shifted_image(spark):
    rng = np.random.default_rng(6)
    big = sift.gaussian(rng.uniform(0, 255, (140, 150)), 2.0)
    big = (big - big.min()) / (big.max() - big.min()) * 255
    pa_, da = sift.features(big[:120, :130], 400)
    pb, db = sift.features(big[6:126, 9:139], 400)
    assert len(pa_) > 30 and np.allclose(np.linalg.norm(da, axis=1), 1, atol=1e-6)
    best = (da @ db.T).argmax(axis=1)
    shift = pa_[:, :2] - pb[best][:, :2]
    assert np.mean(np.abs(shift - [9, 6]).max(axis=1) < 1.0) > 0.5
    assert sift.features(np.zeros((40, 40)))[0].shape == (0, 4) and np.allclose((sift.root(da) ** 2).sum(axis=1), 1)
    raster = np.repeat(big[:120, :130, None], 3, axis=2).astype(np.uint8)
    images = spark.createDataFrame([(0, 130, 120, 3, bytearray(raster.tobytes()))], "image_id int, width int, height int, channels int, data binary")
    got = backends.get("extractor", "sift")(images, from_arguments(["--image_dir", "x", "--n_features", "50"]))
    assert 10 < got.count() <= 50 and got.where("size(descriptor) = 128").count() == got.count()


def test_colours_at_observations(spark):
    raster = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    assert np.allclose(colours.bilinear(raster, np.array([1.5, -3.0]), np.array([0.5, 9.0]))[0], (raster[0, 1].astype(float) + raster[0, 2] + raster[1, 1] + raster[1, 2]) / 4)
    images = spark.createDataFrame([(0, 5, 4, 3, bytearray(raster.tobytes()))], "image_id int, width int, height int, channels int, data binary")
    obs = spark.createDataFrame([(0, 7, 1.0, 2.0, 0.5), (0, 8, 3.0, 1.0, 9.0)], "image_id int, point_id long, x double, y double, err double")
    b, g, r = raster[2, 1].astype(float)
    assert [(x["r"], x["g"], x["b"]) for x in colours.sample_colours(obs.where("point_id = 7"), images).collect()] == [(r, g, b)]
    got = {x["point_id"]: (x["r"], x["g"], x["b"]) for x in colours.colourise(obs, images, obs).collect()}
    assert got == {7: (int(r), int(g), int(b)), 8: (128, 128, 128)}


def test_a_flat_wall_is_consistent_and_a_displaced_one_is_not(spark):
    rng = np.random.default_rng(7)
    texture = sift.gaussian(rng.uniform(0, 255, (200, 200)), 1.5)
    k = evaluation.camera_matrix(100.0, 100, 80)
    photos, cams = [], []
    for i, x in enumerate((-0.4, 0.0, 0.3, 0.6)):
        r, t = np.eye(3), -np.array([x, 0.0, -4.0])
        v, u = np.mgrid[0:80, 0:100]
        wall = np.stack([(u - 50) / 100 * 4 + x, (v - 40) / 100 * 4], -1)  # the wall is z = 0
        at = np.clip(((wall + 5) * 20).astype(int), 0, 199)
        grey = texture[at[..., 1], at[..., 0]].astype(np.uint8)
        photos.append((i, 100, 80, 3, bytearray(np.repeat(grey[..., None], 3, 2).tobytes())))
        cams.append((i, r.ravel().tolist(), t.tolist(), k.ravel().tolist(), float(x), 0.0, -4.0))
    images = spark.createDataFrame(photos, "image_id int, width int, height int, channels int, data binary")
    cameras = spark.createDataFrame(cams, "image_id int, R array<double>, t array<double>, K array<double>, cx double, cy double, cz double")
    grid = [(i, float(x), float(y), 0.0, 0.0, 0.0, -1.0) for i, (x, y) in enumerate((a, b) for a in np.linspace(-1, 1, 9) for b in np.linspace(-1, 1, 9))]
    samples = spark.createDataFrame(grid, "sid long, x double, y double, z double, nx double, ny double, nz double")
    got = {r["offset"]: (r["n"], r["mean_deviation"]) for r in colours.consistency_report(samples, cameras, images, 0.1, (10.0,)).collect()}
    assert got[0.0][0] > 40 and got[0.0][1] < 0.5 * got[10.0][1]


def test_small_clouds_have_neighbours_after_pruning(spark):
    pts = np.random.default_rng(8).uniform(size=(60, 3)) * [1, 1, 0.01]
    c = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "pid long, x double, y double, z double")
    got = {(r["qid"], r["rank"]): r["distance"] for r in cloud.self_neighbours(c, 70, side=0.05).collect()}
    d = np.sort(np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1)), axis=1)[:, 1:]
    assert len(got) == 60 * 59 and all(abs(v - d[q, k - 1]) < 1e-9 for (q, k), v in got.items())
