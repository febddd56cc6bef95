"""The workflow on the synthetic ring, mesh preparation and validation."""

from __future__ import annotations

import numpy as np
from scenes import ring

from sparkogram.plans import backends, workflow
from sparkogram.plans import mesh as M
from sparkogram.plans.config import Config


def test_ring_end_to_end(spark, tmp_path):
    k, _, _, kp, matches = ring()
    cfg = Config(min_matches=8, min_inliers=10, geometric_loop_closure=False, export_cameras=str(tmp_path / "cameras.json"))
    out = workflow.run(spark.createDataFrame(kp), cfg, k, matches=spark.createDataFrame(matches))
    assert out.summary["n_cameras"] >= 4 and out.summary["n_points"] >= 50 and out.summary["reprojection"]["rmse"] <= 2.0
    workflow.save_points(out.points, str(tmp_path / "cloud.ply"))
    assert spark.read.format("ply").load(str(tmp_path / "cloud.ply")).count() == out.summary["n_points"]
    assert (tmp_path / "cameras.json").exists()


def sphere(n: int, seed: int = 0) -> np.ndarray:
    x = np.random.default_rng(seed).normal(size=(n, 3))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def icosphere(rounds: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    v = [np.array(p, float) for p in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
    f = [(0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5)]
    for _ in range(rounds):
        mid, out = {}, []

        def half(a: int, b: int, mid: dict = mid) -> int:
            key = (min(a, b), max(a, b))
            if key not in mid:
                m = v[a] + v[b]
                v.append(m / np.linalg.norm(m))
                mid[key] = len(v) - 1
            return mid[key]

        for a, b, c in f:
            x, y, z = half(a, b), half(b, c), half(c, a)
            out += [(a, x, z), (x, b, y), (z, y, c), (x, y, z)]
        f = out
    return np.array(v), f


def test_mesh_of_a_sphere(spark):
    xyz = sphere(400)
    cloud = spark.createDataFrame([(i, *map(float, p), *((p + 1) / 2).tolist()) for i, p in enumerate(xyz)], "pid long, x double, y double, z double, r double, g double, b double")
    v, f = icosphere(3)
    vertices = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "fid long, a long, b long, c long")
    backends.register("surface", "poisson", lambda c, s, p: (vertices, faces))
    try:
        got = M.MeshPipeline(Config(mesh_quality="low", mesh_no_validate=True)).run(cloud)
        assert got.success and got.faces.count() == len(f) and {"r", "g", "b"} <= set(got.vertices.columns)
        report = M.validate(vertices, faces, cloud.select("pid", "x", "y", "z"), 0.1, n_samples=800)
        assert report["topology"]["euler"] == 2 and report["topology"]["genus"] == 0 and report["topology"]["watertight"]
        assert abs(report["geometry"]["area"] / (4 * np.pi) - 1) < 0.03 and abs(report["geometry"]["volume"] / (4 * np.pi / 3) - 1) < 0.05
        assert report["verdict"] in ("PASS", "WARN") and "verdict" in M.format_report(report)
    finally:
        backends._FOUND.pop(("surface", "poisson"))
    failed = M.MeshPipeline(Config()).run(cloud.limit(0))
    assert not failed.success and "no finite point" in failed.message
