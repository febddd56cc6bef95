"""Operators against closed forms and NumPy."""

from __future__ import annotations

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkogram.functions import geometry as G
from sparkogram.kernels.align import similarity, similarity_ransac
from sparkogram.kernels.match import ratio_pairs
from sparkogram.operators import cloud as C
from sparkogram.operators import focal, matching, mesh, observations, poses, reports, tracks
from sparkogram.operators.components import connected_components
from sparkogram.plans import backends, dense
from sparkogram.plans.config import PRESETS, Config, from_arguments
from sparkogram.streaming.ingest import ingest


def points(spark, xyz, first="pid"):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], f"{first} long, x double, y double, z double")


def test_components_of_chains_and_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ratio_and_mutual_matching_equal_brute_force():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(60, 8)), rng.normal(size=(50, 8))
    b[:20] = a[:20] + rng.normal(0, 0.1, (20, 8))
    b[30] = b[31]
    d = np.linalg.norm(a[:, None] - b[None], axis=2)

    def good(d):
        o = np.argsort(d, axis=1, kind="stable")
        r = np.arange(len(d))
        return {(int(i), int(o[i, 0])) for i in r if d[i, o[i, 0]] < 0.8 * d[i, o[i, 1]]}

    fwd, back = good(d), {(i, j) for j, i in good(d.T)}
    for mutual, want in ((False, fwd), (True, fwd & back)):
        i, j, _ = ratio_pairs(a, b, 0.8, mutual)
        assert list(zip(i, j, strict=True)) == sorted(want)
    assert len(ratio_pairs(a[:1], b, 0.8, True)[0]) == 0


def test_matching_does_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(1)
    rows = [(i, k, rng.normal(size=4).tolist()) for i in range(4) for k in range(12)]
    kp = spark.createDataFrame(rows, "image_id int, kp_id int, descriptor array<double>")
    got = [sorted(map(tuple, matching.match_pairs(k, matching.all_pairs(k), 0.9).collect())) for k in (kp.repartition(1), kp.repartition(9))]
    assert got[0] == got[1] and got[0]
    assert matching.candidate_pairs(kp, "sequential", window=1).count() == 3
    assert matching.candidate_pairs(kp, "vocab_tree", top_k=10).count() == 6  # few images: all pairs
    assert matching.candidate_pairs(kp, "vocab_tree", top_k=1, n_words=6).count() <= 4


def test_conflicting_images_leave_their_track(spark):
    m = spark.createDataFrame([(0, 1, 0, 0, 0), (1, 2, 0, 0, 0), (0, 2, 1, 5, 0), (3, 4, 0, 1, 1)], "img_i int, img_j int, ord int, kp_i int, kp_j int")
    cc = tracks.match_components(m)
    got = {(r["image_id"], r["kp_id"]) for r in tracks.clean_tracks(cc).collect()}
    assert got == {(1, 0), (2, 0), (3, 1), (4, 1)}  # image 0 occurs twice
    row = tracks.track_statistics(cc, tracks.clean_tracks(cc)).first()
    assert (row["n_components"], row["n_conflicted"], row["n_tracks"]) == (2, 1, 2)


def test_spacing_of_grids_and_degenerate_clouds(spark):
    g = np.stack(np.meshgrid(*[np.arange(8) * 0.05] * 3), -1).reshape(-1, 3)
    assert C.spacing(points(spark, g)).first()["spacing"] == pytest.approx(0.05, rel=1e-6)
    assert C.spacing(points(spark, [[0, 0, 0]])).first()["spacing"] == 0.0
    assert C.spacing(points(spark, np.zeros((10, 3)))).first()["spacing"] == 0.0


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_equals_brute_force(spark, k):
    rng = np.random.default_rng(2)
    a, b = np.vstack([rng.normal(size=(80, 3)), [[30.0, 0, 0]]]), np.vstack([rng.normal(size=(70, 3)), [[-40.0, 5, 0]]])
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    got = C.nearest(points(spark, a, "qid"), points(spark, b), k).collect()
    assert len(got) == 81 * k
    for r in got:
        assert r["distance"] == pytest.approx(np.sort(d[r["qid"]])[r["rank"] - 1])


def test_far_blob_is_cut(spark):
    rng = np.random.default_rng(3)
    xyz = np.vstack([rng.normal(size=(490, 3)), rng.normal(0, 0.05, (10, 3)) + 60])
    kept = {r["pid"] for r in C.extent_filter(points(spark, xyz)).select("pid").collect()}
    assert kept == set(range(490))
    assert C.extent_filter(points(spark, xyz[:490])).count() == 490
    assert C.extent_filter(points(spark, xyz[:50])).count() == 50


def test_radius_filter_respects_its_cap(spark):
    rng = np.random.default_rng(4)
    c = points(spark, rng.normal(size=(200, 3)))
    assert C.radius_outliers(c, 3, 1e-9, 0.1).count() >= 179


def test_voxel_search_meets_its_target(spark):
    rng = np.random.default_rng(5)
    c = points(spark, rng.random((3000, 3))).cache()
    size = C.voxel_size_for(c, 500, 0.03)
    assert 350 <= C.voxel_downsample(c, size).count() <= 650


def test_normals_point_to_cameras(spark):
    rng = np.random.default_rng(6)
    n = rng.normal(size=(300, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    flip = np.where(rng.random(300) < 0.5, -1, 1)[:, None]
    rows = [(i, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(n, n * flip, strict=True))]
    c = spark.createDataFrame(rows, "pid long, x double, y double, z double, nx double, ny double, nz double")
    eyes = [[4 * np.cos(a), 4 * np.sin(a), 0] for a in np.linspace(0, 2 * np.pi, 12, endpoint=False)] + [[0, 0, 4], [0, 0, -4]]
    got = C.orient_normals(c, points(spark, eyes, "cid")).select((F.expr("x * nx + y * ny + z * nz") > 0).alias("out")).collect()
    assert sum(r["out"] for r in got) == 300


def octahedron(spark):
    v = points(spark, [[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]], "vid")
    f = [(0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5)]
    return spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "fid long, a long, b long, c long"), v


def test_closed_and_open_mesh(spark):
    f, v = octahedron(spark)
    t = mesh.edge_topology(f).first()
    assert (t["n_boundary"], t["n_nonmanifold"], t["euler"]) == (0, 0, 2)
    assert mesh.genus(mesh.edge_topology(f), mesh.orientable(f)).first()["genus"] == 0
    assert mesh.signed_volume(f, v).first()["volume"] == pytest.approx(4 / 3)
    q = mesh.triangle_quality(f, v).first()
    assert q["area"] == pytest.approx(8 * np.sqrt(3) / 4 * 2) and q["aspect_mean"] == pytest.approx(1.0) and q["n_degenerate"] == 0
    hole = f.where("fid <> 3")
    assert mesh.edge_topology(hole).first()["n_boundary"] == 3
    assert [r["n_edges"] for r in mesh.boundary_loops(hole).collect()] == [3]
    closed = mesh.fill_holes(hole, v)
    assert mesh.edge_topology(closed[0]).first()["n_boundary"] == 0 and mesh.orientable(closed[0]).first()["oriented"]
    twice = f.unionAll(f.selectExpr("fid + 100", "b", "c", "a")).unionAll(f.selectExpr("fid + 200", "a", "a", "c"))
    assert mesh.clean_faces(twice).count() == 8
    s = mesh.sample_surface(f, v, 4000).collect()
    assert abs(len(s) - 4000) < 50 and all(abs(abs(r["x"]) + abs(r["y"]) + abs(r["z"]) - 1) < 1e-9 for r in s)


def test_slivers(spark):
    v = points(spark, [[0, 0, 0], [1, 0, 0], [0.5, 0.001, 0], [2, 0, 0]], "vid")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 1, 3)], "fid long, a long, b long, c long")
    q = mesh.triangle_quality(f, v).first()
    assert q["aspect_max"] > 10 and q["sliver_share"] == 1.0 and q["n_degenerate"] == 1


def test_geometry_expressions_equal_numpy(spark):
    rng = np.random.default_rng(7)
    q = rng.normal(size=4)
    x, t = rng.normal(size=3) + [0, 0, 6], rng.normal(size=3)
    k = [500.0, 0.0, 320.0, 0.0, 510.0, 240.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([(q.tolist(), x.tolist(), t.tolist(), k)], "q array<double>, x array<double>, t array<double>, K array<double>").withColumn("R", G.quaternion_rotation("q"))
    xs = [F.col("x")[i] for i in range(3)]
    u, v, z = G.project(xs, "R", "t", "K")
    angle = G.triangulation_angle(xs, [F.lit(0.0)] * 3, [F.lit(1.0), F.lit(0.0), F.lit(0.0)])
    row = df.select("R", u.alias("u"), v.alias("v"), z.alias("z"), F.array(*G.camera_centre("R", "t")).alias("c"), G.projection_matrix("K", "R", "t").alias("P"), angle.alias("angle"), G.rotation_angle("R").alias("turn")).first()
    r = np.array(row["R"]).reshape(3, 3)
    cam = r @ x + t
    assert np.allclose(r @ r.T, np.eye(3)) and np.allclose(row["c"], -r.T @ t) and row["z"] == pytest.approx(cam[2])
    assert row["u"] == pytest.approx(500 * cam[0] / cam[2] + 320) and row["v"] == pytest.approx(510 * cam[1] / cam[2] + 240)
    p = np.array(row["P"]).reshape(3, 4) @ np.append(x, 1)
    assert p[0] / p[2] == pytest.approx(row["u"])
    a, b = x, x - [1, 0, 0]
    assert row["angle"] == pytest.approx(np.degrees(np.arccos(a @ b / np.linalg.norm(a) / np.linalg.norm(b))))


def test_similarity_fit(spark):
    rng = np.random.default_rng(8)
    src = rng.normal(size=(30, 3))
    r = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    r *= np.sign(np.linalg.det(r))
    dst = 2.5 * src @ r.T + [1, 2, 3]
    s, rot, t = similarity(src, dst)
    assert s == pytest.approx(2.5) and np.allclose(rot, r) and np.allclose(t, [1, 2, 3])
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(src, dst, strict=True)], "sx double, sy double, sz double, tx double, ty double, tz double")
    got = poses.fit_similarity(df)
    assert got[0] == pytest.approx(2.5) and np.allclose(got[1], r) and np.allclose(got[2], [1, 2, 3])
    bad = dst.copy()
    bad[:6] += 50
    assert similarity_ransac(src, bad)[0] == pytest.approx(2.5)


def test_outlier_thresholds_and_dense_ids(spark):
    e = spark.createDataFrame([(i * 3, 1.0 + (i % 5) * 0.1) for i in range(50)] + [(999, 90.0), (1000, None)], "point_id long, err double")
    rows = observations.inlier_points(e, 1e9).orderBy("new_id").collect()
    assert [(r["point_id"], r["new_id"]) for r in rows] == [(i * 3, i) for i in range(50)]
    assert observations.inlier_points(e, 1.15).count() == 20


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, observations.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, observations.insert_absent(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_focal_routes(spark):
    schema = "image_id int, focal_35 double, focal_mm double, plane_res double, unit_mm double, exif_width double, make string, model string, width int, height int"
    rows = [
        (0, 50.0, None, None, None, None, None, None, 4000, 3000),
        (1, None, 35.0, 100.0, 10.0, 4000.0, None, None, 4000, 3000),
        (2, None, 30.0, None, None, None, " SONY ", "ILCE-6000", 6000, 4000),
        (3, None, 5000.0, None, None, None, "SONY", "ILCE-6000", 6000, 4000),
        (4, None, None, None, None, None, None, None, 640, 480),
        (5, None, 30.0, None, None, None, "Sony Corporation", "ilce-6000", 6000, 4000),
    ]
    sensors = spark.createDataFrame([("sony", "ilce-6000", 23.5)], "make string, model string, width_mm double")
    got = {r["image_id"]: (r["focal_px"], r["source"]) for r in focal.focal_routes(spark.createDataFrame(rows, schema), sensors).collect()}
    assert got[0] == (pytest.approx(50 / np.hypot(36, 24) * 5000), "equivalent") and got[1] == (pytest.approx(350.0), "focal_plane") or got[1][1] == "guess"
    assert got[2] == (pytest.approx(30 / 23.5 * 6000), "sensor") and got[5] == got[2]
    assert got[3] == (6000.0, "guess") and got[4] == (640.0, "guess")


def test_report_helpers(spark):
    assert reports.even_selection(67, 6) == [0, 13, 26, 40, 53, 66] and reports.even_selection(3, 9) == [0, 1, 2]
    checks = spark.createDataFrame([("a", "PASS"), ("b", "WARN")], "name string, level string")
    assert reports.roll_up(checks).first()[0] == "WARN" and reports.roll_up(checks.limit(0)).first()[0] == "PASS"
    n = spark.createDataFrame([(1234567.891,), (None,)], "v double")
    assert [r[0] for r in n.select(reports.number("v")).collect()] == ["1234567.89", "n/a"]
    assert n.select(reports.german("v", 2)).first()[0] == "1.234.567,89"
    assert reports.markdown(checks, ["name"]).splitlines()[2] == "| a | PASS |"


def test_config():
    assert from_arguments(["--ratio", "0.8", "--no-mesh-fill-holes"]).ratio == 0.8
    assert Config(intrinsics="1,2,3,4").shared_intrinsics() == {"fx": 1.0, "fy": 2.0, "cx": 3.0, "cy": 4.0}
    for bad in ({"ratio": 1.5}, {"intrinsics": "1,2"}, {"mesh_quality": "best"}, {"focal": -1.0}, {"min_inliers": 2}):
        with pytest.raises(ValueError):
            Config(**bad).validated()
    sizes = [PRESETS[q]["poisson_depth"] for q in ("low", "medium", "high", "ultra")]
    assert sizes == sorted(sizes) and len(dataclasses.fields(Config)) > 75


def test_missing_backends_say_what_to_do():
    with pytest.raises(backends.BackendMissing, match="install"):
        backends.get("surface", "poisson")
    with pytest.raises(backends.BackendMissing, match="no extractor"):
        backends.get("extractor", "nothing")


def test_block_matching_finds_a_shift():
    rng = np.random.default_rng(9)
    right = rng.integers(0, 255, (40, 90)).astype(np.uint8)
    left = np.roll(right, 7, axis=1)
    d = dense.block_match(left, right, 0, 16)[5:-5, 20:-5]
    assert np.nanmean(d == 7) > 0.95
    assert dense.disparity_window(np.array([5.0] * 20), 500, 0.1, 640) == (0, 64)


def test_streaming_ingest_matches_new_with_all(spark, tmp_path):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(10, 4))
    schema = "image_id int, kp_id int, descriptor array<double>"
    for b, imgs in enumerate([(0, 1), (2,)]):
        rows = [(i, k, (base[k] + rng.normal(0, 0.01, 4)).tolist()) for i in imgs for k in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{b}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = ingest(stream, str(tmp_path / "store"), str(tmp_path / "ck"), 0.8, 1)
    q.processAllAvailable()
    q.stop()
    got = {(r["img_i"], r["img_j"]) for r in spark.read.parquet(str(tmp_path / "store" / "matches")).collect()}
    assert got == {(0, 1), (0, 2), (1, 2)}


def test_greedy_pairs_look_behind_the_first_block_of_ranks(spark):
    """Images used up at once fill the first ranks; pairs that are still allowed come later."""
    pairs = [(0, 1), (0, 2), *((0, i) for i in range(3, 30)), (3, 4), (1, 2), (5, 6), (3, 5)]
    ranked = spark.createDataFrame([(i, j, 1000 - k, k + 1) for k, (i, j) in enumerate(pairs)], "img_i int, img_j int, n_matches int, rank int")
    pick = lambda n, **o: [(r["img_i"], r["img_j"]) for r in reports.greedy_pairs(ranked, n, 2, **o).collect()]
    want = [(0, 1), (0, 2), (3, 4), (1, 2), (5, 6), (3, 5)]
    assert sorted(pick(6, considered=10)) == sorted(pick(6)) == sorted(want)
    assert sorted(pick(8, considered=3)) == sorted(pick(8)) == sorted([*want, (0, 3), (0, 4)])
    assert pick(1, considered=1) == [(0, 1)]
