"""Readers and writers: round trips and damaged or empty inputs."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest

from sparkogram.sources import colmap, documents, images
from sparkogram.sources.ply import PlyDataSource, count_vertices, parse_header


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(PlyDataSource)
    colmap.register(spark)


def test_ply_round_trip(spark, tmp_path):
    path = str(tmp_path / "new" / "c.ply")
    rows = [(float(i), i / 2, -1.0, i % 256, 7, 255) for i in range(1000)]
    spark.createDataFrame(rows, "x double, y double, z double, r int, g int, b int").repartition(4, "x").write.format("ply").mode("append").save(path)
    assert count_vertices(path) == 1000 and (tmp_path / "new" / "c.ply").stat().st_size == parse_header(path).start + 15 * 1000
    df = spark.read.format("ply").option("rows_per_partition", 300).load(path)
    assert df.rdd.getNumPartitions() == 4
    got = sorted((r["x"], r["y"], r["z"], r["r"], r["g"], r["b"]) for r in df.collect())
    assert got == sorted(rows) and [x.name for x in (tmp_path / "new").iterdir()] == ["c.ply"]


def test_ply_of_no_points_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="at least one point"):
        spark.createDataFrame([], "x double, y double, z double").write.format("ply").mode("append").save(str(tmp_path / "e.ply"))


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply_formats(spark, tmp_path, form):
    path = tmp_path / "f.ply"
    head = f"ply\nformat {form} 1.0\ncomment x\nelement vertex 3\nproperty double x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    rows = [(1.5, 2.0, 3.0, 9), (0.25, -1.0, 0.0, 255), (7.0, 8.0, 9.0, 0)]
    if form == "ascii":
        body = ("\n".join(" ".join(map(str, r)) for r in rows) + "\n3 0 1 2\n").encode()
    else:
        o = "<" if "little" in form else ">"
        body = b"".join(struct.pack(o + "dffB", *r) for r in rows) + struct.pack(o + "Biii", 3, 0, 1, 2)
    path.write_bytes(head.encode() + body)
    assert [tuple(r) for r in spark.read.format("ply").load(str(path)).orderBy("pid").collect()] == [(i, *r) for i, r in enumerate(rows)]


def test_no_ply(tmp_path):
    (tmp_path / "x.ply").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="no PLY header"):
        parse_header(str(tmp_path / "x.ply"))


def test_colmap_binaries(spark, tmp_path):
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<Q", 2) + struct.pack("<iiQQ4d", 1, 2, 640, 480, 500, 320, 240, -0.1) + struct.pack("<iiQQ4d", 2, 1, 640, 480, 510, 520, 321, 241))
    image = lambda i, q, t, c, n, pts: struct.pack("<i7di", i, *q, *t, c) + n.encode() + b"\0" + struct.pack("<Q", len(pts)) + b"".join(struct.pack("<ddq", *p) for p in pts)
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 2) + image(9, (2, 0, 0, 0), (1, 2, 3), 1, "b.jpg", [(1, 2, -1), (3, 4, 77)]) + image(4, (0, 0, 0, 1), (0, 0, 1), 2, "ä.jpg", []))
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", 2) + struct.pack("<Q3d3BdQ", 5, 1, 2, 3, 10, 20, 30, 0.5, 1) + struct.pack("<ii", 9, 1) + struct.pack("<Q3d3BdQ", 3, 4, 5, 6, 1, 2, 3, 0.1, 0))
    load = lambda s, f: spark.read.format(s).load(str(tmp_path / f))
    pts = load("colmap_points", "points3D.bin").collect()
    assert [(r["point_id"], r["x"], r["r"], r["track_length"]) for r in pts] == [(3, 4.0, 1, 0), (5, 1.0, 10, 1)]
    im = {r["name"]: r for r in load("colmap_images", "images.bin").collect()}
    assert [p["point_id"] for p in im["b.jpg"]["points"]] == [None, 77]
    cams = colmap.model_cameras(load("colmap_cameras", "cameras.bin"), load("colmap_images", "images.bin")).orderBy("image_id").collect()
    assert [c["image_name"] for c in cams] == ["b.jpg", "ä.jpg"]
    assert np.allclose(cams[0]["R"], np.eye(3).ravel()) and np.allclose([cams[0]["cx"], cams[0]["cy"], cams[0]["cz"]], [-1, -2, -3])
    assert cams[0]["K"] == [500.0, 0, 320.0, 0, 500.0, 240.0, 0, 0, 1] and cams[1]["K"][4] == 520.0
    assert np.allclose(cams[1]["R"], np.diag([-1, -1, 1]).ravel())


def test_colmap_text(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# c\n1 SIMPLE_RADIAL 2736 1540 1857.5 1368 770 -0.0006\n")
    (tmp_path / "images.txt").write_text("# i\n1 1 0 0 0 0.5 0 1 1 a b.jpg\n1 2 -1\n2 0 1 0 0 0 0 1 1 c.jpg\n\n")
    (tmp_path / "points3D.txt").write_text("# p\n1 0 0 0 1 2 3 0.5 1 0 2 1\n2 0 0 0 1 2 3 0.5 1 0 2 1 3 4 4 4\n")
    cam = colmap.read_cameras_text(spark, str(tmp_path / "cameras.txt")).first()
    assert (cam["camera_id"], cam["model"], cam["width"], cam["params"]) == (1, "SIMPLE_RADIAL", 2736, [1857.5, 1368.0, 770.0, -0.0006])
    assert [(r["image_id"], r["name"], r["tvec"]) for r in colmap.read_images_text(spark, str(tmp_path / "images.txt")).collect()] == [(1, "a b.jpg", [0.5, 0.0, 1.0]), (2, "c.jpg", [0.0, 0.0, 1.0])]
    assert tuple(colmap.points_text_summary(spark, str(tmp_path / "points3D.txt")).first()) == (2, 3.0)


def test_cameras_document(spark, tmp_path):
    path = str(tmp_path / "cameras.json")
    r = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([(0, "a.jpg", r, [1.0, 2.0, 3.0], [500.0, 0.0, 1.0, 0.0, 500.0, 1.0, 0.0, 0.0, 1.0])], "image_id int, image_name string, R array<double>, t array<double>, K array<double>")
    documents.write_cameras(df, path, n_points=5)
    row = documents.read_cameras(spark, path).first()
    assert row["R"] == r and np.allclose([row["cx"], row["cy"], row["cz"]], [-2, 1, -3])
    doc = json.loads((tmp_path / "cameras.json").read_text())
    del doc["cameras"][0]["center"]
    (tmp_path / "cameras.json").write_text(json.dumps(doc))
    assert np.allclose([documents.read_cameras(spark, path).first()[c] for c in ("cx", "cy", "cz")], [-2, 1, -3])


def test_ground_truth(spark, tmp_path):
    k = np.array([[700.0, 2, 320], [0, 690, 240], [0, 0, 1]])
    a = 0.4
    r = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
    c = np.array([1.0, -2, 0.5])
    p = -3 * k @ np.column_stack([r, -r @ c])
    (tmp_path / "x_P.txt").write_text("\n".join(" ".join(map(repr, map(float, row))) for row in p))
    (tmp_path / "bad_P.txt").write_text("1 2 3")
    rows = documents.read_ground_truth(spark, str(tmp_path)).collect()
    assert [x["image_name"] for x in rows] == ["x"]
    assert np.allclose(rows[0]["K"], k.ravel()) and np.allclose(rows[0]["R"], r.ravel()) and np.allclose([rows[0]["cx"], rows[0]["cy"], rows[0]["cz"]], c)


def test_checkpoints_know_their_images(spark, tmp_path):
    df = spark.range(3)
    documents.save_checkpoint(df, str(tmp_path), "m", "abc")
    assert documents.load_checkpoint(spark, str(tmp_path), "m", "abc").count() == 3
    assert documents.load_checkpoint(spark, str(tmp_path), "m", "other") is None
    assert documents.load_checkpoint(spark, str(tmp_path), "none", "abc") is None
    assert documents.checkpoint_key("exhaustive", 0.75, 15) != documents.checkpoint_key("exhaustive", 0.8, 15)


def test_mesh_files(spark, tmp_path):
    v = spark.createDataFrame([(10, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (20, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (30, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "vid long, x double, y double, z double, r double, g double, b double")
    f = spark.createDataFrame([(1, 10, 20, 30)], "fid long, a long, b long, c long")
    for kind in ("obj", "ply", "stl", "glb"):
        documents.export_mesh(v, f, str(tmp_path / f"m.{kind}"))
    assert "f 1//1 2//2 3//3" in (tmp_path / "m.obj").read_text()
    assert (tmp_path / "m.stl").stat().st_size == 84 + 50
    glb = (tmp_path / "m.glb").read_bytes()
    assert glb[:4] == b"glTF" and struct.unpack("<I", glb[8:12])[0] == len(glb)
    assert spark.read.format("ply").load(str(tmp_path / "m.ply")).count() == 3
    with pytest.raises(ValueError, match="unknown mesh format"):
        documents.export_mesh(v, f, str(tmp_path / "m.xyz"))


def _tiff(entries: list[tuple[int, int, bytes]]) -> bytes:
    """A little-endian TIFF block with one directory; long values follow it."""
    at, tail, out = 8 + 2 + 12 * len(entries) + 4, b"", struct.pack("<H", len(entries))
    for tag, kind, raw in entries:
        n = len(raw) // {2: 1, 3: 2, 4: 4, 5: 8}[kind]
        if len(raw) <= 4:
            out += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
        else:
            out += struct.pack("<HHII", tag, kind, n, at + len(tail))
            tail += raw
    return b"II*\0" + struct.pack("<I", 8) + out + b"\0\0\0\0" + tail


def test_exif():
    tiff = _tiff([(271, 2, b"SONY\0"), (37386, 5, struct.pack("<II", 30, 1)), (41989, 3, struct.pack("<H", 50))])
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + tiff + b"\xff\xd9"
    want = {271: "SONY", 37386: "30/1", 41989: "50"}
    assert images.parse_exif(tiff) == images.parse_exif(jpeg) == want
    for bad in (None, b"", b"\xff\xd8", jpeg[:20], b"II*\0\xff\xff\xff\xff", b"plain"):
        assert images.parse_exif(bad) == {}


def test_orientation():
    a = np.arange(6).reshape(2, 3, 1)
    assert (images.orient(a, 1) == a).all() and images.orient(a, 6).shape == (3, 2, 1)
    assert (images.orient(images.orient(a, 6), 8) == a).all() and (images.orient(images.orient(a, 5), 5) == a).all()


def test_photo_folder(spark, tmp_path):
    with pytest.raises(ValueError, match="no images"):
        (tmp_path / "n.txt").write_text("x")
        images.list_images(spark, str(tmp_path))
    for i, name in enumerate(("b.bmp", "a.BMP")):
        pixel = bytes([10 * i, 20, 30, 0]) * 2
        (tmp_path / name).write_bytes(b"BM" + struct.pack("<IHHI", 54 + 8, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 2, 1, 24, 0, 8, 0, 0, 0, 0) + pixel)
    (tmp_path / "c.png").write_bytes(b"broken")
    listed = images.list_images(spark, str(tmp_path))
    assert listed.count() == 3
    got = images.load_images(spark, str(tmp_path)).orderBy("image_id").collect()
    assert [(r["image_id"], r["image_name"], r["width"], r["height"]) for r in got] == [(0, "a.BMP", 1, 2), (1, "b.bmp", 1, 2)]
    h = images.image_set_hash(listed)
    (tmp_path / "b.bmp").write_bytes((tmp_path / "a.BMP").read_bytes())
    assert len(h) == 16 and images.image_set_hash(images.list_images(spark, str(tmp_path))) != h


def test_runs_and_logs(spark, tmp_path):
    (tmp_path / "a.run.json").write_text(json.dumps({"name": "n6", "wall_s": 13.1, "summary": {"cameras": 6}}))
    assert documents.load_runs(spark, str(tmp_path)).first()["summary"]["cameras"] == 6
    (tmp_path / "log.txt").write_text("INFO Registered image 4: 120 new points, 88 correspondences\nINFO BA RMSE 1.25 -> 0.75 px\nother\n")
    rows = [tuple(r) for r in documents.parse_log(spark, str(tmp_path / "log.txt")).collect()]
    assert rows == [("step", 4.0, 120.0, 88.0), ("ba", 1.25, 0.75, None)]
