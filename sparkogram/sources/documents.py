"""Camera documents, ground truth, run records, logs, checkpoints and mesh files."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkogram.functions.geometry import camera_centre
from sparkogram.sources.files import place, write_bytes

CAMERA_ROW = "array<struct<image_index:int,image_name:string,R:array<array<double>>,t:array<double>,center:array<double>,K:array<array<double>>>>"


def write_cameras(cameras: DataFrame, path: str, **facts: object) -> None:
    """One JSON document: facts (counts, timings, arguments) and per camera R, t, centre, K; one row per photo."""
    rows = cameras.orderBy("image_id").collect()
    square = lambda v: [list(v[3 * i : 3 * i + 3]) for i in range(3)]
    every = []
    for r in rows:
        rot, t = np.array(r["R"]).reshape(3, 3), np.array(r["t"])
        every.append({"image_index": r["image_id"], "image_name": r["image_name"], "R": square(r["R"]), "t": list(r["t"]), "center": (-rot.T @ t).tolist(), "K": square(r["K"])})
    write_bytes(path, json.dumps({"convention": "x_cam = R X + t", "n_images": len(rows), **facts, "cameras": every}, indent=1).encode())


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, image_name, R, t, K, cx, cy, cz); a missing centre follows from R and t."""
    doc = spark.read.schema(f"cameras {CAMERA_ROW}").option("multiLine", True).json(path)
    c = doc.select(F.explode("cameras").alias("c")).select("c.*")
    c = c.select(F.col("image_index").alias("image_id"), "image_name", F.flatten("R").alias("R"), "t", F.flatten("K").alias("K"), "center")
    own = camera_centre("R", "t")
    return c.select("image_id", "image_name", "R", "t", "K", *(F.coalesce(F.col("center").getItem(i), own[i]).alias(f"c{a}") for i, a in enumerate("xyz")))


def decompose_projection(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K, R and centre of a 3x4 projection matrix by RQ decomposition; K has a positive diagonal and K[2, 2] = 1."""
    m = p[:, :3] * (1.0 if np.linalg.det(p[:, :3]) > 0 else -1.0)
    q, r = np.linalg.qr(m[::-1].T)
    k, rot = r.T[::-1, ::-1], q.T[::-1]
    sign = np.diag(np.where(np.diag(k) < 0, -1.0, 1.0))
    k, rot = k @ sign, sign @ rot
    return k / k[2, 2], rot, -np.linalg.solve(p[:, :3], p[:, 3])


def read_ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """(image_name, K, R, cx, cy, cz) of 3x4 matrices in files named <image>_P.txt; other shapes are skipped."""
    text = spark.read.text(folder, wholetext=True, pathGlobFilter="*_P.txt").select(F.input_file_name().alias("path"), "value")
    v = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    rows = text.select(F.regexp_extract("path", r"([^/]+)_P\.txt$", 1).alias("image_name"), v.cast("array<double>").alias("p")).where("size(p) = 12")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [decompose_projection(np.array(p).reshape(3, 4)) for p in b["p"]]
            yield pd.DataFrame(
                {"image_name": b["image_name"], "K": [k.ravel().tolist() for k, _, _ in got], "R": [r.ravel().tolist() for _, r, _ in got], **{f"c{a}": [float(c[i]) for _, _, c in got] for i, a in enumerate("xyz")}}
            )

    return rows.mapInPandas(run, "image_name string, K array<double>, R array<double>, cx double, cy double, cz double")


def load_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run records (*.run.json), a row each."""
    return spark.read.option("multiLine", True).json(folder, pathGlobFilter="*.run.json").orderBy("name")


def parse_log(spark: SparkSession, path: str) -> DataFrame:
    """(kind, a, b, c) rows of registration steps and bundle adjustment rounds found in a log."""
    lines = spark.read.text(path)
    step = r"[Rr]egistered image (\d+).*?(\d+) new points.*?(\d+) correspondences"
    ba = r"BA.*?RMSE[^\d]*([\d.]+)\s*->\s*([\d.]+)"
    steps = lines.where(F.regexp_like("value", F.lit(step))).select(F.lit("step").alias("kind"), *(F.regexp_extract("value", step, i).cast("double").alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))))
    rounds = lines.where(F.regexp_like("value", F.lit(ba))).select(F.lit("ba").alias("kind"), *(F.regexp_extract("value", ba, i).cast("double").alias(n) for i, n in ((1, "a"), (2, "b"))), F.lit(None).cast("double").alias("c"))
    return steps.unionByName(rounds)


def save_checkpoint(df: DataFrame, folder: str, name: str, image_hash: str) -> None:
    """A stage's table with a manifest that names the image set it belongs to."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    write_bytes(f"{folder}/{name}.json", json.dumps({"image_hash": image_hash}).encode())


def load_checkpoint(spark: SparkSession, folder: str, name: str, image_hash: str) -> DataFrame | None:
    """The table, or None when there is none or it belongs to another image set."""
    system, path = place(f"{folder}/{name}.json")
    try:
        with system.open_input_stream(path) as f:
            manifest = json.loads(f.read())
    except (FileNotFoundError, OSError, ValueError):
        return None
    return spark.read.parquet(f"{folder}/{name}") if manifest.get("image_hash") == image_hash else None


def checkpoint_key(strategy: str, ratio: float, min_matches: int, **more: object) -> str:
    """Name of a match checkpoint: everything that changes its content."""
    return "_".join([f"matches_{strategy}_r{ratio:.3f}_m{min_matches}", *(f"{k}{v}" for k, v in sorted(more.items()))])


def write_report(report: dict, path: str) -> str | None:
    """The report as JSON; None when it can't be written."""
    try:
        write_bytes(path, json.dumps(report, indent=1).encode())
    except OSError:
        return None
    return path


def _ordered(vertices: DataFrame, faces: DataFrame) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Arrays of a mesh in id order with dense corner numbers: single-file formats are sequential."""
    colour = {"r", "g", "b"} <= set(vertices.columns)
    cols = ["vid", "x", "y", "z", *(["r", "g", "b"] if colour else [])]
    v = vertices.select(*cols).orderBy("vid").toPandas()
    f = faces.select("fid", "a", "b", "c").orderBy("fid").toPandas()
    number = pd.Series(np.arange(len(v)), index=v["vid"])
    corner = np.column_stack([number.loc[f[k]].to_numpy() for k in "abc"]).astype(np.int32) if len(f) else np.empty((0, 3), np.int32)
    rgb = np.clip(np.round(v[["r", "g", "b"]].to_numpy() * 255), 0, 255).astype(np.uint8) if colour else None
    return v[["x", "y", "z"]].to_numpy(np.float64), rgb, corner


def vertex_normals(xyz: np.ndarray, corner: np.ndarray) -> np.ndarray:
    n = np.zeros_like(xyz)
    if len(corner):
        a, b, c = (xyz[corner[:, i]] for i in range(3))
        face = np.cross(b - a, c - a)
        for i in range(3):
            np.add.at(n, corner[:, i], face)
    size = np.linalg.norm(n, axis=1, keepdims=True)
    return np.divide(n, size, out=np.zeros_like(n), where=size > 0)


def export_mesh(vertices: DataFrame, faces: DataFrame, path: str) -> str:
    """Write .obj, .ply, .stl or .glb by suffix; ValueError for others.  STL has no colours.

    A mesh file is one sequence of bytes, so the mesh has to fit the driver.
    """
    kind = path.lower().rsplit(".", 1)[-1]
    if kind not in ("obj", "ply", "stl", "glb"):
        raise ValueError(f"unknown mesh format .{kind}")
    xyz, rgb, corner = _ordered(vertices, faces)
    normal = vertex_normals(xyz, corner)
    if kind == "obj":
        tail = [""] * len(xyz) if rgb is None else [" " + " ".join(f"{c / 255:.6f}" for c in row) for row in rgb]
        lines = [f"v {x:.9g} {y:.9g} {z:.9g}{t}" for (x, y, z), t in zip(xyz, tail, strict=True)]
        lines += [f"vn {x:.6g} {y:.6g} {z:.6g}" for x, y, z in normal] + [f"f {a}//{a} {b}//{b} {c}//{c}" for a, b, c in corner + 1]
        write_bytes(path, ("\n".join(lines) + "\n").encode())
    elif kind == "ply":
        fields = [(n, "<f4") for n in ("x", "y", "z", "nx", "ny", "nz")] + ([(n, "u1") for n in ("red", "green", "blue")] if rgb is not None else [])
        body = np.zeros(len(xyz), np.dtype(fields))
        for i, n in enumerate("xyz"):
            body[n], body["n" + n] = xyz[:, i], normal[:, i]
        for i, n in enumerate(("red", "green", "blue") if rgb is not None else ()):
            body[n] = rgb[:, i]
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(xyz)}\n" + "".join(f"property {'uchar' if c == 'u1' else 'float'} {n}\n" for n, c in fields)
        head += f"element face {len(corner)}\nproperty list uchar int vertex_indices\nend_header\n"
        face = np.zeros(len(corner), np.dtype([("n", "u1"), ("v", "<i4", 3)]))
        face["n"], face["v"] = 3, corner
        write_bytes(path, head.encode(), body.tobytes(), face.tobytes())
    elif kind == "stl":
        rec = np.zeros(len(corner), np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("attr", "<u2")]))
        if len(corner):
            rec["v"] = xyz[corner]
            n = np.cross(xyz[corner[:, 1]] - xyz[corner[:, 0]], xyz[corner[:, 2]] - xyz[corner[:, 0]])
            rec["n"] = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-30)
        write_bytes(path, b"\0" * 80 + struct.pack("<I", len(corner)), rec.tobytes())
    else:
        _write_glb(path, xyz, rgb, normal, corner)
    return path


def _write_glb(path: str, xyz: np.ndarray, rgb: np.ndarray | None, normal: np.ndarray, corner: np.ndarray) -> None:
    pad = lambda b, fill=b"\0": b + fill * (-len(b) % 4)
    pos = xyz.astype("<f4")
    blobs = [("POSITION", pos, 5126, "VEC3", 34962), ("NORMAL", normal.astype("<f4"), 5126, "VEC3", 34962)]
    if rgb is not None:
        blobs.append(("COLOR_0", np.column_stack([rgb, np.full(len(rgb), 255, np.uint8)]), 5121, "VEC4", 34962))
    blobs.append(("", corner.astype("<u4").ravel(), 5125, "SCALAR", 34963))
    binary, views, accessors = b"", [], []
    for name, data, component, kind, target in blobs:
        raw = data.tobytes()
        views.append({"buffer": 0, "byteOffset": len(binary), "byteLength": len(raw), "target": target})
        acc = {"bufferView": len(views) - 1, "componentType": component, "count": len(data), "type": kind}
        if name == "POSITION" and len(pos):
            acc |= {"min": pos.min(axis=0).tolist(), "max": pos.max(axis=0).tolist()}
        if name == "COLOR_0":
            acc["normalized"] = True
        accessors.append(acc)
        binary += pad(raw)
    attributes = {b[0]: i for i, b in enumerate(blobs) if b[0]}
    doc = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": attributes, "indices": len(blobs) - 1}]}], "buffers": [{"byteLength": len(binary)}], "bufferViews": views, "accessors": accessors}
    text = pad(json.dumps(doc).encode(), b" ")
    chunks = struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(binary), 0x004E4942) + binary
    write_bytes(path, struct.pack("<4sII", b"glTF", 2, 12 + len(chunks)) + chunks)
