"""Evaluation runs: one run with its record, matrices of runs, ablations, and the protocols that judge them.

A run is a child process (by default this package's command line); its record is
one JSON document with command, wall time, peak memory and summary, and everything
that compares runs is a DataFrame over such records.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
import sys
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROGRAM = (sys.executable, "-m", "sparkogram")

# ---- one run -------------------------------------------------------------------------------


def sample_peak_rss(pid: int, done: threading.Event, out: dict, every: float = 0.25) -> None:
    """Largest resident size of a process and its children in MB, until ``done``."""
    while not done.wait(every):
        total, todo = 0, [pid]
        while todo:
            p = todo.pop()
            try:
                with open(f"/proc/{p}/statm") as f:
                    total += int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
                for task in os.listdir(f"/proc/{p}/task"):
                    with open(f"/proc/{p}/task/{task}/children") as f:
                        todo += [int(x) for x in f.read().split()]
            except (OSError, IndexError, ValueError):
                continue
        out["peak_rss_mb"] = max(out.get("peak_rss_mb", 0.0), total / 1e6)


@dataclass(frozen=True)
class Ended:
    """How a child process ended."""

    code: int | None  # None: out of time
    output: str
    seconds: float
    peak_rss_mb: float


def execute(command: list[str], timeout: float | None = None, env: dict[str, str] | None = None) -> Ended:
    """Run a command with its output, wall time and peak memory; out of time it is killed."""
    start, seen, done = time.time(), {}, threading.Event()
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, env={**os.environ, **(env or {})}) as child:
        watch = threading.Thread(target=sample_peak_rss, args=(child.pid, done, seen), daemon=True)
        watch.start()
        try:
            output, _ = child.communicate(timeout=timeout)
            code: int | None = child.returncode
        except subprocess.TimeoutExpired:
            child.kill()
            output, _ = child.communicate()
            code = None
        done.set()
        watch.join()
    return Ended(code, output, time.time() - start, seen.get("peak_rss_mb", 0.0))


def summary_of(output: str) -> dict:
    """The last line of the output that is a JSON object."""
    for line in reversed(output.splitlines()):
        try:
            got = json.loads(line)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return {}


def run(name: str, arguments: Iterable[str], folder: str, timeout: float | None = None, program: Iterable[str] = PROGRAM) -> dict:
    """Run once and write ``<name>.run.json`` below ``folder``; returns the record."""
    os.makedirs(folder, exist_ok=True)
    command = [*program, *arguments]
    ended = execute(command, timeout)
    record = {"name": name, "cmd": command, "returncode": ended.code, "wall_s": ended.seconds, "peak_rss_mb": ended.peak_rss_mb, "summary": summary_of(ended.output), "output_tail": ended.output[-2000:]}
    with open(os.path.join(folder, f"{name}.run.json"), "w") as f:
        json.dump(record, f, indent=1, default=str)
    return record


def run_matrix(configurations: dict[str, list[str]], folder: str, again: bool = False, timeout: float | None = None, program: Iterable[str] = PROGRAM) -> list[str]:
    """Run every named configuration that has no finished record yet; the names that ran."""
    ran = []
    for name, arguments in configurations.items():
        path = os.path.join(folder, f"{name}.run.json")
        if not again and os.path.exists(path):
            with open(path) as f:
                if json.load(f).get("returncode") == 0:
                    continue
        run(name, arguments, folder, timeout, program)
        ran.append(name)
    return ran


def compare_backends(images: str, backends: Iterable[str], folder: str, program: Iterable[str] = PROGRAM) -> list[dict]:
    """One run per backend over the same photos."""
    return [run(b, ["--image_dir", images, "--backend", b, "--output", os.path.join(folder, f"{b}.ply")], folder, program=program) for b in backends]


# ---- ablations -----------------------------------------------------------------------------

#: Improvements and the option that switches each one off.
SWITCHES = {
    "track_completion": "--no-track-completion",
    "global_tracks": "--no-global-tracks",
    "geometric_loop_closure": "--no-geometric-loop-closure",
    "focal_search": "--no-focal-search",
    "param_scaling": "--ba-no-param-scaling",
}


def flags_with(enabled: Iterable[str], switches: dict[str, str] | None = None) -> list[str]:
    """Options that leave only the named improvements on."""
    switches = SWITCHES if switches is None else switches
    on = set(enabled)
    if unknown := on - set(switches):
        raise ValueError(f"no such improvement: {', '.join(sorted(unknown))}")
    return [flag for name, flag in switches.items() if name not in on]


def default_configurations(switches: dict[str, str] | None = None) -> dict[str, list[str]]:
    """before: none; one run with each improvement alone; after: all."""
    switches = SWITCHES if switches is None else switches
    alone = {f"plus_{name}": flags_with([name], switches) for name in switches}
    return {"before": flags_with([], switches)} | alone | {"after": flags_with(switches, switches)}


def ablation(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """(name, figures and their change against ``before``): runs with pose scores, a row per configuration."""
    got = runs.join(scores, "name", "left")
    figures = [c for c, t in got.dtypes if t in ("double", "bigint", "int") and c != "name"]
    base = got.where("name = 'before'").select(*(F.col(c).cast("double").alias(f"_{c}") for c in figures))
    return got.join(F.broadcast(base.limit(1)), F.lit(True), "left").select(
        "name", *figures, *((F.col(c) - F.col(f"_{c}")).alias(f"{c}_change") for c in figures)
    )


# ---- protocols -----------------------------------------------------------------------------


def verdict(code: str, output: str, expect: str, keywords: str) -> Column:
    """PASS, WEAK or FAIL of a run on a degenerate input, as an expression.

    ``expect`` is ``ok`` or ``error``.  An expected error passes when the run ended
    with a code other than 0, without a traceback, and named one of the ``keywords``
    (an array); without a keyword it is weak.  A run out of time (null code) fails.
    """
    text = F.lower(F.col(output))
    traceback = F.contains(F.col(output), F.lit("Traceback (most recent call last)"))
    named = F.exists(F.col(keywords), lambda k: F.contains(text, F.lower(k))) | (F.size(F.col(keywords)) == 0)
    return (
        F.when(F.col(code).isNull() | traceback, "FAIL")
        .when(F.col(expect) == "ok", F.when(F.col(code) == 0, "PASS").otherwise("FAIL"))
        .when(F.col(code) == 0, "FAIL")
        .when(named, "PASS")
        .otherwise("WEAK")
    )


def robustness(spark: SparkSession, cases: Iterable[tuple[str, list[str], str, list[str]]], timeout: float = 900, program: Iterable[str] = PROGRAM) -> DataFrame:
    """(case, code, seconds, verdict) of cases (name, arguments, expect, keywords)."""
    rows = []
    for name, arguments, expect, keywords in cases:
        ended = execute([*program, *arguments], timeout)
        rows.append((name, ended.code, ended.seconds, ended.output, expect, keywords))
    table = spark.createDataFrame(rows, "case string, code int, seconds double, output string, expect string, keywords array<string>")
    return table.select("case", "code", "seconds", verdict("code", "output", "expect", "keywords").alias("verdict"))


def degenerate_folders(top: str) -> list[tuple[str, list[str], str, list[str]]]:
    """Folders that a run must refuse with a plain message, made below ``top``: cases for :func:`robustness`."""
    def folder(name: str, files: dict[str, bytes]) -> str:
        path = os.path.join(top, name)
        os.makedirs(path, exist_ok=True)
        for file, data in files.items():
            with open(os.path.join(path, file), "wb") as f:
                f.write(data)
        return path

    one = bitmap(np.zeros((16, 16, 3), np.uint8))
    out = os.path.join(top, "out.ply")
    case = lambda name, path, *words: (name, ["--image_dir", path, "--output", out], "error", list(words))
    return [
        case("missing folder", os.path.join(top, "nowhere"), "not", "no"),
        case("empty folder", folder("empty", {}), "no images"),
        case("no photos", folder("text", {"notes.txt": b"no photo"}), "no images"),
        case("one photo", folder("one", {"a.bmp": one}), "image", "pair", "needs"),
        case("two equal photos", folder("equal", {"a.bmp": one, "b.bmp": one}), "image", "pair", "needs"),
        case("broken photo", folder("broken", {"a.png": b"\x89PNG broken"}), "readable", "no image"),
    ]


def bitmap(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP of an H x W x 3 raster in BGR; equal sizes give files of equal size."""
    h, w = pixels.shape[:2]
    row = (3 * w + 3) // 4 * 4
    body = b"".join(np.ascontiguousarray(r).tobytes().ljust(row, b"\0") for r in pixels[::-1])
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = b"".join(x.to_bytes(4, "little") for x in (40, w, h)) + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(4) + len(body).to_bytes(4, "little") + bytes(16)
    return head + info + body


def sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(1 << 20):
            digest.update(data)
    return digest.hexdigest()


def identical(outputs: DataFrame) -> DataFrame:
    """(artefact, n_runs, n_versions, reproducible) of (run, artefact, sha256) rows."""
    n = F.countDistinct("sha256")
    return outputs.groupBy("artefact").agg(F.countDistinct("run").alias("n_runs"), n.alias("n_versions"), (n == 1).alias("reproducible"))


def reproducibility(spark: SparkSession, times: int, make: Callable[[str], list[str]], folder: str, artefacts: Iterable[str], program: Iterable[str] = PROGRAM) -> DataFrame:
    """Run the same command ``times`` times (``make`` gives its arguments for an output folder) and compare the artefacts byte by byte."""
    rows = []
    for i in range(times):
        place = os.path.join(folder, f"run{i}")
        os.makedirs(place, exist_ok=True)
        run(f"run{i}", make(place), folder, program=program)
        rows += [(f"run{i}", a, sha256(os.path.join(place, a))) for a in artefacts if os.path.exists(os.path.join(place, a))]
    return identical(spark.createDataFrame(rows, "run string, artefact string, sha256 string"))


#: Figures that a run's log names, and their patterns.
LOG_FIGURES = {"cameras": r"(\d+) cameras", "points": r"(\d+) points", "rmse": r"rmse[ =:]+([0-9.]+)", "reused": r"(reused|loaded) checkpoint"}


def log_figures(output: str) -> dict[str, str | None]:
    """First match of every pattern in a log."""
    found = {k: re.search(p, output, re.IGNORECASE) for k, p in LOG_FIGURES.items()}
    return {k: m.group(1) if m else None for k, m in found.items()}


def checkpoint_protocol(step: Callable[[str, dict], dict]) -> dict[str, bool]:
    """Does a cache hit and miss when it should?  ``step(name, options)`` runs and returns {"reused": bool, "result": ...}.

    A first run fills the cache; the same again reuses it with the same result; other
    options, other photos of the same names and sizes, and a removed cache do not.
    """
    cold = step("cold", {})
    warm = step("warm", {"resume": True})
    options = step("other options", {"resume": True, "ratio": 0.7})
    photos = step("other photos", {"resume": True, "photos": "other"})
    gone = step("no cache", {"resume": True, "cache": "removed"})
    return {
        "first run computes": not cold["reused"], "second run reuses": bool(warm["reused"]), "same result": warm["result"] == cold["result"],
        "other options compute": not options["reused"], "other photos compute": not photos["reused"], "without a cache it computes": not gone["reused"],
    }


def stale_hits(spark: SparkSession, first: dict[str, bytes], second: dict[str, bytes], folder: str) -> bool:
    """True when the image-set hash takes photos of equal names and sizes but other contents for the same."""
    from sparkogram.sources.images import image_set_hash, list_images

    seen = []
    for name, files in (("first", first), ("second", second)):
        place = os.path.join(folder, name)
        os.makedirs(place, exist_ok=True)
        for file, data in files.items():
            with open(os.path.join(place, file), "wb") as f:
                f.write(data)
        seen.append(image_set_hash(list_images(spark, place)))
    return first != second and seen[0] == seen[1]


# ---- synthetic experiments -----------------------------------------------------------------


def look_at(eye: np.ndarray, target: np.ndarray | None = None, up: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(R, t) of a camera at ``eye`` that looks at ``target``."""
    target, up = np.zeros(3) if target is None else target, np.array([0.0, 1.0, 0.0]) if up is None else up
    forward = target - eye
    forward = forward / np.linalg.norm(forward)
    right = np.cross(forward, up)
    right = right / max(np.linalg.norm(right), 1e-12) if np.linalg.norm(right) > 1e-9 else np.array([1.0, 0.0, 0.0])
    r = np.stack([right, np.cross(forward, right), forward])
    return r, -r @ eye


def camera_matrix(f: float, width: int, height: int) -> np.ndarray:
    return np.array([[f, 0, width / 2], [0, f, height / 2], [0, 0, 1.0]])


def project(k: np.ndarray, r: np.ndarray, t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pixels, depths) of world points."""
    cam = x @ r.T + t
    z = np.where(np.abs(cam[:, 2]) < 1e-9, 1e-9, cam[:, 2])
    return cam[:, :2] / z[:, None] * [k[0, 0], k[1, 1]] + k[:2, 2], cam[:, 2]


def two_view_scene(kind: str, n: int = 800, noise: float = 0.3, seed: int = 0) -> dict[str, np.ndarray]:
    """A pair of views of a ``planar`` or ``volume`` scene: K, x1, x2 (pixels), R, t of the second camera."""
    rng = np.random.default_rng(seed)
    k = camera_matrix(1400.0, 1600, 1200)
    x = np.column_stack([rng.uniform(-2, 2, n), rng.uniform(-1.5, 1.5, n), np.full(n, 6.0) if kind == "planar" else rng.uniform(4.5, 7.5, n)])
    a = np.radians(12.0)
    r = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
    t = -r @ np.array([0.9, 0.0, 0.0])
    p1, z1 = project(k, np.eye(3), np.zeros(3), x)
    p2, z2 = project(k, r, t, x)
    inside = (z1 > 0.1) & (z2 > 0.1)
    for p in (p1, p2):
        inside &= (p[:, 0] > 0) & (p[:, 0] < 1600) & (p[:, 1] > 0) & (p[:, 1] < 1200)
    jitter = lambda p: p[inside] + rng.normal(0, noise, (int(inside.sum()), 2))
    return {"K": k, "x1": jitter(p1), "x2": jitter(p2), "R": r, "t": t}


def ring_scene(n_points: int = 250, n_cameras: int = 6, radius: float = 4.0, noise: float = 0.5, seed: int = 42, least: int = 8) -> dict:
    """Cameras on a ring around random points: K, poses, keypoints (image_id, kp_id, x, y, wid) and matches of pairs with enough common points."""
    rng = np.random.default_rng(seed)
    k = camera_matrix(640.0, 640, 480)
    world = rng.uniform(-1.5, 1.5, (n_points, 3))
    angles = np.linspace(0, 2 * np.pi, n_cameras, endpoint=False)
    poses = [look_at(np.array([radius * np.cos(a), 0.4 * np.sin(2 * a), radius * np.sin(a)])) for a in angles]
    views, keypoints = [], []
    for i, (r, t) in enumerate(poses):
        p, z = project(k, r, t, world)
        p = p + rng.normal(0, noise, p.shape)
        seen = np.flatnonzero((z > 0.3) & (p[:, 0] > 4) & (p[:, 0] < 636) & (p[:, 1] > 4) & (p[:, 1] < 476))
        views.append({int(w): kp for kp, w in enumerate(seen)})
        keypoints += [(i, kp, float(p[w, 0]), float(p[w, 1]), int(w)) for kp, w in enumerate(seen)]
    matches = []
    for i in range(n_cameras):
        for j in range(i + 1, n_cameras):
            common = sorted(views[i].keys() & views[j].keys())
            if len(common) >= least:
                matches += [(i, j, o, views[i][w], views[j][w]) for o, w in enumerate(common)]
    return {"K": k, "poses": poses, "world": world, "keypoints": keypoints, "matches": matches}


def planar_report(fallback: Iterable[bool] = (True, False), seed: int = 0) -> list[dict]:
    """Rotation error and inliers of pair verification on planar and volume scenes, with and without the homography's pose."""
    from sparkogram.kernels import twoview

    rows = []
    for kind in ("planar", "volume"):
        scene = two_view_scene(kind, seed=seed)
        for use in fallback:
            got = twoview.verify_pair(scene["x1"], scene["x2"], scene["K"], planar_fallback=use, seed=seed)
            angle = None
            if got is not None:
                trace = np.trace(got.R @ scene["R"].T)
                angle = float(np.degrees(np.arccos(np.clip((trace - 1) / 2, -1, 1))))
            rows.append({"scene": kind, "fallback": use, "n_inliers": 0 if got is None else len(got.inliers), "rotation_error": angle})
    return rows


def focal_sweep(spark: SparkSession, factors: Iterable[float], reconstruct: Callable[[SparkSession, float], dict]) -> DataFrame:
    """(factor, n_cameras, n_points, rmse, focal): a reconstruction per assumed focal factor."""
    rows = []
    for f in factors:
        got = reconstruct(spark, f)
        rows.append((float(f), int(got["n_cameras"]), int(got["n_points"]), float(got["rmse"]), float(got["focal"])))
    return spark.createDataFrame(rows, "factor double, n_cameras long, n_points long, rmse double, focal double")


def focal_verdicts(sweep: DataFrame, truth: float, tolerance: float = 0.1) -> DataFrame:
    """The sweep with the relative error of the recovered focal length and whether it is within the tolerance."""
    error = F.abs(F.col("focal") - F.lit(truth)) / F.lit(truth)
    return sweep.withColumn("focal_error", error).withColumn("accepted", error <= tolerance)


# ---- reports -------------------------------------------------------------------------------


def checkpoint_section(results: dict[str, bool]) -> str:
    """The checkpoint protocol as a Markdown table."""
    lines = ["| Check | Result |", "|---|---|"]
    return "\n".join(lines + [f"| {k} | {'ok' if v else 'FAILED'} |" for k, v in results.items()])


def report(spark: SparkSession, folder: str, checks: dict[str, bool] | None = None) -> str:
    """A Markdown report over the run records of a folder."""
    from sparkogram.operators import reports as R

    runs = spark.read.option("multiLine", True).json(os.path.join(folder, "*.run.json"))
    figures = runs.select("name", R.number("wall_s", 1).alias("seconds"), R.number("peak_rss_mb", 0).alias("peak_mb"), F.col("returncode").cast("string").alias("code"))
    parts = ["# Evaluation", "## Runs", R.markdown(figures, ["name"])]
    summary = dict(runs.dtypes).get("summary", "")
    if "n_cameras" in summary:
        parts += ["## Quality", R.markdown(runs.select("name", "summary.n_cameras", "summary.n_points"), ["name"])]
    if checks is not None:
        parts += ["## Checkpoints", checkpoint_section(checks)]
    return "\n\n".join(parts) + "\n"
