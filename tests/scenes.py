"""Synthetic scenes with exact ground truth."""

from __future__ import annotations

import numpy as np
import pandas as pd


def look_at(eye: np.ndarray, target: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    z = (np.zeros(3) if target is None else target) - eye
    z = z / np.linalg.norm(z)
    x = np.cross(z, [0.0, 1.0, 0.0])
    x = x / np.linalg.norm(x)
    r = np.stack([x, np.cross(z, x), z])
    return r, -r @ eye


def ring(n_points: int = 250, n_cameras: int = 6, noise: float = 0.5, seed: int = 42):
    """Cameras on a circle of radius 4 around points in a cube: K, poses, keypoints and matches as pandas tables."""
    rng = np.random.default_rng(seed)
    k = np.array([[640.0, 0, 320], [0, 640, 240], [0, 0, 1]])
    world = rng.uniform(-1.5, 1.5, (n_points, 3))
    poses, rows, seen = [], [], []
    for c in range(n_cameras):
        a = 2 * np.pi * c / n_cameras
        r, t = look_at(np.array([4 * np.cos(a), 0.6 * np.sin(2 * a), 4 * np.sin(a)]))
        cam = world @ r.T + t
        uv = cam @ k.T
        uv = uv[:, :2] / uv[:, 2:] + rng.normal(0, noise, (n_points, 2))
        ok = (cam[:, 2] > 0.3) & (uv[:, 0] > 4) & (uv[:, 0] < 636) & (uv[:, 1] > 4) & (uv[:, 1] < 476)
        wid = np.flatnonzero(ok)
        poses.append((r, t))
        seen.append({int(w): i for i, w in enumerate(wid)})
        rows += [(c, i, float(uv[w, 0]), float(uv[w, 1]), int(w)) for i, w in enumerate(wid)]
    kp = pd.DataFrame(rows, columns=["image_id", "kp_id", "x", "y", "wid"])
    m = []
    for i in range(n_cameras):
        for j in range(i + 1, n_cameras):
            common = sorted(seen[i].keys() & seen[j].keys())
            if len(common) >= 8:
                m += [(i, j, n, seen[i][w], seen[j][w]) for n, w in enumerate(common)]
    matches = pd.DataFrame(m, columns=["img_i", "img_j", "ord", "kp_i", "kp_j"])
    return k, poses, world, kp, matches
