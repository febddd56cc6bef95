"""Similarity alignment of two point sets."""

from __future__ import annotations

import numpy as np


def from_moments(mean_s: np.ndarray, mean_d: np.ndarray, cov: np.ndarray, var_s: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(s, R, t) from means, target-by-source covariance and source variance; never a reflection."""
    u, d, vt = np.linalg.svd(cov)
    sign = np.ones(3)
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        sign[2] = -1
    r = u @ np.diag(sign) @ vt
    s = float((d * sign).sum() / var_s) if var_s > 0 else 1.0
    return s, r, mean_d - s * r @ mean_s


def similarity(src: np.ndarray, dst: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Least-squares dst = s R src + t."""
    ms, md = src.mean(axis=0), dst.mean(axis=0)
    a, b = src - ms, dst - md
    return from_moments(ms, md, b.T @ a / len(src), float((a * a).sum() / len(src)))


def similarity_ransac(src: np.ndarray, dst: np.ndarray, rounds: int = 500, share: float = 0.1, seed: int = 0):
    """(s, R, t, inliers): best of seeded three-point fits by points within ``share`` of the target's extent, refitted."""
    rng = np.random.default_rng(seed)
    limit = share * float(np.linalg.norm(dst.max(axis=0) - dst.min(axis=0)))
    best = np.ones(len(src), bool) if len(src) < 4 else np.zeros(len(src), bool)
    for _ in range(rounds if len(src) >= 4 else 0):
        pick = rng.choice(len(src), 3, replace=False)
        s, r, t = similarity(src[pick], dst[pick])
        inside = np.linalg.norm(s * src @ r.T + t - dst, axis=1) <= limit
        if inside.sum() > best.sum():
            best = inside
    if best.sum() < 3:
        best[:] = True
    return (*similarity(src[best], dst[best]), best)
