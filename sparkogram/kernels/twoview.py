"""Two-view geometry in NumPy: fundamental and essential matrices, homographies, poses, triangulation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def normaliser(x: np.ndarray) -> np.ndarray:
    """Similarity that moves points to their centroid and mean distance sqrt 2."""
    c = x.mean(axis=0)
    s = np.sqrt(2) / max(float(np.linalg.norm(x - c, axis=1).mean()), 1e-12)
    return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def homogeneous(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def undistort(x: np.ndarray, k: np.ndarray, dist: np.ndarray | None, rounds: int = 20) -> np.ndarray:
    """Pixels without radial distortion (k1, k2)."""
    if dist is None or not np.any(dist[:2]):
        return x.astype(float)
    d = (x - k[[0, 1], 2]) / k[[0, 1], [0, 1]]
    u = d.copy()
    for _ in range(rounds):
        r2 = (u * u).sum(axis=1, keepdims=True)
        u = d / (1 + dist[0] * r2 + dist[1] * r2 * r2)
    return u * k[[0, 1], [0, 1]] + k[[0, 1], 2]


def linear_fundamental(x1: np.ndarray, x2: np.ndarray, essential: bool = False) -> np.ndarray:
    """Eight-point estimate with x2' F x1 = 0, singular values fixed."""
    t1, t2 = normaliser(x1), normaliser(x2)
    a, b = homogeneous(x1) @ t1.T, homogeneous(x2) @ t2.T
    f = np.linalg.svd(np.einsum("ni,nj->nij", b, a).reshape(len(a), 9))[2][-1].reshape(3, 3)
    f = t2.T @ f @ t1
    u, s, vt = np.linalg.svd(f)
    s = np.array([1.0, 1.0, 0.0]) if essential else s * [1, 1, 0]
    f = u @ np.diag(s) @ vt
    return f / max(np.linalg.norm(f), 1e-300)


def sampson(f: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Squared first-order distances to the epipolar constraint."""
    a, b = homogeneous(x1), homogeneous(x2)
    fa, fb = a @ f.T, b @ f
    return (b * fa).sum(axis=1) ** 2 / np.maximum(fa[:, 0] ** 2 + fa[:, 1] ** 2 + fb[:, 0] ** 2 + fb[:, 1] ** 2, 1e-300)


def linear_homography(x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    t1, t2 = normaliser(x1), normaliser(x2)
    a, b = homogeneous(x1) @ t1.T, homogeneous(x2) @ t2.T
    z = np.zeros_like(a)
    rows = np.vstack([np.hstack([a, z, -b[:, :1] * a]), np.hstack([z, a, -b[:, 1:2] * a])])
    h = np.linalg.inv(t2) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ t1
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def transfer_error(h: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    p = homogeneous(x1) @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        e = ((p[:, :2] / p[:, 2:] - x2) ** 2).sum(axis=1)
    return np.where(np.isfinite(e), e, np.inf)


def consensus(n: int, size: int, fit, error, limit: float, rng: np.random.Generator, confidence: float = 0.999, rounds: int = 2000):
    """(model, inlier mask): sampling until the confidence is reached, then refits on the inliers."""
    best, mask, tried, need = None, np.zeros(n, bool), 0, rounds
    while tried < min(need, rounds):
        tried += 1
        try:
            model = fit(rng.choice(n, size, replace=False))
        except np.linalg.LinAlgError:
            continue
        inside = error(model) <= limit
        if inside.sum() > mask.sum():
            best, mask = model, inside
            miss = 1 - (inside.mean() ** size)
            need = rounds if miss >= 1 else (1 if miss <= 0 else int(np.log(1 - confidence) / np.log(miss)) + 1)
    for _ in range(3):
        if mask.sum() < size:
            break
        model = fit(np.flatnonzero(mask))
        inside = error(model) <= limit
        if inside.sum() < mask.sum():
            break
        best, mask = model, inside
    return best, mask


def triangulate(p1: np.ndarray, p2: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, valid) by the direct linear transform on all pairs at once."""
    if not len(x1):
        return np.empty((0, 3)), np.empty(0, bool)
    rows = np.stack([x1[:, :1] * p1[2] - p1[0], x1[:, 1:2] * p1[2] - p1[1], x2[:, :1] * p2[2] - p2[0], x2[:, 1:2] * p2[2] - p2[1]], axis=1)
    rows /= np.maximum(np.linalg.norm(rows, axis=2, keepdims=True), 1e-300)
    h = np.linalg.svd(rows)[2][:, -1]
    good = np.abs(h[:, 3]) > 1e-10
    return h[:, :3] / np.where(good, h[:, 3], 1.0)[:, None], good


def depth(x: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    return x @ r[2] + t[2]


def in_front(r: np.ndarray, t: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Which normalised matches lie before both cameras [I | 0] and [R | t]."""
    x, good = triangulate(np.eye(3, 4), np.column_stack([r, t]), n1, n2)
    return good & (x[:, 2] > 0) & (depth(x, r, t) > 0)


def essential_poses(e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    u, _, vt = np.linalg.svd(e)
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    fix = lambda r: r * np.sign(np.linalg.det(r))
    return [(fix(u @ m @ vt), s * u[:, 2]) for m in (w, w.T) for s in (1, -1)]


def homography_poses(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(R, t, n) of a plane-induced homography in normalised coordinates; t in units of the plane's distance."""
    h = h / np.linalg.svd(h)[1][1]
    h = h if np.linalg.det(h) > 0 else -h
    _, s, vt = np.linalg.svd(h)
    v1, v2, v3 = vt
    a, b, c = s[0] ** 2, 1.0, s[2] ** 2
    if a - c < 1e-9:
        return [(h, np.zeros(3), v3)]
    u1 = (np.sqrt(max(b - c, 0)) * v1 + np.sqrt(max(a - b, 0)) * v3) / np.sqrt(a - c)
    u2 = (np.sqrt(max(b - c, 0)) * v1 - np.sqrt(max(a - b, 0)) * v3) / np.sqrt(a - c)
    out = []
    for u in (u1, u2):
        n = np.cross(v2, u)
        frame = np.column_stack([v2, u, n])
        image = np.column_stack([h @ v2, h @ u, np.cross(h @ v2, h @ u)])
        r = image @ frame.T
        t = (h - r) @ n
        out += [(r, t, n), (r, -t, -n)]
    return out


def collinear(x: np.ndarray, limit: float = 0.01) -> bool:
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    return bool(s[1] < limit * max(s[0], 1e-12))


@dataclass
class Verified:
    R: np.ndarray
    t: np.ndarray
    F: np.ndarray
    E: np.ndarray
    H: np.ndarray | None
    inliers: np.ndarray
    planar: bool
    h_ratio: float


def verify_pair(x1: np.ndarray, x2: np.ndarray, k: np.ndarray, threshold: float = 1.0, min_inliers: int = 15, confidence: float = 0.999, planar_ratio: float = 0.85, planar_fallback: bool = True, seed: int = 0, dist: np.ndarray | None = None) -> Verified | None:
    """Geometric verification of matched pixels, or None.

    Gates in order: enough matches; enough inliers of a fundamental matrix; a
    homography that explains nearly all of them means a plane, whose pose comes
    from the homography (or none); no collinear points; enough inliers of an
    essential matrix; enough points before both cameras; a baseline.
    """
    n = len(x1)
    if n < max(min_inliers, 8):
        return None
    rng = np.random.default_rng(seed)
    a, b = undistort(x1, k, dist), undistort(x2, k, dist)
    f, mask = consensus(n, 8, lambda i: linear_fundamental(a[i], b[i]), lambda m: sampson(m, a, b), (2 * threshold) ** 2, rng, confidence)
    if mask.sum() < min_inliers:
        return None
    keep = np.flatnonzero(mask)
    p, q = a[keep], b[keep]
    ki = np.linalg.inv(k)
    n1, n2 = (homogeneous(p) @ ki.T)[:, :2], (homogeneous(q) @ ki.T)[:, :2]
    h, hmask = consensus(len(p), 4, lambda i: linear_homography(p[i], q[i]), lambda m: transfer_error(m, p, q), (3 * threshold) ** 2, rng, confidence, 500)
    ratio = float(hmask.mean())
    if ratio > planar_ratio:
        if not planar_fallback:
            return None
        best, votes = None, np.zeros(0, bool)
        for r, t, normal in homography_poses(ki @ h @ k):
            size = np.linalg.norm(t)
            if normal[2] < 0 or size < 1e-6:
                continue
            front = in_front(r, t / size, n1, n2) & hmask
            if front.sum() > votes.sum():
                best, votes = (r, t / size), front
        if best is None or votes.sum() < min_inliers:
            return None
        r, t = best
        cross = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]])
        return Verified(r, t, f, cross @ r, h, keep[votes], True, ratio)
    if collinear(p) or collinear(q):
        return None
    focal = (k[0, 0] + k[1, 1]) / 2
    e, emask = consensus(len(p), 8, lambda i: linear_fundamental(n1[i], n2[i], True), lambda m: sampson(m, n1, n2), (threshold / focal) ** 2, rng, confidence)
    if e is None or emask.sum() < min_inliers:
        return None
    poses = [(r, t, in_front(r, t, n1, n2) & emask) for r, t in essential_poses(e)]
    r, t, front = max(poses, key=lambda x: x[2].sum())
    if front.sum() < min_inliers or np.linalg.norm(t) < 1e-4:
        return None
    return Verified(r, t, f, e, h, keep[front], False, ratio)
