"""Bundle adjustment: Levenberg-Marquardt with a Schur complement over points.

Parameters: per camera axis-angle and translation, per point a position, and
shared intrinsics (focal length, optionally principal point, k1, k2).  Residuals
carry Huber weights per scalar; columns are scaled by their own curvature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sparkogram.kernels.resection import nearest_rotation, rotation


@dataclass(frozen=True)
class Options:
    max_rounds: int = 200
    ftol: float = 1e-6
    xtol: float = 1e-6
    gtol: float = 1e-6
    loss: str = "huber"
    f_scale: float = 2.0
    fix_principal_point: bool = False
    separate_focal: bool = False
    refine_intrinsics: bool = True


def project(cam: np.ndarray, intr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels of camera-frame points with their derivatives by point and by intrinsics (fx, fy, cx, cy, k1, k2)."""
    fx, fy, cx, cy, k1, k2 = intr
    z = np.where(np.abs(cam[:, 2]) > 1e-9, cam[:, 2], 1e-9)
    a, b = cam[:, 0] / z, cam[:, 1] / z
    r2 = a * a + b * b
    d, dd = 1 + k1 * r2 + k2 * r2 * r2, k1 + 2 * k2 * r2
    uv = np.column_stack([fx * a * d + cx, fy * b * d + cy])
    da = np.zeros((len(cam), 2, 2))
    da[:, 0, 0], da[:, 0, 1] = fx * (d + 2 * a * a * dd), fx * 2 * a * b * dd
    da[:, 1, 0], da[:, 1, 1] = fy * 2 * a * b * dd, fy * (d + 2 * b * b * dd)
    dz = np.zeros((len(cam), 2, 3))
    dz[:, 0, 0], dz[:, 1, 1], dz[:, 0, 2], dz[:, 1, 2] = 1 / z, 1 / z, -a / z, -b / z
    di = np.zeros((len(cam), 2, 6))
    di[:, 0, 0], di[:, 1, 1], di[:, 0, 2], di[:, 1, 3] = a * d, b * d, 1, 1
    di[:, 0, 4], di[:, 1, 4], di[:, 0, 5], di[:, 1, 5] = fx * a * r2, fy * b * r2, fx * a * r2**2, fy * b * r2**2
    return uv, da @ dz, di


def _mixing(o: Options) -> np.ndarray:
    """6 x m map from free intrinsics to (fx, fy, cx, cy, k1, k2)."""
    if not o.refine_intrinsics:
        return np.zeros((6, 0))
    cols = [np.array([1.0, 1, 0, 0, 0, 0])] if not o.separate_focal else [np.eye(6)[0], np.eye(6)[1]]
    if not o.fix_principal_point:
        cols += [np.eye(6)[2], np.eye(6)[3]]
    return np.column_stack([*cols, np.eye(6)[4], np.eye(6)[5]])


def adjust(r: np.ndarray, t: np.ndarray, points: np.ndarray, cam_idx: np.ndarray, pt_idx: np.ndarray, uv: np.ndarray, intr: np.ndarray, options: Options = Options()):
    """(R, t, points, intrinsics, rmse before, rmse after); unchanged under 8 observations or when the error grows."""
    n_cam, n_pt = len(r), len(points)
    if len(uv) < 8:
        return r, t, points, intr, 0.0, 0.0
    mix = _mixing(options)
    m, f0 = mix.shape[1], intr[0]
    low = np.array([0.5 * f0, 0.5 * intr[1], 0.9 * intr[2], 0.9 * intr[3], -2, -2])
    high = np.array([2 * f0, 2 * intr[1], 1.1 * intr[2], 1.1 * intr[3], 2, 2])

    def state(r, t, x, i):
        uv_hat, dc, di = project(np.einsum("nij,nj->ni", r[cam_idx], x[pt_idx]) + t[cam_idx], i)
        return uv_hat - uv, dc, di

    e, dc, di = state(r, t, points, intr)
    start = (r, t, points, intr)
    rmse0 = float(np.sqrt((e * e).sum(axis=1).mean()))
    scale = options.f_scale
    if options.loss == "huber" and scale == 2.0:
        scale = float(np.clip(1.4826 * np.median(np.abs(e)), 0.5, 10.0))

    def cost_of(e):
        a = np.abs(e)
        return float(np.where(a <= scale, 0.5 * e * e, scale * (a - 0.5 * scale)).sum()) if options.loss == "huber" else float(0.5 * (e * e).sum())

    cost, lam = cost_of(e), 1e-3
    for _ in range(options.max_rounds):
        w = np.minimum(1.0, scale / np.maximum(np.abs(e), 1e-12)) if options.loss == "huber" else np.ones_like(e)
        turned = np.einsum("nij,nj->ni", r[cam_idx], points[pt_idx])
        skew = np.zeros((len(e), 3, 3))
        skew[:, 0, 1], skew[:, 0, 2], skew[:, 1, 2] = turned[:, 2], -turned[:, 1], turned[:, 0]
        skew[:, 1, 0], skew[:, 2, 0], skew[:, 2, 1] = -turned[:, 2], turned[:, 1], -turned[:, 0]
        jc = np.concatenate([dc @ skew, dc], axis=2)
        jp, ji = dc @ r[cam_idx], di @ mix
        # normal equations by blocks
        wc, wp, wi = jc * w[:, :, None], jp * w[:, :, None], ji * w[:, :, None]
        hcc, gc = np.zeros((n_cam, 6, 6)), np.zeros((n_cam, 6))
        hpp, gp = np.zeros((n_pt, 3, 3)), np.zeros((n_pt, 3))
        np.add.at(hcc, cam_idx, np.einsum("nki,nkj->nij", wc, jc))
        np.add.at(gc, cam_idx, np.einsum("nki,nk->ni", wc, e))
        np.add.at(hpp, pt_idx, np.einsum("nki,nkj->nij", wp, jp))
        np.add.at(gp, pt_idx, np.einsum("nki,nk->ni", wp, e))
        hci = np.zeros((n_cam, 6, m))
        np.add.at(hci, cam_idx, np.einsum("nki,nkj->nij", wc, ji))
        hii, gi = np.einsum("nki,nkj->ij", wi, ji), np.einsum("nki,nk->i", wi, e)
        hpi = np.zeros((n_pt, 3, m))
        np.add.at(hpi, pt_idx, np.einsum("nki,nkj->nij", wp, ji))
        wcp = np.einsum("nki,nkj->nij", wc, jp)  # one 6 x 3 block per observation
        size = 6 * n_cam + m
        a0, b0 = np.zeros((size, size)), np.concatenate([gc.ravel(), gi])
        for c in range(n_cam):
            a0[6 * c : 6 * c + 6, 6 * c : 6 * c + 6] = hcc[c]
            a0[6 * c : 6 * c + 6, 6 * n_cam :] = hci[c]
            a0[6 * n_cam :, 6 * c : 6 * c + 6] = hci[c].T
        a0[6 * n_cam :, 6 * n_cam :] = hii
        if max(np.abs(b0).max(initial=0), np.abs(gp).max(initial=0)) < options.gtol:
            break
        accepted = False
        while lam < 1e12:
            inv = np.linalg.inv(hpp + (lam * np.einsum("nii->ni", hpp) + 1e-9)[:, :, None] * np.eye(3))
            a, b = a0 + np.diag(lam * np.diag(a0) + 1e-9), b0.copy()
            # eliminate the points: rows of E (cameras and intrinsics by points) as one dense slab per point group
            slab = np.zeros((n_pt, size, 3)) if size * n_pt < 4_000_000 else None
            if slab is not None:
                np.add.at(slab.reshape(n_pt, -1), (pt_idx[:, None], (cam_idx[:, None] * 18 + np.arange(18)[None, :])), wcp.reshape(len(wcp), 18))
                slab[:, 6 * n_cam :, :] = hpi.transpose(0, 2, 1)
                half = slab @ inv
                a -= np.tensordot(half, slab, axes=([0, 2], [0, 2]))
                b -= np.einsum("pij,pj->i", half, gp)
            else:
                order = np.argsort(pt_idx, kind="stable")
                bounds = np.flatnonzero(np.diff(np.append(-1, pt_idx[order])))
                for s, end in zip(bounds, np.append(bounds[1:], len(order)), strict=True):
                    rows, p = order[s:end], pt_idx[order[s]]
                    idx = np.concatenate([(6 * cam_idx[rows][:, None] + np.arange(6)).ravel(), 6 * n_cam + np.arange(m)])
                    ep = np.vstack([wcp[rows].reshape(-1, 3), hpi[p].T])
                    half = ep @ inv[p]
                    np.subtract.at(a, (idx[:, None], idx[None, :]), half @ ep.T)
                    np.subtract.at(b, idx, half @ gp[p])
            try:
                step = np.linalg.solve(a, -b)
            except np.linalg.LinAlgError:
                lam *= 10
                continue
            sc, si = step[: 6 * n_cam].reshape(n_cam, 6), step[6 * n_cam :]
            back = gp + hpi @ si
            np.add.at(back, pt_idx, np.einsum("nij,ni->nj", wcp, sc[cam_idx]))
            sp = -np.einsum("pij,pj->pi", inv, back)
            r2 = np.stack([rotation(v) @ q for v, q in zip(sc[:, :3], r, strict=True)])
            t2, x2, i2 = t + sc[:, 3:], points + sp, np.clip(intr + mix @ si, low, high)
            e2, dc2, di2 = state(r2, t2, x2, i2)
            new = cost_of(e2)
            if new < cost:
                accepted = True
                break
            lam *= 4
        if not accepted:
            break
        gain, move = cost - new, np.abs(step).max() / (1e-12 + np.abs(t).max())
        r, t, points, intr, e, dc, di, cost, lam = r2, t2, x2, i2, e2, dc2, di2, new, max(lam / 5, 1e-12)
        if gain < options.ftol * cost or move < options.xtol * 1e-3:
            break
    rmse1 = float(np.sqrt((e * e).sum(axis=1).mean()))
    if not np.isfinite(rmse1) or rmse1 > 1.5 * rmse0:
        return (*start, rmse0, rmse0)
    return np.stack([nearest_rotation(x) for x in r]), t, points, intr, rmse0, rmse1
