"""Incremental reconstruction of one connected component."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from sparkogram.kernels.adjust import Options, adjust
from sparkogram.kernels.resection import resect, residuals
from sparkogram.kernels.twoview import triangulate


@dataclass
class Pair:
    inliers: np.ndarray  # (n, 2) keypoint numbers
    R: np.ndarray
    t: np.ndarray
    planar: bool = False


@dataclass(frozen=True)
class Settings:
    max_error: float = 4.0
    min_angle: float = 2.0
    seed_angle: float = 5.0
    ba_interval: int = 5
    seed: int = 0
    completion: bool = True
    ba: Options = Options()
    local_window: int = 0


@dataclass
class Reconstruction:
    """Cameras, points and observations; ids of points are stable positions until :meth:`result`."""

    features: dict[int, np.ndarray]
    pairs: dict[tuple[int, int], Pair]
    K: np.ndarray
    settings: Settings = Settings()
    cameras: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    points: list[np.ndarray] = field(default_factory=list)
    obs: dict[tuple[int, int], int] = field(default_factory=dict)  # (image, point) -> keypoint
    log: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.intr = np.array([self.K[0, 0], self.K[1, 1], self.K[0, 2], self.K[1, 2], 0.0, 0.0])
        self.link = {i: np.full(len(x), -1) for i, x in self.features.items()}
        self.near: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for (i, j), p in sorted(self.pairs.items()):
            self.near.setdefault(i, []).append((j, p.inliers[:, 0], p.inliers[:, 1]))
            self.near.setdefault(j, []).append((i, p.inliers[:, 1], p.inliers[:, 0]))
        self.flat = {i: x.astype(float) for i, x in self.features.items()}

    def _matrix(self) -> np.ndarray:
        fx, fy, cx, cy = self.intr[:4]
        return np.array([[fx, 0, cx], [0, fy, cy], [0, 0, 1.0]])

    def _undistort(self) -> None:
        from sparkogram.kernels.twoview import undistort

        self.flat = {i: undistort(x, self._matrix(), self.intr[4:]) for i, x in self.features.items()}

    # ---- pieces ----

    def _accept(self, x: np.ndarray, good: np.ndarray, i: int, j: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """In front of both cameras, wide enough, close enough to both observations."""
        k = self._matrix()
        for c, w in ((i, u), (j, v)):
            e, z = residuals(*self.cameras[c], k, x, w)
            good = good & (z > 0) & (np.hypot(e[:, 0], e[:, 1]) <= self.settings.max_error)
        return good & (self._angles(x, i, j) >= self.settings.min_angle)

    def _angles(self, x: np.ndarray, i: int, j: int) -> np.ndarray:
        rays = [x + self.cameras[c][0].T @ self.cameras[c][1] for c in (i, j)]
        n = [np.linalg.norm(a, axis=1) for a in rays]
        with np.errstate(divide="ignore", invalid="ignore"):
            cos = (rays[0] * rays[1]).sum(axis=1) / (n[0] * n[1])
        return np.where((n[0] > 1e-10) & (n[1] > 1e-10), np.degrees(np.arccos(np.clip(cos, -1, 1))), -1.0)

    def _two_view(self, i: int, j: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self._matrix()
        p = [k @ np.column_stack(self.cameras[c]) for c in (i, j)]
        return triangulate(p[0], p[1], self.flat[i][a], self.flat[j][b])

    def _observe(self, image: int, kp: int, point: int) -> None:
        """First claim wins, for the keypoint and for (image, point)."""
        if self.link[image][kp] < 0 and (image, point) not in self.obs:
            self.link[image][kp] = point
            self.obs[image, point] = int(kp)

    def _add_points(self, i: int, j: int, a: np.ndarray, b: np.ndarray) -> int:
        """Triangulate matches whose ends are both free."""
        free = (self.link[i][a] < 0) & (self.link[j][b] < 0)
        a, b = a[free], b[free]
        if not len(a):
            return 0
        x, good = self._two_view(i, j, a, b)
        good = self._accept(x, good, i, j, self.flat[i][a], self.flat[j][b])
        made = 0
        for n in np.flatnonzero(good):
            if self.link[i][a[n]] < 0 and self.link[j][b[n]] < 0:
                self.points.append(x[n])
                self._observe(i, a[n], len(self.points) - 1)
                self._observe(j, b[n], len(self.points) - 1)
                made += 1
        return made

    # ---- stages ----

    def choose_seed(self) -> tuple[int, int] | None:
        """Most inliers times baseline among non-planar pairs of enough median angle, else most inliers."""
        best, score = None, 0.0
        for (i, j), p in sorted(self.pairs.items()):
            if p.planar:
                continue
            self.cameras = {i: (np.eye(3), np.zeros(3)), j: (p.R, p.t)}
            x, good = self._two_view(i, j, p.inliers[:, 0], p.inliers[:, 1])
            worth = float(np.linalg.norm(p.t)) * len(p.inliers)
            if good.any() and np.median(self._angles(x, i, j)[good]) >= self.settings.seed_angle and worth > score:
                best, score = (i, j), worth
        self.cameras = {}
        if best is None and self.pairs:
            best = max(sorted(self.pairs), key=lambda q: len(self.pairs[q].inliers))
        return best

    def correspondences(self, image: int) -> tuple[np.ndarray, np.ndarray]:
        """(keypoints, points) an image reaches through registered neighbours; the first keypoint of a point wins."""
        kp, pt, seen = [], [], set()
        for other, a, b in self.near.get(image, []):
            if other not in self.cameras:
                continue
            for k, p in zip(a, self.link[other][b], strict=True):
                if p >= 0 and p not in seen:
                    seen.add(p)
                    kp.append(k)
                    pt.append(p)
        return np.array(kp, int), np.array(pt, int)

    def register(self, image: int) -> bool:
        kp, pt = self.correspondences(image)
        if len(pt) < 6:
            return False
        x = np.array(self.points)[pt]
        got = resect(x, self.flat[image][kp], self._matrix(), self.settings.max_error, self.settings.seed + image)
        if got is None or np.linalg.norm(got[1]) > 50 * (np.median(np.linalg.norm(np.array(self.points), axis=1)) + 1e-6):
            return False
        self.cameras[image] = got[:2]
        for k, p in zip(kp[got[2]], pt[got[2]], strict=True):
            self._observe(image, k, p)
        return True

    def complete(self) -> int:
        """Matches with one linked end add an observation that fits."""
        added, k, x = 0, self._matrix(), np.array(self.points)
        for (i, j), p in sorted(self.pairs.items()):
            if i not in self.cameras or j not in self.cameras:
                continue
            for src, dst, a, b in ((i, j, p.inliers[:, 0], p.inliers[:, 1]), (j, i, p.inliers[:, 1], p.inliers[:, 0])):
                pt = self.link[src][a]
                open_ = (pt >= 0) & (self.link[dst][b] < 0)
                if not open_.any():
                    continue
                e, z = residuals(*self.cameras[dst], k, x[pt[open_]], self.flat[dst][b[open_]])
                fits = (z > 0) & (np.hypot(e[:, 0], e[:, 1]) <= self.settings.max_error)
                before = len(self.obs)
                for kp, q in zip(b[open_][fits], pt[open_][fits], strict=True):
                    self._observe(dst, kp, q)
                added += len(self.obs) - before
        return added

    def bundle(self) -> tuple[float, float]:
        if self.settings.completion:
            self.complete()
        images = sorted(self.cameras)
        used = sorted({p for _, p in self.obs})
        cam, pt = {c: n for n, c in enumerate(images)}, {p: n for n, p in enumerate(used)}
        keys = sorted(self.obs)
        ci, pi = np.array([cam[i] for i, _ in keys]), np.array([pt[p] for _, p in keys])
        uv = np.array([self.features[i][self.obs[i, p]] for i, p in keys], float)
        r, t = np.stack([self.cameras[c][0] for c in images]), np.stack([self.cameras[c][1] for c in images])
        r, t, x, self.intr, before, after = adjust(r, t, np.array([self.points[p] for p in used]), ci, pi, uv, self.intr, self.settings.ba)
        for c, n in cam.items():
            self.cameras[c] = (r[n], t[n])
        for p, n in pt.items():
            self.points[p] = x[n]
        self._undistort()
        for (i, j), pair in sorted(self.pairs.items()):
            if i in self.cameras and j in self.cameras:
                self._add_points(i, j, pair.inliers[:, 0], pair.inliers[:, 1])
        self.log.append({"kind": "ba", "before": before, "after": after, "cameras": len(images), "points": len(used)})
        return before, after

    def bundle_local(self, window: int) -> tuple[float, float]:
        """Adjust the last ``window`` registered cameras and the points they see; intrinsics stay."""
        images = list(self.cameras)[-window:]
        keys = sorted(k for k in self.obs if k[0] in set(images))
        used = sorted({p for _, p in keys})
        if len(keys) < 8:
            return 0.0, 0.0
        cam, pt = {c: n for n, c in enumerate(images)}, {p: n for n, p in enumerate(used)}
        ci, pi = np.array([cam[i] for i, _ in keys]), np.array([pt[p] for _, p in keys])
        uv = np.array([self.features[i][self.obs[i, p]] for i, p in keys], float)
        r, t = np.stack([self.cameras[c][0] for c in images]), np.stack([self.cameras[c][1] for c in images])
        fixed = replace(self.settings.ba, refine_intrinsics=False)
        r, t, x, _, before, after = adjust(r, t, np.array([self.points[p] for p in used]), ci, pi, uv, self.intr, fixed)
        for c, n in cam.items():
            self.cameras[c] = (r[n], t[n])
        for p, n in pt.items():
            self.points[p] = x[n]
        self.log.append({"kind": "ba", "before": before, "after": after, "cameras": len(images), "points": len(used)})
        return before, after

    def point_errors(self) -> dict[int, float]:
        k, total, count = self._matrix(), {}, {}
        x = np.array(self.points)
        for image in sorted(self.cameras):
            keys = [(p, kp) for (i, p), kp in self.obs.items() if i == image]
            if not keys:
                continue
            p, kp = np.array(keys).T
            e, z = residuals(*self.cameras[image], k, x[p], self.flat[image][kp])
            for q, v in zip(p[z > 0], np.hypot(e[:, 0], e[:, 1])[z > 0], strict=True):
                total[q], count[q] = total.get(q, 0.0) + v, count.get(q, 0) + 1
        return {q: total[q] / count[q] for q in total}

    def remove_outliers(self) -> None:
        """Points above min(2 tau, median + 3 deviations) of the mean error go."""
        errors = self.point_errors()
        if not errors:
            return
        v = np.array(list(errors.values()))
        limit = min(2 * self.settings.max_error, float(np.median(v) + 3 * v.std()))
        keep = {p for p, e in errors.items() if e <= limit}
        for (i, p), kp in list(self.obs.items()):
            if p not in keep:
                del self.obs[i, p]
                self.link[i][kp] = -1

    def run(self) -> Reconstruction:
        seed = self.choose_seed()
        if seed is None:
            return self
        pair = self.pairs[seed]
        self.cameras = {seed[0]: (np.eye(3), np.zeros(3)), seed[1]: (pair.R, pair.t)}
        n = self._add_points(*seed, pair.inliers[:, 0], pair.inliers[:, 1])
        self.log.append({"kind": "seed", "image": seed[0], "other": seed[1], "new_points": n})
        waiting = set(self.features) - set(self.cameras)
        while waiting and self.points:
            counts = {i: len(self.correspondences(i)[1]) for i in sorted(waiting)}
            image = max(counts, key=lambda i: (counts[i], -i))
            if counts[image] < 6:
                break
            waiting.discard(image)
            if not self.register(image):
                continue
            new = 0
            for other, a, b in self.near.get(image, []):
                if other in self.cameras:
                    new += self._add_points(image, other, a, b)
            self.log.append({"kind": "registered", "image": image, "new_points": new, "correspondences": counts[image]})
            if self.settings.local_window:
                self.bundle_local(self.settings.local_window)
            if (len(self.cameras) - 2) % self.settings.ba_interval == 0:
                self.bundle()
        if len(self.points):
            self.bundle()
            self.remove_outliers()
        return self

    def rmse(self) -> float:
        k, x, sq, n = self._matrix(), np.array(self.points), 0.0, 0
        for (i, p), kp in self.obs.items():
            e, z = residuals(*self.cameras[i], k, x[p : p + 1], self.flat[i][kp : kp + 1])
            if z[0] > 1e-6:
                sq, n = sq + float((e * e).sum()), n + 1
        return float(np.sqrt(sq / n)) if n else float("nan")
