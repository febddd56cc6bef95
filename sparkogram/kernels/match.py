"""Exact descriptor matching of two keypoint blocks."""

from __future__ import annotations

import numpy as np

CHUNK = 1024


def two_nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest row of b, its distance, second distance) for every row of a.

    Candidates come from one matrix product per 1024 rows; the final distances of
    the few best are computed from differences, so equal descriptors are at
    distance 0.  Ties go to the smaller row.
    """
    n, keep = len(a), min(4, len(b))
    first, d1, d2 = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, np.inf)
    bb = (b * b).sum(axis=1)
    for at in range(0, n, CHUNK):
        q = a[at : at + CHUNK]
        rough = bb[None, :] - 2.0 * (q @ b.T)
        best = np.sort(np.argpartition(rough, keep - 1, axis=1)[:, :keep], axis=1)
        exact = np.sqrt(((q[:, None, :] - b[best]) ** 2).sum(axis=2))
        order = np.argsort(exact, axis=1, kind="stable")
        rows = np.arange(len(q))
        first[at : at + CHUNK] = best[rows, order[:, 0]]
        d1[at : at + CHUNK] = exact[rows, order[:, 0]]
        if keep > 1:
            d2[at : at + CHUNK] = exact[rows, order[:, 1]]
    return first, d1, d2


def ratio_pairs(a: np.ndarray, b: np.ndarray, ratio: float, mutual: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs (i, j, distance) that pass d1 < ratio * d2, from both sides when ``mutual``; sorted by (i, j)."""
    none = np.empty(0, np.int64)
    if len(a) < 2 or len(b) < 2:
        return none, none, np.empty(0)
    j, d1, d2 = two_nearest(a, b)
    good = d1 < ratio * d2
    if mutual:
        i, e1, e2 = two_nearest(b, a)
        back = e1 < ratio * e2
        rows = np.arange(len(a))
        good &= back[j] & (i[j] == rows)
    i = np.flatnonzero(good)
    return i, j[i], d1[i]
