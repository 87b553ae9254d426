"""Homography from point pairs, on the driver: a clip has a few named points."""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np

RANSAC_M = 2.0  # metres


class Homography(NamedTuple):
    h: list[float]
    n_points: int
    method: str


def calibrate(pairs: dict[str, dict]) -> Homography:
    """The homography from pixels to metres.

    Four pairs are solved exactly.  Of more, the four that bring most pairs within
    ``RANSAC_M`` are found by trying all, and all pairs near them are fitted; if no
    four do so for at least four pairs, all pairs are fitted.
    """
    src = np.array([p["pixel"] for p in pairs.values()], float)
    dst = np.array([p["terrain_m"] for p in pairs.values()], float)
    if len(src) < 4:
        raise ValueError(f"4 pairs are needed, {len(src)} were given")
    if len(src) == 4:
        return Homography(_fit(src, dst).reshape(-1).tolist(), 4, "perspective_4pts")
    best, error = np.zeros(len(src), bool), np.inf
    for four in combinations(range(len(src)), 4):
        at = list(four)
        with np.errstate(all="ignore"):
            off = np.linalg.norm(_apply(_fit(src[at], dst[at]), src) - dst, axis=1)
        near = off <= RANSAC_M
        if (near.sum(), -off[near].sum()) > (best.sum(), -error):
            best, error = near, off[near].sum()
    if best.sum() >= 4 and np.linalg.matrix_rank(src[best] - src[best].mean(axis=0), tol=1e-6) == 2:
        return Homography(_fit(src[best], dst[best]).reshape(-1).tolist(), len(src), "ransac")
    return Homography(_fit(src, dst).reshape(-1).tolist(), len(src), "least_squares")


def _scaled(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = points.mean(axis=0)
    s = np.sqrt(2) / max(np.linalg.norm(points - mean, axis=1).mean(), 1e-12)
    t = np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1]])
    return (points - mean) * s, t


def _fit(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    (a, ta), (b, tb) = _scaled(src), _scaled(dst)
    rows = []
    for (x, y), (u, v) in zip(a, b, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.inv(tb) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def _apply(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    q = np.c_[points, np.ones(len(points))] @ h.T
    return q[:, :2] / q[:, 2:]
