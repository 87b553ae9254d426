"""Tracking by detection, one clip at a time.

A clean implementation after two papers: association in two stages by confidence
(arXiv 2110.06864), with an optional appearance cost (arXiv 2206.14651).  Tracking is
sequential in a clip and clips are independent, so the clip is the unit of work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class TrackerConfig:
    high: float = 0.25  # confidence of the first stage
    low: float = 0.1  # and of the second
    new: float = 0.25  # least confidence that begins a track, from the first stage's boxes
    buffer: int = 30  # frames that a lost track is kept, at 30 frames a second
    match: float = 0.8  # greatest cost of a match in the first stage
    second: float = 0.5  # and in the second
    least_frames: int = 2  # matches before a track is reported
    appearance: float = 0.0  # weight of the embedding distance


def frame_rate(fps: float, subsample: int = 1) -> int:
    return max(1, round(fps / max(1, subsample)))


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.prod(np.clip(hi - lo, 0, None), axis=2)
    area = lambda x: np.prod(np.clip(x[:, 2:] - x[:, :2], 0, None), axis=1)
    return inter / np.maximum(area(a)[:, None] + area(b)[None] - inter, 1e-9)


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Least-cost matching of rows and columns (shortest augmenting paths); pairs above ``limit`` are left apart."""
    n, m = cost.shape
    if not n or not m:
        return []
    if n > m:
        return [(j, i) for i, j in assign(cost.T, limit)]
    capped = np.minimum(cost, limit + 1e-6)
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            cur = capped[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = ~used[1:] & (cur < least[1:])
            least[1:][better], way[1:][better] = cur[better], j0
            j1 = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j] and cost[owner[j] - 1, j - 1] <= limit]


class _Track:
    """A box with constant velocity, followed by a steady-gain filter."""

    def __init__(self, box, feature):
        self.box, self.speed, self.hits, self.missed, self.id, self.feature = box.astype(float), np.zeros(4), 1, 0, None, feature

    def predict(self):
        self.box = self.box + self.speed

    def update(self, box, feature):
        off = box - self.box
        self.box, self.speed = self.box + 0.8 * off, self.speed + 0.3 * off
        self.hits, self.missed = self.hits + 1, 0
        if feature is not None:
            self.feature = feature if self.feature is None else 0.9 * self.feature + 0.1 * feature


def track_clip(rows: pd.DataFrame, config: TrackerConfig, rate: int) -> np.ndarray:
    """The track of each detection of one clip, or 0; ``rows`` are in frame order."""
    tracks: list[_Track] = []
    out, next_id, keep = np.zeros(len(rows), np.int64), 1, max(1, config.buffer * rate // 30)
    boxes, conf = rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows["confidence"].to_numpy(float)
    features = [np.asarray(f, float) for f in rows["embedding"]] if config.appearance and "embedding" in rows else None
    for _, at in rows.groupby("frame_idx", sort=True).indices.items():
        for t in tracks:
            t.predict()
        free, given = list(range(len(tracks))), set()
        sure, unsure = at[conf[at] >= config.high], at[(conf[at] < config.high) & (conf[at] >= config.low)]
        for stage, limit in ((sure, config.match), (unsure, config.second)):
            if not len(free) or not len(stage):
                continue
            cost = 1 - iou(np.array([tracks[k].box for k in free]), boxes[stage])
            if features:
                near = np.array([[1.0 if tracks[k].feature is None else 1 - float(_cosine(tracks[k].feature, features[d])) for d in stage] for k in free])
                cost = (1 - config.appearance) * cost + config.appearance * near
            pairs = assign(cost, limit)
            for i, j in pairs:
                t, d = tracks[free[i]], stage[j]
                t.update(boxes[d], features[d] if features else None)
                given.add(d)
                if t.hits >= config.least_frames:
                    if t.id is None:
                        t.id, next_id = next_id, next_id + 1
                    out[d] = t.id
            taken = {i for i, _ in pairs}
            free = [k for i, k in enumerate(free) if i not in taken]
        for k in free:
            tracks[k].missed += 1
        tracks = [t for t in tracks if t.missed <= (keep if t.id is not None else 0)]
        for d in at:
            if d not in given and conf[d] >= max(config.high, config.new):
                tracks.append(_Track(boxes[d], features[d] if features else None))
                if config.least_frames <= 1:
                    tracks[-1].id, out[d], next_id = next_id, next_id, next_id + 1
    return out


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    return a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12)


def track(det: DataFrame, fps: float, subsample: int = 1, config: TrackerConfig = TrackerConfig()) -> DataFrame:
    """Add ``tracker_id`` to detections ``(clip_id, frame_idx, det_ord, x1, y1, x2, y2, confidence, class_id[, embedding])``."""
    rate = frame_rate(fps, subsample)
    names = ["clip_id", "frame_idx", "det_ord", "class_id"]
    kinds = dict(det.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame_idx", "det_ord"]).reset_index(drop=True)
        rows["tracker_id"] = track_clip(rows, config, rate)
        return rows.loc[rows["tracker_id"] > 0, [*names, "tracker_id"]]

    return det.groupBy("clip_id").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", tracker_id long")


#: Trackers by name.
BACKENDS = {"bytetrack": TrackerConfig(), "botsort": TrackerConfig(buffer=60, appearance=0.25)}


def track_with(det: DataFrame, backend: str, fps: float, subsample: int = 1) -> DataFrame:
    if backend not in BACKENDS:
        raise ValueError(f"unknown tracker {backend}")
    return track(det, fps, subsample, BACKENDS[backend])
