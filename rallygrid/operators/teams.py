"""Team of each track from the colour of torsos."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tracks import TRACK, majority


def torso_colour(pixels: DataFrame) -> DataFrame:
    """Median of each channel over the torso of each box.

    ``pixels(.., det_ord, x, y, b, g, r, x1, y1, x2, y2)`` has a row per pixel of a
    box; the torso is 15 to 40 % of its height, within 20 % of its width around the
    centre.  A box without such pixels is black.  Only torso pixels and one row a box
    reach the medians, which Spark sorts for.
    """
    box = ["clip_id", "frame_idx", "det_ord"]
    w, h, cx = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), ((F.col("x1") + F.col("x2")) / 2).cast("int")
    half = (w * F.lit(0.2)).cast("int")
    top, bottom = F.col("y1") + (h * F.lit(0.15)).cast("int"), F.col("y1") + (h * F.lit(0.4)).cast("int")
    inside = (F.col("y") >= top) & (F.col("y") < bottom) & (F.col("x") >= cx - half) & (F.col("x") < cx + half)
    boxes = pixels.select(*box).distinct().select(*box, *(F.lit(None).cast("double").alias(c) for c in "bgr"))
    torso = pixels.where(inside).select(*box, *"bgr").unionByName(boxes)
    return torso.groupBy(*box).agg(*(F.coalesce(F.median(c), F.lit(0.0)).alias(c) for c in "bgr"))


def two_colours(colours: DataFrame, rounds: int = 50) -> DataFrame:
    """Two clusters of each clip's colours; 0 is the darker one, the home team.

    Lloyd's steps from the darkest and the brightest colour, on counts of equal
    colours, so that what one task holds of a clip is bounded by its distinct colours.
    ``colours(clip_id, tracker_id, frame_idx, det_ord, b, g, r)`` gains ``team``.
    Clips with fewer than two colours have no teams.
    """
    counts = colours.groupBy("clip_id", "b", "g", "r").agg(F.count("*").alias("n"))

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        x, n = rows[["b", "g", "r"]].to_numpy(float), rows["n"].to_numpy(float)
        if len(x) < 2:
            return rows.assign(team=-1)[["clip_id", "b", "g", "r", "team"]].iloc[:0]
        order = np.lexsort((x[:, 2], x[:, 1], x[:, 0], x.mean(axis=1)))
        centres = x[order[[0, -1]]]
        for _ in range(rounds):
            team = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([np.average(x[team == k], axis=0, weights=n[team == k]) if (team == k).any() else centres[k] for k in (0, 1)])
            if np.allclose(new, centres):
                break
            centres = new
        if centres[0].mean() > centres[1].mean():
            team = 1 - team
        return rows.assign(team=team)[["clip_id", "b", "g", "r", "team"]]

    kinds = {c: t for c, t in colours.dtypes if c in ("clip_id", "b", "g", "r")}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("clip_id", "b", "g", "r")) + ", team int"
    return colours.join(counts.groupBy("clip_id").applyInPandas(split, schema), ["clip_id", "b", "g", "r"])


def track_teams(labelled: DataFrame) -> DataFrame:
    """Each track's commonest team; ties go to the one seen first."""
    return majority(labelled, "team").select(*TRACK, "team")
