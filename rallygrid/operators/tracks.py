"""Votes, trajectories, gaps, resumed identities and tracking quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLASS_IDS, COURT, Court
from ..functions.scalar import class_key, feet, in_zone, project

TRACK = ["clip_id", "tracker_id"]


def majority(df: DataFrame, value: str, out: str | None = None) -> DataFrame:
    """The commonest ``value`` of each track; of equal counts the one seen first."""
    counted = df.groupBy(*TRACK, value).agg(F.count("*").alias("n"), F.min(F.struct("frame_idx", "det_ord")).alias("first"))
    best = F.max_by(value, F.struct("n", -F.col("first.frame_idx"), -F.col("first.det_ord")))
    return counted.groupBy(*TRACK).agg(best.alias(out or value))


def remap_classes(det: DataFrame, names: DataFrame, targets: dict[str, int] = CLASS_IDS) -> DataFrame:
    """Class ids of a model brought to the vocabulary's by name; unknown classes are dropped.

    ``names(class_id, name)`` has a row per class of the model, so it is small.  If no
    name is known, all detections pass as they are.
    """
    table = remap_table(names, targets)
    if not table.limit(1).count():
        return det
    return det.join(F.broadcast(table), "class_id").drop("class_id").withColumnRenamed("target_id", "class_id")


def remap_table(names: DataFrame, targets: dict[str, int] = CLASS_IDS) -> DataFrame:
    rows = names.sparkSession.createDataFrame([(name, i) for name, i in targets.items()], "target string, target_id int")
    return names.join(rows, class_key(F.col("name")) == class_key(F.col("target"))).select("class_id", "target_id")


def player_positions(det: DataFrame, classes: DataFrame, class_id: int = 0, court: Court | None = COURT) -> DataFrame:
    """Positions of the tracks whose voted class is ``class_id``, inside the court's zone."""
    kept = det.join(classes.where(F.col("class_id") == class_id).select(*TRACK), TRACK, "left_semi")
    if court:
        kept = kept.where(in_zone(F.col("x_m"), F.col("y_m"), court))
    return kept.select(*TRACK, "frame_idx", "det_ord", "x_m", "y_m", F.lit(False).alias("interpole"))


def located(boxes: DataFrame, h: list[float]) -> DataFrame:
    """``boxes(.., x1, y1, x2, y2)`` with ``x_m`` and ``y_m``: where their feet stand on the court, by the homography ``h``."""
    x, y = project(*feet(F.col("x1"), F.col("x2"), F.col("y2")), h)
    return boxes.withColumn("x_m", x).withColumn("y_m", y)


def drop_short_tracks(positions: DataFrame, min_frames: int) -> DataFrame:
    """Tracks with at least ``min_frames`` real positions, interpolated rows included; all if it is 1 or less."""
    if min_frames <= 1:
        return positions
    real = F.count_if(~F.col("interpole")).over(Window.partitionBy(*TRACK))
    return positions.withColumn("n_real", real).where(F.col("n_real") >= min_frames).drop("n_real")


def interpolate(positions: DataFrame, max_gap: int = 10) -> DataFrame:
    """Fill gaps of up to ``max_gap`` frames on straight lines; nothing is added at the ends."""
    order = Window.partitionBy(*TRACK).orderBy("frame_idx", "det_ord")
    ahead = positions.select(
        *TRACK, "frame_idx", "x_m", "y_m", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("frame_idx", "x_m", "y_m"))
    ).withColumn("gap", F.col("next_frame_idx") - F.col("frame_idx"))
    share = F.col("k").cast("double") / F.col("gap")
    steps = ahead.where(F.col("gap").between(2, max_gap)).withColumn("k", F.explode(F.expr("sequence(1L, gap - 1)")))
    added = steps.select(
        *TRACK, (F.col("frame_idx") + F.col("k")).alias("frame_idx"), F.lit(None).cast("long").alias("det_ord"),
        (F.col("x_m") + share * (F.col("next_x_m") - F.col("x_m"))).alias("x_m"), (F.col("y_m") + share * (F.col("next_y_m") - F.col("y_m"))).alias("y_m"),
        F.lit(True).alias("interpole"),
    )
    return positions.unionByName(added)


def track_bounds(positions: DataFrame) -> DataFrame:
    """First and last real position of each track, its real rows, and its order of appearance in the clip."""
    at = F.struct("frame_idx", "det_ord", "x_m", "y_m")
    b = positions.where(~F.col("interpole")).groupBy(*TRACK).agg(F.min(at).alias("a"), F.max(at).alias("z"), F.count("*").alias("n_real"))
    ord_ = F.row_number().over(Window.partitionBy("clip_id").orderBy("a.frame_idx", "a.det_ord"))
    return b.select(
        *TRACK, "n_real", ord_.cast("long").alias("track_ord"), F.col("a.frame_idx").alias("first_frame"), F.col("a.x_m").alias("first_x"),
        F.col("a.y_m").alias("first_y"), F.col("z.frame_idx").alias("last_frame"), F.col("z.x_m").alias("last_x"), F.col("z.y_m").alias("last_y"),
    )


def resume_candidates(bounds: DataFrame, max_m: float = 3.0, max_frames: int = 30) -> DataFrame:
    """Pairs of a track's end and a later track's start within ``max_m`` and ``max_frames``.

    Ends meet starts on clip and a bucket of ``max_frames``, so the join is on equal keys.
    """
    ends = bounds.select("clip_id", F.col("tracker_id").alias("a"), F.col("track_ord").alias("ord_a"), "last_frame", "last_x", "last_y")
    ends = ends.withColumn("bucket", F.explode(F.array(*(F.floor(F.col("last_frame") / max_frames) + k for k in (0, 1)))))
    starts = bounds.select("clip_id", F.col("tracker_id").alias("b"), F.col("track_ord").alias("ord_b"), "first_frame", "first_x", "first_y")
    starts = starts.withColumn("bucket", F.floor(F.col("first_frame") / max_frames))
    dx, dy = F.col("first_x") - F.col("last_x"), F.col("first_y") - F.col("last_y")
    pairs = ends.join(starts, ["clip_id", "bucket"]).withColumn("gap", F.col("first_frame") - F.col("last_frame")).withColumn("dist_m", F.sqrt(dx * dx + dy * dy))
    near = F.col("gap").between(1, max_frames) & (F.col("dist_m") <= max_m) & (F.col("a") != F.col("b"))
    return pairs.where(near).select("clip_id", "a", "b", "ord_a", "ord_b", "last_frame", "gap", "dist_m")


def resume_pairs(candidates: DataFrame) -> DataFrame:
    """Greedy matching: ends in order of their frame, each takes the nearest start that is still free.

    One fold a clip over its ends; a clip's tracks are few.
    """
    per_end = candidates.groupBy("clip_id", "a").agg(
        F.min(F.struct("last_frame", "ord_a")).alias("at"), F.array_sort(F.collect_list(F.struct("dist_m", "ord_b", "b"))).alias("starts")
    )
    per_clip = per_end.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("at", "a", "starts"))).alias("ends"))
    fold = """aggregate(ends, cast(array() as array<struct<a:bigint,b:bigint>>), (done, e) -> concat(done,
        transform(slice(filter(e.starts, s -> not exists(done, d -> d.b = s.b)), 1, 1), s -> named_struct('a', e.a, 'b', s.b))))"""
    return per_clip.select("clip_id", F.explode(F.expr(fold)).alias("p")).select("clip_id", "p.a", "p.b")


def player_estimate(positions: DataFrame, pairs: DataFrame, paths: bool = False) -> DataFrame:
    """Tracks, pairs given, and players: the components that the pairs make of a clip's tracks.

    Pairs may repeat, run both ways, close circles or name tracks that don't exist,
    which join nothing.  Those of ``resume_pairs`` make paths (``paths``), so there
    each joins two tracks into one player and no components need be found; else one
    task joins a clip's pairs, which are few.
    """
    if not paths:
        kinds = dict(positions.dtypes)
        ids = positions.select(*TRACK).distinct()
        return ids.groupBy("clip_id").cogroup(pairs.select("clip_id", "a", "b").groupBy("clip_id")).applyInPandas(
            _players, f"clip_id {kinds['clip_id']}, nb_tracks long, nb_reprises long, nb_joueurs long"
        )
    n = positions.groupBy("clip_id").agg(F.count_distinct("tracker_id").alias("nb_tracks"))
    r = pairs.groupBy("clip_id").agg(F.count("*").alias("nb_reprises"))
    return n.join(r, "clip_id", "left").select(
        "clip_id", "nb_tracks", F.coalesce("nb_reprises", F.lit(0)).alias("nb_reprises"), (F.col("nb_tracks") - F.coalesce("nb_reprises", F.lit(0))).alias("nb_joueurs")
    )


def _players(ids: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    group = {t: t for t in ids["tracker_id"].tolist()}

    def head(t):
        while group[t] != t:
            t = group[t]
        return t

    for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True):
        if a in group and b in group:
            lo, hi = sorted((head(a), head(b)))
            group[hi] = lo
    players = sum(t == up for t, up in group.items())
    rows = [(ids["clip_id"].iloc[0], len(ids), len(pairs), players)] if len(ids) else []
    return pd.DataFrame(rows, columns=["clip_id", "nb_tracks", "nb_reprises", "nb_joueurs"])


def tracking_quality(positions: DataFrame, max_m: float = 3.0, max_frames: int = 30) -> DataFrame:
    """Tracks, resumed identities, estimated players and mean real length of each clip."""
    bounds = track_bounds(positions)
    estimate = player_estimate(positions, resume_pairs(resume_candidates(bounds, max_m, max_frames)), paths=True)
    mean = bounds.groupBy("clip_id").agg(F.avg("n_real").alias("longueur_moyenne"))
    return estimate.join(mean, "clip_id", "left").withColumn("longueur_moyenne", F.coalesce("longueur_moyenne", F.lit(0.0)))
