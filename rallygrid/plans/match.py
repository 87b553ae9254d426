"""The whole analysis of tracked matches as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COURT, Court, Detector
from ..operators import actions, render, stats, tracking, tracks
from ..operators.homography import Homography
from ..operators.teams import track_teams, two_colours
from ..sources.detections import detector_filter


@dataclass(frozen=True)
class MatchAnalysis:
    positions: DataFrame
    quality: DataFrame
    stats: DataFrame
    block_width: DataFrame
    filled: DataFrame
    actions: DataFrame
    metadata: DataFrame
    colours: DataFrame


def analyse(
    det: DataFrame, frames: DataFrame, teams: DataFrame, fps: float, subsample: int = 1, min_frames: int = 0, home: int = 0, court: Court = COURT,
    tracker: str | None = None, homography: Homography | None = None, clips: DataFrame | None = None,
) -> MatchAnalysis:
    """Votes, positions, quality, statistics, gaps and actions of all clips.

    Quality is judged before short tracks go, statistics after; gaps are filled for
    rendering only; actions count all tracked players of the picture.  Only the
    metadata take ``tracker``, ``homography`` and ``clips(clip_id, nb_frames)``, the
    source's frame counts; what isn't given is null there.
    """
    max_gap = max(2, subsample * 5)
    classes = tracks.majority(det, "class_id")
    positions = tracks.player_positions(det, classes, court=court)
    quality = tracks.tracking_quality(positions)
    kept = tracks.drop_short_tracks(positions, min_frames)
    player = stats.player_stats(kept, fps)
    width = [stats.block_width(kept, teams, t, fps).withColumn("equipe", F.lit("MHB" if t == home else "ADV")) for t in (home, 1 - home)]
    found = actions.detect_actions(actions.players_per_frame(frames, det, classes), fps)
    meta = (
        quality.join(positions.groupBy("clip_id").agg(F.count_distinct("tracker_id").alias("nb_joueurs_avant_filtre")), "clip_id", "left")
        .join(player.groupBy("clip_id").agg(F.count("*").alias("nb_joueurs_stats")), "clip_id", "left")
        .join(found.groupBy("clip_id").agg(F.count("*").alias("nb_actions_detectees")), "clip_id", "left")
        .join(classes.groupBy("clip_id").agg(F.count("*").alias("nb_trackers_total")), "clip_id", "right")
        .join(teams.where(F.col("team").isNotNull()).groupBy("clip_id").agg(F.count_distinct("tracker_id").alias("nb_joueurs_classes")), "clip_id", "left")
        .join(frames.select("clip_id", "frame_idx").distinct().groupBy("clip_id").agg(F.count("*").alias("nb_frames_analysees")), "clip_id", "left")
        .na.fill(0)
    )
    if clips is None:
        meta = meta.withColumn("nb_frames_total", F.lit(None).cast("long"))
    else:
        meta = meta.join(clips.select("clip_id", F.col("nb_frames").cast("long").alias("nb_frames_total")), "clip_id", "left")
    given = {
        "fps": (float(fps), "double"), "subsample": (subsample, "int"), "max_gap_interpolation": (max_gap, "int"),
        "homographie_methode": (homography and homography.method, "string"), "homographie_nb_points": (homography and homography.n_points, "int"),
        "cluster_mhb": (home, "int"), "tracker": (tracker, "string"), "min_frames_track": (min_frames, "int"),
    }
    meta = meta.withColumns({name: F.lit(value).cast(kind) for name, (value, kind) in given.items()})
    colours = render.tracker_colours(classes.select(*tracks.TRACK), classes, teams, home)
    return MatchAnalysis(positions, quality, player, width[0].unionByName(width[1]), tracks.interpolate(kept, max_gap), found, meta, colours)


def analyse_boxes(
    boxes: DataFrame, frames: DataFrame, fps: float, homography: Homography, teams: DataFrame | None = None, torsos: DataFrame | None = None,
    names: DataFrame | None = None, tracker: str = "bytetrack", subsample: int = 1, min_frames: int = 0, home: int = 0, court: Court = COURT,
    clips: DataFrame | None = None, detector: Detector | None = None,
) -> MatchAnalysis:
    """From a detector's boxes to the whole analysis: filter, track, place on the court, find teams, analyse.

    ``boxes(clip_id, frame_idx, det_ord, x1, y1, x2, y2, confidence, class_id[, embedding])``
    have pixels of the picture that ``homography`` was calibrated on.  ``names(class_id,
    name)`` are the detector's classes, where they aren't the vocabulary's.  Teams come
    from ``teams(clip_id, tracker_id, team)`` or, of players, from the colours in
    ``torsos(clip_id, frame_idx, det_ord, b, g, r)``; without either no track has one.
    """
    kept = detector_filter(boxes, detector) if detector else boxes
    if names is not None:
        kept = tracks.remap_classes(kept, names)
    told = tracking.track_with(kept, tracker, fps, subsample).drop("class_id")
    det = tracks.located(kept, homography.h).join(told, ["clip_id", "frame_idx", "det_ord"])
    if teams is None and torsos is not None:
        players = tracks.majority(det, "class_id").where(F.col("class_id") == 0).select(*tracks.TRACK)
        looks = torsos.join(det.select("clip_id", "frame_idx", "det_ord", "tracker_id").join(players, tracks.TRACK, "left_semi"), ["clip_id", "frame_idx", "det_ord"])
        teams = track_teams(two_colours(looks))
    if teams is None:
        teams = det.select(*tracks.TRACK, F.lit(None).cast("int").alias("team")).limit(0)
    return analyse(det, frames, teams, fps, subsample, min_frames, home, court, tracker, homography, clips)


def detection_seconds(frames: int, subsample: int = 1, per_second: float = 25.0) -> float:
    """How long a detector of so many pictures a second takes for every ``subsample``-th frame."""
    return frames / max(subsample, 1) / per_second


def metadata_dicts(analysis: MatchAnalysis) -> dict:
    """The metadata of each clip by its id; a clip is a row, so they are few.

    The mean length is rounded to one decimal as Python rounds, to the nearest
    number that prints so, which no rounding of Spark's does for all ties.
    """
    out = {}
    for row in analysis.metadata.collect():
        found = row.asDict()
        for old, new in (("nb_reprises", "nb_reprises_id"), ("nb_joueurs", "nb_joueurs_estimes"), ("longueur_moyenne", "longueur_track_moyenne")):
            found[new] = found.pop(old)
        found["longueur_track_moyenne"] = round(found["longueur_track_moyenne"], 1)
        out[found.pop("clip_id")] = found
    return out


def read_block_width(spark: SparkSession, folder: str) -> DataFrame:
    """What ``write`` wrote as CSV of the block's width, of both teams."""
    schema = "clip_id long, frame_idx long, largeur_y_m double, x_moyen double, nb_defenseurs_visibles long, temps_s double, equipe string"
    return spark.read.schema(schema).csv(f"{folder}/largeur_bloc.csv", header=True)


def write(analysis: MatchAnalysis, folder: str) -> None:
    """Statistics as Parquet and CSV, block width by team as CSV, the rest as Parquet."""
    analysis.stats.write.mode("overwrite").parquet(f"{folder}/stats_joueurs.parquet")
    analysis.stats.write.mode("overwrite").csv(f"{folder}/stats_joueurs.csv", header=True)
    analysis.block_width.write.mode("overwrite").partitionBy("equipe").csv(f"{folder}/largeur_bloc.csv", header=True)
    for name in ("quality", "filled", "actions", "metadata", "colours"):
        getattr(analysis, name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
