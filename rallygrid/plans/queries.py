"""Queries over the derived detection table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Detector
from ..functions.scalar import class_key, feet, in_zone, project, rounded
from ..operators import actions, render, stats, teams, tracking, tracks
from ..sources import correspondences, detections
from . import match

FPS = 5.0
#: Thresholds that give several actions a clip in the derived table: start, end, least seconds, pause.
ACTIONS = (8, 7, 1.0, 0.7)
H = [0.04, 0.002, -1.5, -0.001, 0.05, 0.25, 0.0001, 0.0002, 1.0]
NAMES = [(0, "Ball"), (1, " goalkeepers "), (2, "PLAYER"), (3, "referee"), (4, "crowd")]
JSON = '{"_comment": "x", "A": {"pixel": [100.9, 200], "terrain_m": [0, 0]}, "B": {"pixel": [1000, 100], "terrain_m": [40, 20.5]}}'


class Base:
    """The tables that most queries begin with."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.det = detections.detections_from_events(spark, sf_dir)

    @property
    def classes(self) -> DataFrame:
        return tracks.majority(self.det, "class_id")

    @property
    def positions(self) -> DataFrame:
        return tracks.player_positions(self.det, self.classes)

    @property
    def teams(self) -> DataFrame:
        return self.det.select(*tracks.TRACK, (F.col("tracker_id") % 2).cast("int").alias("team")).distinct()

    @property
    def counts(self) -> DataFrame:
        return actions.players_per_frame(detections.frames_of(self.det), self.det, self.classes)

    @property
    def boxes(self) -> DataFrame:
        """Boxes and confidences made from the positions, for queries on pixels."""
        x, y = F.col("x_m") * 20 + 50, F.col("y_m") * 20 + 60
        f = lambda c: c.cast("float")
        return self.det.withColumns({"x1": f(x - 10), "y1": f(y - 60), "x2": f(x + 10), "y2": f(y), "confidence": F.col("k") / F.lit(1e2)})


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c)) for c in cols})


STATS = ["distance_parcourue_m", "vitesse_moyenne_m_s", "vitesse_max_m_s", "temps_total_s", "x_min", "x_max", "y_min", "y_max", "centroide_x", "centroide_y"]


def _stats(df: DataFrame, **options) -> DataFrame:
    return _round(stats.player_stats(df, FPS, **options), *STATS)


def _resumes(b: Base) -> DataFrame:
    return tracks.resume_candidates(tracks.track_bounds(b.positions))


def _actions(b: Base) -> DataFrame:
    start, end, least, pause = ACTIONS
    return actions.detect_actions(b.counts, FPS, start, end, least, pause)


def _widths(b: Base) -> DataFrame:
    both = [_round(stats.block_width(b.positions, b.teams, t, FPS), "largeur_y_m", "x_moyen", "temps_s").withColumn("equipe", F.lit(n)) for t, n in ((0, "MHB"), (1, "ADV"))]
    return both[0].unionByName(both[1])


def _project(b: Base) -> DataFrame:
    px, py = feet(F.col("x1"), F.col("x2"), F.col("y2"))
    x, y = project(px, py, H)
    return _round(b.boxes.select("clip_id", "det_ord", px.cast("double").alias("px"), py.cast("double").alias("py"), x.alias("x"), y.alias("y")), "px", "py", "x", "y")


def _positions(b: Base) -> DataFrame:
    """From boxes to positions: feet, homography, voted class, zone."""
    return _round(tracks.player_positions(tracks.located(b.boxes.drop("x_m", "y_m"), H), b.classes).drop("interpole"), "x_m", "y_m")


def _names(spark: SparkSession, rows=NAMES) -> DataFrame:
    return spark.createDataFrame(rows, "class_id int, name string")


def _bytetrack(b: Base, backend: str) -> DataFrame:
    return tracking.track_with(b.boxes, backend, FPS)


def _looks(b: Base) -> DataFrame:
    """The boxes with an embedding made from the slot, the same in all its segments, and some noise."""
    slot = F.expr("tracker_id DIV 4")
    parts = [F.cos(slot * (n + 1)) + ((F.col("k") * (n + 3)) % 7) / F.lit(7e1) for n in range(8)]
    return b.boxes.withColumn("embedding", F.array(*(p.cast("float") for p in parts)))


def _botsort(b: Base) -> DataFrame:
    return tracking.track_with(_looks(b), "botsort", FPS)


def _kmeans(b: Base) -> DataFrame:
    return teams.track_teams(teams.two_colours(_coloured(b)))


def _coloured(b: Base) -> DataFrame:
    shade = (F.col("tracker_id") % 2) * 100 + F.col("k") % 30
    return b.det.select("clip_id", "tracker_id", "frame_idx", "det_ord", *((shade + n).cast("double").alias(c) for n, c in enumerate("bgr")))


def _torso(b: Base) -> DataFrame:
    grid = b.det.withColumn("p", F.explode(F.expr("sequence(0L, 199L)")))
    x, y = F.col("p") % 10, F.expr("p DIV 10")
    return teams.torso_colour(
        grid.select("clip_id", "frame_idx", "det_ord", x.alias("x"), y.alias("y"), *(((F.col("p") * (n + 3) + F.col("det_ord")) % 251).cast("double").alias(c) for n, c in enumerate("bgr")),
                    *(F.lit(v).alias(c) for v, c in ((0, "x1"), (0, "y1"), (10, "x2"), (20, "y2"))))
    )


def _top_heatmap(b: Base) -> DataFrame:
    top = stats.top_tracker(stats.player_stats(b.positions, FPS))
    return _round(stats.heatmap(b.positions.join(top, tracks.TRACK, "left_semi"), sigma=1.5), "densite")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plans: dict[str, Callable[[Base, SparkSession], DataFrame]] = {
        "subsample_frames": lambda b, s: detections.batches(detections.sample_frames(detections.frames_of(b.det), 4, 300)),
        "class_name_normalize": lambda b, s: _names(s).select("class_id", class_key(F.col("name")).alias("cle")),
        "class_remap": lambda b, s: tracks.remap_classes(b.det, _names(s)).select("clip_id", "det_ord", "class_id"),
        "class_remap_empty_passthrough": lambda b, s: tracks.remap_classes(b.det, _names(s, [(0, "person"), (2, "car")])).select("clip_id", "det_ord", "class_id"),
        "confidence_class_filter": lambda b, s: detections.detector_filter(b.boxes, Detector()).select("clip_id", "det_ord", "class_id"),
        "class_vote": lambda b, s: b.classes,
        "player_filter": lambda b, s: tracks.player_positions(b.det, b.classes, court=None).drop("interpole"),
        "zone_filter": lambda b, s: b.det.where(in_zone(F.col("x_m"), F.col("y_m"))).select("clip_id", "det_ord", "x_m", "y_m"),
        "project_feet": lambda b, s: _project(b),
        "project_positions": lambda b, s: _positions(b),
        "detection_nms": lambda b, s: detections.suppress(b.boxes, 0.3).select("clip_id", "det_ord", "class_id"),
        "short_track_filter": lambda b, s: tracks.drop_short_tracks(b.positions, 10).drop("interpole"),
        "interpolate_gaps": lambda b, s: tracks.interpolate(b.positions).select(*tracks.TRACK, "frame_idx", "x_m", "y_m", "interpole"),
        "player_stats": lambda b, s: _stats(b.positions),
        "player_stats_uncapped": lambda b, s: _stats(b.positions, max_speed=None),
        "player_stats_with_interpolated": lambda b, s: _stats(tracks.interpolate(b.positions), real_only=False),
        "defensive_block_width": lambda b, s: _round(stats.block_width(b.positions, b.teams, 0, FPS), "largeur_y_m", "x_moyen", "temps_s"),
        "block_width_union": lambda b, s: _widths(b),
        "players_per_frame": lambda b, s: b.counts,
        "actions": lambda b, s: _round(_actions(b), "duree_s", "nb_joueurs_moyen"),
        "clip_manifest": lambda b, s: _round(actions.clip_manifest(_actions(b), FPS), "debut_s", "duree_s"),
        "track_bounds": lambda b, s: tracks.track_bounds(b.positions),
        "id_resume_candidates": lambda b, s: _round(_resumes(b).select("clip_id", "a", "b", "gap", "dist_m"), "dist_m"),
        "id_resume_pairs": lambda b, s: tracks.resume_pairs(_resumes(b)),
        "player_count_estimate": lambda b, s: tracks.player_estimate(b.positions, tracks.resume_pairs(_resumes(b)), paths=True),
        "tracking_quality": lambda b, s: _round(tracks.tracking_quality(b.positions), "longueur_moyenne"),
        "heatmap_raw": lambda b, s: _round(stats.heatmap(b.positions, sigma=None), "densite"),
        "heatmap_smoothed": lambda b, s: _round(stats.heatmap(b.positions, resolution=1.0), "densite"),
        "top_tracker": lambda b, s: stats.top_tracker(stats.player_stats(b.positions, FPS)),
        "top_tracker_heatmap": lambda b, s: _top_heatmap(b),
        "tracker_color": lambda b, s: render.tracker_colours(b.classes.select(*tracks.TRACK), b.classes, b.teams),
        "radar_plan": lambda b, s: render.radar_plan(b.positions, render.tracker_colours(b.classes.select(*tracks.TRACK), b.classes, b.teams)),
        "box_render_plan": lambda b, s: render.box_plan(b.boxes, 0.75, 0.5),
        "frame_semi_join": lambda b, s: detections.fetch_frames(detections.frames_of(b.det), b.det.where(F.col("k") < 5).select("clip_id", "frame_idx")),
        "team_vote": lambda b, s: tracks.majority(b.det.withColumn("team", (F.col("k") % 2).cast("int")), "team"),
        "correspondences_json": lambda b, s: correspondences.parse_correspondences(s.createDataFrame([(1, JSON)], "clip_id int, json string")),
        "team_kmeans": lambda b, s: _kmeans(b),
        "torso_median": lambda b, s: _torso(b),
        "bytetrack": lambda b, s: _bytetrack(b, "bytetrack"),
        "run_metadata": lambda b, s: _round(match.analyse(b.det, detections.frames_of(b.det), b.teams, FPS).metadata, "longueur_moyenne"),
        "botsort": lambda b, s: _botsort(b),
    }
    return {name: (lambda spark, sf_dir, plan=plan: plan(Base(spark, sf_dir), spark)) for name, plan in plans.items()}
