"""Player statistics, defensive block and presence heatmaps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import COURT, Court
from .tracks import TRACK

MAX_SPEED = 12.0  # m/s; faster steps are taken for tracking errors


def player_stats(positions: DataFrame, fps: float, real_only: bool = True, max_speed: float | None = MAX_SPEED) -> DataFrame:
    """Distance, speeds, time, extent and centre of each track.

    Steps above ``max_speed`` count in the distance and the mean, not in the maximum;
    if all are above, the maximum is ``max_speed``.  Two rows of one frame are
    1 / ``fps`` apart.  A track without rows to count has a row of zeros.
    """
    if fps <= 0:
        raise ValueError("fps must be positive")
    used = positions.withColumn("used", ~F.col("interpole") if real_only else F.lit(True))
    order = Window.partitionBy(*TRACK, "used").orderBy("frame_idx", F.col("det_ord").asc_nulls_last())
    dx, dy = F.col("x_m") - F.lag("x_m").over(order), F.col("y_m") - F.lag("y_m").over(order)
    gap = (F.col("frame_idx") - F.lag("frame_idx").over(order)) / F.lit(float(fps))
    steps = used.withColumn("step", F.sqrt(dx * dx + dy * dy)).withColumn("speed", F.col("step") / F.when(gap > 0, gap).otherwise(F.lit(1.0 / fps)))
    on = F.col("used")
    counted = F.when(on, F.col("speed")) if max_speed is None else F.when(on & (F.col("speed") <= max_speed), F.col("speed"))
    one = lambda f, c: f(F.when(on, F.col(c)))
    agg = steps.groupBy(*TRACK).agg(
        F.coalesce(one(F.sum, "step"), F.lit(0.0)).alias("distance_parcourue_m"),
        F.max(counted).alias("top"),
        F.count(F.when(on, F.col("speed"))).alias("n_steps"),
        F.coalesce((one(F.max, "frame_idx") - one(F.min, "frame_idx")) / F.lit(float(fps)), F.lit(0.0)).alias("temps_total_s"),
        *(F.coalesce(one(f, c), F.lit(0.0)).alias(n) for f, c, n in (
            (F.min, "x_m", "x_min"), (F.max, "x_m", "x_max"), (F.min, "y_m", "y_min"), (F.max, "y_m", "y_max"), (F.avg, "x_m", "centroide_x"), (F.avg, "y_m", "centroide_y"))),
        F.count_if(on).alias("nb_frames_detectees"),
    )
    top = F.when(F.col("n_steps") > 0, F.coalesce(F.col("top"), F.lit(max_speed).cast("double"))).otherwise(F.lit(0.0))
    mean = F.when(F.col("temps_total_s") > 0, F.col("distance_parcourue_m") / F.col("temps_total_s")).otherwise(F.lit(0.0))
    return agg.select(
        *TRACK, "distance_parcourue_m", mean.alias("vitesse_moyenne_m_s"), top.alias("vitesse_max_m_s"), "temps_total_s",
        "x_min", "x_max", "y_min", "y_max", "centroide_x", "centroide_y", "nb_frames_detectees",
    )


def longest(stats: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` tracks that went furthest; ties by clip and track."""
    return stats.orderBy(F.desc("distance_parcourue_m"), *TRACK).limit(n)


def top_tracker(stats: DataFrame) -> DataFrame:
    """The track with the most real frames of each clip; of equal ones the smallest id."""
    best = F.max_by("tracker_id", F.struct("nb_frames_detectees", -F.col("tracker_id")))
    return stats.groupBy("clip_id").agg(best.alias("tracker_id"), F.max("nb_frames_detectees").alias("nb_frames_detectees"))


def block_width(positions: DataFrame, teams: DataFrame, team: int, fps: float, real_only: bool = True) -> DataFrame:
    """Width in y, mean x and number of a team's visible players in each frame that has any."""
    own = positions.join(teams.where(F.col("team") == team).select(*TRACK), TRACK, "left_semi")
    own = own.where(~F.col("interpole")) if real_only else own
    return own.groupBy("clip_id", "frame_idx").agg(
        (F.max("y_m") - F.min("y_m")).alias("largeur_y_m"), F.avg("x_m").alias("x_moyen"), F.count("*").alias("nb_defenseurs_visibles")
    ).withColumn("temps_s", F.col("frame_idx") / F.lit(float(fps)))


def heatmap(positions: DataFrame, resolution: float = 0.5, sigma: float | None = 1.0, court: Court = COURT, real_only: bool = True) -> DataFrame:
    """``(.., iy, ix, densite)``: each track's share of presence by cell, smoothed by a Gaussian of ``sigma`` cells.

    Points outside go to the border cells; mass that smoothing carries past the
    border is lost before the shares are taken.  Cells without presence have no row.
    """
    if resolution <= 0:
        raise ValueError("resolution must be positive")
    nx, ny = round(court.length_m / resolution), round(court.width_m / resolution)
    if nx <= 0 or ny <= 0:
        raise ValueError("the court has no cells")
    used = positions.where(~F.col("interpole")) if real_only else positions
    cell = lambda c, n: F.floor(F.greatest(F.lit(0.0), F.least(F.col(c) / F.lit(resolution), F.lit(float(n - 1))))).cast("int")
    grid = used.groupBy(*TRACK, cell("y_m", ny).alias("iy"), cell("x_m", nx).alias("ix")).agg(F.count("*").cast("double").alias("w"))
    if sigma:
        radius = int(4 * sigma + 0.5)
        raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
        kernel = F.array(*(F.struct(F.lit(k).alias("d"), F.lit(v / sum(raw)).alias("g")) for k, v in zip(range(-radius, radius + 1), raw, strict=True)))
        for axis, n in (("ix", nx), ("iy", ny)):
            other = "iy" if axis == "ix" else "ix"
            moved = grid.select(*TRACK, other, axis, "w", F.explode(kernel).alias("e")).select(*TRACK, other, (F.col(axis) + F.col("e.d")).alias(axis), (F.col("w") * F.col("e.g")).alias("w"))
            grid = moved.where(F.col(axis).between(0, n - 1)).groupBy(*TRACK, other, axis).agg(F.sum("w").alias("w"))
    total = F.sum("w").over(Window.partitionBy(*TRACK))
    return grid.select(*TRACK, "iy", "ix", (F.col("w") / total).alias("densite"))
