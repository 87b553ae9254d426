"""Segmentation of play into actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def players_per_frame(frames: DataFrame, det: DataFrame, classes: DataFrame, class_id: int = 0) -> DataFrame:
    """Players in each analysed frame, 0 included; anywhere in the picture, by the voted class."""
    seen = det.join(classes.where(F.col("class_id") == class_id).select("clip_id", "tracker_id"), ["clip_id", "tracker_id"], "left_semi")
    n = seen.groupBy("clip_id", "frame_idx").agg(F.count("*").alias("nb"))
    return frames.join(n, ["clip_id", "frame_idx"], "left").select("clip_id", "frame_idx", F.coalesce("nb", F.lit(0)).alias("nb"))


def detect_actions(counts: DataFrame, fps: float, start: int = 6, end: int = 4, min_s: float = 3.0, pause_s: float = 3.0) -> DataFrame:
    """Actions of each clip: ``(action_idx, frame_debut, frame_fin, duree_s, nb_joueurs_moyen, equipe_en_attaque)``.

    An action opens at ``start`` players and lives while there are ``end`` or more; a
    low frame more than ``pause_s`` after the last such frame closes it there.  As
    ``end`` is at most ``start``, that is islands of present frames: a break stands
    before a present frame whose preceding analysed frame is low and too late.
    """
    if fps <= 0 or end > start:
        raise ValueError("fps must be positive and end at most start")
    order = Window.partitionBy("clip_id").orderBy("frame_idx")
    here = F.col("nb") >= end
    marked = counts.withColumn("present", here).withColumn("before", F.lag("frame_idx").over(order)).withColumn(
        "last", F.max(F.when(here, F.col("frame_idx"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    )
    late = F.col("present") & (F.col("before") > F.col("last")) & ((F.col("before") - F.col("last")) / F.lit(float(fps)) > pause_s)
    islands = marked.withColumn("island", F.sum(F.coalesce(late, F.lit(False)).cast("int")).over(order))
    spans = islands.where("present").groupBy("clip_id", "island").agg(
        F.min(F.when(F.col("nb") >= start, F.col("frame_idx"))).alias("frame_debut"), F.max("frame_idx").alias("frame_fin")
    )
    spans = spans.withColumn("duree_s", (F.col("frame_fin") - F.col("frame_debut")) / F.lit(float(fps))).where(F.col("duree_s") >= min_s)
    inside = islands.join(spans, ["clip_id", "island"]).where(F.col("frame_idx").between(F.col("frame_debut"), F.col("frame_fin")))
    mean = inside.groupBy("clip_id", "frame_debut", "frame_fin", "duree_s").agg(F.avg("nb").alias("nb_joueurs_moyen"))
    idx = F.row_number().over(Window.partitionBy("clip_id").orderBy("frame_debut")) - 1
    return mean.withColumn("action_idx", idx.cast("long")).withColumn("equipe_en_attaque", F.lit(None).cast("int"))


def clip_manifest(actions: DataFrame, fps: float, prefix: str = "action") -> DataFrame:
    """File name, start and length in seconds of each action's clip."""
    return actions.select(
        "clip_id", "action_idx", F.format_string(f"{prefix}_%03d_%.1fs.mp4", "action_idx", "duree_s").alias("fichier"),
        (F.col("frame_debut") / F.lit(float(fps))).alias("debut_s"), "duree_s",
    )
