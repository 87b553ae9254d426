"""Render plans: what to draw, without drawing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AWAY, HOME, KEEPER, OTHER, REFEREE
from ..functions.scalar import radar_pixel
from .tracks import TRACK


def _bgr(c: tuple[int, int, int]) -> Column:
    return F.struct(*(F.lit(v).alias(n) for v, n in zip(c, "bgr", strict=True)))


def role_colour(class_id: Column, team: Column, home: Column) -> Column:
    player = F.when(team == home, _bgr(HOME)).otherwise(_bgr(AWAY))
    return F.when(class_id == 1, _bgr(KEEPER)).when(class_id == 2, _bgr(REFEREE)).when(class_id == 0, player).otherwise(_bgr(OTHER))


def tracker_colours(tracks: DataFrame, classes: DataFrame, teams: DataFrame, home: int = 0) -> DataFrame:
    """Colour of each track from its class and team; players without a team count as away."""
    named = tracks.join(classes, TRACK, "left").join(teams, TRACK, "left")
    return named.select(*TRACK, role_colour(F.col("class_id"), F.col("team"), F.lit(home)).alias("c")).select(*TRACK, "c.b", "c.g", "c.r")


def radar_plan(positions: DataFrame, colours: DataFrame) -> DataFrame:
    """A disc and a label for each position, in radar pixels."""
    cx, cy = radar_pixel(F.col("x_m"), F.col("y_m"))
    drawn = positions.select(*TRACK, "frame_idx", cx.alias("cx"), cy.alias("cy"))
    return drawn.withColumns({"label_x": F.col("cx") + 11, "label_y": F.col("cy") + 4}).join(colours, TRACK, "left")


def box_plan(boxes: DataFrame, sx: float, sy: float) -> DataFrame:
    """Boxes scaled to the output, cut to integers; labels stand five pixels above, not below 0."""
    s = lambda c, f: (F.col(c) * F.lit(f)).cast("int")
    out = boxes.select(*TRACK, "frame_idx", s("x1", sx).alias("x1"), s("y1", sy).alias("y1"), s("x2", sx).alias("x2"), s("y2", sy).alias("y2"))
    return out.withColumn("label_y", F.greatest(F.lit(0), F.col("y1") - 5))
