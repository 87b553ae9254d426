"""Players in the picture, from a stream of tracked detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def players_per_second(det: DataFrame, time_col: str = "ts", late: str = "10 seconds", window: str = "1 second") -> DataFrame:
    """Distinct players of each clip and time window; rows later than ``late`` are left out.

    Works on a stream, where a window is final once the watermark has passed it, and
    on a table.
    """
    return (
        det.where(F.col("class_id") == 0).withWatermark(time_col, late).groupBy("clip_id", F.window(time_col, window).alias("w"))
        .agg(F.approx_count_distinct("tracker_id").alias("nb")).select("clip_id", F.col("w.start").alias("debut"), "nb")
    )
