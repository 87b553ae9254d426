"""Detection tables, sampled and filtered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Detector


def detections_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection table derived from ``events``: 200 analysed frames a clip, 40 slots, four tracks each.

    It stands in for a detector's output, of which the test data have none.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    b = e.select(
        "event_id", F.expr("event_id DIV 2000").alias("clip_id"), F.expr("((event_id % 2000) DIV 10) * 2").alias("frame_idx"),
        (F.col("user_id") % 40).alias("slot"), F.expr("(event_id % 2000) DIV 500").alias("seg"), "event_type", k.alias("k"),
        F.round(F.col("value") * F.lit(1e2)).cast("long").alias("c"),
    )
    first = b.groupBy("clip_id", "slot", "seg", "frame_idx").agg(F.min(F.struct("event_id", "event_type", "k", "c")).alias("r"))
    slot, k, c = F.col("slot"), F.col("r.k"), F.col("r.c")
    label = F.when(slot % 10 == 8, 1).when(slot % 10 == 9, 2).when((F.col("r.event_type") == "error") & (k < 50), 3).otherwise(0)
    x = ((slot * 7) % 40 + F.when(k >= 95, 15).otherwise(0)).cast("double") + (c % 300) / F.lit(1e2)
    y = ((slot * 3) % 20).cast("double") + k / F.lit(5e1)
    return first.select(
        "clip_id", "frame_idx", F.col("r.event_id").alias("det_ord"), (slot * 4 + F.col("seg")).alias("tracker_id"),
        label.cast("int").alias("class_id"), x.alias("x_m"), y.alias("y_m"), k.alias("k"),
    )


def frames_of(det: DataFrame) -> DataFrame:
    """All analysed frames of each clip, with or without detections."""
    return det.select("clip_id", "frame_idx").distinct()


def sample_frames(frames: DataFrame, subsample: int = 1, max_frames: int | None = None) -> DataFrame:
    """Every ``subsample``-th source frame below ``max_frames``."""
    if subsample < 1:
        raise ValueError("subsample must be 1 or more")
    kept = frames.where(F.col("frame_idx") % subsample == 0)
    return kept if max_frames is None else kept.where(F.col("frame_idx") < max_frames)


def batches(frames: DataFrame, batch_size: int = 8) -> DataFrame:
    """How many detector batches the frames of each clip make: full ones and a remainder."""
    if batch_size < 1:
        raise ValueError("batch_size must be 1 or more")
    return frames.groupBy("clip_id").agg(F.count("*").alias("n_frames")).withColumn("n_batches", F.ceil(F.col("n_frames") / F.lit(batch_size)))


def fetch_frames(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """The frames whose index is wanted; indices without a frame are left out."""
    return frames.join(wanted.distinct(), ["clip_id", "frame_idx"], "left_semi")


def detector_filter(det: DataFrame, detector: Detector = Detector()) -> DataFrame:
    kept = det.where(F.col("confidence") >= detector.confidence)
    return kept if detector.classes is None else kept.where(F.col("class_id").isin(*detector.classes))


def suppress(det: DataFrame, most: float = Detector().iou) -> DataFrame:
    """Of boxes of one frame and class that overlap by more than ``most``, the more confident ones.

    The greedy rule of detectors: in falling order of confidence, of equal ones by
    ``det_ord``, a box stays if none that stayed before overlaps it by more than
    ``most`` of their union.  One fold a frame and class, over what stayed so far.
    """
    at = ["clip_id", "frame_idx", "class_id"]
    row = F.struct(-F.col("confidence").alias("order"), "det_ord", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    kinds = dict(det.dtypes)
    item = f"struct<det_ord:{kinds['det_ord']},x1:double,y1:double,x2:double,y2:double>"
    fold = f"""aggregate(boxes, cast(array() as array<{item}>), (done, d) -> if(
        exists(done, e -> greatest(least(d.x2, e.x2) - greatest(d.x1, e.x1), 0D) * greatest(least(d.y2, e.y2) - greatest(d.y1, e.y1), 0D)
          > {float(most)!r}D * ((d.x2 - d.x1) * (d.y2 - d.y1) + (e.x2 - e.x1) * (e.y2 - e.y1)
            - greatest(least(d.x2, e.x2) - greatest(d.x1, e.x1), 0D) * greatest(least(d.y2, e.y2) - greatest(d.y1, e.y1), 0D))),
        done, concat(done, array(cast(named_struct('det_ord', d.det_ord, 'x1', d.x1, 'y1', d.y1, 'x2', d.x2, 'y2', d.y2) as {item})))))"""
    kept = det.groupBy(*at).agg(F.array_sort(F.collect_list(row)).alias("boxes")).select(*at, F.explode(F.expr(fold)).alias("kept"))
    return det.join(kept.select(*at, F.col("kept.det_ord").alias("det_ord")), [*at, "det_ord"], "left_semi")


def check_clips(clips: DataFrame) -> DataFrame:
    """``clips(clip_id, fps, nb_frames)``; a clip without a frame rate or frames is an error when it is read."""
    bad = F.coalesce(F.col("fps") <= 0, F.lit(True)) | F.coalesce(F.col("nb_frames") <= 0, F.lit(True))
    return clips.withColumn("fps", F.when(bad, F.raise_error(F.concat(F.lit("unreadable clip "), F.col("clip_id").cast("string"))).cast("double")).otherwise(F.col("fps")))


def from_centres(det: DataFrame) -> DataFrame:
    """Boxes given by centre and size as corner boxes."""
    w, h = F.col("w") / F.lit(2), F.col("h") / F.lit(2)
    return det.select("*", (F.col("cx") - w).alias("x1"), (F.col("cy") - h).alias("y1"), (F.col("cx") + w).alias("x2"), (F.col("cy") + h).alias("y2")).drop("cx", "cy", "w", "h")
