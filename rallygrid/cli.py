"""``python -m rallygrid.cli analyse``: tables of detections in, results out."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import tracking
from .operators.actions import clip_manifest
from .operators.homography import calibrate
from .plans import match
from .sources.correspondences import load_correspondences


def main(argv: list[str] | None = None) -> int:
    """0: done, 1: the analysis failed, 2: bad arguments."""
    parser = argparse.ArgumentParser(prog="rallygrid")
    analyse = parser.add_subparsers(dest="command", required=True).add_parser("analyse")
    for name in ("--detections", "--frames", "--output"):
        analyse.add_argument(name, required=True)
    analyse.add_argument("--teams", help="table of teams; needed without --homographie")
    analyse.add_argument("--torsos", help="table of torso colours, from which teams are found")
    analyse.add_argument("--homographie", help="JSON of correspondences; the detections are then boxes, which are tracked and projected")
    analyse.add_argument("--tracker", choices=sorted(tracking.BACKENDS), default="bytetrack")
    analyse.add_argument("--no-decoupage", action="store_true", help="without the clip manifest")
    analyse.add_argument("--fps", type=float, required=True)
    analyse.add_argument("--subsample", type=int, default=2)
    analyse.add_argument("--min-frames-track", type=int, default=0)
    args = parser.parse_args(argv)
    if args.fps <= 0 or args.subsample < 1 or not (args.homographie or args.teams):
        return 2
    try:
        spark = SparkSession.builder.getOrCreate()
        read = spark.read.parquet
        det, frames, teams = read(args.detections), read(args.frames), read(args.teams) if args.teams else None
        if args.homographie:
            placed, torsos = calibrate(load_correspondences(spark, args.homographie)), read(args.torsos) if args.torsos else None
            done = match.analyse_boxes(det, frames, args.fps, placed, teams, torsos, None, args.tracker, args.subsample, args.min_frames_track)
        else:
            done = match.analyse(det, frames, teams, args.fps, args.subsample, args.min_frames_track)
        match.write(done, args.output)
        if not args.no_decoupage:
            clip_manifest(done.actions, args.fps).write.mode("overwrite").parquet(f"{args.output}/clips.parquet")
        logging.info("%s clips", done.metadata.agg(F.count("*")).first()[0])
    except Exception:
        logging.exception("the analysis failed")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
