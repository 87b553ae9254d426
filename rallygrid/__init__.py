"""Analysis of indoor court sports on Spark."""

from .config import CLASS_IDS, CLASS_NAMES, COURT, Court, Detector
from .operators.homography import Homography, calibrate
from .plans.match import MatchAnalysis, analyse, analyse_boxes, metadata_dicts, write

__all__ = ["CLASS_IDS", "CLASS_NAMES", "COURT", "Court", "Detector", "Homography", "MatchAnalysis", "analyse", "analyse_boxes", "calibrate", "metadata_dicts", "write"]
