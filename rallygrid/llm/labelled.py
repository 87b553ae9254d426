"""Labelled rows for the classifiers, and isotonic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_remainder(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; the fold of a row."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def training_ids(labels: DataFrame, label: str, fold: tuple[int, int], rows: int, by_class: bool = False) -> DataFrame:
    """``(doc_id, y, half)`` of at most ``rows`` labelled rows outside the held-out fold.

    ``fold`` is (parts, held-out remainder).  Rows are taken in the order of a hash
    of the id, with ``by_class`` as many of either label.  ``half`` 0 fits, 1
    calibrates.  Null ids, null labels and ids with labels that disagree are left out.
    """
    clean = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(id_remainder("doc_id", fold[0]) != fold[1])
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("top"))
        .where("y = top").select("doc_id", "y", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))
    )
    order = F.xxhash64(F.col("doc_id"), F.lit("order"))
    if by_class:
        parts = [clean.where(F.col("y") == y).orderBy(order, "doc_id").limit(rows // 2) for y in (0, 1)]
        return parts[0].unionByName(parts[1])
    return clean.orderBy(order, "doc_id").limit(rows)


def isotonic(scores: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and the non-decreasing rate at each.

    Equal scores are pooled first.  Rates are drawn towards the overall rate by the
    weight of one row, so that they stay inside (0, 1).
    """
    weight = np.ones(len(y)) if weight is None else weight
    base = float((y * weight).sum() / weight.sum()) if len(y) else 0.0
    knots, inverse = np.unique(scores, return_inverse=True)
    w, s = np.bincount(inverse, weight, len(knots)), np.bincount(inverse, y * weight, len(knots))
    blocks: list[list[float]] = []  # weight, sum, first knot
    for k in range(len(knots)):
        blocks.append([w[k], s[k], k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1][0] += last[0]
            blocks[-1][1] += last[1]
    # one point per block at the middle of its scores; between the points the rate is interpolated
    firsts = [int(b[2]) for b in blocks] + [len(knots)]
    middle = np.array([knots[lo:hi].mean() for lo, hi in zip(firsts[:-1], firsts[1:], strict=True)])
    return middle, np.array([(b[1] + base) / (b[0] + 1.0) for b in blocks])


def calibrated(scores: np.ndarray, knots: np.ndarray, rates: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(scores, knots, np.maximum.accumulate(rates)), 0.0, 1.0) if len(knots) else np.zeros(len(scores))
