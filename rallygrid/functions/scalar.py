"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CLASS_NAMES, COURT, Court


def rounded(c: Column) -> Column:
    """Six decimals, ties up: the same in every engine that has floor."""
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def class_key(name: Column) -> Column:
    """A class name without case, separators at its ends and one plural s."""
    plain = F.trim(F.translate(F.lower(F.trim(name)), "_-", "  "))
    return F.regexp_replace(plain, "^(.+)s$", "$1")


def class_name(class_id: Column) -> Column:
    """The vocabulary's name of a class id; null for others."""
    return F.create_map(*(F.lit(v) for pair in CLASS_NAMES.items() for v in pair))[class_id]


def in_zone(x: Column, y: Column, court: Court = COURT) -> Column:
    return x.between(court.margin_x_m, court.length_m - court.margin_x_m) & y.between(court.margin_y_m, court.width_m - court.margin_y_m)


def feet(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The bottom centre of a box, in single precision."""
    return ((x1.cast("float") + x2.cast("float")) / F.lit(2).cast("float")).cast("float"), y2.cast("float")


def project(x: Column, y: Column, h: list[float]) -> tuple[Column, Column]:
    """A point through a row-major 3x3 homography; 0 where the scale is 0."""
    x, y = x.cast("double"), y.cast("double")
    row = [F.lit(float(h[k])) * x + F.lit(float(h[k + 1])) * y + F.lit(float(h[k + 2])) for k in (0, 3, 6)]
    return tuple(F.coalesce(F.try_divide(r, row[2]), F.lit(0.0)).cast("float").cast("double") for r in row[:2])


def radar_pixel(x: Column, y: Column, court: Court = COURT) -> tuple[Column, Column]:
    """Metres, clipped to the court, to radar pixels; ties to even, y upwards."""
    ox, oy = court.origin
    cx = F.greatest(F.lit(0.0), F.least(x, F.lit(court.length_m)))
    cy = F.greatest(F.lit(0.0), F.least(y, F.lit(court.width_m)))
    return F.lit(ox) + F.rint(cx * court.px_per_m).cast("int"), F.lit(oy) + F.rint((F.lit(court.width_m) - cy) * court.px_per_m).cast("int")
