"""Pixel-to-court correspondences from JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 4


def parse_correspondences(df: DataFrame, json_col: str = "json") -> DataFrame:
    """``(.., name, px, py, xm, ym)`` for each named pair of a JSON object.

    Names that begin with an underscore are comments.  Pixels are cut to integers.
    """
    point = "struct<pixel:array<double>,terrain_m:array<double>>"
    pairs = F.map_filter(F.from_json(json_col, "map<string,string>"), lambda k, _: ~F.startswith(k, F.lit("_")))
    rows = df.select(*[c for c in df.columns if c != json_col], F.explode(pairs).alias("name", "body")).withColumn("p", F.from_json("body", point))
    return rows.select(
        *[c for c in df.columns if c != json_col], "name",
        F.col("p.pixel")[0].cast("int").alias("px"), F.col("p.pixel")[1].cast("int").alias("py"),
        F.col("p.terrain_m")[0].alias("xm"), F.col("p.terrain_m")[1].alias("ym"),
    )


def load_correspondences(spark: SparkSession, path: str) -> dict[str, dict]:
    """The pairs of one file, checked: an object of at least four pairs of two numbers each."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise FileNotFoundError(path)
    found = json.loads(rows[0][0])
    if not isinstance(found, dict):
        raise ValueError("the root must be an object")
    out = {}
    for name, pair in found.items():
        if name.startswith("_"):
            continue
        if not isinstance(pair, dict) or not all(isinstance(pair.get(k), list) and len(pair[k]) == 2 for k in ("pixel", "terrain_m")):
            raise ValueError(f"{name} needs pixel and terrain_m, two numbers each")
        out[name] = {"pixel": tuple(int(v) for v in pair["pixel"]), "terrain_m": tuple(float(v) for v in pair["terrain_m"])}
    if len(out) < LEAST:
        raise ValueError(f"at least {LEAST} correspondences are needed, {len(out)} were given")
    return out
