"""Quality scores: random Fourier features, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import mapped, written
from .labelled import calibrated, isotonic, training_ids
from .text_stats import AT, NAMES, count_rows

FEATURES, RIDGE, SEED = 256, 1e-3, 7
TRAINING_ROWS = 40_000
TEXTS = 1_000  # mapped at a time, which bounds the feature matrices


def statistics(counts: np.ndarray) -> np.ndarray:
    """Ratios of a text's counts, none of which depends on its language or its words' meaning."""
    c = {name: counts[:, k].astype(float) for name, k in AT.items()}
    words, lines, points = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["n_chars"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, np.log1p(20 * c["n_symbols"] / words), c["n_dup_lines"] / lines,
            np.sqrt(c["n_repeat_words"] / words), np.log(np.maximum(c["n_distinct"], 1)) / np.log(words + 2), np.sqrt(c["n_top"] / words),
            c["n_upper"] / np.maximum(c["n_upper"] + c["n_lower"], 1), np.sqrt(c["n_digits"] / points),
            np.log1p(20 * c["n_marks"] / words), np.sqrt(c["n_wide"] / points), np.sqrt(c["n_twins"] / words),
            c["n_ended"] / lines, np.log(words / lines),
        ],
        axis=1,
    )


class QualityModel:
    """Standardised statistics, mapped by random cosines, times ridge weights, calibrated."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.frequencies = rng.standard_normal((len(mean), features)) / np.sqrt(len(mean) / 2)
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights, self.knots, self.rates = np.zeros(features + 1), np.empty(0), np.empty(0)

    @property
    def fitted(self) -> bool:
        """Whether labelled rows gave both weights and a calibration."""
        return bool(len(self.knots) and self.weights.any())

    def map(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        cosines = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.concatenate([cosines, np.ones((len(z), 1))], axis=1)

    def score(self, counts: np.ndarray) -> np.ndarray:
        return calibrated(self.map(statistics(counts)) @ self.weights, self.knots, self.rates)

    def score_texts(self, texts: list[str | None]) -> np.ndarray:
        parts = [self.score(count_rows(texts[at : at + TEXTS])) for at in range(0, len(texts), TEXTS)]
        return np.concatenate(parts) if parts else np.empty(0)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple[int, int] = (3, 1), rows: int = TRAINING_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled documents outside the held-out fold.

    Half of them give the normal equations, summed by partition, the other half the
    calibration.  Without any labelled row the model scores 0 throughout.
    """
    ids = F.broadcast(training_ids(labels, label, fold, rows))  # bounded by rows
    counted = docs.select("doc_id", "text").join(ids, "doc_id").select("text", "y", "half")
    sample = written(mapped(counted, _count_labelled, _stat_schema("y int, half int")), "quality-sample").coalesce(8)
    sums = [F.sum(f"s{k}").alias(f"a{k}") for k in range(_WIDTH)] + [F.sum(F.col(f"s{k}") * F.col(f"s{k}")).alias(f"b{k}") for k in range(_WIDTH)]
    row = sample.agg(F.count("*").alias("n"), *sums).first()
    n = row["n"]
    mean = np.array([row[f"a{k}"] / n if n else 0.0 for k in range(_WIDTH)])
    scale = np.sqrt(np.maximum(np.array([row[f"b{k}"] / n if n else 0.0 for k in range(_WIDTH)]) - mean**2, 0)) + 1e-3
    model = QualityModel(mean, scale)
    if not n:
        return model

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(model.weights)
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.iloc[at : at + TEXTS]
                z = model.map(part[_COLUMNS].to_numpy())
                left += z.T @ z
                right += z.T @ part["y"].to_numpy(float)
        yield pd.DataFrame({"left": [left.reshape(-1)], "right": [right]})

    fitting = sample.where("half = 0")
    parts = fitting.mapInPandas(equations, "left array<double>, right array<double>").collect()  # a row per partition, at most 8
    size = len(model.weights)
    left = sum(np.array(p["left"]).reshape(size, size) for p in parts)
    right = sum(np.array(p["right"]) for p in parts)
    model.weights = np.linalg.solve(left + RIDGE * max(n, 1) / 2 * np.eye(size), right)
    rest = sample.where("half = 1").toPandas()  # bounded by rows
    if len(rest):
        model.knots, model.rates = isotonic(model.map(rest[_COLUMNS].to_numpy()) @ model.weights, rest["y"].to_numpy(float))
    return model


def score_documents(docs: DataFrame, model, column: str = "score") -> DataFrame:
    """Add ``column``, the model's score of each whole text; the other columns stay as they are.

    A null text is an empty one.  ``docs`` may have any columns but one named
    ``column``, which is replaced.
    """
    docs = docs.drop(column)
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    names = [*docs.columns, column]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score_texts(batch.column(at).cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return mapped(docs.toDF(*(f"_{k}" for k in range(len(docs.columns)))), score, schema)  # names may hold dots


_WIDTH = statistics(np.zeros((1, len(NAMES)))).shape[1]
_COLUMNS = [f"s{k}" for k in range(_WIDTH)]


def _stat_schema(more: str) -> str:
    return ", ".join(f"{c} double" for c in _COLUMNS) + ", " + more


def _count_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = statistics(count_rows(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(stats[:, k]) for k in range(_WIDTH)), batch.column(1), batch.column(2)], names=[*_COLUMNS, "y", "half"]
        )
