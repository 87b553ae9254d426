"""Toxicity by compression distance between two Zstandard dictionaries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written
from .labelled import calibrated, id_remainder, isotonic, training_ids

WINDOW = 40  # bytes; a window ends with the word that reaches it
TRAINED_BYTES, SHARED_BYTES = 16_000, 8_000  # of each trained dictionary; of the part that both share
SEGMENT, DMER = 24, 6  # bytes that the trainer places at a time, and by which it counts
STEP = 12  # own parts are cut to a multiple, so that both dictionaries index the shared part alike
TRAINING_ROWS, TRAINING_WINDOWS = 8_000, 500  # labelled rows; windows of one text that train, evenly spread
GRAM, SURPRISE = 5, 8.0  # bytes of a letter group; nats by which its contexts must exceed chance
EXCEEDED = 0.01  # the share of ordinary windows whose difference may pass the threshold
_MARKS = b".,!?;:\"'()|"


def windows(text: str | None) -> list[bytes]:
    """The whole text, A-Z lower-cased, in windows of whole words."""
    out, part, size = [], [], 0
    for word in (text or "").encode("utf-8", "surrogatepass").lower().split():
        part.append(word)
        size += len(word) + 1
        if size >= WINDOW:
            out.append(b" " + b" ".join(part) + b" ")
            part, size = [], 0
    if part:
        out.append(b" " + b" ".join(part) + b" ")
    return out


class ToxicityModel:
    """Two dictionaries, the threshold of a window's difference, and a calibration of texts' distances."""

    def __init__(self, ordinary: bytes, toxic: bytes, threshold: float = 0.0):
        self.contents, self.threshold = (ordinary, toxic), threshold
        self.knots, self.rates = np.empty(0), np.empty(0)
        self._compress = None

    def __getstate__(self):
        return self.__dict__ | {"_compress": None}

    def differences(self, parts: list[bytes]) -> np.ndarray:
        """For each window, its compressed length with the ordinary dictionary less that with the toxic one."""
        if self._compress is None:
            # the tables' sizes are given, or they would follow the dictionary's and change how all windows are parsed
            params = zstandard.ZstdCompressionParameters(
                window_log=16, hash_log=15, chain_log=16, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
                write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            self._compress = [
                zstandard.ZstdCompressor(
                    dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params
                ).compress
                for c in self.contents
            ]
        ordinary, toxic = self._compress
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in parts], float)

    def gains(self, text: str | None) -> np.ndarray:
        return self.differences(windows(text))

    def distance(self, text: str | None) -> float:
        """What the windows' differences exceed the threshold by, over the root of how many windows there are.

        Where none exceeds it: how far the mean of the three largest stays below, as
        a negative number; 0 for a text without windows.
        """
        found = self.gains(text)
        over = np.maximum(found - self.threshold, 0).sum()
        if over > 0 or not len(found):
            return float(over / np.sqrt(max(1, len(found))))
        return float(min(0.0, np.sort(found)[-3:].mean() - self.threshold))

    def distances(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.distance(t) for t in texts], float)

    def score_texts(self, texts: list[str | None]) -> np.ndarray:
        return calibrated(self.distances(texts), self.knots, self.rates)


def train_dictionaries(
    texts: list[str] | list[list[bytes]], y: np.ndarray, trained_bytes: int = TRAINED_BYTES, shared_bytes: int = SHARED_BYTES
) -> tuple[bytes, bytes]:
    """Dictionary contents of equal size for ordinary and for toxic text.

    A Zstandard dictionary is trained on the windows of either class.  Both hold
    much that any text has, and there compression would tell languages and subjects
    apart rather than toxic text.  So of each only the pieces are kept whose letter
    groups stand in more contexts, by the word before them, than the other class
    accounts for.  Counting contexts and not occurrences keeps copies of one text
    from counting twice.  The two own parts are cut to one size and set before the
    same end of the ordinary dictionary.
    """
    parts = [windows(t) if isinstance(t, str) else t for t in texts]
    grams, sizes, trained = [], [], []
    for label in (0, 1):
        own = [p for p, k in zip(parts, y, strict=True) if int(k) == label]
        pairs = {pair for p in own for w in p for pair in _in_context(w)}
        counted: Counter = Counter()
        for w, n in Counter(w for _, w in pairs).items():
            for g in set(_grams(w)):
                counted[g] += n
        grams.append(counted)
        sizes.append(len(pairs))
        trained.append(_trained([w for p in own for w in p], trained_bytes))
    share = sizes[1] / max(1, sum(sizes))
    ordinary = _pieces(trained[0], {g for g, n in grams[0].items() if _surprise(n, grams[1][g], 1 - share) > SURPRISE})
    toxic = _pieces(trained[1], {g for g, n in grams[1].items() if _surprise(n, grams[0][g], share) > SURPRISE})
    size, shared = len(toxic) // STEP * STEP, trained[0][-shared_bytes:]
    toxic = toxic[len(toxic) - size :]
    ordinary = ordinary[max(0, len(ordinary) - size) :]
    return ordinary.rjust(size) + shared, toxic + shared


def _in_context(window: bytes):
    words = [w.strip(_MARKS) for w in window.split()]
    return zip([b"", *words], words, strict=False)


def _pieces(content: bytes, grams: set[bytes]) -> bytes:
    """The parts of ``content`` that these letter groups cover, shortest first, none inside another."""
    inside = np.zeros(len(content) + 1, bool)
    for k in range(len(content) - GRAM + 1):
        if content[k : k + GRAM] in grams:
            inside[k : k + GRAM] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    found = sorted({content[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)}, key=lambda p: (-len(p), p))
    kept: list[bytes] = []
    for piece in found:
        if not any(piece in other for other in kept):
            kept.append(piece)
    return b"".join(reversed(kept))


def _surprise(toxic: int, ordinary: int, share: float) -> float:
    """Nats by which toxic contexts exceed chance, where ``share`` of all contexts are toxic; 0 below twice the ordinary rate.

    Both counts are weighed against the share, so it works for any mixture of labels.
    """
    if not 0 < share < 1 or toxic * (1 - share) <= 2 * ordinary * share:
        return 0.0
    n = toxic + ordinary
    return toxic * np.log(toxic / (n * share)) + (ordinary * np.log(ordinary / (n * (1 - share))) if ordinary else 0.0)


def _grams(word: bytes) -> list[bytes]:
    padded = b" " + word + b" "
    return [padded[k : k + GRAM] for k in range(len(padded) - GRAM + 1)]


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content of a Zstandard dictionary trained on ``samples``; the samples themselves where they are too few."""
    try:
        return zstandard.train_dictionary(size + 2000, samples, k=SEGMENT, d=DMER).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(sorted(set(samples)))[:size]


def _spread(text: str | None, most: int) -> list[bytes]:
    parts = windows(text)
    return parts if len(parts) <= most else [parts[k * len(parts) // most] for k in range(most)]


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: tuple[int, int] = (4, 2), rows: int = TRAINING_ROWS, most: int = TRAINING_WINDOWS
) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents.

    None is of the held-out fold.  Up to ``rows / 2`` of either label are taken: half
    of them train the dictionaries, each with at most ``most`` windows spread over its
    whole text, and half calibrate with the distances of their whole texts, where
    each label weighs as much as it has rows outside the held-out fold.  Texts of
    any length take part; equal ones count once.  Without labelled rows in both
    halves the model scores 0 throughout.
    """
    ids = F.broadcast(training_ids(labels, label, fold, rows, by_class=True))  # bounded by rows
    trained_on = labels.where(F.col(label).isin(0, 1)).where(id_remainder("doc_id", fold[0]) != fold[1])
    shares = {r[label]: r["n"] for r in trained_on.groupBy(label).agg(F.count("*").alias("n")).collect()}
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, "doc_id").where("text IS NOT NULL")
    found = written(found.select("doc_id", "y", "half", "text", F.xxhash64("text").alias("code")), "toxicity-sample")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spread = [_spread(t, most) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 4)), pa.array(spread, pa.list_(pa.binary()))], names=["doc_id", "y", "code", "windows"])

    fitting = _once(mapped(found.where("half = 0"), sampled, "doc_id long, y int, code long, windows array<binary>").toPandas())  # at most rows * most windows
    parts, y = [list(w) for w in fitting.windows], fitting.y.to_numpy()
    model = ToxicityModel(*train_dictionaries(parts, y))
    plain = model.differences([w for p, k in zip(parts, y, strict=True) if not k for w in p])
    model.threshold = float(max(1.0, np.quantile(plain, 1 - EXCEEDED))) if len(plain) else 1.0

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = model.distances(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 4)), pa.array(far, pa.float64())], names=["doc_id", "y", "code", "distance"])

    rest = _once(mapped(found.where("half = 1"), measured, "doc_id long, y int, code long, distance double").toPandas())  # a number a row
    if len(rest) and len(fitting):
        y = rest.y.to_numpy(float)
        weight = np.where(y == 1, shares.get(1, 0) / max(1, (y == 1).sum()), shares.get(0, 0) / max(1, (y == 0).sum()))
        model.knots, model.rates = isotonic(rest.distance.to_numpy(), y, weight / weight.mean())
    return model


def _once(found: pd.DataFrame) -> pd.DataFrame:
    """Rows in the order of ids, of equal texts the first."""
    return found.sort_values(["doc_id", "code"]).drop_duplicates("code")
