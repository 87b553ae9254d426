"""Quality by weak supervision: rules vote or abstain, their accuracies in each class are estimated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written
from .text_stats import AT, count_rows

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Rules, one a measure: name, measure of the counts, and two bounds.  On the side of the
#: first a text is as plain prose is and the rule votes good; from the second on it has
#: that fault and the rule votes bad; in between it abstains.
RULES = [
    ("symbols", lambda c: c["n_symbols"] / c["words"], 0.02, 0.15),
    ("capitals", lambda c: c["n_upper"] / np.maximum(c["n_upper"] + c["n_lower"], 1), 0.12, 0.40),
    ("marks", lambda c: c["n_marks"] / c["words"], 0.05, 0.30),
    ("word_length", lambda c: np.abs(c["word_chars"] / c["words"] - 5.2), 1.6, 4.5),
    ("repeated_words", lambda c: c["n_repeat_words"] / c["words"], 0.05, 0.25),
    ("repeated_lines", lambda c: c["n_dup_lines"] / c["lines"], 0.05, 0.30),
    ("sameness", lambda c: 1 - np.log(np.maximum(c["n_distinct"], 1)) / np.log(c["words"] + 1), 0.12, 0.30),
    ("top_word", lambda c: c["n_top"] / c["words"], 0.12, 0.30),
    ("twins", lambda c: c["n_twins"] / c["words"], 0.05, 0.25),
    ("unended_lines", lambda c: 1 - c["n_ended"] / c["lines"], 0.30, 0.80),
]

#: Where the estimation begins: the share of good texts, and for each class the
#: probabilities of a bad vote, an abstention and a good vote.  ``STRENGTH`` is the weight of
#: this start, as a share of the texts, so that it counts alike at every size.
SHARE = 0.7
START = np.array([[0.25, 0.30, 0.45], [0.01, 0.09, 0.90]])  # bad texts, good texts
STRENGTH = 0.005
LONG = 20  # a text of fewer words gives no votes; its measures would say little


def votes(counts: np.ndarray) -> np.ndarray:
    """A row of votes for each row of counts: 1 good, -1 bad, 0 abstains."""
    c = {name: counts[:, k].astype(float) for name, k in AT.items()}
    c["words"], c["lines"] = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    out = np.zeros((len(counts), len(RULES)), np.int8)
    for k, (_, measure, good, bad) in enumerate(RULES):
        m = measure(c)
        out[:, k] = (m <= good).astype(np.int8) - (m >= bad).astype(np.int8)
    out[c["n_words"] < LONG] = 0
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    """One number for each row of votes, in base three."""
    return (v.astype(np.int64) + 1) @ 3 ** np.arange(v.shape[1], dtype=np.int64)


def unpattern(numbers: np.ndarray, rules: int) -> np.ndarray:
    return (numbers[:, None] // 3 ** np.arange(rules, dtype=np.int64) % 3 - 1).astype(np.int8)


class LabelModel:
    """Two classes; each rule votes bad, abstains or votes good with its own probabilities in each class."""

    def __init__(self, outcome: np.ndarray, share: float):
        self.outcome, self.share = outcome, share  # outcome[class, rule, vote + 1]; class 1 is good

    @property
    def accuracy(self) -> np.ndarray:
        """For each class, how often each rule is right when it votes."""
        right = np.stack([self.outcome[0, :, 0], self.outcome[1, :, 2]])
        return right / np.maximum(self.outcome[:, :, 0] + self.outcome[:, :, 2], 1e-300)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """The probability of good quality for rows of votes; the share of good texts where all abstain."""
        if not v.shape[1]:
            return np.full(len(v), self.share)
        each = np.take_along_axis(np.log(self.outcome[1] / self.outcome[0]), v.T.astype(np.int64) + 1, axis=1)
        odds = np.log(self.share / (1 - self.share)) + np.where(v.any(axis=1), each.sum(axis=0), 0.0)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_label_model(v: np.ndarray, n: np.ndarray, start: np.ndarray = START, share: float = SHARE, strength: float = STRENGTH, rounds: int = 1_000) -> LabelModel:
    """Expectation-maximisation over patterns of votes and how many rows have each.

    Both the rules' probabilities in each class and the share of good texts are
    estimated.  They begin at ``start`` and ``share`` and are drawn to them with the
    weight of ``strength`` times all rows.  Rows on which all rules abstain say
    nothing and don't count.  ``start`` may also be one accuracy for each rule, for
    both classes; how often a rule votes is then what it is over all rows.
    """
    told, n = v.any(axis=1) & (n > 0), np.asarray(n, float)
    total = n[told].sum()
    if start.ndim == 1:
        often = np.clip(n[told] @ (v[told] != 0) / max(total, 1.0), 0.01, 0.99)
        right, wrong = often * start, often * (1 - start)
        begin = np.array([[right, 1 - often, wrong], [wrong, 1 - often, right]]).transpose(0, 2, 1)
    else:
        begin = np.broadcast_to(start[:, None, :], (2, v.shape[1], 3))
    model = LabelModel(begin, share)
    v, n = v[told], n[told]
    if not len(v):
        return model
    one_hot = (v[:, :, None] == np.array([-1, 0, 1])).astype(float)
    for _ in range(rounds):
        good = model.posterior(v)
        counted = np.stack([np.einsum("p,prv->rv", n * w, one_hot) for w in (1 - good, good)]) + strength * total * begin
        outcome = counted / counted.sum(axis=2, keepdims=True)
        moved = abs(outcome - model.outcome).max()
        model = LabelModel(outcome, float((n @ good + strength * total * share) / (total * (1 + strength))))
        if moved < 1e-9:
            break
    return model


def weak_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge each whole text by rules whose accuracies are estimated from all texts.

    Returns ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, quality)``, one row per input row; ``quality`` is the posterior
    probability of good quality, and ``kept`` means that the base didn't fail and
    ``quality`` is 0.5 or more.  A null text has no words and fails the base.  Null
    and repeated ids go through; further columns are ignored.

    Rules vote good, vote bad or abstain; a single vote decides nothing.  The
    estimation sees every text that the base leaves open, as counts of vote patterns,
    of which there are at most 3 to the number of rules (59,049 rows of 24 bytes).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{b} long" for b in BASE) + ", pattern long"
    counted = written(mapped(docs, _count, schema), "votes")
    failed = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
    patterns = counted.groupBy("pattern").agg(F.count_if(~F.expr(failed)).alias("n")).orderBy("pattern").toPandas()  # at most 3**rules rows
    v = unpattern(patterns["pattern"].to_numpy(np.int64), len(RULES))
    model = fit_label_model(v, patterns["n"].to_numpy(float))
    quality = dict(zip(patterns["pattern"].tolist(), model.posterior(v).tolist(), strict=True))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, repeated = batch.column(1).to_numpy(), batch.column(5).to_numpy()
            failed = (words < 20) | (100 * repeated > 30 * words)
            q = np.array([quality[p] for p in batch.column(6).to_pylist()], float)
            columns = [*batch.columns[:6], pa.array(failed), pa.array(~failed & (q >= 0.5)), pa.array(q)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, "base_failed", "kept", "quality"])

    return mapped(counted, judge, "doc_id long, " + ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, kept boolean, quality double")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = count_rows(batch.column(1).to_pylist())
        columns = [batch.column(0), *(pa.array(counts[:, AT[b]]) for b in BASE), pa.array(pattern(votes(counts)))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, "pattern"])
