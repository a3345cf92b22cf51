"""Toxicity severity by cumulative-link ordinal regression on sparse text features (operator 3).

Grades 0 < 1 < ... < K - 1 share one weight vector w; only the thresholds differ:
P(grade <= k) = sigmoid(threshold[k] - w . x).  The expected severity is the sum over k >= 1 of
P(grade >= k).  x marks which of the selected words (bare words, A-Z lower-cased) and four-byte
word beginnings a text holds, each once, whatever its length.

The fit uses a bounded sample of labelled rows (``sample``, 8,000 by default, those with the
smallest hashed ids) and keeps the ``features`` columns that tell most about the grade.  Grades are
the labels as they are, never made up: labels of K values give K - 1 thresholds, and labels that
only say toxic or not give one, so that the expected severity is then the probability of toxic.
Scoring is one pass over the whole texts.

Defined results: null and empty texts get the score of a text without features; the longest texts are
read whole, in pieces; rows without a label, or with a null one, are not used for the fit, and of a
labelled id with several texts the one with the smallest hash is; negative labels count as 0; with no
labelled row, or a single grade, the severity is that grade (0 with none); repeated rows give repeated
rows; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import kernels

BINS, PREFIX = 1 << 18, 4


def sparse_features(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For groups of texts: (number of texts, text number, feature number) of every occurrence."""
    for first, end, data, offsets in kernels.joined_blocks(texts):
        full, begins, _, start = kernels.hash_words(data, bare=True, prefix=PREFIX)
        doc = np.searchsorted(offsets, begins, side="right") - 1
        low = np.uint64(BINS - 1)
        yield end - first, np.concatenate((doc, doc)), np.concatenate(((full & low).astype(np.int64), (start & low).astype(np.int64) + BINS))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """A fitted cumulative-link model: feature weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, base: float = 0.0):
        self.weights, self.thresholds, self.base = weights, thresholds, base

    def at_least(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K - 1, one column each."""
        return _sigmoid(margin[:, None] - self.thresholds[None, :])

    def margins(self, texts: list[bytes]) -> np.ndarray:
        parts = []
        for n, doc, feature in sparse_features(texts):
            used = np.flatnonzero(self.weights[feature])
            pairs = np.unique(doc[used] * (2 * BINS) + feature[used])
            parts.append(np.bincount(pairs // (2 * BINS), self.weights[pairs % (2 * BINS)], minlength=n))
        return np.concatenate(parts) if parts else np.zeros(0)


def _telling(present: list[np.ndarray], toxic: np.ndarray, features: int) -> np.ndarray:
    """The features with the largest chi-square statistic against ``toxic`` (those seen twice at least)."""
    n, pos = len(present), toxic.sum()
    all_ = np.bincount(np.concatenate(present), minlength=2 * BINS).astype(float)
    inside = np.bincount(np.concatenate([p for p, t in zip(present, toxic) if t] or [np.zeros(0, np.int64)]), minlength=2 * BINS)
    expected = all_ * pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(all_ >= 2, (inside - expected) ** 2 / expected / (1 - all_ / n + 1e-9), 0)
    chi = np.nan_to_num(chi)
    best = np.argsort(-chi, kind="stable")[:features]
    return best[chi[best] > 3.8]


def fit(present: list[np.ndarray], grades: np.ndarray, features: int = 1024, ridge: float = 1e-5, rounds: int = 600) -> OrdinalModel:
    """Fits weights and thresholds by gradient steps on the ordinal likelihood (numpy, driver side)."""
    levels = int(grades.max()) if len(grades) else 0
    weights = np.zeros(2 * BINS)
    if levels == 0 or len(set(grades.tolist())) < 2:
        return OrdinalModel(weights, np.zeros(0), float(grades[0]) if len(grades) else 0.0)
    chosen = _telling(present, (grades > 0).astype(int), features)
    column = np.full(2 * BINS, -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(present), len(chosen)), np.float32)
    for row, p in enumerate(present):
        c = column[p]
        x[row, c[c >= 0]] = 1
    above = (grades[:, None] >= np.arange(1, levels + 1)[None, :]).astype(float)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    cut, w = np.log(1 / share - 1), np.zeros(len(chosen))
    m, v, step = np.zeros(len(w) + levels), np.zeros(len(w) + levels), 0.05
    for t in range(1, rounds + 1):
        upper = _sigmoid((x @ w.astype(np.float32))[:, None] - cut[None, :])  # P(grade >= k)
        full = np.concatenate((np.ones((len(x), 1)), upper, np.zeros((len(x), 1))), axis=1)
        cell = np.maximum(full[np.arange(len(x)), grades] - full[np.arange(len(x)), grades + 1], 1e-9)
        slope = upper * (1 - upper)
        push = np.zeros_like(upper)  # d log-likelihood / d margin_k
        rows = np.arange(len(x))
        low, high = grades >= 1, grades < levels
        push[rows[low], grades[low] - 1] += slope[rows[low], grades[low] - 1] / cell[low]
        push[rows[high], grades[high]] -= slope[rows[high], grades[high]] / cell[high]
        gradient = np.concatenate((-(x.T @ push.sum(1).astype(np.float32)) / len(x) + ridge * w, push.sum(0) / len(x)))
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, cut = w - move[: len(w)], np.sort(cut - move[len(w) :])
    weights[chosen] = w
    return OrdinalModel(weights, cut)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_col: str, text_col: str) -> DataFrame:
    """id, label and text of at most ``sample`` labelled rows, those with the smallest hashed ids.

    An id that stands on several documents gives one row, with the text of the smallest hash.
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
        .filter("id is not null and label is not null").distinct()
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(chosen), "id")  # bounded by ``sample`` rows of two integers
    return met.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 8000, features: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Collects the sample's feature numbers (never its texts) and fits the model."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small_batches(batches, "text"):
            out = []
            for n, doc, feature in sparse_features(kernels.text_bytes(batch.column("text"))):
                pairs = np.unique(doc * (2 * BINS) + feature)
                cut = np.searchsorted(pairs, np.arange(n + 1) * (2 * BINS))
                out += [(pairs[a:b] % (2 * BINS)).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(out, pa.binary())], ["id", "label", "held"])

    rows = map_arrow(labelled_sample(docs, labels, label, sample, id_col, text_col), run, "id long, label int, held binary").collect()
    rows.sort(key=lambda r: (r.id, r.label, r.held))
    present = [np.frombuffer(r.held, np.int32).astype(np.int64) for r in rows]
    grades = np.array([max(0, r.label) for r in rows], np.int64)
    return fit(present, grades, features)


def severities(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity, grade (the likeliest) and toxic (grade >= 1 is likelier than not)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small_batches(batches, "text"):
            margin = model.margins(kernels.text_bytes(batch.column("text")))
            if len(model.thresholds):
                upper = model.at_least(margin)
                full = np.concatenate((np.ones((len(margin), 1)), upper, np.zeros((len(margin), 1))), axis=1)
                expected, grade, toxic = upper.sum(1), np.argmax(full[:, :-1] - full[:, 1:], axis=1), upper[:, 0] >= 0.5
            else:
                expected = np.full(len(margin), model.base)
                grade, toxic = expected.astype(np.int64), expected >= 1
            columns = [batch.column("doc_id"), pa.array(expected), pa.array(grade.astype(np.int32)), pa.array(toxic)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_severity", "grade", "toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, expected_severity double, grade int, toxic boolean")
