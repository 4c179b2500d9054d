"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

A logistic fit on margins of rows that the weights did not see turns margins into probabilities: on its own rows the
regression is too sure of the larger class.

Null and empty texts score with the intercept alone. Every row is scored by itself, so ties, repeated rows and
extra columns change nothing; an empty table gives an empty result, and without labels every score is 0.5.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalcheck.llm.common import append_columns, fit_in_one_task, ftrl, held_out_column, table, training_sample

BITS = 18
SAMPLE_ROWS = 8_000
FOLDS = 3
TOKENS = re.compile(r"\w+|[^\w\s]+")


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed one- and two-word n-grams, each worth one over the root of their number."""
    words = TOKENS.findall(text or "")
    one = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    at = np.unique(np.concatenate([one * np.uint64(0x9E3779B97F4A7C15), two]) >> np.uint64(64 - BITS)).astype(np.int64)
    return at, np.full(len(at), 1 / np.sqrt(max(len(at), 1)))


def margins(features: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    return np.array([weights[at] @ x + weights[-1] for at, x in features])


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) such that the logistic of a * margin + b fits ``y``, with targets held off 0 and 1 by one row a class."""
    target = np.where(y > 0, 1 - 1 / (2 + y.sum()), 1 / (2 + (1 - y).sum()))
    points, found = np.stack([margin, np.ones(len(y))], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(points @ found, -35, 35)))
        bend = (points * (p * (1 - p))[:, None]).T @ points + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, points.T @ (p - target))
        found -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(found[0], 0.0)), float(found[1])


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "quality") -> np.ndarray:
    def learn(found, y):
        return ftrl([a for a, _ in found], [x for _, x in found], y, 1 << BITS, alpha=1.0, l1=0.02, l2=0.01)

    def fit(texts, y):
        found = [ngrams(t) for t in texts]
        weights = learn(found, y)
        fold, unseen = np.arange(len(y)) % FOLDS, np.zeros(len(y))
        for f in range(FOLDS):
            seen, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            unseen[rest] = margins([found[i] for i in rest], learn([found[i] for i in seen], y[seen]))
        slope, shift = calibrate(unseen, y)
        weights = weights * slope
        weights[-1] += shift
        return weights

    return fit_in_one_task(training_sample(docs, labels, label, 5, 0, rows), fit)


def score_quality(docs: DataFrame, weights: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    weights = weights if len(weights) else np.zeros((1 << BITS) + 1)

    def compute(texts):
        scores = []
        for text in texts:
            at, x = ngrams(text)
            margin = float(weights[at] @ x + weights[-1])
            scores.append(float(1 / (1 + np.exp(-np.clip(margin, -35, 35)))))
        return [scores]

    return append_columns(docs, ["text"], "score double", compute, keep)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    weights = fit_quality(docs, table(spark, folder, "labels"))
    return score_quality(docs, weights, ["doc_id"]).select(
        "doc_id", held_out_column(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
