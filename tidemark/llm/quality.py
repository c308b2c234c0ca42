"""Quality classifier: Naive Bayes support vectors.

Indicators of word and shape n-grams are scaled by the log ratio of their smoothed counts
in the two classes; a linear model with hinge loss is fitted to them by dual coordinate
descent. Margins become probabilities by a logistic curve fitted to margins of rows that
the model in question did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.features import StyleGrams, fitted, held_out, labelled_features, sigmoid

BITS = 18


@dataclass(frozen=True)
class Model:
    """One weight per feature (the log-count ratio times the margin's weight), and the curve."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(size, smooth), np.full(size, smooth)]
    for row, label in zip(rows, y):
        counts[int(label)][row] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    return ratios.astype(np.float32)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model; *y* is 0 or 1.

    One dual variable per row, kept between 0 and the row's cost (classes weighed alike)
    and moved to its optimum in turn, in a fixed random order.
    """
    sign = np.where(y == 1, 1.0, -1.0)
    upper = cost * np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    square = np.array([v @ v + 1 for v in values])
    alpha, weights, bias = np.zeros(len(y)), np.zeros(size), 0.0
    rng = np.random.default_rng(1)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            gradient = sign[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]) / upper[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def _linear(rows: list[np.ndarray], y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    ratios = log_count_ratios(rows, y, size)
    values = [ratios[r] / max(1e-9, np.sqrt(ratios[r] @ ratios[r])) for r in rows]
    weights, bias = dual_coordinate_descent(rows, values, y, size)
    return np.stack([weights, ratios]), bias


def _margin(weights: np.ndarray, bias: float, row: np.ndarray) -> float:
    """Each row's scaled indicators have length 1, as in fitting."""
    ratios = weights[1][row]
    norm = float(np.sqrt(ratios @ ratios))
    return float(weights[0][row] @ ratios) / max(1e-9, norm) + bias


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, by Newton steps."""
    slope, shift = 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = sigmoid(slope * margins + shift)
        g = np.array([(p - target) @ margins + 1e-3 * slope, (p - target).sum()])
        w = p * (1 - p) + 1e-9
        hessian = np.array([[w @ margins**2 + 1e-3, w @ margins], [w @ margins, w.sum() + 1e-6]])
        step = np.linalg.solve(hessian, g)
        slope, shift = slope - np.clip(step[0], -2, 2), shift - np.clip(step[1], -2, 2)
    return float(slope), float(shift)


def fit(rows: list[np.ndarray], y: np.ndarray, size: int, folds: int = 3) -> Model:
    """A model of labelled feature rows. With one class only, its smoothed share is the score."""
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros((2, size), np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    margins = np.zeros(len(y))
    for k in range(folds):
        seen = [i for i in range(len(y)) if i % folds != k]
        weights, bias = _linear([rows[i] for i in seen], y[seen], size)
        for i in range(k, len(y), folds):
            margins[i] = _margin(weights, bias, rows[i])
    weights, bias = _linear(rows, y, size)
    return Model(weights.astype(np.float32), bias, *_curve(margins, y))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, label: str = "quality") -> Model:
    """Fit on at most *max_rows* labelled documents (see :func:`labelled_features`)."""
    sample = labelled_features(docs, labels, label, lambda: StyleGrams(BITS), max_rows)
    return fitted(sample, lambda rows, y: fit(rows, y, StyleGrams(BITS).size))


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """Probability of label 1 for each whole text; null counts as empty, which has no features."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, m = StyleGrams(BITS), shared.value
        for texts in batches:
            yield pd.Series([float(sigmoid(m.slope * _margin(m.weights, m.bias, grams(t or "")) + m.shift)) for t in texts])

    return of(text)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 6000) -> DataFrame:
    """held_out, score and predicted for every document.

    Null ids (never held out), repeated and tied rows are scored one by one; other columns
    are not read, so their names cannot clash; an empty table gives none. Without labels
    every score is one half. Row-wise: no shuffle of texts; the broadcast weights have a
    fixed size.
    """
    model = train(docs, labels, max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(spark, model, F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
