"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams, skip-grams and stems.

Every coordinate has its own learning rate, and the L1 term keeps a weight at exactly zero
until its gradients add up to more than that term, so the model is a short list of
(position, weight) that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.features import WordGrams, fitted, held_out, labelled_features, sigmoid

BITS = 20


@dataclass(frozen=True)
class Model:
    """Positions and weights that are not zero, and the bias."""

    positions: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.positions] = self.weights
        return out


def fit(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, rounds: int = 6) -> Model:
    """FTRL-proximal over the rows in order, *rounds* times; the bias is a coordinate without the L1 term."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = np.zeros(2)

    def weights(z: np.ndarray, n: np.ndarray, bound: float) -> np.ndarray:
        return np.where(np.abs(z) <= bound, 0.0, -(z - np.sign(z) * bound) / ((beta + np.sqrt(n)) / alpha + l2))

    def moved(z: np.ndarray, n: np.ndarray, w: np.ndarray, g: float) -> tuple[np.ndarray, np.ndarray]:
        after = n + g * g
        return z + g - (np.sqrt(after) - np.sqrt(n)) / alpha * w, after

    for _ in range(rounds):
        for at, label in zip(rows, y):
            w, b = weights(z[at], n[at], l1), weights(bias[0], bias[1], 0.0)
            g = sigmoid(w.sum() + b) - label
            z[at], n[at] = moved(z[at], n[at], w, g)
            bias[:] = moved(bias[0], bias[1], b, g)
    every = weights(z, n, l1)
    kept = np.flatnonzero(every)
    return Model(kept, every[kept].astype(np.float32), float(weights(bias[0], bias[1], 0.0)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, label: str = "toxic") -> Model:
    """Fit on at most *max_rows* labelled documents (see :func:`labelled_features`)."""
    return fitted(labelled_features(docs, labels, label, lambda: WordGrams(BITS), max_rows), fit)


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """Probability of label 1 for each whole text; null counts as empty, which has the bias only."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, weights, bias = WordGrams(BITS), shared.value.dense(), shared.value.bias
        for texts in batches:
            yield pd.Series([float(sigmoid(weights[grams(t or "")].sum() + bias)) for t in texts])

    return of(text)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 12_000) -> DataFrame:
    """held_out, score and predicted for every document.

    Null ids (never held out), repeated and tied rows are scored one by one; other columns
    are not read, so their names cannot clash; an empty table gives none. Without labels
    every score is one half. Row-wise: no shuffle of texts.
    """
    model = train(docs, labels, max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(spark, model, F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
