"""Hooks for a caller's own models. The models themselves are not part of this."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def detect_faces(
    frames: DataFrame,
    ident: str,
    detect: Callable[[pd.DataFrame], np.ndarray],
    *,
    limit: int = 4,
    minimum: float = 0.6,
) -> DataFrame:
    """Run *detect* over Arrow batches of frames and keep the best faces of each.

    *detect* gets a batch and returns a score per frame and candidate (2-D). At most
    *limit* faces a frame are kept: that is the detector's own rule.
    """
    kind = frames.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = np.asarray(detect(pdf), dtype=float)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :limit]
            best = np.take_along_axis(scores, order, axis=1)
            row, col = np.nonzero(best >= minimum)
            yield pd.DataFrame(
                {ident: pdf[ident].to_numpy()[row], "face": order[row, col].astype("int32"), "det": best[row, col]}
            )

    return frames.mapInPandas(run, f"{ident} {kind}, face INT, det DOUBLE")


def classify(
    crops: DataFrame, ident: list[str], classify_fn: Callable[[pd.DataFrame], np.ndarray], *, out: str = "probs"
) -> DataFrame:
    """Run *classify_fn* over Arrow batches; adds its probability vector per row."""
    kept = ", ".join(f"{c} {crops.schema[c].dataType.simpleString()}" for c in ident)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            probs = np.asarray(classify_fn(pdf), dtype=float)
            yield pdf[ident].assign(**{out: list(probs)})

    return crops.mapInPandas(run, f"{kept}, {out} ARRAY<DOUBLE>")
