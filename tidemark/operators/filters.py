"""Predicates and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(start: Column, end: Column, lo: float, hi: float, mode: str) -> Column:
    """Time-range predicate: ``overlap`` counts touching, ``contained``, ``strict``, ``point``."""
    if mode == "overlap":
        return ~((end < lo) | (start > hi))
    if mode == "contained":
        return (start >= lo) & (end <= hi)
    if mode == "strict":
        return (start < hi) & (end > lo)
    if mode == "point":
        return start.between(lo, hi)
    raise ValueError(mode)


def confidence_band(
    df: DataFrame, *, lo: float, hi: float, classes: Sequence[str], conf: str = "conf", label: str = "label"
) -> DataFrame:
    return df.filter(F.col(conf).between(lo, hi) & F.col(label).isin(*classes))


def admit(
    df: DataFrame, *, threshold: float, wanted: Sequence[str], conf: str = "conf", label: str = "label"
) -> DataFrame:
    """Detections strictly above *threshold* in a wanted class."""
    return df.filter((F.col(conf) > threshold) & F.lower(label).isin(*[w.lower() for w in wanted]))


def strip_names(names: Column, stripped: Sequence[str]) -> Column:
    """The list without the given names."""
    return F.filter(names, lambda x: ~x.isin(*stripped))


def frame_survives(names: Column, stripped: Sequence[str]) -> Column:
    """False only when every name of the frame is stripped."""
    return ~F.forall(names, lambda x: x.isin(*stripped))


# Utterances that are interjections and nothing else.
INTERJECTIONS = ("oh", "ah", "ha", "um", "uh")
PURE_INTERJECTION = "|".join(rf"^({w}+,?\s*)+$" for w in INTERJECTIONS)


def valid_speech(text: Column) -> Column:
    """At least 2 characters, not a pure interjection, no word over 70 % of 3+ words."""
    low = F.trim(F.lower(text))
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", "")
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    # sorted once, the longest run of equal words is the highest count
    counted = F.aggregate(
        F.array_sort(words),
        F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("top")),
        lambda a, w: F.struct(
            w.alias("w"),
            F.when(a["w"] == w, a["n"] + 1).otherwise(1).alias("n"),
            F.greatest(a["top"], F.when(a["w"] == w, a["n"] + 1).otherwise(1)).alias("top"),
        ),
    )
    repetitive = (F.size(words) >= 3) & (counted["top"] / F.size(words) > 0.7)
    return (F.length(low) >= 2) & ~low.rlike(PURE_INTERJECTION) & ~repetitive


def triage(top: Column, *, sure: float = 0.1, maybe: float = 0.05) -> Column:
    """``sorted`` / ``uncertain`` / ``review`` by the best score."""
    return F.when(top >= sure, "sorted").when(top >= maybe, "uncertain").otherwise("review")
