"""Vector and box arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """L2-normalised, safe on zero vectors."""
    return F.transform(F.array(F.struct(a.alias("v"), F.greatest(norm(a), F.lit(1e-12)).alias("n"))), lambda p: F.transform(p["v"], lambda x: x / p["n"]))[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def softmax(scores: Column) -> Column:
    """Stable softmax of an array."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["w"]) * F.greatest(F.lit(0.0), b["h"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes with x, y, w, h."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    inter = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def centre_inside(source: Column, region: Column) -> Column:
    cx, cy = source["x"] + source["w"] / 2, source["y"] + source["h"] / 2
    return (
        (cx >= region["x"])
        & (cx <= region["x"] + region["w"])
        & (cy >= region["y"])
        & (cy <= region["y"] + region["h"])
    )
