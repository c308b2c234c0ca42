"""Loud stretches: candidates above a threshold and their grouping into events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.islands import point_islands


def runs_above(
    curve: DataFrame,
    keys: Sequence[str],
    *,
    value: str,
    threshold: float,
    min_duration: float = 1.0,
    tick: str = "sec",
    extra: dict[str, tuple[str, str | Column]] | None = None,
) -> DataFrame:
    """Unbroken runs of ticks whose *value* exceeds *threshold*.

    ``end`` is exclusive, ``peak_sec`` is the first tick of the maximum.
    """
    hot = curve.filter(F.col(value) > threshold)
    best = F.struct(F.col(value).alias("v"), (-F.col(tick)).alias("neg"))
    runs = point_islands(
        hot, keys, tick, 1, aggs={"_best": ("max", best), "seconds": ("count", tick), **(extra or {})}
    )
    return (
        runs.withColumn("end", F.col("end") + 1)
        .withColumn("peak_sec", -F.col("_best.neg"))
        .withColumn("z", F.col("_best.v"))
        .filter(F.col("end") - F.col("start") >= min_duration)
        .drop("_best")
    )


def group_events(
    runs: DataFrame,
    keys: Sequence[str],
    *,
    total: str,
    edge_guard: float = 120.0,
    merge_gap: float = 30.0,
) -> DataFrame:
    """Drop runs peaking near an edge, merge when the next peak is close.

    The test compares a run's *peak* with the furthest end so far. A run never
    ends before its peak, so a broken chain always has a larger end than
    anything before it and the running maximum over all earlier runs equals the
    current event's end. Runs are already one row per stretch of the axis.
    """
    inside = runs.filter(
        (F.col("peak_sec") >= edge_guard) & (F.col("peak_sec") <= F.col(total) - edge_guard)
    )
    w = Window.partitionBy(*keys).orderBy("start")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("peak_sec") - reach > merge_gap), 1).otherwise(0)
    numbered = inside.withColumn("_fresh", fresh).withColumn(
        "_event", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    loudest = F.struct(F.col("z"), (-F.col("start")).alias("s"))
    return (
        numbered.groupBy(*keys, "_event")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.max_by("peak_sec", loudest).alias("peak_sec"),
            F.max("z").alias("z"),
            F.count("*").alias("runs"),
        )
        .drop("_event")
    )
