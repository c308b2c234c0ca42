"""Boxes within frames: containment, merging, tracks and their smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import centre_inside, iou


def _box() -> Column:
    return F.struct("x", "y", "w", "h")


def contained_sources(boxes: DataFrame, keys: Sequence[str], *, source: str, region: str) -> DataFrame:
    """Source boxes whose centre lies in some region box of the same frame.

    The regions of a frame travel as one array, so no pair becomes a row.
    """
    regions = (
        boxes.filter(F.col("label") == region).groupBy(*keys).agg(F.collect_list(_box()).alias("_r"))
    )
    src = boxes.filter(F.col("label") == source).join(regions, list(keys))
    return src.filter(F.exists("_r", lambda r: centre_inside(_box(), r))).drop("_r")


def best_face_per_box(people: DataFrame, faces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each person box the highest-scoring face whose centre lies inside it."""
    f = F.struct(F.col("conf").alias("s"), (-F.col("idx")).alias("i"), "x", "y", "w", "h")
    table = faces.groupBy(*keys).agg(F.collect_list(f).alias("_f"))
    inside = F.filter("_f", lambda c: centre_inside(c, _box()))
    best = F.array_max(inside)
    return (
        people.join(table, list(keys))
        .withColumn("_b", best)
        .filter("_b IS NOT NULL")
        .select(*people.columns, (-F.col("_b.i")).alias("face_idx"), F.col("_b.s").alias("face_score"))
    )


def merge_boxes(boxes: DataFrame, keys: Sequence[str], *, threshold: float = 0.5) -> DataFrame:
    """Greedy merge within a frame: the most confident unused box absorbs the unused
    boxes overlapping *it* by more than *threshold*; the result is their union box.

    A box belongs to the first seed (in confidence order) it overlaps, so one pass
    that keeps the seeds and grows the first matching seed's union is the same rule.
    """
    row = F.struct((-F.col("conf")).alias("o"), "idx", "x", "y", "w", "h", "corner")
    frames = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    group = (
        "array<struct<seed: struct<x: double, y: double, w: double, h: double>, "
        "x1: double, y1: double, x2: double, y2: double, corner: boolean, n: int>>"
    )

    def step(groups: Column, b: Column) -> Column:
        hit = F.array_position(
            F.transform(groups, lambda g: iou(g["seed"], b) > threshold), F.lit(True)
        )
        new = F.struct(
            F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h")).alias("seed"),
            b["x"].alias("x1"),
            b["y"].alias("y1"),
            (b["x"] + b["w"]).alias("x2"),
            (b["y"] + b["h"]).alias("y2"),
            b["corner"].alias("corner"),
            F.lit(1).alias("n"),
        )
        grown = F.transform(
            groups,
            lambda g, i: F.when(
                i + 1 == hit,
                F.struct(
                    g["seed"].alias("seed"),
                    F.least(g["x1"], b["x"]).alias("x1"),
                    F.least(g["y1"], b["y"]).alias("y1"),
                    F.greatest(g["x2"], b["x"] + b["w"]).alias("x2"),
                    F.greatest(g["y2"], b["y"] + b["h"]).alias("y2"),
                    (g["corner"] | b["corner"]).alias("corner"),
                    (g["n"] + 1).alias("n"),
                ),
            ).otherwise(g),
        )
        return F.when(hit > 0, grown).otherwise(F.concat(groups, F.array(new)))

    merged = F.aggregate("_all", F.array().cast(group), step)
    return frames.select(*keys, F.posexplode(merged).alias("box", "_g")).select(
        *keys, "box", "_g.x1", "_g.y1", "_g.x2", "_g.y2", "_g.corner", F.col("_g.n").alias("merged")
    )


def moving_average(points: DataFrame, keys: Sequence[str], *, order: str, columns: Sequence[str], window: int) -> DataFrame:
    """Trailing mean of tracked coordinates over the last *window* rows and this one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, 0)
    return points.select(*keys, order, *[F.avg(c).over(w).alias(c) for c in columns])


def median_smoothing(boxes: DataFrame, keys: Sequence[str], *, order: str, columns: Sequence[str], window: int = 8) -> DataFrame:
    """Trailing median of box coordinates; fewer than three boxes pass through."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    enough = F.count("*").over(w) >= 3
    return boxes.select(
        *keys,
        order,
        *[F.when(enough, F.percentile(c, F.lit(0.5)).over(w)).otherwise(F.col(c)).alias(c) for c in columns],
    )


def fill_between(anchors: DataFrame, keys: Sequence[str], *, frame: str, columns: Sequence[str]) -> DataFrame:
    """Frames between two neighbouring anchors, linearly interpolated.

    A point occluded (or missing) on one side takes the other side's value; one
    marked ``occluded`` on either side is not filled.
    """
    w = Window.partitionBy(*keys).orderBy(frame)
    x = anchors.withColumn("_n", F.lead(F.struct(frame, "occluded", *columns)).over(w))
    gaps = x.filter(
        (F.col(f"_n.{frame}") - F.col(frame) > 1) & ~F.col("occluded") & ~F.col("_n.occluded")
    ).withColumn("_f", F.explode(F.sequence(F.col(frame) + 1, F.col(f"_n.{frame}") - 1)))
    t = (F.col("_f") - F.col(frame)) / (F.col(f"_n.{frame}") - F.col(frame))
    return gaps.select(
        *keys,
        F.col("_f").alias(frame),
        *[
            F.coalesce(F.col(c) + t * (F.col(f"_n.{c}") - F.col(c)), F.col(c), F.col(f"_n.{c}")).alias(c)
            for c in columns
        ],
    )


def synchrony(tracks: DataFrame, keys: Sequence[str], *, frame: str, a: int = 0, b: int = 1, last: int = 20) -> DataFrame:
    """How alike two tracks move: mean of the clipped x and y correlations of their
    frame-to-frame steps over the last *last* shared frames; 0.5 under five frames."""
    centre = tracks.select(
        *keys, frame, "track", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy")
    )
    side = lambda t, p: F.max(F.when(F.col("track") == t, F.struct("cx", "cy"))).alias(p)
    both = (
        centre.filter(F.col("track").isin(a, b))
        .groupBy(*keys, frame)
        .agg(side(a, "_a"), side(b, "_b"))
        .filter("_a IS NOT NULL AND _b IS NOT NULL")
    )
    newest = Window.partitionBy(*keys).orderBy(F.desc(frame))
    recent = both.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= last)
    w = Window.partitionBy(*keys).orderBy(frame)
    step = lambda c: F.col(c) - F.lag(c).over(w)
    moves = recent.select(
        *keys,
        step("_a.cx").alias("ax"),
        step("_a.cy").alias("ay"),
        step("_b.cx").alias("bx"),
        step("_b.cy").alias("by"),
    )

    def clipped(a: str, b: str) -> Column:
        # no variation on one side is no correlation
        spread = F.stddev_pop(a) * F.stddev_pop(b)
        return F.greatest(F.lit(0.0), F.when(spread > 0, F.covar_pop(a, b) / spread).otherwise(0.0))

    return moves.groupBy(*keys).agg(
        F.when(F.count("*") < 5, F.lit(0.5))
        .otherwise((clipped("ax", "bx") + clipped("ay", "by")) / 2)
        .alias("synchrony")
    )
