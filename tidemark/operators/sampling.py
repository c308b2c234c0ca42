"""Sampling, class weights and splits of labelled examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def strided_sample(
    frames: DataFrame, keys: Sequence[str], *, order: str, length: int, low: int = 3, high: int = 8
) -> DataFrame:
    """The first *length* frames at a stride of ``n // (2 * length)`` held in [low, high]."""
    w = Window.partitionBy(*keys)
    i = F.row_number().over(w.orderBy(order)) - 1
    stride = F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.count("*").over(w) / (length * 2))))
    return (
        frames.withColumn("_i", i)
        .withColumn("_s", stride)
        .filter((F.col("_i") % F.col("_s") == 0) & (F.col("_i") < F.col("_s") * length))
        .drop("_i", "_s")
    )


def even_sample(frames: DataFrame, keys: Sequence[str], *, order: str, length: int) -> DataFrame:
    """*length* positions evenly spread from the first frame to the last, truncated to frames."""
    w = Window.partitionBy(*keys)
    i = F.row_number().over(w.orderBy(order)) - 1
    x = frames.withColumn("_i", i).withColumn("_n", F.count("*").over(w))
    # a frame is taken for each of the positions k * (n - 1) / (length - 1) it holds
    step = (F.col("_n") - 1) / F.lit(max(length - 1, 1))
    spots = F.filter(
        F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.floor(k * step) == F.col("_i")
    )
    return x.withColumn("position", F.explode(spots)).drop("_i", "_n")


def class_weights(examples: DataFrame, *, label: str = "label") -> DataFrame:
    """Inverse-frequency weights: total / (classes * count)."""
    n = examples.groupBy(label).agg(F.count("*").alias("count"))
    whole = n.agg(F.sum("count").alias("_total"), F.count("*").alias("_classes"))
    return (
        n.crossJoin(F.broadcast(whole))  # one row
        .withColumn("weight", F.col("_total") / (F.col("_classes") * F.col("count")))
        .drop("_total", "_classes")
    )


def resplit(
    examples: DataFrame,
    *,
    label: str,
    ident: str,
    is_val: str,
    min_train: int = 5,
    min_val: int = 2,
    min_ratio: float = 0.2,
    max_ratio: float = 0.3,
    seed: int = 42,
) -> DataFrame:
    """Labels with enough training examples, re-split where validation is too thin.

    A thin label's examples are ranked by a seeded digest and the first
    ``ceil(ratio * n)`` become validation. The rank is exact without ordering a
    whole label in one task: counts per digest slice give the offset, and only a
    slice is ordered.
    """
    counts = examples.groupBy(label).agg(
        F.count("*").alias("_n"), F.count(F.when(F.col(is_val), 1)).alias("_v")
    )
    train = F.col("_n") - F.col("_v")
    thin = (F.col("_v") < min_val) | (F.col("_v") / F.col("_n") < min_ratio)
    ratio = F.least(F.greatest(F.lit(float(min_val)) / F.col("_n"), F.lit(min_ratio)), F.lit(max_ratio))
    plan = (
        counts.filter((train >= min_train) & (~thin | (F.col("_n") >= min_train + min_val)))
        .withColumn("_take", F.when(thin, F.ceil(F.round(ratio * F.col("_n"), 9))))
        .select(label, "_take")
    )
    h = F.xxhash64(F.col(ident), F.lit(seed))
    x = examples.withColumn("_h", h).withColumn("_slice", F.shiftrightunsigned(F.col("_h"), 52).cast("int"))
    slices = x.groupBy(label, "_slice").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(label).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = slices.select(label, "_slice", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(label, "_slice").orderBy("_h", ident)
    ranked = (
        x.withColumn("_r", F.row_number().over(inner))
        .join(offset, [label, "_slice"])
        .join(plan, label)
    )
    val = F.when(F.col("_take").isNotNull(), F.col("_before") + F.col("_r") <= F.col("_take")).otherwise(F.col(is_val))
    return ranked.withColumn(is_val, val).select(*examples.columns)


def pruned_classes(accuracy: DataFrame, *, label: str = "label", minimum: float = 0.3) -> DataFrame:
    """Classes that reach a validation accuracy, re-indexed without gaps.

    One row per class, so the global order is over the class list.
    """
    kept = accuracy.filter(F.col("accuracy") >= minimum)
    return kept.withColumn("new_index", F.row_number().over(Window.orderBy(label)) - 1)
